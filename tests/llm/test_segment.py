from __future__ import annotations

import random

import pytest

from docgrain.llm import segment as g

SEA = "the ship sailed on the wide sea with a sailor and a sail in the wind"
LAB = "the model learned weights from data with a gradient and a loss on the graph"


def make(seed, sentences):
    rnd = random.Random(seed)
    out = []
    for k in range(sentences):
        words = (SEA if k < sentences // 2 else LAB).split()
        out.append(" ".join(rnd.sample(words, 10)).capitalize() + ".")
    return " ".join(out)


def spans(text, limit=1800, overlap=150):
    return [(s, n) for _, _, s, n in g.split([text], limit, overlap)]


def check(text, limit=1800, overlap=150):
    found = spans(text, limit, overlap)
    assert found[0][0] == 0 and sum(found[-1]) == len(text) and all(n <= limit for _, n in found)
    for (a, n), (b, _) in zip(found, found[1:], strict=False):
        assert 0 <= a + n - b <= overlap and b > a
    return found


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cover_in_order_with_overlap(seed):
    text = make(seed, 120)
    found = check(text)
    for (a, n), (b, _) in zip(found, found[1:], strict=False):
        assert text[a + n - 2] == "." and text[b - 1] == " " and a + n - b > 130


@pytest.mark.parametrize("seed", range(5))
def test_the_topic_change_is_cut(seed):
    text = make(seed, 40)
    change = sum(len(p) + 2 for p in text.split(". ")[:20])
    cut = spans(text, len(text) * 3 // 4)[0][1]
    assert abs(cut - change) <= 70


def test_texts_without_boundaries():
    assert [n for _, n in check("x" * 4000)] == [1800, 1800, 700]
    check("字" * 5000)
    check(("word " * 1500).strip())
    check("结果令人惊讶。" * 900)
    check(" " * 4000)


def test_long_text_is_linear_and_short_ones_give_nothing():
    assert spans("a" * 1800) == [] and spans("") == []
    check(make(3, 9000))


def test_operator(spark):
    long = make(2, 60)
    df = spark.createDataFrame([(1, long, 9), (1, long, 9), (2, None, 9), (3, "short", 9)], "id bigint, t string, piece_no int")
    got = g.split_oversized(df, "id", "t").collect()
    assert {r.doc_id for r in got} == {1} and len(got) == 2 * len(spans(long))
    assert all(r.piece == long[r.start_char : r.start_char + r.n_chars] for r in got)
    assert g.split_oversized(df.limit(0), "id", "t").count() == 0
    with pytest.raises(ValueError):
        g.split_oversized(df, "id", "t", 100, 80)
