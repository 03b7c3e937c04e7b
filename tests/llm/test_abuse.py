from __future__ import annotations

import numpy as np
import pytest

from docgrain.llm import abuse as a
from docgrain.llm.tokens import words


@pytest.fixture(scope="module")
def own():
    index = a.index(tuple(a.default_examples()))
    index.weigh(np.full(len(index.terms), 3), 1000)
    return index


def score(own, text):
    return a.score_texts(own, [text])[0][0]


@pytest.mark.parametrize("text", ["You are a worthless idiot!", "All results hold. Kill yourself, loser. We add more.", "You are a w0rthless 1diot, you m*ron", "Du bist ein elender Vollidiot.", "Foreigners are vermin and should be thrown out.", "S h u t up, you stuuuuupid b.a.s.t.a.r.d"])
def test_abuse_is_found(own, text):
    assert score(own, text) >= a.THRESHOLD


@pytest.mark.parametrize("text", ["", "N.", "The word idiot is listed as offensive in the lexicon.", "The argument is weak and the plots are ugly.", "We kill the child process after ten minutes.", "Sex and age were recorded with consent.", "The loss falls after 3 epochs. " * 2000])
def test_harmless_texts_are_not(own, text):
    assert score(own, text) < a.THRESHOLD


def test_disguises(own):
    assert a.undisguised("stttttupid m*r*n b.a.s.t.a.r.d r@t$ a-n-a-l", own.hidden) == "stupid moron bastard rats anal"
    assert a.undisguised("macro-F1 of v1.96 e.g. i.e. 3*4", own.hidden) == "macro-F1 of v1.96 e.g. i.e. 3*4"


def test_blocks_give_the_exact_cosines(own):
    texts = ["You are a moron. The loss falls. Why do we hire refugees?", "I will smash your teeth in today, you clown", "nothing here", "Send me nude pics tonight"]
    w = words(texts)
    sentence = a.sentences("\n".join(texts), w)
    got = {int(s): row for ids, score in own.cosines(*own.queries(w, sentence)) for s, row in zip(ids, score, strict=True)}
    full = np.zeros((len(own.texts), len(own.terms)))
    full[own.row, own.term] = own.weight[own.term]
    full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)
    s, t, v = own.queries(w, sentence)
    for k in range(int(sentence[-1]) + 1):
        q = np.zeros(len(own.terms))
        q[t[s == k]] = v[s == k]
        exact = full @ q
        if exact[own.labels == 1].max() >= a.LEAST:
            seen = got[k]
            # what a block bound skipped lies under the least useful cosine
            assert np.allclose(np.where(seen > 0, seen, 0), np.where(seen > 0, exact, 0), atol=1e-5)
            assert np.all((seen > 0) | (exact < a.LEAST + 1e-6))
        else:
            assert k not in got


def test_examples_are_classified_without_their_group(own):
    """No sentence of the same pattern helps."""
    full = np.zeros((len(own.texts), len(own.terms)), np.float32)
    full[own.row, own.term] = own.weight[own.term]
    full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)
    s = full @ full.T
    s[own.groups[:, None] == own.groups[None, :]] = 0
    x, _ = own.votes(s)
    p = np.where(x[:, 1] >= a.LEAST, 1 / (1 + np.exp(-x @ own.curve)), 0)
    said, y = p >= a.THRESHOLD, own.labels == 1
    print("held out by pattern: recall", (said & y).sum() / y.sum(), "precision", (said & y).sum() / said.sum())
    assert (said & y).sum() / y.sum() > 0.8 and (said & y).sum() / said.sum() > 0.9


def test_a_callers_labels(spark):
    rows = [("the blue fish is bad", 1, "x"), ("blue fish are bad", 1, "y"), ("the red fish is good", 0, "z"), ("the red fish is good", 0, "z"), (None, 1, "x"), ("no label", None, "q")]
    given = a.read_examples(spark.createDataFrame(rows, "s string, y int, g string"), "s", "y", "g")
    assert sorted(t for t, _, _ in given) == ["blue fish are bad", "the blue fish is bad", "the red fish is good"]
    df = spark.createDataFrame([(1, "We saw it. The blue fish is so bad."), (2, "The red fish is good."), (3, "You worthless idiot!")], "d bigint, t string")
    got = {r.doc_id: r.score for r in a.score_documents(df, "d", "t", examples=given).collect()}
    assert got[1] > 0 == got[3] and got[2] < 0.7
    assert len(a.read_examples(spark.createDataFrame(rows, "s string, y int, g string"), "s", "y", most=2)) == 2


def test_operator(spark):
    rows = [(1, "Fine text. You are a stupid moron!", "s"), (1, "Fine text. You are a stupid moron!", "s"), (2, "Fine text.", "s"), (3, None, None), (4, "", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumnRenamed("doc_id", "key").selectExpr("*", "'c' AS score")
    got = a.score_documents(df, "key", "text", carry=("source",))
    found = {r.doc_id: r for r in got.collect()}
    assert got.count() == 5 and found[1].score > 0.5 > found[2].score and found[3].score is None and found[4].score == 0
    assert "moron" in found[1].evidence and found[1].nearest
    shares = {r.source: (r.documents, r.abusive) for r in a.rates(got, "source").collect()}
    assert shares == {"s": (3, 2), None: (1, 0), "t": (1, 0)}
    assert a.score_documents(df.limit(0), "key", "text").count() == 0
