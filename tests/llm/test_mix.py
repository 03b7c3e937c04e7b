from __future__ import annotations

import pytest

from docgrain.llm import mix
from docgrain.llm.queries import vocabulary_path

VOCABULARY = vocabulary_path()
pytestmark = pytest.mark.skipif(not VOCABULARY, reason="no vocabulary here")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (5 + i % 17), "abc"[i % 3] if i % 50 else "rare") for i in range(3000)] + [(9001, None, "a"), (9002, "x", None), (9003, "x", "other")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumnRenamed("doc_id", "key").selectExpr("key", "text", "source", "'z' AS h")


def test_budgets_are_met_or_reported(docs):
    targets = {"a": (0.5, 2), "b": (0.1, 1), "c": (0.3, 1), "rare": (0.08, 2), "none": (0.02, 3)}
    chosen, plans = mix.mix(docs, "key", "text", "source", targets, vocabulary=VOCABULARY)
    report = {r.doc_source: r for r in mix.shares(chosen, plans).collect()}
    assert set(report) == set(targets)
    for s in ("a", "b"):
        assert abs(report[s].chosen_tokens - plans[s].budget) <= 25
    assert report["c"].chosen_tokens <= plans["c"].tokens and report["none"].chosen_tokens == 0
    assert report["rare"].most_repeats <= 2 and report["a"].most_repeats <= 2
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)
    assert not {r.doc_id for r in chosen.collect()} & {9001, 9002, 9003}


def test_smaller_budgets_are_nested(docs):
    targets = {"a": (1.0, 1)}
    sets = [{r.doc_id for r in mix.mix(docs, "key", "text", "source", targets, total_tokens=n, vocabulary=VOCABULARY)[0].collect()} for n in (500, 2000, 5000)]
    assert sets[0] < sets[1] < sets[2]


def test_choice_does_not_depend_on_partitions(docs):
    one, two = (sorted((r.doc_id, r.repeats) for r in mix.mix(d, "key", "text", "source", {"a": (0.3, 1), "b": (0.2, 1)}, 4000, VOCABULARY)[0].collect()) for d in (docs, docs.repartition(9)))
    assert one == two


def test_tokens_are_counted_whole(docs, spark):
    text = "Größe 中文 don't\n\n  x" * 3000
    row = mix.count_tokens(spark.createDataFrame([(1, text, "a")], "k bigint, t string, s string"), "k", "t", "s", VOCABULARY).first()
    e = mix.encoding(VOCABULARY)
    assert row.n_tokens == len(e.encode_ordinary(text)) and e.decode(e.encode_ordinary(text)) == text


def test_empty_and_wrong_targets(docs, spark):
    chosen, plans = mix.mix(docs.limit(0), "key", "text", "source", {"a": (1.0, 1)}, vocabulary=VOCABULARY)
    assert chosen.count() == 0 and mix.shares(chosen, plans).first().reached_share == 0
    twice = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1)], "s string, p double, m int")
    with pytest.raises(ValueError):
        mix.read_targets(twice, "s", "p", "m")
