from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docgrain.operators import evaluation as ev
from docgrain.operators import tables


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, "b", "a"), (5, "c", "a"), (6, None, "a"), (7, "a", None)]
    return spark.createDataFrame(rows, "case_id int, expected string, predicted string")


def test_binary_metrics_and_auroc(spark):
    rows = [("ai", "ai", 0.9), ("ai", "human", 0.4), ("human", "human", 0.2), ("human", "ai", 0.6)]
    df = spark.createDataFrame(rows, "expected string, predicted string, score double")
    m = ev.binary(df, F.col("expected") == "ai", F.col("predicted") == "ai").first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5, 0.5)
    assert ev.auroc(df, "score", F.col("expected") == "ai").first().auroc == 0.75
    assert ev.auroc(df.where("expected = 'ai'"), "score", F.col("expected") == "ai").first().auroc is None


def test_auroc_with_ties_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), rnd.randrange(6) / 5) for _ in range(200)]
    wins = [(x > y) + 0.5 * (x == y) for p, x in rows if p for q, y in rows if not q]
    got = ev.auroc(spark.createDataFrame(rows, "y int, s double"), "s", F.col("y") == 1).first().auroc
    assert got == pytest.approx(sum(wins) / len(wins), abs=6e-4)


def test_per_label_counts(cases):
    got = {r.label: (r.tp, r.fp, r.fn, r.support) for r in ev.per_label(cases).collect()}
    assert got == {"a": (1, 3, 2, 3), "b": (1, 1, 1, 2), "c": (0, 0, 1, 1)}


def test_perfect_rows(spark):
    df = spark.createDataFrame([("x", "x"), ("y", "y"), ("z", "z")], "expected string, predicted string")
    assert ev.macro(df).first().macro_f1 == 1.0
    assert ev.macro(df, labels=("x", "y", "z", "w")).first().macro_f1 == 0.75
    assert ev.micro(df, ["x", "y"]).first().micro_f1 == 1.0


def test_empty_input(cases):
    none = cases.limit(0)
    assert ev.confusion(none).count() == 0
    assert ev.binary(none, F.col("expected") == "a", F.col("predicted") == "a").first().n == 0
    assert ev.per_label(none).count() == 0


def test_tool_comparison_and_agreement(spark):
    rows = [(c, t, "a", p) for c, t, p in [(1, "x", "a"), (1, "y", "a"), (2, "x", "a"), (2, "y", "b"), (3, "x", "a"), (3, "y", "missing")]]
    df = spark.createDataFrame(rows, "case_id int, tool string, expected string, predicted string")
    board = {r.tool: r for r in ev.leaderboard(df).collect()}
    assert board["x"].accuracy == 1.0 and board["x"].place == 1 and board["y"].coverage == 0.667
    assert {r.case_id: r.agreement for r in ev.agreement_class(df).collect()} == {1: "agreement", 2: "disagreement", 3: "incomplete"}
    pair = ev.pairwise_agreement(df.where("predicted != 'missing'")).first()
    assert (pair.shared, pair.agreement) == (2, 0.5)


def test_agreement_of_tools_without_a_shared_case(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "a")], "case_id int, tool string, predicted string")
    assert [(r.shared, r.agreement) for r in ev.pairwise_agreement(df).collect()] == [(0, 0.0)]


def test_typical_failure_prefers_the_first_of_equal_ones(spark):
    df = spark.createDataFrame([(1, "a", "c"), (2, "a", "b"), (3, "a", "b"), (4, "a", "c")], "case_id int, expected string, predicted string")
    assert ev.typical_failure(df.withColumn("g", F.lit(1)), ["g"], "case_id").first().predicted == "c"


def test_recall_and_mrr_are_cut_at_the_last_k(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 8, True)], "q int, rank int, hit boolean")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    r = ev.hit_rate_and_mrr(ranked, queries, "q", "rank", F.col("hit"), (1, 5)).first()
    assert (r.recall_at_1, r.recall_at_5, r.mrr) == (0.0, 0.333, 0.167)


def test_inheritance_is_chained_and_sections_carried(spark):
    rows = [(1, 1, "intro", True, False), (1, 2, None, False, True), (1, 3, None, False, True), (1, 4, "method", False, False), (2, 1, None, False, True)]
    df = spark.createDataFrame(rows, "d int, i int, s string, own boolean, may boolean")
    got = {(r.d, r.i): r.inherited for r in tables.inherit(df, ["d"], "i", F.col("own"), F.col("may"), "own").collect()}
    assert got == {(1, 1): True, (1, 2): True, (1, 3): True, (1, 4): False, (2, 1): False}
    carried = {(r.d, r.i): r.s for r in tables.carry_forward(df, ["d"], "i", "s", "unknown").collect()}
    assert carried == {(1, 1): "intro", (1, 2): "intro", (1, 3): "intro", (1, 4): "method", (2, 1): "unknown"}


def test_sample_is_balanced_and_repeatable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("l"))
    a = tables.balanced_sample(df, "l", "id", 5, 1).collect()
    b = tables.balanced_sample(df.repartition(7), "l", "id", 5, 1).collect()
    assert sorted(a) == sorted(b) and len(a) == 15


def test_keep_first_and_last_and_pending(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "k string, p int, v string")
    assert sorted(tables.keep_first(df, ["k"], "p").collect()) == [("a", 1, "x"), ("b", 5, None)]
    assert sorted(r.v or "" for r in tables.keep_first(df, ["k"], "p", last=True).collect()) == ["", "y"]
    assert [r.k for r in tables.pending(df.select("k").distinct(), df.where("k = 'a'"), "k").collect()] == ["b"]


def test_states_carried_in_blocks_equal_those_of_whole_groups(spark):
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "d string, i int, v string").withColumn("place", F.struct("i"))
    for size in (1, 7, 1000):
        got = {r.i: r.o for r in tables.carry_blocks(df, "d", "place", F.floor(F.col("i") / size), F.col("v"), "o").collect()}
        last: dict = {}
        want = {}
        for d, i, v in rows:
            last[d] = v or last.get(d)
            want[i] = last[d]
        assert got == want
    assert tables.carry_blocks(df.limit(0), "d", "place", F.col("i"), F.col("v"), "o").count() == 0


def test_leaderboard_counts_absent_labels_and_available_rows(spark):
    rows = [(1, "x", "a", "a"), (2, "x", "b", "missing"), (1, "y", "a", "b"), (2, "y", "b", "b"), (3, "y", "c", "c"), (1, "z", "a", "missing")]
    board = {r.tool: (r.accuracy, r.macro_f1, r.micro_f1) for r in ev.leaderboard(spark.createDataFrame(rows, "case_id int, tool string, expected string, predicted string")).collect()}
    assert board == {"x": (1.0, 0.333, 1.0), "y": (0.667, 0.556, 0.667), "z": (0.0, 0.0, 0.0)}


def test_written_tables_are_read_back_and_deleted(spark):
    from pathlib import Path

    from docgrain.session import discard, materialize

    kept, gone = materialize(spark.range(5), "kept"), materialize(spark.range(3), "gone")
    discard(gone)
    assert kept.count() == 5 and not Path(gone._written_to).exists()
    discard(kept)
