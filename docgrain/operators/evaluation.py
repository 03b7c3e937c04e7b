"""Evaluation algebra: confusion counts, precision, recall and F1 in the variants the reports need, ranking metrics,
agreement and leaderboards. Every operator takes a frame with one row per case and groups by the columns in ``by``.

Nulls: a null expected or predicted label is a label of its own in counts, and never equals another. Empty input gives
empty output (or one row of zeros where there is no ``by``). All are combinable aggregates: partial sums before shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrain.functions.numbers import harmonic, ratio, round_half_up

def hit() -> Column:
    return F.col("expected") == F.col("predicted")


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, expected, predicted, cnt)."""
    return df.groupBy(*by, "expected", "predicted").agg(F.count("*").alias("cnt"))


def confusion_wide(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per expected label, one column per predicted label of the fixed list."""
    counts = [F.count_if(F.col("predicted") == label).alias(f"n_{label}") for label in labels]
    return df.groupBy("expected").agg(*counts)


def per_label(df: DataFrame, by: Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """tp, fp, fn, support, predicted_count, precision, recall and f1 per label; ``rounded``: F1 from rounded values.

    One pass: every case counts once for its expected and once for its predicted label.
    """
    sides = df.select(*by, F.explode(F.array(
        F.struct(F.col("expected").alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p"), hit().cast("int").alias("h")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("h")),
    )).alias("s")).select(*by, "s.*").where("label is not null")
    counts = sides.groupBy(*by, "label").agg(F.sum("e").alias("support"), F.sum("p").alias("predicted_count"), F.coalesce(F.sum("h"), F.lit(0)).alias("tp"))
    digits = 3 if rounded else None
    p, r = ratio(F.col("tp"), F.col("predicted_count"), digits), ratio(F.col("tp"), F.col("support"), digits)
    return counts.select(
        *by, "label", "tp", (F.col("predicted_count") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support", "predicted_count",
        round_half_up(p).alias("precision"), round_half_up(r).alias("recall"), harmonic(p, r).alias("f1"),
    )


def macro(df: DataFrame, by: Sequence[str] = (), labels: Sequence[str] | None = None, rounded: bool = True) -> DataFrame:
    """Unweighted means over labels: those with support, or exactly the given ones (absent ones count 0)."""
    each = per_label(df, by, rounded)
    each = each.where("support > 0") if labels is None else each.where(F.col("label").isin(list(labels)))
    n = F.count("*").cast("double") if labels is None else F.lit(float(len(labels)))
    mean = lambda c: round_half_up(F.coalesce(F.sum(c), F.lit(0.0)) / F.greatest(F.lit(1.0), n)).alias(f"macro_{c}")
    return each.groupBy(*by).agg(mean("precision"), mean("recall"), mean("f1"))


def micro(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pooled precision, recall and F1: false positives need a predicted, false negatives an expected label of the list."""
    own = list(labels)
    e, p = F.col("expected").isin(own), F.col("predicted").isin(own)
    counts = df.groupBy(*by).agg(F.count_if(hit() & e).alias("tp"), F.count_if(p & ~F.coalesce(hit(), F.lit(False))).alias("fp"), F.count_if(e & ~F.coalesce(hit(), F.lit(False))).alias("fn"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(*by, "tp", "fp", "fn", pr.alias("micro_precision"), rc.alias("micro_recall"), harmonic(pr, rc).alias("micro_f1"))


def binary(df: DataFrame, positive: Column, claimed: Column, by: Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """n, accuracy, precision, recall, f1, tp, tn, fp, fn of two boolean columns; null counts as false."""
    yes, said = F.coalesce(positive, F.lit(False)), F.coalesce(claimed, F.lit(False))
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn")
    )
    digits = 3 if rounded else None
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), digits), ratio(F.col("tp"), F.col("tp") + F.col("fn"), digits)
    return counts.select(*by, "n", ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), round_half_up(p).alias("precision"), round_half_up(r).alias("recall"), harmonic(p, r).alias("f1"), "tp", "tn", "fp", "fn")


def auroc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties half; null where a class is missing.

    Scores are counted first, so the ranking runs over distinct scores: two aggregations and a window over counts,
    not the product of both classes.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~positive).cast("double").alias("q"))
    below = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("under", F.coalesce(F.sum("q").over(below), F.lit(0.0)))
    total = ranked.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("under") + F.col("q") / 2)).alias("wins"))
    pairs = F.col("positives") * F.col("negatives")
    return total.select(*by, F.col("positives").cast("bigint").alias("positives"), F.col("negatives").cast("bigint").alias("negatives"), F.when(pairs > 0, round_half_up(F.col("wins") / pairs)).alias("auroc"))


def leaderboard(df: DataFrame, tool: str = "tool") -> DataFrame:
    """coverage, accuracy, macro and micro F1 over available predictions per tool, and the rank (macro, coverage, name).

    Rows without a prediction have predicted 'missing' and count for the coverage alone. Macro is the mean over all labels that are
    expected of any tool; micro pools their counts."""
    available = F.col("predicted") != "missing"
    base = df.groupBy(tool).agg(F.count("*").alias("cases"), F.count_if(available).alias("available"), F.count_if(available & hit()).alias("correct"))
    expected = df.select(F.col("expected").alias("label")).where("label is not null").distinct()
    scored = per_label(df.where(available), [tool]).join(expected, "label", "left_semi")
    sums = scored.groupBy(tool).agg(F.sum("f1").alias("f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    labels = expected.agg(F.count("*").alias("labels"))
    joined = base.join(sums, tool, "left").crossJoin(F.broadcast(labels))  # one row
    none = F.lit(0)
    tp, fp, fn = (F.coalesce(c, none) for c in ("tp", "fp", "fn"))
    out = joined.select(
        tool, "cases", ratio(F.col("available"), F.col("cases")).alias("coverage"), ratio(F.col("correct"), F.col("available")).alias("accuracy"),
        round_half_up(F.coalesce("f1", F.lit(0.0)) / F.greatest(F.lit(1), "labels")).alias("macro_f1"), harmonic(ratio(tp, tp + fp), ratio(tp, tp + fn)).alias("micro_f1"),
    )
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("macro_f1"), F.desc("coverage"), tool)))


def pairwise_agreement(df: DataFrame, case: str = "case_id", tool: str = "tool") -> DataFrame:
    """(tool_a, tool_b, shared, agreement) for every pair of tools, 0 where they share no case. Counted per case, so
    the pairs formed are those of tools, never of cases."""
    tools = df.select(tool).distinct()
    pairs = tools.select(F.col(tool).alias("tool_a")).join(tools.select(F.col(tool).alias("tool_b")), F.col("tool_a") < F.col("tool_b"))
    a, b = df.select(case, F.col(tool).alias("tool_a"), F.col("predicted").alias("x")), df.select(case, F.col(tool).alias("tool_b"), F.col("predicted").alias("y"))
    shared = a.join(b, case).where("tool_a < tool_b").groupBy("tool_a", "tool_b").agg(F.count("*").alias("shared"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    return pairs.join(shared, ["tool_a", "tool_b"], "left").select("tool_a", "tool_b", F.coalesce("shared", F.lit(0)).alias("shared"), ratio(F.coalesce("same", F.lit(0)), F.coalesce("shared", F.lit(0))).alias("agreement"))


def agreement_class(df: DataFrame, case: str = "case_id") -> DataFrame:
    """agreement when all tools gave a verdict and they are equal, disagreement when two or more differ, else incomplete."""
    valid = F.when(F.col("predicted") != "missing", F.col("predicted"))
    each = df.groupBy(case).agg(F.count("*").alias("tools"), F.count(valid).alias("valid"), F.count_distinct(valid).alias("distinct_labels"))
    return each.select(case, "tools", "valid", F.when((F.col("valid") == F.col("tools")) & (F.col("distinct_labels") == 1), "agreement").when((F.col("valid") >= 2) & (F.col("distinct_labels") > 1), "disagreement").otherwise("incomplete").alias("agreement"))


def typical_failure(df: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """The most frequent wrong (expected, predicted) per group; of equal ones the first seen by ``position``."""
    wrong = df.where(~hit()).groupBy(*by, "expected", "predicted").agg(F.count("*").alias("cnt"), F.min(position).alias("first_seen"))
    best = wrong.groupBy(*by).agg(F.max_by(F.struct("expected", "predicted", "cnt"), F.struct("cnt", -F.col("first_seen"))).alias("b"))
    return best.select(*by, "b.expected", "b.predicted", "b.cnt")


def majority_label(df: DataFrame, label: str, position: str) -> DataFrame:
    """The most frequent label, of equal ones the first seen."""
    counts = df.groupBy(label).agg(F.count("*").alias("cnt"), F.min(position).alias("first_seen"))
    return counts.agg(F.max_by(label, F.struct("cnt", -F.col("first_seen"))).alias("majority"), F.max("cnt").alias("cnt"))


def hit_rate_and_mrr(ranked: DataFrame, queries: DataFrame, query: str, rank: str, hit: str, ks: Sequence[int]) -> DataFrame:
    """Share of queries with a hit among the first k for every k, and mean reciprocal rank cut at the last k."""
    first = ranked.where(hit).groupBy(query).agg(F.min(rank).alias("first_hit"))
    each = queries.select(query).distinct().join(first, query, "left")
    rates = [ratio(F.count_if(F.col("first_hit") <= k), F.count("*")).alias(f"recall_at_{k}") for k in ks]
    reciprocal = F.when(F.col("first_hit") <= ks[-1], 1.0 / F.col("first_hit")).otherwise(0.0)
    return each.agg(F.count("*").alias("queries"), *rates, round_half_up(F.avg(reciprocal)).alias("mrr"))
