"""Order-dependent and relational helpers: top-k, keep-first, arg-max, carried values, islands, crossovers, samples.

Ties are broken by the given position, nulls sort last unless said, repeated rows are kept where positions differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank. Spark prunes each partition to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, by: Sequence[str], position: str, last: bool = False) -> DataFrame:
    """One whole row per group: the one with the smallest (``last``: largest) position. A combinable aggregate."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in by]
    kept = df.groupBy(*by).agg(pick(F.struct(*rest), F.col(position)).alias("__row"))
    return kept.select(*by, "__row.*").select(*df.columns)


def carry_forward(df: DataFrame, by: Sequence[str], position: str, value: str, default: str) -> DataFrame:
    """``value`` with nulls replaced by the last one before in the group, or the default."""
    before = W.partitionBy(*by).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(default)))


def carry_blocks(df: DataFrame, by: str, position: str, block: Column, value: Column, out: str) -> DataFrame:
    """``out``: the last value that is not null at or before each row of its group. Rows are sorted only within blocks
    (``block`` rises with ``position``), and every block's last value is carried over the few rows of a group's blocks, so a
    group of any size is spread over many tasks."""
    keys = ["__group", "__block"]
    cut = df.withColumns({"__group": F.coalesce(F.concat(F.lit("g"), F.col(by).cast("string")), F.lit("")), "__block": F.coalesce(block.cast("bigint"), F.lit(-(2**62))), "__value": value})
    before = W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    ends = cut.where("__value is not null").groupBy(*keys).agg(F.max_by("__value", F.col(position)).alias("__end"))
    ends = cut.select(*keys).distinct().join(ends, keys, "left")
    earlier = W.partitionBy("__group").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, F.last("__end", ignorenulls=True).over(earlier).alias("__end"))
    carried = cut.withColumn("__own", F.last("__value", ignorenulls=True).over(before)).join(ends, keys)
    return carried.withColumn(out, F.coalesce("__own", "__end")).drop(*keys, "__value", "__own", "__end")


def inherit(df: DataFrame, by: Sequence[str], position: str, own: Column, may_inherit: Column, value: str) -> DataFrame:
    """``inherited``: the value of the row that starts a row's island. A row starts an island when it has its own value
    or may not inherit; the others pass on what the island began with, however long the chain."""
    ordered = W.partitionBy(*by).orderBy(position)
    start = F.coalesce(own, F.lit(False)) | ~F.coalesce(may_inherit, F.lit(False))
    numbered = df.withColumn("__island", F.sum(start.cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*by, "__island").orderBy(position)
    return numbered.withColumn("inherited", F.first(value).over(inside)).drop("__island")


def matched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The inner join that leaves no row of ``left`` without a match: one without raises when it is read."""
    there = right.withColumn("__there", F.lit(True))
    lost = F.raise_error(F.concat(F.lit(f"no match for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast("boolean")
    return left.join(there, on, "left").where(F.coalesce("__there", lost)).drop("__there")


def pending(cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cases not in the ledger: resume after an interruption."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def balanced_sample(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows per label chosen by the hash of key and seed: the same rows in any order and partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return top_k(df.withColumn("__h", h), [label], [F.col("__h"), F.col(key)], n, "__n").drop("__h", "__n")


def first_crossover(df: DataFrame, x: str, better: Column, by: Sequence[str] = ()) -> DataFrame:
    """The smallest x at which the condition holds, null if never."""
    return df.groupBy(*by).agg(F.min(F.when(better, F.col(x))).alias("first_x"))


def peak_and_drop(df: DataFrame, by: Sequence[str], x: str, y: str, drop: float) -> DataFrame:
    """Per group the first x of the highest y, and the first later x whose y lies more than ``drop`` below."""
    peak = df.groupBy(*by).agg(F.max_by(F.struct(F.col(x).alias("peak_x"), F.col(y).alias("peak_y")), F.struct(F.col(y), -F.col(x))).alias("p")).select(*by, "p.*")
    later = df.join(peak, list(by)).where((F.col(x) > F.col("peak_x")) & (F.col(y) < F.col("peak_y") - drop)).groupBy(*by).agg(F.min(x).alias("drop_x"))
    return peak.join(later, list(by), "left")


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str, relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """Equal on ``on`` and a close to b: |a - b| <= absolute + relative * |b|."""
    return left.join(right, list(on)).where(F.abs(F.col(a) - F.col(b)) <= absolute + relative * F.abs(F.col(b)))
