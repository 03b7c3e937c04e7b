"""Mixing sources to target weights by token counts of a public tokenizer.

Tokens are counted once and written beside a hash of the row. A histogram of tokens by source and hash bucket, whose
size does not depend on the data, gives each source's budget and, by running sums in the cluster, the bucket in which it is used
up (one row a source comes to the driver); only that boundary bucket is split again by further hash bits, until it holds one hash. A source's threshold is a hash, so choosing is a
filter: nothing is sorted, and the choice with a smaller budget is part of the choice with a larger one.

The total is ``total_tokens``, by default all tokens of the targeted sources. A source takes its share of the total, at
most ``max_repeats`` times its tokens: every document floor(budget / tokens) times, and once more those whose hash lies
under the threshold. A source that cannot fill its share (too small, or without documents) gives all it may, and
the others keep their budgets; the report shows share of the total and share reached of what was chosen.

Defined results: documents with a null source, or one without a target, are not chosen; null text counts no tokens and
is never chosen by itself; rows repeated whole share a hash and are chosen together; a target repeated for one source is
an error; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrain.session import materialize, spread

#: A rank file of byte-level BPE; a path that every executor can read.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bits of the hash, and bits a histogram resolves.
BITS, STEP = 60, 12
MOST_SOURCES = 5_000


@functools.cache
def encoding(path: str):  # noqa: ANN201
    import tiktoken  # only where tokens are counted

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, key: str, column: str, source: str, vocabulary: str = VOCABULARY, seed: int = 42) -> DataFrame:
    """(doc_id, source, h, n_tokens): h is a hash of the row's id and text, of BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["doc_id", "source", "h", "n_tokens"])

    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(column)), 64 - BITS)
    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), h.alias("h"), F.col(column).cast("string").alias("t"))
    return spread(narrow).mapInArrow(run, "doc_id bigint, source string, h bigint, n_tokens bigint")


@dataclass
class Plan:
    """What one source gives: every document ``whole`` times, and once more those with a hash under ``below``."""

    share: float
    most: int
    tokens: int = 0
    budget: float = 0.0
    whole: int = 0
    below: int = 0


def _histogram(tokens: DataFrame, shift: int, within: DataFrame | None = None) -> DataFrame:
    """(source, bucket, n, spread): tokens, and hashes beyond the first, of each bucket; ``within``: (source, low, high)."""
    if within is not None:
        tokens = tokens.join(F.broadcast(within), "source").where("h >= low and h < high")  # one row a source
    return tokens.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), (F.max("h") - F.min("h")).alias("spread"))


def _boundaries(histogram: DataFrame, rest: dict[str, float]) -> dict[str, Row]:
    """Per source the bucket in which ``rest`` tokens are used up: bucket, n, spread and the tokens before it; of a source whose
    buckets all fit the one after the last, with n 0."""
    wanted = histogram.sparkSession.createDataFrame(list(rest.items()), "source string, rest double")
    upto = W.partitionBy("source").orderBy("bucket")  # a source has at most 2 ** STEP buckets
    summed = histogram.join(F.broadcast(wanted), "source").withColumn("upto", F.sum("n").over(upto))
    over = F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "n", "spread", (F.col("upto") - F.col("n")).alias("before")))
    rows = summed.groupBy("source").agg(F.min(over).alias("b"), F.max("bucket").alias("last"), F.sum("n").alias("all")).collect()
    return {r.source: r.b or Row(bucket=r["last"] + 1, n=0, spread=0, before=r["all"]) for r in rows}


def plan(tokens: DataFrame, targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, Plan]:
    """A plan for each source. Histograms stay in the cluster; one row a source comes to the driver."""
    plans = {s: Plan(share, most) for s, (share, most) in targets.items()}
    shift = BITS - STEP
    found = materialize(_histogram(tokens, shift), "mix-histogram")
    for r in found.groupBy("source").agg(F.sum("n").alias("n")).collect():
        plans[r.source].tokens = r.n
    total = sum(p.tokens for p in plans.values()) if total_tokens is None else total_tokens
    rest: dict[str, float] = {}
    for s, p in plans.items():
        p.budget = min(p.share * total, p.most * p.tokens)
        p.whole = int(p.budget // p.tokens) if p.tokens else 0
        if p.whole < p.most and p.tokens:
            rest[s] = p.budget - p.whole * p.tokens
    while rest:
        again: list[tuple[str, int, int]] = []
        for s, at in _boundaries(found, rest).items():
            rest[s] -= at.before
            plans[s].below = at.bucket << shift
            if at.n and (at.spread == 0 or shift == 0):
                if at.n - rest[s] < rest[s]:  # one hash is left: with it when that comes nearer
                    plans[s].below = (at.bucket + 1) << shift
            elif at.n:
                again.append((s, at.bucket << shift, (at.bucket + 1) << shift))
        rest = {s: rest[s] for s, _, _ in again}
        if again:
            shift = max(0, shift - STEP)
            found = _histogram(tokens, shift, tokens.sparkSession.createDataFrame(again, "source string, low bigint, high bigint"))
    return plans


def read_targets(targets: DataFrame, source: str, share: str, most: str) -> dict[str, tuple[float, int]]:
    rows = targets.select(source, share, most).where(F.col(source).isNotNull()).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a source has two targets")
    return {r[0]: (float(r[1] or 0), max(0, int(r[2] or 0))) for r in rows}


def mix(docs: DataFrame, key: str, column: str, source: str, targets: dict[str, tuple[float, int]], total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 42) -> tuple[DataFrame, dict[str, Plan]]:
    """The chosen documents (doc_id, source, n_tokens, repeats), and the plan of each source."""
    wanted = docs.where(F.col(source).isin(list(targets)))
    tokens = materialize(count_tokens(wanted, key, column, source, vocabulary, seed), "mix-tokens")
    plans = plan(tokens, targets, total_tokens)
    rows = [(s, p.whole, p.below) for s, p in plans.items()]
    known = docs.sparkSession.createDataFrame(rows, "source string, whole int, below bigint")  # at most MOST_SOURCES rows
    repeats = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    chosen = tokens.join(F.broadcast(known), "source").select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats"))
    return chosen.where("repeats > 0 and n_tokens > 0"), plans


def shares(chosen: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """Per source the target beside what was reached: one row for every target, also without documents."""
    spark = chosen.sparkSession
    total = sum(p.tokens for p in plans.values())
    rows = [(s, p.share, p.most, p.tokens, float(p.budget)) for s, p in plans.items()]
    wanted = spark.createDataFrame(rows, "doc_source string, target_share double, max_repeats int, available_tokens bigint, budget_tokens double")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most_used"))
    joined = wanted.join(used, F.col("doc_source") == F.col("source"), "left")
    whole = used.agg(F.sum("n").alias("whole"))
    return joined.crossJoin(F.broadcast(whole)).select(  # one row
        "doc_source", "target_share", "max_repeats", "available_tokens", "budget_tokens",
        F.coalesce("n", F.lit(0)).alias("chosen_tokens"),
        F.coalesce("uses", F.lit(0)).alias("chosen_documents"),
        F.coalesce("most_used", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("n") / F.col("whole"), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.col("n") / F.lit(float(max(1, total))), F.lit(0.0)).alias("share_of_total"),
    )
