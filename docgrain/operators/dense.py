"""Exact dense retrieval: query blocks against blocks of all vectors.

Vectors and queries are packed into rows of at most BLOCK vectors each, within their partitions; every block of queries meets
every block of vectors in one product, each product keeps the best k per query, and the survivors meet in one ranking. Nothing
comes to the driver, and no pair of vectors is a row of its own beyond the survivors. Null or wrong-sized vectors (of another
size than most) are left out; ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.operators import tables

BLOCK = 2048


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the right size as rows, and which rows they are."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0))
    good = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(good), size), good


def inner(a: Column, b: Column) -> Column:
    """Inner product of two vectors, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _packed(df: DataFrame, key: str, column: str, prefix: str) -> DataFrame:
    """(ids, values): rows of at most BLOCK vectors of one size, flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                sizes = np.array(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
                for size in np.unique(sizes[sizes > 0]).tolist():
                    v, good = _matrix(batch.column(1), size)
                    ids = batch.column(0).take(pa.array(good))
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([v.ravel()], pa.list_(pa.float64()))], names=[f"{prefix}_size", f"{prefix}_ids", f"{prefix}_values"])

    narrow = df.select(F.col(key).cast("bigint"), column).where(F.col(key).isNotNull() & F.col(column).isNotNull())
    return narrow.mapInArrow(run, f"{prefix}_size int, {prefix}_ids array<bigint>, {prefix}_values array<double>")


def top_matches(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(query_id, match_id, score, rank): the k best inner products of each query with the other vectors of its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, own = (np.asarray(batch.column(c)[row].values) for c in (1, 4))
                q, v = (np.asarray(batch.column(c)[row].values).reshape(len(ids), -1) for c, ids in ((2, q_ids), (5, own)))
                s = q @ v.T
                s[q_ids[:, None] == own[None, :]] = -np.inf
                n = min(k, s.shape[1])
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :n]
                value = np.take_along_axis(s, order, 1).ravel()
                keep = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)[keep]), pa.array(own[order].ravel()[keep]), pa.array(value[keep])], names=["query_id", "match_id", "score"])

    # blocks of a stated query set against blocks of all rows
    met = _packed(queries, key, column, "q").crossJoin(_packed(vectors, key, column, "v")).where("q_size = v_size")
    found = met.select("q_size", "q_ids", "q_values", "v_size", "v_ids", "v_values").mapInArrow(run, "query_id bigint, match_id bigint, score double")
    return tables.top_k(found, ["query_id"], [F.desc("score"), F.col("match_id")], k)
