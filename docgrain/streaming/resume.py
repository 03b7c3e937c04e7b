"""Resumable processing of a directory of cases, in micro-batches: what was done is never done again.

The batch form is an anti join with the ledger; the streaming form reads new files once, keeps its place in a checkpoint
folder and appends each micro-batch to the ledger, so that a restart goes on where it ended. A case delivered twice is
done once: the batch is reduced to one row per key and joined against the ledger before it is processed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docgrain.sources.sinks import append_ledger


def process_available(spark: SparkSession, source: str, schema: StructType, key: str, work: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that applies ``work`` to all cases of the Parquet folder not yet in the ledger, then ends."""

    def batch(df: DataFrame, _: int) -> None:
        append_ledger(work(df.dropDuplicates([key])), ledger, key)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
