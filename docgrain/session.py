"""Session helpers shared by operators and tests."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docgrain")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="docgrain-"))


#: Whether the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives executor loss. The shuffle
    files of the write are deleted, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


@contextlib.contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is written within is broadcast only where a shuffle has measured its size. Sizes that Spark infers take a compressed
    file for its rows and a row that is exploded for a single one, so a table many times the threshold would go to the driver."""
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(k, None) for k in keys]
    spark.conf.set(keys[1], before[1] or spark.conf.get(keys[0]))
    spark.conf.set(keys[0], "-1")
    try:
        yield
    finally:
        for key, value in zip(keys, before, strict=True):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def discard(df: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str, wide: bool = False) -> DataFrame:
    """One of the driver's tables; ``wide`` spreads it over all cores for costly work a row."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if wide else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the cluster has cores, where its files gave fewer: for costly work a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
