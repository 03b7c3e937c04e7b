"""Sinks: claim tables, JSON and Markdown reports, a resumable ledger, removal of account fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrain.operators import tables

# Keys that identify an account and never leave in a report.
ACCOUNT_KEYS = ("account_id", "organization", "org_id", "project_id", "request_id", "user_id")


def joined(values: Column) -> Column:
    """List values as one text with "; ", null and empty ones left out."""
    return F.array_join(F.filter(values.cast("array<string>"), lambda v: v.isNotNull() & (v != "")), "; ")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; list columns are joined, other nested columns written as JSON."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            columns.append(joined(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            columns.append(F.to_json(f.name).alias(f.name))
        else:
            columns.append(F.col(f.name))
    df.select(*columns).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def without_accounts(df: DataFrame, keys: Sequence[str] = ACCOUNT_KEYS) -> DataFrame:
    """``df`` without columns and struct fields of the given names, at any depth of structs and arrays of structs."""

    def cleaned(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [cleaned(column[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in keys]
            return F.when(column.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(column, lambda x: cleaned(x, kind.elementType))
        return column

    return df.select(*[cleaned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in keys])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls kept, account fields removed."""
    without_accounts(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, order: str, limit: int = 1000) -> DataFrame:
    """One row with a Markdown table of at most ``limit`` rows in the order of a column: for summaries, not for data."""
    names = df.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[|\n]", " "), F.lit("")) for c in names]), F.lit(" |"))
    top = df.orderBy(order).limit(limit).select(F.col(order).alias("o"), line.alias("line"))
    head = "| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda s: s["line"]), "\n")
    return top.agg(F.concat(F.lit(head), body).alias("markdown"))


def document_review(claims: DataFrame, document: str) -> DataFrame:
    """One Markdown line block per document: counts and the first ten sentences without a citation, which alone are collected."""
    each = claims.groupBy(document).agg(F.count("*").alias("n"), F.count_if("missing_citation").alias("m"))
    first = tables.top_k(claims.where("missing_citation"), [document], [F.col("claim_id")], 10, "place").select(document, F.struct("place", F.concat(F.lit("- "), F.left("sentence", F.lit(160))).alias("l")).alias("s"))
    shown = first.groupBy(document).agg(F.array_sort(F.collect_list("s")).alias("s"))
    joined = each.join(shown.withColumnRenamed(document, "__document"), F.col(document).eqNullSafe(F.col("__document")), "left")
    lines = F.coalesce(F.array_join(F.transform("s", lambda x: x["l"]), "\n"), F.lit(""))
    return joined.select(document, F.concat(F.lit("## "), F.col(document), F.lit("\n"), F.col("n"), F.lit(" sentences, "), F.col("m"), F.lit(" without a citation\n"), lines).alias("markdown"))


def append_ledger(done: DataFrame, path: str, key: str) -> None:
    """Adds finished cases to a Parquet ledger; cases already there are not written again."""
    spark = done.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        done = done.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    done.write.mode("append").parquet(path)
