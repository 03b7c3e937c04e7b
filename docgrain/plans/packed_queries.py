"""Queries over packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.operators.packed import split_packed
from docgrain.session import read

FIELDS = (
    ("raw_reference", "reference_parsing_benchmark", "case_id", "entries"),
    ("expected_authors", "reference_parsing_benchmark", "case_id", "names"),
    ("raw_text", "citation", "citation_id", "citations"),
)


def author_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of expected_authors, as p5_found has them."""
    return split_packed(read(spark, sf_dir, "reference_parsing_benchmark"), "case_id", "expected_authors", "names")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, table, key, kind in FIELDS:
        rows = read(spark, sf_dir, table).select(key, name)
        if table == "citation":
            rows = rows.dropDuplicates()  # some rows are delivered twice
        parts.append(split_packed(rows, key, name, kind).select(F.lit(name).alias("field_name"), "row_id", "value_pos", "value_text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {"p5_found": p5_found}
