"""All queries of the core and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgrain.plans import bibliography_queries, claim_queries, document_queries, evaluation_queries, packed_queries, report_queries, text_queries

FLAGSHIP = "lexical_verdicts"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _module in (evaluation_queries, text_queries, claim_queries, bibliography_queries, document_queries, report_queries, packed_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(getattr(_module, "ORACLE", {}))
