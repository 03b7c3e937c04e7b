"""Queries over large text tables, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.llm import abuse, leak, linkage, lookalike, mix, names, segment, sentences
from docgrain.plans.packed_queries import author_values
from docgrain.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "parsed_reference")
    records = read(spark, sf_dir, "crossref_record").select(F.col("record_id").alias("id"), F.col("crossref_title").alias("value"))
    titles = refs.select(F.col("ref_id").alias("id"), F.col("parsed_title").alias("value"))
    raw = refs.select(F.col("ref_id").alias("id"), F.col("raw_text").alias("value"))
    return (
        lookalike.lookalike_pairs(titles, records)
        .select(F.lit("title").alias("pair_field"), "id_a", "id_b")
        .unionByName(lookalike.lookalike_pairs(raw, raw).select(F.lit("raw_text").alias("pair_field"), "id_a", "id_b"))
    )


@query
def p4_canonical_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parsed title with its canonical form over the titles of both tables."""
    refs = read(spark, sf_dir, "parsed_reference").select("ref_id", F.col("parsed_title").alias("title"))
    records = read(spark, sf_dir, "crossref_record").select(F.col("record_id").alias("ref_id"), F.col("crossref_title").alias("title"))
    return lookalike.canonicalize(refs.unionByName(records), "title", "canonical_title")


SENTENCE_TABLES = (("claim", "claim_id"), ("rq_claim_annotations", "case_id"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [read(spark, sf_dir, table).select(F.lit(table).alias("source_table"), F.col(key).alias("id"), "sentence") for table, key in SENTENCE_TABLES]
    weights = sentences.train(texts[0].unionByName(texts[1]), "sentence")
    found = [sentences.split_sentences(t, "id", "sentence", weights).select(F.lit(name).alias("source_table"), "row_id", "unit_no", "start_char", "n_chars") for t, (name, _) in zip(texts, SENTENCE_TABLES, strict=True)]
    return found[0].unionByName(found[1])


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak.leaked(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "claimguard_benchmark"), "case_id", ["claim", "evidence"])
    return found.select(F.col("item").alias("case_id"), F.col("doc").alias("doc_id"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_oversized(read(spark, sf_dir, "documents"), "doc_id", "text", with_text=False).where("piece_no = 1").select("doc_id")


@query
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_oversized(read(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = abuse.score_documents(read(spark, sf_dir, "documents"), "doc_id", "text")
    return scored.where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


@query
def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, worst sentence and nearest example of every document."""
    return abuse.score_documents(read(spark, sf_dir, "documents"), "doc_id", "text", carry=("source",))


@query
def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, abusive documents and their rate per source."""
    return abuse.rates(abuse.score_documents(read(spark, sf_dir, "documents"), "doc_id", "text", carry=("source",)), "source")


def vocabulary_path() -> str | None:
    """The default rank file, if it is here."""
    return mix.VOCABULARY if Path(mix.VOCABULARY).exists() else None


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, mix.Plan]]:
    targets = mix.read_targets(read(spark, sf_dir, "mix_target"), "doc_source", "target_share", "max_repeats")
    return mix.mix(read(spark, sf_dir, "documents"), "doc_id", "text", "source", targets)


@query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeat counts."""
    return _mix(spark, sf_dir)[0]


@query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the share reached beside the target."""
    return mix.shares(*_mix(spark, sf_dir))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "parsed_reference").select(F.explode("authors").alias("name"))
    return listed.unionByName(author_values(spark, sf_dir).select(F.col("value_text").alias("name")))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(names.entities(_spellings(spark, sf_dir), "name"))


@query
def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the key of its person or organisation."""
    return names.entities(_spellings(spark, sf_dir), "name")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(read(spark, sf_dir, "parsed_reference"), read(spark, sf_dir, "crossref_record")).select("ref_id", "record_id").distinct()


@query
def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs with their confidence."""
    return linkage.link(read(spark, sf_dir, "parsed_reference"), read(spark, sf_dir, "crossref_record"))
