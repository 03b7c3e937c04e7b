"""Report queries: label lookups, answer matching, joined reports, selections; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.functions.numbers import r3, ratio, round_half_up
from docgrain.operators import evaluation as ev
from docgrain.operators import tables
from docgrain.plans.claim_queries import _CARRIED, _RERANK, classified, reranked
from docgrain.plans.evaluation_queries import _EXP, TOOLS, _div, experiments, tools
from docgrain.plans.text_queries import _STYLE, style_scores_of
from docgrain.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


# Status, its label and what to do.
STATUSES = (
    ("supported", "supported by evidence", "spot-check"), ("partially_supported", "partly supported", "sharpen wording or evidence"), ("not_supported", "not supported", "check the source"),
    ("contradicted", "in conflict with evidence", "check the source"), ("insufficient_evidence", "too little evidence", "add evidence"),
)
_STATUS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in STATUSES) + ") s(status, meaning, advice)"


@query(f"SELECT b.case_id, b.expected_label AS status, coalesce(s.meaning, 'unknown') AS meaning, coalesce(s.advice, 'review') AS advice FROM claimguard_benchmark b LEFT JOIN {_STATUS_SQL} ON s.status = b.expected_label")
def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status to label and advice by a fixed table of five rows, with a default."""
    lookup = spark.createDataFrame(STATUSES, "status string, meaning string, advice string")
    b = read(spark, sf_dir, "claimguard_benchmark").select("case_id", F.col("expected_label").alias("status"))
    return b.join(F.broadcast(lookup), "status", "left").select("case_id", "status", F.coalesce("meaning", F.lit("unknown")).alias("meaning"), F.coalesce("advice", F.lit("review")).alias("advice"))


@query("SELECT case_id, CASE upper(replace(trim(expected_label), '_', ' ')) WHEN 'SUPPORTED' THEN 'SUPPORT' WHEN 'PARTIALLY SUPPORTED' THEN 'SUPPORT' WHEN 'CONTRADICTED' THEN 'CONTRADICT' WHEN 'NOT SUPPORTED' THEN 'NOT_ENOUGH_INFO' WHEN 'INSUFFICIENT EVIDENCE' THEN 'NOT_ENOUGH_INFO' END AS label FROM claimguard_benchmark")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five labels folded into three."""
    u = F.upper(F.replace(F.trim("expected_label"), F.lit("_"), F.lit(" ")))
    label = F.when(u.isin("SUPPORTED", "PARTIALLY SUPPORTED"), "SUPPORT").when(u == "CONTRADICTED", "CONTRADICT").when(u.isin("NOT SUPPORTED", "INSUFFICIENT EVIDENCE"), "NOT_ENOUGH_INFO")
    return read(spark, sf_dir, "claimguard_benchmark").select("case_id", label.alias("label"))


@query(f"SELECT claim_id, CASE WHEN p >= 0.6e0 THEN 'likely_ai' ELSE 'likely_human' END AS label, {r3('abs(p - 0.6e0) / greatest(0.6e0, 1e0 - 0.6e0)')} AS confidence FROM (SELECT claim_id, coalesce(classification_confidence, 0e0) AS p FROM claim)")
def probability_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability against a threshold, with the distance as confidence."""
    p, limit = F.coalesce("classification_confidence", F.lit(0.0)), 0.6
    return read(spark, sf_dir, "claim").select("claim_id", F.when(p >= limit, "likely_ai").otherwise("likely_human").alias("label"), round_half_up(F.abs(p - limit) / max(limit, 1 - limit)).alias("confidence"))


@query("SELECT record_id, CASE WHEN crossref_score >= 0.75e0 THEN 'strong' WHEN crossref_title IS NOT NULL THEN 'weak' ELSE 'unavailable' END AS status FROM crossref_record")
def baseline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("crossref_score") >= 0.75, "strong").when(F.col("crossref_title").isNotNull(), "weak").otherwise("unavailable")
    return read(spark, sf_dir, "crossref_record").select("record_id", status.alias("status"))


_NORM = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH n AS (SELECT case_id, {_NORM.format('claim')} AS c, {_NORM.format('evidence')} AS e FROM claimguard_benchmark), p AS (SELECT case_id, c, e, string_split(c, ' ')[1] AS first_word FROM n) SELECT case_id, contains(e, c) OR contains(c, e) AS contained, contains(e, first_word) AS names_first FROM p")
def answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of two answers contains the other after normalisation."""
    n = read(spark, sf_dir, "claimguard_benchmark").select("case_id", t.marker(F.col("claim")).alias("c"), t.marker(F.col("evidence")).alias("e"))
    return n.select("case_id", (F.contains("e", "c") | F.contains("c", "e")).alias("contained"), F.contains("e", F.split("c", " ")[0]).alias("names_first"))


@query()
def answer_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim and evidence as two answers: correct if one contains the other or their matching blocks make at least 0.45. No
    SQL: the ratio is that of difflib."""
    from docgrain.operators.bibliography import block_ratio

    n = read(spark, sf_dir, "claimguard_benchmark").select("case_id", t.marker(F.col("claim")).alias("c"), t.marker(F.col("evidence")).alias("e")).withColumn("similarity", round_half_up(block_ratio("c", "e"), 3))
    filled = (F.col("c") != "") & (F.col("e") != "")
    return n.select("case_id", "similarity", (filled & (F.contains("e", "c") | F.contains("c", "e") | (F.col("similarity") >= 0.45))).alias("correct"))


@query("WITH r AS (SELECT ref_id, lower(rtrim(regexp_replace(doi, '(?i)^https?://(?:dx\\.)?doi\\.org/', ''), '.,;:)]')) AS d FROM parsed_reference WHERE doi IS NOT NULL) SELECT d AS doi, count(*) AS entries, min(ref_id) AS first_ref FROM r GROUP BY d HAVING count(*) > 1")
def repeated_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers cited more than once, after the resolver and trailing punctuation are stripped."""
    d = F.lower(F.regexp_replace(F.regexp_replace("doi", r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"[.,;:)\]]+$", ""))
    r = read(spark, sf_dir, "parsed_reference").where("doi is not null").select("ref_id", d.alias("doi"))
    return r.groupBy("doi").agg(F.count("*").alias("entries"), F.min("ref_id").alias("first_ref")).where("entries > 1")


@query("WITH a AS (SELECT ref_id, list_distinct(flatten([regexp_extract_all(lower(x), '[a-z]{3,}') for x in authors])) AS l, list_distinct(regexp_extract_all(lower(raw_text), '[a-z]{3,}')) AS r FROM parsed_reference WHERE authors IS NOT NULL)"
       f" SELECT ref_id, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 0e0 ELSE {r3('CAST(len(list_intersect(l, r)) AS DOUBLE) / least(len(l), len(r))')} END AS author_match FROM a")
def author_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the smaller token set of two author texts found in the other."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    a = read(spark, sf_dir, "parsed_reference").where("authors is not null").select("ref_id", F.array_distinct(F.flatten(F.transform("authors", words))).alias("l"), F.array_distinct(words(F.col("raw_text"))).alias("r"))
    return a.select("ref_id", ratio(F.size(F.array_intersect("l", "r")), F.least(F.size("l"), F.size("r"))).alias("author_match"))


@query(f"WITH {_CARRIED}, m AS (SELECT f.claim_id, c.claim_type AS expected, f.kind AS predicted, coalesce(c.missing_citation, false) AS y, f.missing AS s FROM fin f JOIN claim c USING (claim_id))"
       f" SELECT count(*) AS n, {_div('count(*) FILTER (expected = predicted)', 'count(*)')} AS type_accuracy, {_div('count(*) FILTER (y AND s)', 'count(*) FILTER (s)')} AS citation_precision, {_div('count(*) FILTER (y AND s)', 'count(*) FILTER (y)')} AS citation_recall FROM m")
def claim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type accuracy and precision and recall of the missing-citation flag against the stored values."""
    gold = read(spark, sf_dir, "claim").select("claim_id", F.col("claim_type").alias("expected"), F.coalesce("missing_citation", F.lit(False)).alias("y"))
    m = classified(spark, sf_dir).select("claim_id", F.col("claim_type").alias("predicted"), F.col("missing_citation").alias("s")).join(gold, "claim_id")
    both, y, s = F.count_if(F.col("y") & F.col("s")), F.count_if("y"), F.count_if("s")
    return m.agg(F.count("*").alias("n"), ratio(F.count_if(ev.hit()), F.count("*")).alias("type_accuracy"), ratio(both, s).alias("citation_precision"), ratio(both, y).alias("citation_recall"))


@query(f"WITH {_CARRIED}, m AS (SELECT c.claim_type AS e, f.kind AS p FROM fin f JOIN claim c USING (claim_id)), l AS (SELECT e AS label FROM m WHERE e IS NOT NULL UNION SELECT p FROM m), k AS (SELECT label, count(*) FILTER (e = label AND p = label) AS tp, count(*) FILTER (e = label) AS su, count(*) FILTER (p = label) AS pc FROM l, m GROUP BY 1),"
       f" q AS (SELECT *, {_div('tp', 'pc')} AS pr, {_div('tp', 'su')} AS rc FROM k WHERE su > 0) SELECT {r3('avg(pr)')} AS macro_precision, {r3('avg(rc)')} AS macro_recall, {r3('avg(CASE WHEN pc + su > 0 THEN 2e0 * tp / (pc + su) ELSE 0e0 END)')} AS macro_f1 FROM q")
def claim_type_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the claim types that occur in the stored values; F1 from counts, not from rounded parts."""
    gold = read(spark, sf_dir, "claim").select("claim_id", F.col("claim_type").alias("expected"))
    m = classified(spark, sf_dir).select("claim_id", F.col("claim_type").alias("predicted")).join(gold, "claim_id")
    each = ev.per_label(m).where("support > 0")
    f1 = F.when(F.col("predicted_count") + F.col("support") > 0, 2.0 * F.col("tp") / (F.col("predicted_count") + F.col("support"))).otherwise(0.0)
    return each.agg(round_half_up(F.avg("precision")).alias("macro_precision"), round_half_up(F.avg("recall")).alias("macro_recall"), round_half_up(F.avg(f1)).alias("macro_f1"))


@query(f"WITH {TOOLS} SELECT b.expected AS case_type, b.tool, count(*) AS n, {_div('count(*) FILTER (expected = predicted)', 'count(*)')} AS accuracy, count(*) FILTER (predicted = 'missing') AS degraded FROM tools b GROUP BY 1, 2")
def accuracy_by_case_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per case type and tool with the number of degraded cases."""
    return tools(spark, sf_dir).groupBy(F.col("expected").alias("case_type"), "tool").agg(F.count("*").alias("n"), ratio(F.count_if(ev.hit()), F.count("*")).alias("accuracy"), F.count_if(F.col("predicted") == "missing").alias("degraded"))


@query("SELECT c.claim_id, coalesce(b.expected_label, 'missing') AS predicted FROM claim c LEFT JOIN claimguard_benchmark b ON b.case_id = c.claim_id")
def aligned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases joined to predictions by id; a case without one is 'missing'."""
    b = read(spark, sf_dir, "claimguard_benchmark").select(F.col("case_id").alias("claim_id"), "expected_label")
    return read(spark, sf_dir, "claim").select("claim_id").join(b, "claim_id", "left").select("claim_id", F.coalesce("expected_label", F.lit("missing")).alias("predicted"))


@query("SELECT r.ref_id, r.author_pos, r.author FROM (SELECT ref_id, unnest(range(greatest(1, len(coalesce(authors, []))))) AS author_pos, unnest(CASE WHEN len(coalesce(authors, [])) = 0 THEN ['unknown'] ELSE authors END) AS author FROM parsed_reference) r")
def author_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per author with position; an entry without authors gives one row with a default."""
    some = F.when(F.coalesce(F.size("authors"), F.lit(0)) > 0, F.col("authors")).otherwise(F.array(F.lit("unknown")))
    return read(spark, sf_dir, "parsed_reference").select("ref_id", F.posexplode(some).alias("author_pos", "author"))


@query(f"WITH {_EXP} SELECT method || '/' || chunk_size AS configuration, count(*) AS n_questions, count(*) FILTER (accuracy >= 0.5e0) AS n_correct, {_div('count(*) FILTER (accuracy >= 0.5e0)', 'count(*)')} AS answer_accuracy FROM exps GROUP BY 1")
def answer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.count_if(F.col("accuracy") >= 0.5)
    return experiments(spark, sf_dir).groupBy(F.concat_ws("/", "method", "chunk_size").alias("configuration")).agg(F.count("*").alias("n_questions"), good.alias("n_correct"), ratio(good, F.count("*")).alias("answer_accuracy"))


@query(f"WITH {_EXP}, b AS (SELECT method, chunk_size, overlap, max(accuracy) AS base FROM exps GROUP BY ALL), r AS (SELECT method, chunk_size, overlap, min(accuracy) AS again FROM exps WHERE seed = 1 GROUP BY ALL) SELECT method, chunk_size, overlap, base, again FROM r JOIN b USING (method, chunk_size, overlap)")
def rerank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-stage rows joined to their first-stage rows on three configuration keys."""
    keys = ["method", "chunk_size", "overlap"]
    base = experiments(spark, sf_dir).groupBy(*keys).agg(F.max("accuracy").alias("base"))
    again = experiments(spark, sf_dir).where("seed = 1").groupBy(*keys).agg(F.min("accuracy").alias("again"))
    return again.join(base, keys).select(*keys, "base", "again")


@query(f"WITH {_EXP}, b AS (SELECT method, chunk_size, {r3('avg(accuracy)')} AS m, count(*) AS n FROM exps GROUP BY ALL) SELECT * FROM b ORDER BY m DESC, n DESC, method, chunk_size LIMIT 1")
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row by a sort over several keys: a top-one report."""
    b = experiments(spark, sf_dir).groupBy("method", "chunk_size").agg(round_half_up(F.avg("accuracy")).alias("m"), F.count("*").alias("n"))
    return b.orderBy(F.desc("m"), F.desc("n"), "method", "chunk_size").limit(1)


@query(f"WITH {_RERANK}, f AS (SELECT query_id, min(first_rank) FILTER (ql = vl) AS base, min(rank) FILTER (ql = vl) AS re FROM rr GROUP BY 1), s AS (SELECT {r3('avg(CASE WHEN base <= 5 THEN 1e0 ELSE 0e0 END)')} AS base_recall, {r3('avg(CASE WHEN re <= 5 THEN 1e0 ELSE 0e0 END)')} AS reranked_recall FROM f) SELECT *, CASE WHEN reranked_recall >= base_recall THEN 'reranked' ELSE 'base' END AS chosen FROM s")
def strategy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reranked ranking is chosen if its recall is at least the base's."""
    f = reranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("first_rank"))).alias("base"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("re"))
    share = lambda c: round_half_up(F.avg(F.when(F.col(c) <= 5, 1.0).otherwise(0.0)))
    s = f.agg(share("base").alias("base_recall"), share("re").alias("reranked_recall"))
    return s.withColumn("chosen", F.when(F.col("reranked_recall") >= F.col("base_recall"), "reranked").otherwise("base"))


@query("SELECT document, left(string_agg(sentence, ' ' ORDER BY sentence_index, claim_id), 3500) AS context FROM claim WHERE sentence IS NOT NULL GROUP BY document")
def document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's sentences joined in order, cut to 3,500 characters. Only rows that begin before the cut are collected."""
    place = W.partitionBy("document").orderBy(F.asc_nulls_last("sentence_index"), "claim_id")
    c = read(spark, sf_dir, "claim").where("sentence is not null").select("document", "sentence_index", "claim_id", "sentence")
    c = c.withColumns({"pos": F.row_number().over(place), "before": F.sum(F.length("sentence") + 1).over(place.rowsBetween(W.unboundedPreceding, -1))})
    c = c.where("before is null or before < 3500")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    return c.groupBy("document").agg(F.left(F.array_join(F.transform(ordered, lambda s: s["sentence"]), " "), F.lit(3500)).alias("context"))


@query(f"WITH {_STYLE}, x AS (SELECT CASE WHEN label = 'likely_ai' THEN 'ai' WHEN label = 'likely_human' THEN 'human' END AS side, d.text, s.score FROM styled s JOIN documents d USING (doc_id)) SELECT side, count(*) AS n, {r3('avg(CAST(len(regexp_extract_all(text, $$al[.]$$)) AS DOUBLE))')} AS mean_citations, {r3('avg(score)')} AS mean_score FROM x WHERE side IS NOT NULL GROUP BY side")
def citations_by_predicted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean citations per predicted class; uncertain and short texts are left out."""
    d = read(spark, sf_dir, "documents")
    s = style_scores_of(d.select(F.struct("doc_id", F.regexp_count("text", F.lit("al[.]")).alias("c")).alias("k"), "text"), "k", "text")
    side = F.when(F.col("label") == "likely_ai", "ai").when(F.col("label") == "likely_human", "human")
    x = s.select(side.alias("side"), F.col("k.c").cast("double").alias("c"), "score").where("side is not null")
    return x.groupBy("side").agg(F.count("*").alias("n"), round_half_up(F.avg("c")).alias("mean_citations"), round_half_up(F.avg("score")).alias("mean_score"))


@query(f"WITH d AS (SELECT *, len([w for w in regexp_split_to_array(text, '\\s+') if w <> '']) AS n FROM documents) SELECT source, min(report) AS first_report, count(DISTINCT report) AS reports, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS documents, CAST(sum(n) AS BIGINT) AS words, {r3('sum(n) / CAST(count(n) AS DOUBLE)', 1)} AS mean_words, min(n) AS shortest, max(n) AS longest FROM d GROUP BY source")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, languages and word counts per source; the language list is bounded by the set of codes."""
    n = F.when(F.col("text").isNotNull(), t.word_count(F.col("text"))).alias("n")
    return read(spark, sf_dir, "documents").select("source", "report", "lang", n).groupBy("source").agg(
        F.min("report").alias("first_report"), F.count_distinct("report").alias("reports"), F.nullif(F.array_join(F.array_sort(F.collect_set("lang")), ","), F.lit("")).alias("languages"),
        F.count("*").alias("documents"), F.sum("n").alias("words"), round_half_up(F.sum("n") / F.count("n").cast("double"), 1).alias("mean_words"), F.min("n").alias("shortest"), F.max("n").alias("longest"),
    )


@query("SELECT citation_id, claim_id, raw_text, count(*) AS deliveries FROM citation GROUP BY ALL HAVING count(*) > 1")
def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "citation").groupBy("citation_id", "claim_id", "raw_text").agg(F.count("*").alias("deliveries")).where("deliveries > 1")


@query(f"WITH {TOOLS}, s AS (SELECT case_id, expected, predicted FROM tools WHERE expected <> predicted), f AS (SELECT case_id, expected, predicted FROM s QUALIFY row_number() OVER (PARTITION BY expected, predicted ORDER BY case_id) = 1) SELECT * FROM f")
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example per kind of failure, the first."""
    wrong = tools(spark, sf_dir).where(~ev.hit()).select("case_id", "expected", "predicted")
    return tables.keep_first(wrong, ["expected", "predicted"], "case_id")


@query("WITH p AS (SELECT doc_id, coalesce(source, 'none') AS s, len(text) AS n FROM documents WHERE text IS NOT NULL) SELECT s AS source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars, count(*) FILTER (n > 1800) AS oversized FROM p GROUP BY ROLLUP (s)")
def size_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters per source and in all (source null)."""
    n = F.length("text")
    p = read(spark, sf_dir, "documents").where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), n.alias("n"))
    return p.rollup("source").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"), F.count_if(F.col("n") > 1800).alias("oversized"))
