"""The path of one document through verification: passages of its evidence, which claims are verified against which of them,
verdicts, and all claims with what became of them. Every query has SQL.

Passages come from four sources: paragraphs of evidence sections (with the reference their label names), references, abstracts
and full texts of the report. A claim that cites references meets their passages and those of no reference, one that cites none
meets all of its report. Claims and passages of a report are multiplied in blocks; only the best of a block leave it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.operators import chunks, claims, lexical, retrieval, tables
from docgrain.plans.bibliography_queries import _EV
from docgrain.plans.claim_queries import (
    _AUTHOR, _CARRIED, _NUMS, _SCORE, _SCORED, _VERDICT, citation_resolve_author_year, citation_resolve_numeric, cited, classified, has, words_naming,
)
from docgrain.plans.text_queries import _COLLAPSE, rx
from docgrain.session import materialize, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


# Words and overlap of a passage, and of a passage of a full text; how a paragraph's label is written.
SIZES = {"passage": (95, 20), "full": (140, 30)}
LABEL = r"^\[([^\]]+)\]\s*(.*)$"
SPLIT = (r"([.!?])\s+([A-Z0-9\[])", r"(;)\s+([A-Z0-9])")


def sql_chunks(name: str, source: str, size: int, overlap: int) -> str:
    """CTEs that cut ``source`` (k, text) into overlapping windows of whole sentences: ``name`` (k, chunk_no, chunk)."""
    cut = r"regexp_replace(trim(regexp_replace(text, '[\t-\r\x1c-\x1f \x{85}\p{Z}]+', ' ', 'g')), '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g')"
    cut = rf"regexp_replace({cut}, '(;)\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')"
    n = name
    return (
        f"{n}_s AS MATERIALIZED (SELECT k, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i, len(ss) AS last FROM (SELECT k, [trim(p) for p in string_split({cut}, chr(1)) if trim(p) <> ''] AS ss FROM {source})),"
        f" {n}_w AS MATERIALIZED (SELECT k, i, last, string_split(s, ' ') AS w FROM {n}_s),"
        f" {n}_r AS (SELECT k, 0 AS i, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS done, false AS ended FROM {n}_w WHERE i = 1 UNION ALL SELECT r.k, w.i, (CASE WHEN len(held) > 0 AND len(held) + len(w) > {size} THEN held[-{overlap}:] ELSE held END) || w,"
        f" CASE WHEN len(held) > 0 AND len(held) + len(w) > {size} THEN array_to_string(held, ' ') END, w.i = w.last FROM {n}_r r JOIN {n}_w w ON w.k = r.k AND w.i = r.i + 1),"
        f" {n}_a AS (SELECT k, i * 2 AS step, done AS chunk FROM {n}_r WHERE done IS NOT NULL UNION ALL SELECT k, i * 2 + 1, array_to_string(held, ' ') FROM {n}_r WHERE ended),"
        f" {n}_n AS (SELECT k, step, chunk, count(*) OVER (PARTITION BY k) AS parts FROM {n}_a),"
        f" {n} AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY step) - 1 AS chunk_no, chunk FROM {n}_n WHERE parts > 1 OR len(string_split(chunk, ' ')) <= {size}"
        f" UNION ALL SELECT k, CAST(j / {size - overlap} AS INTEGER), array_to_string(v[j + 1 : j + {size}], ' ') FROM (SELECT k, string_split(chunk, ' ') AS v, unnest(range(0, len(string_split(chunk, ' ')), {size - overlap})) AS j FROM {n}_n WHERE parts = 1 AND len(string_split(chunk, ' ')) > {size}))"
    )


def cut(df: DataFrame, text: str, kind: str = "passage") -> DataFrame:
    """``df`` (k, text) cut into (k, chunk_no, chunk); k is any struct."""
    size, overlap = SIZES[kind]
    plain = t.collapse(F.col(text))
    return chunks.windows(df.select("k", plain.alias("t")), "k", "t", lambda x: chunks.overlapping(x, size, overlap))


_PARAGRAPHS = (
    rf"{_EV}, pa AS (SELECT d.doc_id, d.report, [{_COLLAPSE} for p in string_split(regexp_replace(regexp_replace(evidence, '\n\s*\n', chr(1), 'g'), '(\.)\s*\n', '\1' || chr(1), 'g'), chr(1)) if {_COLLAPSE} <> ''] AS v FROM ev JOIN documents d USING (doc_id) WHERE evidence <> '' AND d.report IS NOT NULL),"
    f" pg AS (SELECT doc_id, report AS document, unnest(range(len(v))) AS pos, unnest(v) AS paragraph FROM pa), lb AS (SELECT *, trim(regexp_extract(paragraph, {rx(LABEL)}, 1)) AS label, trim(regexp_extract(paragraph, {rx(LABEL)}, 2)) AS body FROM pg)"
)
_LABELLED = (
    f"{_PARAGRAPHS}, rf AS (SELECT ref_id, document, reference_index, parsed_year, lower(array_to_string(authors, ' ')) AS named FROM parsed_reference),"
    " lnm AS (SELECT DISTINCT l.doc_id, l.pos, l.label AS reference_index FROM lb l JOIN rf r ON r.document = l.document AND r.reference_index = l.label WHERE regexp_full_match(l.label, '[0-9]+')),"
    " lot AS (SELECT l.doc_id, l.pos, min_by(r.reference_index, r.ref_id) AS reference_index, min(r.ref_id) AS ref_id FROM lb l JOIN rf r ON r.document = l.document WHERE (l.doc_id, l.pos) NOT IN (SELECT (doc_id, pos) FROM lnm) AND r.named <> ''"
    " AND (r.parsed_year IS NULL OR regexp_extract(l.label, '\\b((?:19|20)[0-9]{2})\\b', 1) IN ('', CAST(r.parsed_year AS VARCHAR))) AND len([f for f in regexp_extract_all(lower(l.label), '[a-z]+') if contains(r.named, f)]) > 0 GROUP BY 1, 2),"
    " la AS (SELECT l.*, coalesce(lnm.reference_index, lot.reference_index) AS reference_index FROM lb l LEFT JOIN lnm USING (doc_id, pos) LEFT JOIN lot USING (doc_id, pos))"
)


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document, pos, paragraph, label, body) of the evidence sections of reports."""
    d = read(spark, sf_dir, "documents").where("report is not null").select("doc_id", F.col("report").alias("document"), t.sections(F.col("text"))["evidence_text"].alias("e")).where("e != ''")
    p = d.select("doc_id", "document", F.posexplode(t.evidence_paragraphs(F.col("e"))).alias("pos", "paragraph"))
    return p.withColumns({"label": F.trim(F.regexp_extract("paragraph", LABEL, 1)), "body": F.trim(F.regexp_extract("paragraph", LABEL, 2))})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paragraphs`` with the index of the reference each label names: an equal number, else the first reference of a
    compatible year whose authors have an alphabetic part of the label."""
    p = paragraphs(spark, sf_dir)
    refs = read(spark, sf_dir, "parsed_reference").select("ref_id", "document", "reference_index", "parsed_year", "authors")
    numbers = refs.where("reference_index is not null").select("document", F.col("reference_index").alias("label"), F.lit(True).alias("known")).distinct()
    marked = p.where("label != ''").join(numbers, ["document", "label"], "left").withColumn("number", F.when(F.col("known") & F.col("label").rlike("^[0-9]+$"), F.col("label")))
    parts = F.array_distinct(F.regexp_extract_all(F.lower("label"), F.lit("[a-z]+"), F.lit(0)))
    year = F.regexp_extract("label", r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    asked = marked.where("number is null").select("doc_id", "pos", "document", year.alias("year"), F.explode(parts).alias("hint"))
    words = refs.select("ref_id", "document", "parsed_year", "reference_index", F.explode(F.array_distinct(F.split(F.lower(F.array_join("authors", " ")), r"\s+"))).alias("word")).where("word != ''")
    words = words.groupBy("document", "word", "parsed_year").agg(F.min(F.struct("ref_id", "reference_index")).alias("r"))
    first = words.join(words_naming(words, asked), ["document", "word"]).groupBy("document", "hint", "parsed_year").agg(F.min("r").alias("r"))
    compatible = F.col("year").isNull() | F.col("parsed_year").isNull() | (F.col("year") == F.col("parsed_year"))
    named = asked.join(first, ["document", "hint"]).where(compatible).groupBy("doc_id", "pos").agg(F.min("r").alias("r")).select("doc_id", "pos", F.col("r.reference_index").alias("named"))
    found = marked.select("doc_id", "pos", "number").join(named, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("number", "named").alias("reference_index"))
    return p.join(found, ["doc_id", "pos"], "left")


@query(f"WITH {_LABELLED} SELECT doc_id, pos, label, reference_index FROM la WHERE label <> ''")
def evidence_label_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of evidence paragraphs resolved to references of the report."""
    return labelled(spark, sf_dir).where("label != ''").select("doc_id", "pos", "label", "reference_index")


_KEY = r"trim(regexp_replace(lower(chunk), '[^\p{L}\p{N}_]+', ' ', 'g'))"
_K = "struct_pack(kind := {kind}, id := {id}, pos := {pos})"
_PASSAGES = (
    f"{_LABELLED}, sev AS (SELECT {_K.format(kind=0, id='doc_id', pos='CAST(pos AS INTEGER)')} AS k, document, reference_index, CASE WHEN body <> '' THEN body ELSE paragraph END AS text FROM la),"
    f" sre AS (SELECT {_K.format(kind=1, id='ref_id', pos='CAST(0 AS INTEGER)')} AS k, document, reference_index, concat_ws('. ', nullif(parsed_title, ''), CASE WHEN len(authors) > 0 THEN 'Authors: ' || array_to_string(authors, ', ') END, 'Year: ' || parsed_year, 'DOI: ' || nullif(doi, ''), nullif(raw_text, '')) AS text FROM parsed_reference WHERE document IS NOT NULL),"
    f" sab AS (SELECT {_K.format(kind=2, id='doc_id', pos='CAST(0 AS INTEGER)')} AS k, report AS document, CAST(NULL AS VARCHAR) AS reference_index, text FROM documents WHERE source = 'evidence_abstract' AND report IS NOT NULL AND text <> ''),"
    f" sfu AS (SELECT {_K.format(kind=3, id='doc_id', pos='CAST(0 AS INTEGER)')} AS k, report AS document, CAST(NULL AS VARCHAR) AS reference_index, text FROM documents WHERE source = 'thesis_archive' AND report IS NOT NULL AND text <> ''),"
    f" sal AS (SELECT * FROM sev UNION ALL SELECT * FROM sre UNION ALL SELECT * FROM sab), {sql_chunks('cs', 'sal', *SIZES['passage'])}, {sql_chunks('cf', 'sfu', *SIZES['full'])},"
    " cl AS (SELECT k, CAST(chunk_no AS INTEGER) AS chunk_no, chunk, document, reference_index FROM cs JOIN sal USING (k) UNION ALL SELECT k, CAST(chunk_no AS INTEGER), chunk, document, reference_index FROM cf JOIN sfu USING (k)),"
    f" un AS (SELECT *, {_KEY} AS key FROM cl), ps AS MATERIALIZED (SELECT document, reference_index, struct_pack(kind := k.kind, id := k.id, pos := k.pos, chunk_no := chunk_no) AS pos, chunk AS passage FROM un WHERE k.kind >= 2 OR key <> ''"
    " QUALIFY k.kind >= 2 OR row_number() OVER (PARTITION BY document, k.kind >= 2, key ORDER BY k, chunk_no) = 1)"
)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, reference_index, pos, passage): those of evidence and references once per report by their words, the first
    kept; pos is the struct (kind, id, pos, chunk_no) with kind 0 evidence, 1 reference, 2 abstract, 3 full text."""
    k = lambda kind, key, pos: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("id"), pos.cast("int").alias("pos"))
    p = labelled(spark, sf_dir)
    evidence = p.select(k(0, "doc_id", F.col("pos")).alias("k"), "document", "reference_index", F.when(F.col("body") != "", F.col("body")).otherwise(F.col("paragraph")).alias("text"))
    r = read(spark, sf_dir, "parsed_reference").where("document is not null")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    listed = F.concat_ws(". ", some("parsed_title"), F.when(F.size("authors") > 0, F.concat(F.lit("Authors: "), F.array_join("authors", ", "))), F.concat(F.lit("Year: "), "parsed_year"), F.concat(F.lit("DOI: "), some("doi")), some("raw_text"))
    references = r.select(k(1, "ref_id", F.lit(0)).alias("k"), "document", "reference_index", listed.alias("text"))
    d = read(spark, sf_dir, "documents").where("report is not null and text != ''")
    whole = lambda kind, source: d.where(F.col("source") == source).select(k(kind, "doc_id", F.lit(0)).alias("k"), F.col("report").alias("document"), F.lit(None).cast("string").alias("reference_index"), "text")
    short = evidence.unionByName(references).unionByName(whole(2, "evidence_abstract"))
    long = whole(3, "thesis_archive")
    carry = lambda df, kind: cut(df.withColumn("k", F.struct("k.*", "document", "reference_index")), "text", kind)
    every = carry(short, "passage").unionByName(carry(long, "full"))
    every = every.select(F.col("k.document").alias("document"), F.col("k.reference_index").alias("reference_index"), F.struct("k.kind", "k.id", "k.pos", "chunk_no").alias("pos"), F.col("chunk").alias("passage"))
    key = F.trim(F.regexp_replace(F.lower("passage"), r"[^\p{L}\p{N}_]+", " "))
    once = tables.keep_first(every.where("pos.kind < 2").withColumn("key", key).where("key != ''"), ["document", "key"], "pos").drop("key")
    return once.unionByName(every.where("pos.kind >= 2"))


_FLAT = "pos.kind AS kind, pos.id AS source_id, pos.pos AS pos, pos.chunk_no AS chunk_no"


def flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("pos.kind").alias("kind"), F.col("pos.id").alias("source_id"), F.col("pos.pos").alias("pos"), F.col("pos.chunk_no").alias("chunk_no"))


@query(f"WITH RECURSIVE {_PASSAGES} SELECT document, reference_index, passage, {_FLAT} FROM ps")
def report_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of a report: the bag union of the four kinds."""
    return flat(passages(spark, sf_dir), "document", "reference_index", "passage")


_CITES = (
    f"{_NUMS}, {_AUTHOR}, rn AS (SELECT n.citation_id, n.marker AS idx FROM nums n JOIN refs r ON r.document = n.document AND r.reference_index = n.marker),"
    " ra AS (SELECT citation_id, min(ref_id) AS ref_id FROM ci JOIN w ON w.document = ci.document AND contains(w.named, ci.hint) AND (ci.cited_year IS NULL OR w.parsed_year IS NULL OR ci.cited_year = w.parsed_year) GROUP BY 1),"
    " ix AS (SELECT citation_id, idx FROM rn UNION SELECT citation_id, reference_index FROM ra JOIN parsed_reference USING (ref_id) WHERE reference_index IS NOT NULL),"
    f" {_SCORED}, cc AS (SELECT t.claim_id, t.document, t.raw FROM ct t WHERE t.kind = 'factual_claim' AND t.claim_id IN (SELECT claim_id FROM citation)),"
    " cx AS (SELECT DISTINCT c.claim_id, x.idx FROM cc c JOIN citation z USING (claim_id) JOIN ix x USING (citation_id))"
)


def cited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, document, sentence, refs): factual claims with a citation, and the indices of the references it resolves to."""
    c = read(spark, sf_dir, "claim").select("claim_id", "document", "sentence")
    factual = claims.scored(c, "sentence", cited(F.col("sentence"))).where("claim_type = 'factual_claim'").select("claim_id", "document", "sentence")
    numeric = citation_resolve_numeric(spark, sf_dir).select("citation_id", F.col("marker").alias("idx"))
    indices = read(spark, sf_dir, "parsed_reference").where("reference_index is not null").select("ref_id", F.col("reference_index").alias("idx"))
    named = citation_resolve_author_year(spark, sf_dir).join(indices, "ref_id").select("citation_id", "idx")
    links = read(spark, sf_dir, "citation").select("citation_id", "claim_id").distinct()
    refs = links.join(numeric.unionByName(named), "citation_id", "left").groupBy("claim_id").agg(F.array_sort(F.collect_set("idx")).alias("refs"))  # marks of one sentence
    return factual.join(refs, "claim_id")


@query(f"WITH {_CITES} SELECT claim_id, document, coalesce((SELECT string_agg(idx, '; ' ORDER BY idx) FROM cx x WHERE x.claim_id = c.claim_id), '') AS cited_references FROM cc c")
def claims_to_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only cited factual claims are verified, against the references their marks resolve to."""
    return cited_claims(spark, sf_dir).select("claim_id", "document", F.array_join("refs", "; ").alias("cited_references"))


_STRIPPED = "raw"
for _pattern, _to in ((t.NARRATIVE, r"\1"), (t.PARENTHETICAL, ""), (t.NUMERIC, "")):
    _STRIPPED = f"regexp_replace({_STRIPPED}, {rx(_pattern)}, '{_to}', 'g')"
_STRIPPED = rf"trim(regexp_replace(regexp_replace({_STRIPPED}, '\s+([.,;:!?])', '\1', 'g'), '\s+', ' ', 'g'))"
_ALLOWED = (
    f"{_PASSAGES}, {_CITES}, cq AS (SELECT claim_id AS case_id, document, {_STRIPPED} AS claim, CAST(NULL AS VARCHAR) AS expected_label FROM cc),"
    " ap AS (SELECT q.case_id, p.pos, p.passage FROM cq q JOIN ps p ON p.document = q.document WHERE q.case_id NOT IN (SELECT claim_id FROM cx) OR p.reference_index IS NULL OR (q.case_id, p.reference_index) IN (SELECT (claim_id, idx) FROM cx)),"
    f" {_SCORE.replace('FROM claimguard_benchmark b JOIN ps p USING (case_id)', 'FROM cq b JOIN ap p USING (case_id)')}"
)


def evidence(spark: SparkSession, sf_dir: str, whole: bool = False, k: int = retrieval.TOP) -> DataFrame:
    """(claim_id, document, pos, reference_index, passage, score, rank): the ``k`` best passages of every cited claim among those it may
    use; ``whole``: of the claims with resolved references, among all of the report."""
    c = cited_claims(spark, sf_dir).select("claim_id", "document", "refs", t.tokens(t.strip_citations(F.col("sentence"))).alias("toks"))
    c = c.where("size(refs) > 0").withColumn("refs", F.array().cast("array<string>")) if whole else c
    c = materialize(c, "cited-claims")
    p = materialize(passages(spark, sf_dir).withColumns({"toks": t.tokens(F.col("passage")), "row": F.monotonically_increasing_id()}), "passages")
    return lexical.top_passages(c, p, k).join(p.select("row", "document", "reference_index", "passage"), "row").drop("row")


@query(f"WITH RECURSIVE {_ALLOWED} SELECT case_id AS claim_id, score, rank, {_FLAT} FROM rk WHERE rank <= 5 AND score >= 0.08e0")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best passages of every cited factual claim: a top-k report."""
    return flat(evidence(spark, sf_dir), "claim_id", "score", "rank")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, status, confidence) of every cited factual claim."""
    c = cited_claims(spark, sf_dir).select("claim_id", t.strip_citations(F.col("sentence")).alias("claim")).withColumn("claim_tokens", t.tokens(F.col("claim")))
    return retrieval.judge(c.join(retrieval.gathered(evidence(spark, sf_dir), "claim_id"), "claim_id", "left")).select("claim_id", "status", "confidence")


_JUDGED = f"{_ALLOWED}, {_VERDICT.replace('claimguard_benchmark b LEFT JOIN', 'cq b LEFT JOIN')}"


@query(f"WITH RECURSIVE {_JUDGED} SELECT c.claim_id, coalesce(status, 'not_verified') AS status, coalesce(confidence, 0e0) AS confidence FROM claim c LEFT JOIN ve ON ve.case_id = c.claim_id")
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with its verdict; claims that are not cited facts are not verified."""
    v = verified(spark, sf_dir)
    return read(spark, sf_dir, "claim").select("claim_id").join(v, "claim_id", "left").select("claim_id", F.coalesce("status", F.lit("not_verified")).alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


_SEVERE = _CARRIED.removeprefix(f"{_SCORED}, ") + f", se AS (SELECT *, CASE WHEN {has('lower(raw)', claims.ABSOLUTE, claims.EVIDENCE)} THEN 'high' ELSE 'medium' END AS severity FROM fin),"
_WHOLE = (
    f"{_PASSAGES}, {_CITES}, cq AS (SELECT claim_id AS case_id, document, {_STRIPPED} AS claim, CAST(NULL AS VARCHAR) AS expected_label FROM cc WHERE claim_id IN (SELECT claim_id FROM cx)), ap AS (SELECT q.case_id, p.pos, p.passage FROM cq q JOIN ps p ON p.document = q.document),"
    f" {_SCORE.replace('FROM claimguard_benchmark b JOIN ps p USING (case_id)', 'FROM cq b JOIN ap p USING (case_id)')}, tw AS (SELECT r.case_id, r.claim, r.rank, r.passage, (r.case_id, p.reference_index) IN (SELECT (claim_id, idx) FROM cx) AS gold FROM rk r JOIN ps p ON p.pos = r.pos WHERE r.rank <= 20 AND r.score >= 0.08e0),"
    " fa AS (SELECT q.case_id, min(w.rank) FILTER (w.gold) AS best, list_distinct(regexp_extract_all(lower(any_value(q.claim)), '[a-z]{4,}')) AS asked, list_distinct(regexp_extract_all(lower(coalesce(string_agg(w.passage, ' ') FILTER (w.rank <= 5), '')), '[a-z]{4,}')) AS met FROM cq q LEFT JOIN tw w USING (case_id) GROUP BY 1)"
)


@query(f"WITH RECURSIVE {_WHOLE} SELECT case_id AS claim_id, best AS first_rank, CASE WHEN best <= 5 THEN 'found' WHEN best <= 20 THEN 'ranked too low' WHEN len(list_intersect(asked, met)) >= greatest(2, len(asked) // 3) THEN 'lexical trap' ELSE 'representation miss' END AS outcome FROM fa")
def evidence_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search in the whole report finds a passage of a cited reference among the best five or twenty; if not, whether the
    best five share the claim's words (at least two, and a third of its words of four letters or more)."""
    c = cited_claims(spark, sf_dir).where("size(refs) > 0")
    found = evidence(spark, sf_dir, True, 20).join(c.select("claim_id", "refs"), "claim_id")
    gold = F.array_contains("refs", F.col("reference_index"))
    texts = F.collect_list(F.when(F.col("rank") <= 5, F.col("passage")))  # at most five
    each = found.groupBy("claim_id").agg(F.min(F.when(gold, F.col("rank"))).alias("best"), F.array_join(texts, " ").alias("met"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    c = c.select("claim_id", words(t.strip_citations(F.col("sentence"))).alias("asked")).join(each, "claim_id", "left")
    shared = F.size(F.array_intersect("asked", words(F.coalesce("met", F.lit("")))))
    trap = shared >= F.greatest(F.lit(2), F.floor(F.size("asked") / 3))
    outcome = F.when(F.col("best") <= 5, "found").when(F.col("best") <= 20, "ranked too low").when(trap, "lexical trap").otherwise("representation miss")
    return c.select("claim_id", F.col("best").alias("first_rank"), outcome.alias("outcome"))


_LEVEL = "CASE WHEN conflicts > 0 OR high > 0 THEN 'elevated' WHEN missing > 0 OR open_checks > 0 THEN 'medium' ELSE 'low' END AS level"


@query(f"WITH RECURSIVE {_JUDGED}, " + _SEVERE + f" r AS (SELECT f.document, count(*) FILTER (v.status IN ('contradicted', 'not_supported')) AS conflicts, count(*) FILTER (f.missing) AS missing, count(*) FILTER (f.missing AND f.severity = 'high') AS high, count(*) FILTER (v.status IN ('partially_supported', 'insufficient_evidence')) AS open_checks FROM se f LEFT JOIN ve v ON v.case_id = f.claim_id GROUP BY 1) SELECT document, {_LEVEL}, conflicts, missing, open_checks FROM r")
def report_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review priority of each report: elevated by conflicting verdicts or severe missing citations, medium by open ones."""
    c = classified(spark, sf_dir).select("claim_id", "document", "missing_citation", "flag_severity").join(verified(spark, sf_dir), "claim_id", "left")
    s, missing = F.col("status"), F.col("missing_citation")
    r = c.groupBy("document").agg(
        F.count_if(s.isin("contradicted", "not_supported")).alias("conflicts"), F.count_if(missing).alias("missing"), F.count_if(missing & (F.col("flag_severity") == "high")).alias("high"), F.count_if(s.isin("partially_supported", "insufficient_evidence")).alias("open_checks"),
    )
    level = F.when((F.col("conflicts") > 0) | (F.col("high") > 0), "elevated").when((F.col("missing") > 0) | (F.col("open_checks") > 0), "medium").otherwise("low")
    return r.select("document", level.alias("level"), "conflicts", "missing", "open_checks")


# ---- SQL of the windows over whole texts ----

_W = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
ORACLE["chunk_words_overlap"] = f"WITH RECURSIVE src AS (SELECT doc_id AS k, text FROM documents WHERE text IS NOT NULL), {sql_chunks('cs', 'src', *SIZES['passage'])} SELECT k AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM cs"
_SENTENCES = (
    rf"s AS MATERIALIZED (SELECT doc_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i, len(ss) AS last FROM (SELECT doc_id, [regexp_replace(p, '^{_W}+|{_W}+$', '', 'g') for p in string_split(regexp_replace(text, '([.!?]){_W}+', '\1' || chr(1), 'g'), chr(1)) if regexp_replace(p, '^{_W}+|{_W}+$', '', 'g') <> ''] AS ss FROM documents WHERE text IS NOT NULL))"
)


def _count(x: str) -> str:
    return f"len([w for w in regexp_split_to_array({x}, '{_W}+') if w <> ''])"


ORACLE["passages_bounded"] = (
    f"WITH RECURSIVE {_SENTENCES}, c AS (SELECT *, {_count('s')} AS n FROM s), l AS (SELECT doc_id, text FROM documents WHERE {_count('text')} > 180), r AS (SELECT doc_id, i, s, last, 0 AS win, n AS held, n FROM c JOIN l USING (doc_id) WHERE i = 1 UNION ALL"
    " SELECT c.doc_id, c.i, c.s, c.last, CASE WHEN held >= 120 AND held + c.n > 180 THEN win + 1 ELSE win END, CASE WHEN held >= 120 AND held + c.n > 180 THEN c.n ELSE held + c.n END, c.n FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1),"
    " e AS (SELECT doc_id, win AS final, held AS rest FROM r WHERE i = last), g AS (SELECT r.doc_id, i, s, CASE WHEN win = final AND final > 0 AND rest < 40 THEN win - 1 ELSE win END AS win FROM r JOIN e USING (doc_id))"
    f" SELECT doc_id, CAST(win AS INTEGER) AS chunk_no, string_agg(s, ' ' ORDER BY i) AS chunk FROM g GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, text FROM documents WHERE {_count('text')} BETWEEN 1 AND 180"
)
_KEEP = "held[coalesce([j for j in range(1, len(held) + 1) if list_sum([length(x) for x in held[j:]]) <= 64][1], len(held) + 1):]"
ORACLE["chunk_sentence_chars"] = (
    f"WITH RECURSIVE {_SENTENCES}, r AS (SELECT doc_id, 0 AS i, 0 AS last, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS done FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, s.last,"
    f" (CASE WHEN len(held) > 0 AND list_sum([length(x) for x in held]) + length(s.s) > 512 THEN {_KEEP} ELSE held END) || [s.s], CASE WHEN len(held) > 0 AND list_sum([length(x) for x in held]) + length(s.s) > 512 THEN array_to_string(held, ' ') END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1),"
    " a AS (SELECT doc_id, i * 2 AS step, done AS chunk FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, i * 2 + 1, array_to_string(held, ' ') FROM r WHERE i = last AND i > 0)"
    " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_no, chunk FROM a"
)
