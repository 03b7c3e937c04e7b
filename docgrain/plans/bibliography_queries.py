"""Queries over bibliography entries, chunks, passages and extracted citations; with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.functions.numbers import r3, ratio, round_half_up
from docgrain.operators import bibliography, chunks, citations, tables
from docgrain.operators.packed import split_packed
from docgrain.plans.text_queries import _COLLAPSE, _STRIP, rx
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


@query()
def chunk_words_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", chunks.overlapping)


@query()
def passages_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", chunks.bounded)


@query()
def chunk_sentence_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", chunks.sentence_chars)


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunked(read(spark, sf_dir, "documents"), "doc_id", "text", chunks.recursive)


_C = citations


def _bef(x: str) -> str:
    for pattern, to in ((r"^\s+", ""), (_C.CUE, ""), (rf"(?s){t.YEAR}.*$", ""), (r"^[\s,]+|[\s,]+$", ""), (r"\s+(?:and|&)\s+", " and ")):
        x = f"regexp_replace({x}, {rx(pattern)}, '{to}', 'g')"
    return x


_HINT = f"regexp_extract_all(regexp_replace(string_split(who, ';')[-1], {rx(r'(?i)\bet\s+al\.?')}, '', 'g'), {rx(_C.HINT)})[-1]"
_ENDS = "[TRY_CAST(n AS BIGINT) for n in regexp_extract_all(x, '[0-9]+')]"
_MARKS = (
    f"scan AS (SELECT claim_id, coalesce(sentence_index, 0) AS p, sentence AS s, 0 AS done, CAST('' AS VARCHAR) AS mark, 0 AS st, false AS refused FROM claim WHERE sentence IS NOT NULL UNION ALL"
    " SELECT claim_id, p, s, CASE WHEN no THEN pl + 1 ELSE pl + length(m) END, m, pl, no FROM (SELECT *, done + instr(substr(s, done + 1), m) - 1 AS pl,"
    f" m[1] = '(' AND (regexp_matches(m, {rx(_C.ONLY_YEARS)}) OR NOT regexp_matches({_bef('m[2:-2]')}, {rx(_C.NAME)})) AS no"
    f" FROM (SELECT claim_id, p, s, done, regexp_extract(substr(s, done + 1), {rx(_C.ANY)}, 0) AS m FROM scan) WHERE m <> ''))"
    ", mk AS (SELECT claim_id, p, mark, st FROM scan WHERE mark <> '' AND NOT refused)"
    f", na AS (SELECT *, 'author_year_narrative' AS kind, regexp_extract(mark, {rx(t.NARRATIVE)}, 1) AS who, regexp_extract(mark, {rx(t.NARRATIVE)}, 2) AS item FROM mk WHERE mark[1] NOT IN ('(', '['))"
    f", it AS (SELECT *, [i for i in string_split(mark[2:-2], ';') if regexp_matches(i, {rx(t.YEAR)})] AS items FROM mk WHERE mark[1] = '(')"
    f", pa AS (SELECT claim_id, p, mark, st, 'author_year' AS kind, [{_bef('x')} for x in items[1:k] if {_bef('x')} <> ''][-1] AS who, items[k] AS item FROM (SELECT *, unnest(range(1, len(items) + 1)) AS k FROM it))"
    f", ay AS (SELECT claim_id, p, mark, st, kind, who, unnest(regexp_extract_all(item, {rx(t.YEAR)}, 1)) AS y FROM (SELECT * FROM na UNION ALL SELECT * FROM pa WHERE who IS NOT NULL))"
    f", nu AS (SELECT claim_id, p, mark, st, unnest(list_distinct(flatten([CASE WHEN {_ENDS}[1] <= {_ENDS}[-1] AND {_ENDS}[-1] - {_ENDS}[1] <= {_C.LONGEST_RANGE} THEN range({_ENDS}[1], {_ENDS}[-1] + 1) ELSE {_ENDS} END for x in regexp_extract_all(mark, '[0-9]+(?:\\s*[-–—]\\s*[0-9]+)?')]))) AS n FROM mk WHERE mark[1] = '[')"
)
_EXTRACTED = (
    "al AS (SELECT claim_id, p, mark, st, trim(regexp_replace(lower(who || ' ' || y), '[^a-z0-9]+', ' ', 'g')) AS marker, kind, CAST(y AS INTEGER) AS year, " + _HINT + " AS author_hint FROM ay"
    " UNION ALL SELECT claim_id, p, mark, st, CAST(n AS VARCHAR), 'numeric', NULL, NULL FROM nu WHERE n IS NOT NULL)"
)


@query(f"WITH RECURSIVE {_MARKS}, {_EXTRACTED} SELECT claim_id, mark AS raw_text, marker, kind AS citation_type, year, author_hint, CAST(st AS INTEGER) AS start_char, CAST(st + length(mark) AS INTEGER) AS end_char, 's' || p || ':c' || st AS group_id FROM al")
def citations_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citations(read(spark, sf_dir, "claim"), "claim_id", "sentence_index", "sentence")


def _cl(x: str) -> str:
    return f"""nullif(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^[ ,.;:"''“”]+|[ ,.;:"''“”]+$', '', 'g'), '')"""


def _seg(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '\\b([A-Z])\\.', '\\1' || chr(2), 'g'), '\\.({bibliography.GLUED})', '. \\1', 'g')"
    trim = "regexp_replace(replace(p, chr(2), '.'), '^[ .]+|[ .]+$', '', 'g')"
    return f"[{trim} for p in string_split(regexp_replace({x}, '\\.\\s+', chr(1), 'g'), chr(1)) if {trim} <> '']"


_B = bibliography
_WORDS = "len([w for w in regexp_split_to_array({0}, '\\s+') if w <> ''])"
_FIT = f"coalesce({_WORDS.format(_cl('q'))} BETWEEN 2 AND 32 AND NOT regexp_matches({_cl('q')}, {rx(_B.VENUE)}) AND NOT regexp_matches({_cl('q')}, {rx('^' + _B.YEAR_ONLY + '$')}) AND NOT regexp_matches({_cl('q')}, {rx(t.DOI)}), false)"
_NAMES = " + ".join(f"len(regexp_extract_all(q, {rx(n)}))" for n in _B.NAMED)
_ENTRY = (
    "e1 AS (SELECT ref_id, trim(regexp_replace(raw_text, '[\\t-\\r \\x{85}\\p{Z}]+', ' ', 'g')) AS clean FROM parsed_reference WHERE raw_text IS NOT NULL)"
    f", e2 AS (SELECT ref_id, coalesce(nullif(regexp_extract(clean, '^\\s*\\[(\\d+)\\]\\s+', 1), ''), nullif(regexp_extract(clean, '^\\s*(\\d+)[.)]\\s+', 1), '')) AS idx, regexp_replace(clean, {rx(_B.START)}, '') AS body FROM e1)"
    f", e3 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(body, {rx(t.DOI)}, '', 'g'), {rx(_B.START)}, ''), '^\\s+|\\s+$', '', 'g') AS work, regexp_extract(body, {rx(_B.YEAR_ONLY)}, 1) AS y, regexp_extract(body, {rx(_B.QUOTED)}, 1) AS quoted FROM e2)"
    f", e4 AS (SELECT *, CASE WHEN y <> '' AND contains(work, y) THEN regexp_replace(regexp_replace(substr(work, instr(work, y) + 4), '^\\)?[a-z]?\\s*[.)]?\\s*', ''), '^[)\\].,\\s]+', '') END AS past, regexp_extract(work, {rx(_B.LEADING_NAMES)}, 0) AS named FROM e3)"
    f", e5 AS (SELECT *, CASE WHEN named <> '' THEN string_split(regexp_replace(regexp_replace(substr(work, length(named) + 1), '^[ ,.]+', ''), {rx(_B.AFTER_TITLE)}, chr(1)), chr(1))[1] END AS region FROM e4)"
    f", e6 AS (SELECT *, {_seg('past')} AS l1, {_seg('region')} AS l2, {_seg('work')} AS l3 FROM e5)"
    f", e7 AS (SELECT *, {_cl(f'CASE WHEN quoted <> $$$$ THEN quoted ELSE coalesce([q for q in l1 if {_FIT}][1], [q for q in l2[1:1] if {_FIT}][1], [q for q in l3 if ({_NAMES}) < 2 AND {_FIT}][1], l3[1]) END')} AS title FROM e6)"
    f", e8 AS (SELECT *, regexp_replace(body, {rx(t.DOI)}, '', 'g') AS nodoi, regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(body, {rx(_B.QUOTE)}) THEN regexp_replace(body, {rx('(?s)' + _B.QUOTE + '.*$')}, '') WHEN y <> '' THEN left(body, instr(body, y) - 1) ELSE string_split(body, '.')[1] END, {rx(_B.START)}, ''), '^[ .(\\[]+|[ .(\\[]+$', '', 'g'), '(?i)\\bet\\s+al\\.?', '', 'g') AS blob FROM e7)"
    f", e9 AS (SELECT *, CASE WHEN regexp_matches(blob, {rx(_B.LAST_FIRST)}) THEN regexp_extract_all(blob, {rx(_B.LAST_FIRST)}, 1) WHEN regexp_matches(blob, {rx(_B.FIRST_LAST)}) THEN regexp_extract_all(blob, {rx(_B.FIRST_LAST)}, 1)"
    " ELSE [regexp_extract(regexp_replace(x, '^[ .,]+|[ .,]+$', '', 'g'), '([A-Z][A-Za-z''-]+)\\s*$', 1) for x in string_split(regexp_replace(replace(blob, '&', ' and '), '\\s+and\\s+|;', chr(1), 'g'), chr(1))] END AS found"
    f", {_seg('CASE WHEN title IS NOT NULL AND contains(lower(nodoi), lower(title)) THEN substr(nodoi, instr(lower(nodoi), lower(title)) + length(title)) ELSE nodoi END')} AS rest FROM e8)"
    ", e10 AS (SELECT *, [trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) for n in found] AS ks FROM e9)"
)
_ENTRY_FIELDS = (
    "SELECT ref_id, idx, title, coalesce(array_to_string([found[i] for i in range(1, len(found) + 1) if ks[i] <> '' AND list_position(ks, ks[i]) = i], '; '), '') AS authors, TRY_CAST(nullif(y, '') AS INTEGER) AS year,"
    f" lower(nullif(regexp_replace(regexp_extract(body, {rx(t.DOI)}, 1), '[.,;:)\\]]+$', ''), '')) AS doi,"
    f" regexp_replace([{_cl('q')} for q in rest if coalesce(NOT regexp_matches({_cl('q')}, {rx(t.DOI)}) AND NOT regexp_matches({_cl('q')}, {rx('^' + _B.YEAR_ONLY + '$')}) AND {_WORDS.format(_cl('q'))} <= 20, false)][1], '^In([A-Z])', 'In \\1') AS venue FROM e10"
)


@query(f"WITH {_ENTRY} {_ENTRY_FIELDS}")
def reference_entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = bibliography.entry_fields(read(spark, sf_dir, "parsed_reference"), "ref_id", "raw_text")
    return fields.withColumn("authors", F.array_join("authors", "; "))


@query()
def reference_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the cases whose first entry gives each expected field, and all of them: index, title (likeness of at least
    0.88), authors (each expected surname among those found), year, doi, venue (at least 0.75). A null expected field is
    met by an absent one; a case without an entry meets none. No SQL: likeness is a ratio of matching blocks."""
    bench = read(spark, sf_dir, "reference_parsing_benchmark")
    first = split_packed(bench, "case_id", "raw_reference", "entries").where("value_pos = 1").select(F.col("row_id").alias("case_id"), "value_text")
    found = bibliography.entry_fields(first, "case_id", "value_text").withColumn("here", F.lit(True))
    people = split_packed(bench, "case_id", "expected_authors", "names").groupBy(F.col("row_id").alias("case_id")).agg(F.collect_list("value_text").alias("people"))  # the names of one field
    c = bench.select("case_id", "expected_index", "expected_title", "expected_year", "expected_doi", "expected_venue").join(found, "case_id", "left").join(people, "case_id", "left")
    c = c.withColumns({"title_like": bibliography.fuzzy("expected_title", "title"), "venue_like": bibliography.fuzzy("expected_venue", "venue"), "listed": bibliography.all_listed("people", "authors")})
    same = lambda a, b: t.marker(F.coalesce(a, F.lit(""))) == t.marker(F.coalesce(b, F.lit("")))
    checks = {
        "index": same(F.col("idx"), F.col("expected_index")), "title": F.col("title_like") >= 0.88, "authors": F.col("listed"), "year": F.coalesce(F.col("year").cast("string"), F.lit("")) == F.coalesce("expected_year", F.lit("")),
        "doi": same(F.col("doi"), F.col("expected_doi")), "venue": F.col("venue_like") >= 0.75,
    }
    checks = {k: F.coalesce(F.col("here") & v, F.lit(False)) for k, v in checks.items()}
    whole = F.lit(True)
    for v in checks.values():
        whole = whole & v
    return c.agg(F.count("*").alias("cases"), *[ratio(F.count_if(v), F.count("*")).alias(f"{k}_accuracy") for k, v in checks.items()], ratio(F.count_if(whole), F.count("*")).alias("all_fields"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with the records of the same title key: the exact phase; ``scored_candidates`` has the fuzzy one."""
    r = read(spark, sf_dir, "parsed_reference").select("ref_id", "parsed_title", "parsed_year", "parsed_venue", t.title_key(F.col("parsed_title")).alias("k")).where("k != ''")
    c = read(spark, sf_dir, "crossref_record").select("record_id", "crossref_title", "crossref_year", "crossref_venue", t.title_key(F.col("crossref_title")).alias("k")).where("k != ''")
    return r.join(c, "k")


@query("WITH r AS (SELECT ref_id, parsed_year AS y, regexp_replace(lower(parsed_title), '[^a-z0-9]+', '', 'g') AS k FROM parsed_reference), c AS (SELECT record_id, crossref_year AS z, regexp_replace(lower(crossref_title), '[^a-z0-9]+', '', 'g') AS k FROM crossref_record)"
       " SELECT ref_id, min(record_id) AS record_id, count(*) AS candidates, count(*) FILTER (y = z) AS same_year FROM r JOIN c USING (k) WHERE k <> '' GROUP BY ref_id")
def exact_title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("parsed_year") == F.col("crossref_year")
    return candidates(spark, sf_dir).groupBy("ref_id").agg(F.min("record_id").alias("record_id"), F.count("*").alias("candidates"), F.count_if(same).alias("same_year"))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that shares a blocking key, a damaged title's too, with the columns of both sides."""
    r = read(spark, sf_dir, "parsed_reference", wide=True).select("ref_id", "parsed_title", "parsed_year", "parsed_venue", "authors")
    c = read(spark, sf_dir, "crossref_record", wide=True).select("record_id", "crossref_title", "crossref_year", "crossref_venue", "crossref_authors")
    left = bibliography.keyed(r, "ref_id", "parsed_title", "authors", "parsed_year", True)
    right = bibliography.keyed(c, "record_id", "crossref_title", "crossref_authors", "crossref_year", False)
    pairs = materialize(left.join(right, "k").select("ref_id", "record_id").distinct(), "bib-candidates")
    return pairs.join(r, "ref_id").join(c, "record_id")


def pair_score() -> Column:
    return bibliography.match_score(F.col("title_like"), F.col("parsed_year"), F.col("crossref_year"), F.lit(False), F.col("same_authors"), F.col("venue_like"))


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidate_pairs`` with their score."""
    c = candidate_pairs(spark, sf_dir)
    c = c.withColumn("title_like", bibliography.fuzzy("parsed_title", "crossref_title")).withColumn("venue_like", bibliography.fuzzy("parsed_venue", "crossref_venue")).withColumn("same_authors", bibliography.author_match("authors", "crossref_authors"))
    return c.select("ref_id", "record_id", pair_score().alias("score"))


@query()
def bib_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_candidates(spark, sf_dir)


@query()
def bib_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each reference (the first of equal ones) and the status its score gives."""
    pairs = candidate_pairs(spark, sf_dir).repartition("ref_id").sortWithinPartitions("ref_id")  # a reference's pairs side by side
    pairs = pairs.withColumns({"parsed_year": F.col("parsed_year").cast("int"), "crossref_year": F.col("crossref_year").cast("int")})
    scored = bibliography.contenders(pairs).select("ref_id", "record_id", pair_score().alias("score"))
    best = scored.groupBy("ref_id").agg(F.max_by(F.struct("record_id", "score"), F.struct("score", -F.col("record_id"))).alias("b"))
    refs = read(spark, sf_dir, "parsed_reference").select("ref_id")
    joined = refs.join(best, "ref_id", "left")
    return joined.select("ref_id", "b.record_id", "b.score", bibliography.outcome(F.col("b.score"), F.lit(0), F.lit(1), F.lit(1)).alias("status"))


@query("WITH s AS (SELECT ref_id, unnest([{'source': 'crossref', 'failed': ref_id % 7 = 0, 'score': CASE WHEN ref_id % 3 = 0 THEN (ref_id % 100) / 100e0 END}, {'source': 'scholar', 'failed': ref_id % 14 = 0, 'score': CASE WHEN ref_id % 5 = 0 THEN (ref_id % 90) / 90e0 END}]) AS l FROM parsed_reference),"
       " a AS (SELECT ref_id, max(l.score) FILTER (NOT l.failed) AS best, count(*) FILTER (l.failed) AS failures, count(*) FILTER (NOT l.failed) AS answered, count(*) AS sources FROM s GROUP BY 1)"
       " SELECT ref_id, CASE WHEN best IS NOT NULL THEN CASE WHEN best >= 0.82e0 THEN 'verified' WHEN best >= 0.65e0 THEN 'partially_matched' ELSE 'unverified' END WHEN sources = 0 OR failures = sources THEN 'api_unavailable' WHEN answered > 0 THEN 'unverified' ELSE 'api_unavailable' END AS status FROM a")
def validation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of references after lookups that may have failed (two sources, simulated from the id)."""
    i = F.col("ref_id")
    looked = F.array(
        F.struct(F.lit("crossref").alias("source"), (i % 7 == 0).alias("failed"), F.when(i % 3 == 0, i % 100 / F.lit(100.0)).alias("score")),
        F.struct(F.lit("scholar").alias("source"), (i % 14 == 0).alias("failed"), F.when(i % 5 == 0, i % 90 / F.lit(90.0)).alias("score")),
    )
    s = read(spark, sf_dir, "parsed_reference").select("ref_id", F.explode(looked).alias("l")).select("ref_id", "l.*")
    a = s.groupBy("ref_id").agg(F.max(F.when(~F.col("failed"), F.col("score"))).alias("best"), F.count_if("failed").alias("failures"), F.count_if(~F.col("failed")).alias("answered"), F.count("*").alias("sources"))
    return a.select("ref_id", bibliography.outcome(F.col("best"), F.col("failures"), F.col("answered"), F.col("sources")).alias("status"))


_EV = f"ev AS (SELECT doc_id, {_STRIP.format('substr([p for p in parts[2:] if p[1] = $$E$$][-1], 2)')} AS evidence FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '(?im)^[ \\t]*(?:references|bibliography|works cited)[ \\t]*:?[ \\t]*$', chr(1) || 'R', 'g'), '(?im)^[ \\t]*(?:evidence passages?|sample evidence)[ \\t]*:?[ \\t]*$', chr(1) || 'E', 'g'), chr(1)) AS parts FROM documents))"


@query(rf"WITH {_EV}, pa AS (SELECT doc_id, [{_COLLAPSE} for p in string_split(regexp_replace(regexp_replace(evidence, '\n\s*\n', chr(1), 'g'), '(\.)\s*\n', '\1' || chr(1), 'g'), chr(1)) if {_COLLAPSE} <> ''] AS v FROM ev WHERE evidence <> ''), ps AS (SELECT doc_id, unnest(range(len(v))) AS pos, unnest(v) AS passage FROM pa)"
       " SELECT doc_id, pos, passage FROM ps QUALIFY row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')) ORDER BY pos) = 1")
def evidence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the evidence section, each once per document by its normalised words, the first kept."""
    d = read(spark, sf_dir, "documents").select("doc_id", t.sections(F.col("text"))["evidence_text"].alias("e")).where("e != ''")
    p = d.select("doc_id", F.posexplode(t.evidence_paragraphs(F.col("e"))).alias("pos", "passage")).withColumn("k", t.marker(F.col("passage")))
    return tables.keep_first(p, ["doc_id", "k"], "pos").drop("k")


@query(f"SELECT parsed_venue, count(*) AS cnt, {r3('avg(CASE WHEN doi IS NULL THEN 0e0 ELSE 1e0 END)')} AS with_doi, min(parsed_year) AS first_year, max(parsed_year) AS last_year FROM parsed_reference GROUP BY 1")
def venue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "parsed_reference").groupBy("parsed_venue").agg(
        F.count("*").alias("cnt"), round_half_up(F.avg(F.when(F.col("doi").isNull(), 0.0).otherwise(1.0))).alias("with_doi"), F.min("parsed_year").alias("first_year"), F.max("parsed_year").alias("last_year")
    )
