"""Queries over claims, their citations and evidence: classification, carried state, resolution, retrieval, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.functions.numbers import r3, ratio, round_half_up
from docgrain.operators import citations, claims, dense, lexical, retrieval, tables
from docgrain.operators import evaluation as ev
from docgrain.plans.text_queries import rx, sql_parts, sql_tokens
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


def has(x: str, *patterns: str) -> str:
    return f"regexp_matches({x}, {rx('|'.join(f'(?:{p})' for p in patterns))})"


CITED = "|".join(f"(?:{p})" for p in (t.NUMERIC, t.NARRATIVE, t.PARENTHETICAL))


def cited(sentence: F.Column) -> F.Column:
    return sentence.rlike(CITED)


_SCORED = (
    "b AS (SELECT claim_id, document, sentence_index, sentence AS raw, trim(sentence) AS s, lower(trim(sentence)) AS low, " + has("sentence", CITED) + " AS own FROM claim),"
    f" p AS (SELECT *, CASE WHEN own THEN 2 ELSE 0 END + CASE WHEN {has('low', *claims.FACTUAL)} THEN 2 ELSE 0 END + CASE WHEN {has('low', claims.NUMBER)} THEN 1 ELSE 0 END AS f,"
    f" CASE WHEN {has('low', *claims.METHOD)} THEN 3 ELSE 0 END + CASE WHEN {has('low', claims.FIRST_PERSON)} THEN 1 ELSE 0 END AS m, CASE WHEN {has('low', *claims.OPINION)} THEN 2 ELSE 0 END AS o, CASE WHEN {has('low', *claims.DEFINITION)} THEN 3 ELSE 0 END AS d,"
    r" len([w for w in regexp_split_to_array(s, '\s+') if w <> '']) < 4 OR regexp_matches(s, '^[\d\W]+$') OR regexp_matches(s, '^[A-Z][A-Za-z ]{0,80}$') AS bare FROM b),"
    " ct AS (SELECT *, CASE WHEN bare THEN 'non_claim' WHEN m >= 3 THEN 'methodological_statement' WHEN d >= 3 AND f <= 3 THEN 'background_or_definition' WHEN o >= 2 AND f < 3 THEN 'opinion_or_interpretation' WHEN f > 0 THEN 'factual_claim' ELSE 'non_claim' END AS kind,"
    f" CASE WHEN bare THEN 0.85e0 WHEN m >= 3 THEN least(0.95e0, {r3('0.55e0 + m * 0.1e0', 2)}) WHEN d >= 3 AND f <= 3 THEN least(0.95e0, {r3('0.55e0 + d * 0.1e0', 2)}) WHEN o >= 2 AND f < 3 THEN least(0.95e0, {r3('0.55e0 + o * 0.1e0', 2)}) WHEN f > 0 THEN least(0.95e0, {r3('0.55e0 + f * 0.1e0', 2)}) ELSE 0.7e0 END AS conf FROM p)"
)


@query(f"WITH {_SCORED} SELECT claim_id, kind AS claim_type, conf AS classification_confidence FROM ct")
def claim_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "claim").select("claim_id", "sentence")
    return claims.scored(c, "sentence", cited(F.col("sentence"))).select("claim_id", "claim_type", "classification_confidence")


_EXEMPT = ", ".join(f"'{e}'" for e in claims.EXEMPT)
_CARRIED = (
    f"{_SCORED}, sec AS (SELECT *, regexp_replace(lower(coalesce(nullif(regexp_extract(left(raw, 240), {rx(claims.NUMBERED_SECTION)}, 1), ''), nullif(regexp_extract(left(raw, 240), {rx(claims.PLAIN_SECTION)}, 1), ''))), 's+$', '') AS found FROM ct),"
    " car AS (SELECT *, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY document ORDER BY sentence_index, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS section FROM sec),"
    f" req AS (SELECT *, kind = 'factual_claim' AND section NOT IN ({_EXEMPT}) AND NOT {has('lower(raw)', claims.OWN_WORK)} AS required FROM car),"
    f" el AS (SELECT *, required AND NOT own AND {has('lower(raw)', claims.FOLLOWS)} AS eligible FROM req),"
    " isl AS (SELECT *, sum(CASE WHEN own OR NOT eligible THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY sentence_index, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM el),"
    " inh AS (SELECT *, eligible AND coalesce(first_value(own) OVER (PARTITION BY document, island ORDER BY sentence_index, claim_id), false) AS inherits FROM isl),"
    " fin AS (SELECT *, required AND NOT own AND NOT inherits AS missing FROM inh)"
)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "claim").select("claim_id", "document", F.struct("sentence_index", "claim_id").alias("place"), "sentence")
    return claims.classify(c, "document", "place", "sentence", cited(F.col("sentence")), F.floor(F.col("place.sentence_index") / claims.BLOCK))


@query(f"WITH {_CARRIED} SELECT claim_id, section FROM fin")
def section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("claim_id", "section")


@query(f"WITH {_CARRIED} SELECT claim_id, kind AS claim_type, missing AS missing_citation, CASE WHEN own THEN 'same_sentence' WHEN inherits THEN 'previous_sentence' ELSE 'none' END AS citation_context, CASE WHEN NOT missing THEN 'none' WHEN {has('lower(raw)', claims.ABSOLUTE, claims.EVIDENCE)} THEN 'high' ELSE 'medium' END AS flag_severity FROM fin")
def citation_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("claim_id", "claim_type", "missing_citation", "citation_context", "flag_severity")


@query(f"WITH {_CARRIED} SELECT c.claim_type AS expected, f.kind AS predicted, count(*) AS cnt FROM fin f JOIN claim c USING (claim_id) GROUP BY 1, 2")
def claim_type_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule classifier against the stored types."""
    gold = read(spark, sf_dir, "claim").select("claim_id", F.col("claim_type").alias("expected"))
    return ev.confusion(classified(spark, sf_dir).select("claim_id", F.col("claim_type").alias("predicted")).join(gold, "claim_id"))


@query(f"WITH {_CARRIED} SELECT document, count(*) AS sentences, count(*) FILTER (own) AS cited, count(*) FILTER (kind = 'factual_claim') AS factual, count(*) FILTER (missing) AS missing, count(*) FILTER (inherits) AS inherited FROM fin GROUP BY document")
def module_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return classified(spark, sf_dir).groupBy("document").agg(
        F.count("*").alias("sentences"), F.count_if(c("citation_context") == "same_sentence").alias("cited"), F.count_if(c("claim_type") == "factual_claim").alias("factual"),
        F.count_if("missing_citation").alias("missing"), F.count_if(c("citation_context") == "previous_sentence").alias("inherited"),
    )


# ---- citations to references ----

_ENDS = "[TRY_CAST(n AS BIGINT) for n in regexp_extract_all(x, '[0-9]+')]"
_NUMS = (
    "nums AS (SELECT DISTINCT citation_id, document, unnest(regexp_extract_all(raw_text, '[0-9]+') || flatten([CASE WHEN "
    + f"{_ENDS}[1] <= {_ENDS}[2] AND {_ENDS}[2] - {_ENDS}[1] <= {citations.LONGEST_RANGE} THEN [CAST(i AS VARCHAR) for i in range({_ENDS}[1], {_ENDS}[2] + 1)] ELSE [] END for x in regexp_extract_all(raw_text, '[0-9]+\\s*[-–—]\\s*[0-9]+')]))"
    " AS marker FROM citation WHERE citation_type = 'numeric'), refs AS (SELECT document, reference_index, ref_id FROM parsed_reference WHERE reference_index IS NOT NULL)"
)


def _markers(raw: F.Column) -> F.Column:
    """Numbers written in a text and those inside its ranges; ranges of more than LONGEST_RANGE give their ends."""
    written = lambda s: F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))

    def inside(span: F.Column) -> F.Column:
        a, z = F.element_at(written(span), 1).try_cast("bigint"), F.element_at(written(span), 2).try_cast("bigint")
        short = (a <= z) & (z - a <= citations.LONGEST_RANGE)
        return F.when(short, F.sequence(a, F.greatest(a, z)).cast("array<string>")).otherwise(F.array().cast("array<string>"))

    spans = F.regexp_extract_all(raw, F.lit(r"[0-9]+\s*[-–—]\s*[0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(written(raw), F.flatten(F.transform(spans, inside))))


@query(f"WITH {_NUMS} SELECT n.citation_id, n.marker, max(r.ref_id) AS ref_id FROM nums n JOIN refs r ON r.document = n.document AND r.reference_index = n.marker GROUP BY 1, 2")
def citation_resolve_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric markers joined to the reference with that index in the same report; of equal indices the last wins.
    The numbers inside a range are markers too.

    References are reduced to one per (report, index) before the join, so a hot report joins single rows."""
    c = read(spark, sf_dir, "citation").where("citation_type = 'numeric'").select("citation_id", "document", F.explode(_markers(F.col("raw_text"))).alias("marker")).distinct()
    refs = read(spark, sf_dir, "parsed_reference").where("reference_index is not null").groupBy("document", F.col("reference_index").alias("marker")).agg(F.max("ref_id").alias("ref_id"))
    return c.join(refs, ["document", "marker"]).select("citation_id", "marker", "ref_id")


_AUTHOR = (
    "ci AS (SELECT DISTINCT citation_id, document, cited_year, lower(author_hint) AS hint FROM citation WHERE author_hint <> ''),"
    " w AS (SELECT ref_id, document, parsed_year, lower(concat_ws(' ', raw_text, array_to_string(authors, ' '))) AS named FROM parsed_reference)"
)


def words_naming(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(document, word, hint): the distinct ``words`` (document, word) of which a hint of ``asked`` (document, hint) is a part. Each word and
    each hint is cut once, not once a report: they meet by the hint's first three letters, wherever in the word these stand."""
    asked = asked.select("document", "hint").distinct()
    own = words.join(asked, "document", "left_semi").select("document", "word").distinct()
    starts = "array_distinct(flatten(transform(sequence(1, length(word)), i -> array(substr(word, i, 1), substr(word, i, 2), substr(word, i, 3)))))"
    parts = own.select("word").distinct().withColumn("start", F.explode(F.expr(starts)))
    hints = asked.select("hint", F.left("hint", F.lit(3)).alias("start")).distinct()
    naming = parts.join(hints, "start").where(F.contains("word", "hint")).select("word", "hint")
    return own.join(naming, "word").join(asked, ["document", "hint"]).select("document", "word", "hint")


@query(f"WITH {_AUTHOR} SELECT citation_id, min(ref_id) AS ref_id FROM ci JOIN w ON w.document = ci.document AND contains(w.named, ci.hint) AND (ci.cited_year IS NULL OR w.parsed_year IS NULL OR ci.cited_year = w.parsed_year) GROUP BY 1")
def citation_resolve_author_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author-year citations to the first reference of the report with a compatible year that names the author: whose
    authors or text have the hint, which is without blanks, as a part.

    The substring test runs on a report's distinct words that have the hint's first letters in a row, never on pairs of rows."""
    c = read(spark, sf_dir, "citation").where("author_hint != ''").select("citation_id", "document", "cited_year", F.lower("author_hint").alias("hint")).distinct()
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "raw_text", "authors")), r"\s+"))
    w = read(spark, sf_dir, "parsed_reference").select("ref_id", "document", "parsed_year", F.explode(words).alias("word")).where("word != ''")
    w = w.groupBy("document", "word", "parsed_year").agg(F.min("ref_id").alias("ref_id"))
    first = w.join(words_naming(w, c), ["document", "word"]).groupBy("document", "hint", "parsed_year").agg(F.min("ref_id").alias("ref_id"))
    compatible = F.col("cited_year").isNull() | F.col("parsed_year").isNull() | (F.col("cited_year") == F.col("parsed_year"))
    return c.join(first, ["document", "hint"]).where(compatible).groupBy("citation_id").agg(F.min("ref_id").alias("ref_id"))


@query(f"WITH {_NUMS}, x AS (SELECT DISTINCT n.citation_id, CAST(n.marker AS BIGINT) AS i FROM nums n JOIN refs r ON r.document = n.document AND r.reference_index = n.marker) SELECT citation_id, string_agg(i, '; ' ORDER BY i) AS indices FROM x GROUP BY 1")
def cited_reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct resolved indices of each citation, sorted as numbers."""
    found = citation_resolve_numeric(spark, sf_dir).select("citation_id", F.col("marker").cast("bigint").alias("i")).distinct()
    return found.groupBy("citation_id").agg(F.array_join(F.sort_array(F.collect_list("i")).cast("array<string>"), "; ").alias("indices"))


@query("SELECT c.claim_id, count(t.citation_id) AS citations, coalesce(max(t.cited_year), 0) AS latest FROM claim c LEFT JOIN (SELECT DISTINCT citation_id, claim_id, cited_year FROM citation) t USING (claim_id) GROUP BY 1")
def claims_with_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t_ = read(spark, sf_dir, "citation").select("citation_id", "claim_id", "cited_year").distinct()
    return read(spark, sf_dir, "claim").select("claim_id").join(t_, "claim_id", "left").groupBy("claim_id").agg(F.count("citation_id").alias("citations"), F.coalesce(F.max("cited_year"), F.lit(0)).alias("latest"))


@query("SELECT DISTINCT t.citation_id, t.claim_id, c.section, c.lang FROM citation t JOIN claim c USING (claim_id)")
def citations_with_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every citation with the claim it stands in; a citation of an unknown claim is an error."""
    cited_ = read(spark, sf_dir, "citation").select("citation_id", "claim_id").distinct()
    return tables.matched(cited_, read(spark, sf_dir, "claim").select("claim_id", "section", "lang"), "claim_id").select("citation_id", "claim_id", "section", "lang")


# ---- evidence retrieval and verdicts ----

_PASS = f"ps AS (SELECT case_id, unnest(range(len(v))) AS pos, unnest(v) AS passage FROM (SELECT case_id, {sql_parts(r'''regexp_replace(regexp_replace(evidence, '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), '(;)\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')''')} AS v FROM claimguard_benchmark))"
_BIG = "CASE WHEN len({0}) > 1 THEN list_distinct([{0}[i] || ' ' || {0}[i + 1] for i in range(1, len({0}))]) ELSE [] END"
_RUNS = "([array_to_string({0}[i : i + 3], ' ') for i in range(1, len({0}) - 2)] || [array_to_string({0}[i : i + 2], ' ') for i in range(1, len({0}) - 1)])"
_SCORE = (
    f"tk AS (SELECT b.case_id, b.claim, p.pos, p.passage, {sql_tokens('b.claim')} AS q, {sql_tokens('p.passage')} AS k FROM claimguard_benchmark b JOIN ps p USING (case_id)),"
    f" ft AS (SELECT *, list_distinct(q) AS qd, list_distinct(k) AS kd, {_BIG.format('q')} AS qb, {_BIG.format('k')} AS kb, array_to_string(k, ' ') AS joined, {_RUNS.format('q')} AS runs FROM tk),"
    " nm AS (SELECT *, list_intersect(qd, kd) AS sh, sqrt(CAST(list_sum([len([x for x in q if x = w]) * len([x for x in q if x = w]) for w in qd]) AS DOUBLE)) * sqrt(CAST(list_sum([len([x for x in k if x = w]) * len([x for x in k if x = w]) for w in kd]) AS DOUBLE)) AS norm FROM ft),"
    " dt AS (SELECT *, CAST(coalesce(list_sum([len([x for x in q if x = w]) * len([x for x in k if x = w]) for w in sh]), 0) AS DOUBLE) AS dot FROM nm),"
    f" sc AS (SELECT case_id, claim, pos, passage, q, CASE WHEN len(qd) = 0 OR len(kd) = 0 THEN 0e0 ELSE {r3('least(1e0, 0.40e0 * (CASE WHEN norm > 0 THEN dot / norm ELSE 0e0 END) + 0.32e0 * (CAST(len(sh) AS DOUBLE) / len(qd)) + 0.12e0 * (CAST(len(sh) AS DOUBLE) / len(list_distinct(qd || kd))) + 0.16e0 * (CASE WHEN len(qb) > 0 THEN CAST(len(list_intersect(qb, kb)) AS DOUBLE) / len(qb) ELSE 0e0 END) + CASE WHEN len([r for r in runs if contains(joined, r)]) > 0 THEN 0.06e0 ELSE 0e0 END)')} END AS score FROM dt),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, pos) AS rank FROM sc)"
)


def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each case's evidence with their score and rank for the case's claim."""
    b = read(spark, sf_dir, "claimguard_benchmark").select("case_id", "claim", t.tokens(F.col("claim")).alias("claim_tokens"), F.posexplode(t.retrieval_sentences(F.col("evidence"))).alias("pos", "passage"))
    s = b.withColumn("score", retrieval.lexical_score(F.col("claim_tokens"), t.tokens(F.col("passage"))))
    return tables.top_k(s, ["case_id"], [F.desc("score"), F.col("pos")], 1_000_000)


@query(f"WITH {_PASS}, {_SCORE} SELECT case_id, pos, score, rank FROM rk")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_scores(spark, sf_dir).select("case_id", "pos", "score", "rank")


_GENERAL = ", ".join(f"'{g}'" for g in retrieval.GENERAL)
_CONF = "least({cap}, greatest(0.05e0, best * 0.42e0 + mean_top * 0.20e0 + coverage * 0.28e0 + {cue} * 0.10e0))"


def _conf(cue: str, cap: str = "0.92e0") -> str:
    return r3(_CONF.format(cue=cue, cap=cap))


_R = retrieval
_VERDICT = (
    f"ga AS (SELECT b.case_id, b.claim, b.expected_label, {sql_tokens('b.claim')} AS q, g.combined, g.best, g.mean_top FROM claimguard_benchmark b LEFT JOIN (SELECT case_id, string_agg(passage, ' ' ORDER BY rank) AS combined, max(score) AS best, avg(score) FILTER (rank <= 3) AS mean_top FROM rk WHERE rank <= 5 AND score >= 0.08e0 GROUP BY 1) g USING (case_id)),"
    f" im AS (SELECT *, [w for w in list_distinct(q) if w NOT IN ({_GENERAL})] AS own, {sql_tokens('combined')} AS ev, lower(claim) AS c, lower(combined) AS e FROM ga),"
    f" cv AS (SELECT *, CASE WHEN len(ev) > 0 AND len(own) > 0 THEN {r3('CAST(len(list_intersect(own, list_distinct(ev))) AS DOUBLE) / len(own)')} ELSE 0e0 END AS coverage,"
    f" greatest(CASE WHEN {has('c', _R.ABSOLUTES)} AND {has('e', _R.NEGATION)} THEN 0.75e0 ELSE 0e0 END, CASE WHEN {has('c', _R.ABSOLUTES)} AND {has('e', _R.DEPENDS)} THEN 0.65e0 ELSE 0e0 END, CASE WHEN {has('c', _R.UP)} AND {has('e', _R.NOT_UP)} THEN 0.75e0 ELSE 0e0 END, CASE WHEN {has('c', _R.DOWN)} AND {has('e', _R.NOT_DOWN)} THEN 0.75e0 ELSE 0e0 END, CASE WHEN contains(c, 'requires no') AND {has('e', _R.NEEDS)} THEN 0.8e0 ELSE 0e0 END) AS against,"
    f" CASE WHEN {has('e', _R.UNTESTED)} THEN 0.7e0 WHEN {has('e', _R.SILENT)} THEN 0.6e0 ELSE 0e0 END AS silent FROM im),"
    " ve AS (SELECT case_id, expected_label, CASE WHEN best IS NULL THEN 'insufficient_evidence' WHEN against >= 0.45e0 THEN 'contradicted' WHEN silent >= 0.45e0 THEN 'not_supported' WHEN best < 0.14e0 AND coverage < 0.25e0 THEN 'insufficient_evidence' WHEN best >= 0.52e0 AND coverage >= 0.55e0 THEN 'supported' WHEN best >= 0.25e0 OR coverage >= 0.35e0 THEN 'partially_supported' ELSE 'not_supported' END AS status,"
    f" CASE WHEN best IS NULL THEN 0e0 WHEN against >= 0.45e0 THEN {_conf('against')} WHEN silent >= 0.45e0 THEN {_conf('silent')} WHEN best < 0.14e0 AND coverage < 0.25e0 THEN {r3('greatest(0.05e0, best)')} WHEN best >= 0.52e0 AND coverage >= 0.55e0 THEN {_conf('0.15e0')} WHEN best >= 0.25e0 OR coverage >= 0.35e0 THEN {_conf('0e0', '0.78e0')} ELSE {_conf('0e0', '0.62e0')} END AS confidence, coverage FROM cv)"
)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "claimguard_benchmark").select("case_id", "claim", "expected_label", t.tokens(F.col("claim")).alias("claim_tokens"))
    evidence = retrieval.gathered(case_scores(spark, sf_dir), "case_id")
    return retrieval.judge(cases.join(evidence, "case_id", "left"))


@query(f"WITH {_PASS}, {_SCORE}, {_VERDICT} SELECT case_id, status, confidence, coverage FROM ve")
def lexical_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("case_id", "status", "confidence", "coverage")


@query(f"WITH {_PASS}, {_SCORE}, {_VERDICT} SELECT expected_label AS expected, status AS predicted, count(*) AS cnt FROM ve GROUP BY 1, 2")
def verdict_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(verdicts(spark, sf_dir).select(F.col("expected_label").alias("expected"), F.col("status").alias("predicted")))


_CHUNKS = r"ck AS (SELECT doc_id, CAST(k / 75 AS INTEGER) AS chunk_no, row_number() OVER () AS p, array_to_string(w[k + 1 : k + 95], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 75)) AS k FROM (SELECT doc_id, [w for w in regexp_split_to_array(text, '\s+') if w <> ''] AS w FROM documents)))"
_INV = (
    f"{_CHUNKS}, tp AS MATERIALIZED (SELECT p, doc_id, chunk_no, {sql_tokens('chunk')} AS k FROM ck), tq AS (SELECT case_id AS q, {sql_tokens('claim')} AS k FROM claimguard_benchmark),"
    " pt AS (SELECT p, w, count(*) AS n FROM (SELECT p, unnest(k) AS w FROM tp) GROUP BY 1, 2), qt AS (SELECT q, w, count(*) AS n FROM (SELECT q, unnest(k) AS w FROM tq) GROUP BY 1, 2),"
    " pn AS (SELECT p, count(*) AS size, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM pt GROUP BY 1), qn AS (SELECT q, count(*) AS size, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM qt GROUP BY 1),"
    " pr AS (SELECT q, p, count(*) AS shared, CAST(sum(qt.n * pt.n) AS DOUBLE) AS dot FROM qt JOIN pt USING (w) GROUP BY 1, 2),"
    f" pb AS (SELECT p, unnest({_BIG.format('k')}) AS w FROM tp), qb AS (SELECT q, unnest({_BIG.format('k')}) AS w FROM tq), bs AS (SELECT q, p, count(*) AS pairs FROM qb JOIN pb USING (w) GROUP BY 1, 2), bn AS (SELECT q, count(*) AS pairs FROM qb GROUP BY 1),"
    f" ru AS (SELECT q, {_RUNS.format('k')} AS runs FROM tq), jo AS (SELECT p, doc_id, chunk_no, array_to_string(k, ' ') AS joined FROM tp),"
    f" so AS (SELECT q, doc_id, chunk_no, {r3('least(1e0, 0.40e0 * (dot / (qn.norm * pn.norm)) + 0.32e0 * (CAST(shared AS DOUBLE) / qn.size) + 0.12e0 * (CAST(shared AS DOUBLE) / (qn.size + pn.size - shared)) + 0.16e0 * coalesce(CAST(bs.pairs AS DOUBLE) / bn.pairs, 0e0) + CASE WHEN len([r for r in runs if contains(joined, r)]) > 0 THEN 0.06e0 ELSE 0e0 END)')} AS score"
    " FROM pr JOIN qn USING (q) JOIN pn USING (p) JOIN ru USING (q) JOIN jo USING (p) LEFT JOIN bs USING (q, p) LEFT JOIN bn USING (q))"
)


@query(f"WITH {_INV} SELECT q AS case_id, doc_id, chunk_no, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, chunk_no) AS rank FROM so WHERE score >= 0.08e0 QUALIFY rank <= 5")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best chunks of the corpus for every claim by the whole lexical score: a top-k report."""
    d = read(spark, sf_dir, "documents", wide=True).select("doc_id", F.posexplode(t.fixed_word_chunks(F.col("text"), 95, 20)).alias("chunk_no", "chunk"))
    chunks = d.select("doc_id", "chunk_no", t.tokens(F.col("chunk")).alias("toks"))
    asked = read(spark, sf_dir, "claimguard_benchmark").select(F.col("case_id").alias("q"), t.tokens(F.col("claim")).alias("toks"))
    return lexical.top_chunks(asked, chunks, 5).withColumnRenamed("q", "case_id")


@query(f"WITH {_INV}, rk AS (SELECT q, doc_id, chunk_no, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, chunk_no) AS rank FROM so WHERE score >= 0.08e0 QUALIFY rank <= 5) SELECT q AS case_id, doc_id, min(rank) AS first_rank, count(*) AS chunks, any_value(source) AS source, any_value(report) AS report FROM rk JOIN documents d USING (doc_id) GROUP BY 1, 2")
def retrieved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the five best chunks of each claim, with their best rank, source and report."""
    found = lexical_topk(spark, sf_dir).groupBy("case_id", "doc_id").agg(F.min("rank").alias("first_rank"), F.count("*").alias("chunks"))
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "report")
    return tables.matched(found, d, "doc_id").select("case_id", "doc_id", "first_rank", "chunks", "source", "report")


def neighbours(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return dense.top_matches(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", k)


_DENSE = "qs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 50 = 0), al AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id AS match_id, v.label AS vl, list_dot_product(q.e, CAST(v.embedding AS DOUBLE[])) AS score, list_dot_product(q.e[1:32], CAST(v.embedding[1:32] AS DOUBLE[])) AS half FROM qs q JOIN embeddings v ON v.vec_id <> q.vec_id), rd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM al)"


@query(f"WITH {_DENSE} SELECT query_id, match_id, {r3('score + 1e0', 4)} AS score, rank FROM rd WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every query vector (those with an id divisible by 50) among all others."""
    return neighbours(spark, sf_dir, 10).select("query_id", "match_id", round_half_up(F.col("score") + 1.0, 4).alias("score"), "rank")


@query(f"WITH {_DENSE}, po AS (SELECT * FROM rd WHERE rank <= 50 AND vl % 2 = 0) SELECT query_id, match_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM po QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search first, filter then: of the best 50 those that are allowed (here an even label), at most ten; there may be fewer."""
    allowed = read(spark, sf_dir, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("match_id"))
    pool = neighbours(spark, sf_dir, 50).withColumnRenamed("rank", "place").join(allowed, "match_id", "left_semi")
    return tables.top_k(pool, ["query_id"], [F.col("place")], 10).select("query_id", "match_id", "rank")


def labelled(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    label = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = neighbours(spark, sf_dir, k)
    n = n.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return n.join(label.select(F.col("vec_id").alias("match_id"), F.col("label").alias("vl")), "match_id").withColumn("hit", F.col("ql") == F.col("vl"))


@query(f"WITH {_DENSE}, f AS (SELECT query_id, min(rank) FILTER (ql = vl AND rank <= 20) AS h FROM rd GROUP BY 1) SELECT count(*) AS queries, {r3('CAST(count(*) FILTER (h <= 5) AS DOUBLE) / count(*)')} AS recall_at_5, {r3('CAST(count(*) FILTER (h <= 10) AS DOUBLE) / count(*)')} AS recall_at_10, {r3('avg(CASE WHEN h <= 10 THEN 1e0 / h ELSE 0e0 END)')} AS mrr FROM f")
def dense_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return ev.hit_rate_and_mrr(labelled(spark, sf_dir), queries, "query_id", "rank", "hit", (5, 10))


_RERANK = f"{_DENSE}, fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY half DESC, match_id) AS first_rank FROM al), rr AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM (SELECT *, 0 AS rank FROM fr WHERE first_rank <= 20))"


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, match_id, first_rank, rank, hit): the best 20 by the first half of the vectors, reordered by whole vectors."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    half = e.select("vec_id", F.slice("embedding", 1, 32).alias("half"))
    pool = dense.top_matches(half, half.where("vec_id % 50 = 0"), "vec_id", "half", 20).withColumnRenamed("rank", "first_rank").drop("score")
    side = lambda key, v, label: e.select(F.col("vec_id").alias(key), F.col("embedding").alias(v), F.col("label").alias(label))
    both = pool.join(side("query_id", "a", "ql"), "query_id").join(side("match_id", "b", "vl"), "match_id")
    scored = both.withColumn("second", dense.inner(F.col("a"), F.col("b"))).drop("a", "b")
    return tables.top_k(scored, ["query_id"], [F.desc("second"), F.col("first_rank")], 20).withColumn("hit", F.col("ql") == F.col("vl"))


@query(f"WITH {_RERANK} SELECT query_id, match_id, first_rank, rank FROM rr WHERE rank <= 5")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 by a cheap score (half of the vector) reordered by the whole one, the best 5 kept."""
    return reranked(spark, sf_dir).where("rank <= 5").select("query_id", "match_id", "first_rank", "rank")


@query(f"WITH {_RERANK}, f AS (SELECT query_id, min(first_rank) FILTER (ql = vl) AS base, min(rank) FILTER (ql = vl) AS re FROM rr GROUP BY 1)"
       " SELECT query_id, CASE WHEN base <= 5 AND coalesce(re, 99) > 5 THEN 'reranking regression' WHEN coalesce(re, 99) <= 5 THEN 'found' WHEN base <= 20 THEN 'ranked too low' ELSE 'representation miss' END AS outcome FROM f")
def failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reranked(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("first_rank"))).alias("base"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("re"))
    re = F.coalesce("re", F.lit(99))
    return f.select("query_id", F.when((F.col("base") <= 5) & (re > 5), "reranking regression").when(re <= 5, "found").when(F.col("base") <= 20, "ranked too low").otherwise("representation miss").alias("outcome"))


@query(f"WITH {_PASS}, x AS (SELECT b.case_id, b.claim, p.pos, p.passage, {sql_tokens('b.claim')} AS q, {sql_tokens('p.passage')} AS k FROM claimguard_benchmark b JOIN ps p USING (case_id)) SELECT case_id, pos, {r3('CAST(len(list_intersect(list_distinct(q), list_distinct(k))) AS DOUBLE) / len(list_distinct(q))')} AS containment, {r3('CAST(len(list_intersect(list_distinct(q), list_distinct(k))) AS DOUBLE) / len(list_distinct(q || k))')} AS jaccard FROM x")
def token_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "claimguard_benchmark").select("case_id", t.tokens(F.col("claim")).alias("q"), F.posexplode(t.retrieval_sentences(F.col("evidence"))).alias("pos", "passage"))
    q, k = F.array_distinct("q"), F.array_distinct(t.tokens(F.col("passage")))
    shared = F.size(F.array_intersect(q, k))
    return b.select("case_id", "pos", ratio(shared, F.size(q)).alias("containment"), ratio(shared, F.size(F.array_union(q, k))).alias("jaccard"))
