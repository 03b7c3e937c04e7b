"""Text queries over documents, claims, citations and references; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.functions.numbers import r3, ratio, round_half_up
from docgrain.operators.plugins import detected, register_detector
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


def rx(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


STOP = ", ".join(f"'{w}'" for w in t.RETRIEVAL_STOPWORDS)
STEM = "CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"


def sql_tokens(x: str) -> str:
    return f"[{STEM} for w in regexp_extract_all(lower({x}), '[a-z0-9]+') if length(w) > 2 AND w NOT IN ({STOP})]"


def sql_parts(x: str) -> str:
    return f"[trim(p) for p in string_split({x}, chr(1)) if trim(p) <> '']"


def _sql_sentences(x: str) -> str:
    heading = rf"(?im)^\s*((?:\d+(?:\.\d+)*)?\s*(?:{t.SECTIONS}))\s*$"
    body = f"trim(regexp_replace(regexp_replace({x}, {rx(heading)}, '\\1. ', 'g'), '\\s+', ' ', 'g'))"
    for k, a in enumerate(t.ABBREVIATIONS):
        body = f"replace({body}, '{a}', chr(2) || '{k}' || chr(2))"
    restored = "p"
    for k, a in enumerate(t.ABBREVIATIONS):
        restored = f"replace({restored}, chr(2) || '{k}' || chr(2), '{a}')"
    cut = rf"regexp_replace({body}, '([.!?])\s+([A-Z0-9\[\(])', '\1' || chr(1) || '\2', 'g')"
    return f"[trim({restored}) for p in string_split({cut}, chr(1)) if trim(p) <> '']"


def _listed(table: str, key: str, expression: str, name: str) -> str:
    return f"WITH l AS (SELECT {key}, {expression} AS v FROM {table}) SELECT {key}, unnest(range(len(v))) AS pos, unnest(v) AS {name} FROM l"


def _exploded(df: DataFrame, key: str, values: F.Column, name: str) -> DataFrame:
    return df.select(key, F.posexplode(values).alias("pos", name))


@query(_listed("documents", "doc_id", _sql_sentences("text"), "sentence"))
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(read(spark, sf_dir, "documents", wide=True), "doc_id", t.sentences(F.col("text")), "sentence")


@query(_listed("documents", "doc_id", sql_parts(r"regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')"), "sentence"))
def style_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(read(spark, sf_dir, "documents", wide=True), "doc_id", t.style_sentences(F.col("text")), "sentence")


@query(_listed("claim", "claim_id", sql_parts(r"regexp_replace(regexp_replace(sentence, '([.!?])\s+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), '(;)\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')"), "sentence"))
def retrieval_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(read(spark, sf_dir, "claim"), "claim_id", t.retrieval_sentences(F.col("sentence")), "sentence")


_COLLAPSE = r"trim(regexp_replace(p, '\s+', ' ', 'g'))"


@query(_listed("documents", "doc_id", rf"[{_COLLAPSE} for p in string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '(\.)\s*\n', '\1' || chr(1), 'g'), chr(1)) if {_COLLAPSE} <> '']", "paragraph"))
def evidence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(read(spark, sf_dir, "documents", wide=True), "doc_id", t.evidence_paragraphs(F.col("text")), "paragraph")


@query(_listed("documents", "doc_id", rf"[{_COLLAPSE} for p in string_split(regexp_replace(text, '\n\s*\n', chr(1), 'g'), chr(1)) if {_COLLAPSE} <> '']", "paragraph"))
def style_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(read(spark, sf_dir, "documents", wide=True), "doc_id", t.style_paragraphs(F.col("text")), "paragraph")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("WITH m AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '(?im)^[ \\t]*(?:references|bibliography|works cited)[ \\t]*:?[ \\t]*$', chr(1) || 'R', 'g'), '(?im)^[ \\t]*(?:evidence passages?|sample evidence)[ \\t]*:?[ \\t]*$', chr(1) || 'E', 'g'), chr(1)) AS parts FROM documents)"
       f" SELECT doc_id, CASE WHEN len(parts) > 1 THEN {_STRIP.format('parts[1]')} ELSE text END AS main_text,"
       f" coalesce({_STRIP.format('substr([p for p in parts[2:] if p[1] = $$R$$][-1], 2)')}, '') AS references_text,"
       f" coalesce({_STRIP.format('substr([p for p in parts[2:] if p[1] = $$E$$][-1], 2)')}, '') AS evidence_text FROM m")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", wide=True).select("doc_id", t.sections(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"WITH k AS (SELECT doc_id, {sql_tokens('text')} AS v FROM documents) SELECT doc_id, len(v) AS tokens, len(list_distinct(v)) AS distinct_tokens, coalesce(list_max([length(x) for x in v]), 0) AS longest FROM k")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", wide=True).select("doc_id", t.tokens(F.col("text")).alias("v"))
    return d.select("doc_id", F.size("v").alias("tokens"), F.size(F.array_distinct("v")).alias("distinct_tokens"), F.coalesce(F.array_max(F.transform("v", F.length)), F.lit(0)).alias("longest"))


_REVIEW = r"[w for w in regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '<br\s*/?>', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+') if w <> '']"
_VOCAB = f"k AS (SELECT doc_id, unnest({_REVIEW}) AS token, unnest(range(len({_REVIEW}))) AS pos FROM documents), c AS (SELECT token, count(*) AS cnt, min((doc_id, pos)) AS f FROM k GROUP BY 1 HAVING count(*) >= 2 ORDER BY cnt DESC, f LIMIT 19998), vocab AS (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, f) + 1 AS token_id FROM c)"


#: Rows of the vocabulary with the two special ids, and tokens of an encoded text.
MAX_VOCAB, MAX_LEN = 20_000, 200


def vocabulary(spark: SparkSession, sf_dir: str, size: int = MAX_VOCAB) -> DataFrame:
    """(token, cnt, token_id): the most frequent tokens, ids from 2; counted partially before the shuffle, cut to
    ``size`` by a top-k before they are numbered."""
    listed = read(spark, sf_dir, "documents", wide=True).select("doc_id", F.posexplode(t.review_tokens(F.col("text"))).alias("pos", "token"))
    counted = listed.groupBy("token").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("f")).where("cnt >= 2")
    top = counted.orderBy(F.desc("cnt"), "f").limit(size - 2)
    return top.select("token", "cnt", (F.row_number().over(W.orderBy(F.desc("cnt"), "f")) + 1).alias("token_id"))


@query(f"WITH {_VOCAB} SELECT token, cnt, token_id FROM vocab")
def vocabulary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir)


@query(f"WITH {_VOCAB}, h AS (SELECT doc_id, pos, coalesce(token_id, 1) AS id FROM k LEFT JOIN vocab USING (token) WHERE pos < 200), e AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM h GROUP BY 1)"
       " SELECT d.doc_id, array_to_string(list_resize(coalesce(ids, []), 200, 0), ' ') AS encoded FROM documents d LEFT JOIN e USING (doc_id)")
def encode_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first MAX_LEN tokens as vocabulary ids, 1 for unknown ones, padded with 0. The vocabulary has at most MAX_VOCAB rows."""
    d = read(spark, sf_dir, "documents", wide=True).select("doc_id", F.slice(t.review_tokens(F.col("text")), 1, MAX_LEN).alias("v"))
    ids = d.select("doc_id", F.posexplode("v").alias("pos", "token")).join(F.broadcast(vocabulary(spark, sf_dir).select("token", "token_id")), "token", "left")
    lists = ids.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(1)).alias("id")))).alias("l"))
    padded = F.slice(F.concat(F.coalesce(F.transform("l", lambda s: s["id"]), F.array().cast("array<int>")), F.array_repeat(F.lit(0), MAX_LEN)), 1, MAX_LEN)
    return d.select("doc_id").join(lists, "doc_id", "left").select("doc_id", F.array_join(padded.cast("array<string>"), " ").alias("encoded"))


_WORDS = r"[w for w in regexp_split_to_array(text, '\s+') if w <> '']"


@query(f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 75)) AS k FROM d) SELECT doc_id, CAST(k / 75 AS INTEGER) AS pos, array_to_string(w[k + 1 : k + 95], ' ') AS chunk FROM s")
def chunk_words_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(read(spark, sf_dir, "documents", wide=True), "doc_id", t.fixed_word_chunks(F.col("text"), 95, 20), "chunk")


@query(rf"WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 448)) AS k FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, k, {_STRIP.format('substr(text, k + 1, 512)')} AS chunk FROM s) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, chunk FROM c WHERE chunk <> ''")
def chunk_chars_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(read(spark, sf_dir, "documents", wide=True), "doc_id", t.fixed_char_chunks(F.col("text"), 512, 64), "chunk")


@query(f"SELECT lang, count(*) AS chunks, {r3('avg(CAST(length(chunk) AS DOUBLE))', 1)} AS mean_chars FROM (SELECT lang, unnest([{_STRIP.format('substr(text, k + 1, 512)')} for k in range(0, length(text), 448) if {_STRIP.format('substr(text, k + 1, 512)')} <> '']) AS chunk FROM documents) GROUP BY lang")
def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean length of chunks per language."""
    c = read(spark, sf_dir, "documents", wide=True).select("lang", F.explode(t.fixed_char_chunks(F.col("text"), 512, 64)).alias("chunk"))
    return c.groupBy("lang").agg(F.count("*").alias("chunks"), round_half_up(F.avg(F.length("chunk").cast("double")), 1).alias("mean_chars"))


_LINES = r"l AS (SELECT report, doc_id, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM (SELECT report, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)), n AS (SELECT report, count(DISTINCT doc_id) AS pages FROM documents GROUP BY report)," \
    r" rep AS (SELECT l.report, line FROM l JOIN n ON l.report = n.report WHERE line <> '' AND length(line) <= 120 AND (regexp_full_match(line, '[0-9]+') OR len(string_split(line, ' ')) <= 12) GROUP BY l.report, line, pages HAVING count(DISTINCT doc_id) >= greatest(2, (pages + 1) // 2))"


@query(f"WITH {_LINES} SELECT l.doc_id, l.pos, l.line FROM l WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM rep WHERE rep.report = l.report AND rep.line = l.line)")
def repeated_line_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report's documents without those that recur on half of them (running heads): counts, then an anti join."""
    d = read(spark, sf_dir, "documents", wide=True).select("report", "doc_id", "text")
    lines = d.select("report", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("report", "doc_id", "pos", t.collapse(F.col("raw")).alias("line")).where("line != ''")
    pages = d.groupBy("report").agg(F.count_distinct("doc_id").alias("pages"))
    short = F.col("line").rlike("^[0-9]+$") | (F.size(F.split("line", " ")) <= 12)
    often = lines.where((F.length("line") <= 120) & short).groupBy("report", "line").agg(F.count_distinct("doc_id").alias("seen"))
    often = often.join(pages, "report").where(F.col("seen") >= F.greatest(F.lit(2), F.floor((F.col("pages") + 1) / 2))).select("report", "line")
    return lines.join(often, ["report", "line"], "left_anti").select("doc_id", "pos", "line")


@query(r"WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT doc_id, regexp_extract(line, '^\[([^\]]+)\]\s*(.*)$', 1) AS label, regexp_extract(line, '^\[([^\]]+)\]\s*(.*)$', 2) AS body FROM l WHERE regexp_matches(line, '^\[([^\]]+)\]\s*(.*)$')")
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, p = F.col("line"), r"^\[([^\]]+)\]\s*(.*)$"
    lines = read(spark, sf_dir, "documents", wide=True).select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.trim("l").alias("line"))
    return lines.where(line.rlike(p)).select("doc_id", F.regexp_extract(line, p, 1).alias("label"), F.regexp_extract(line, p, 2).alias("body"))


@query(f"WITH k AS (SELECT case_id, {sql_tokens('claim')} AS v FROM claimguard_benchmark) SELECT case_id, unnest([array_to_string(v[i : i + 3], ' ') for i in range(1, len(v) - 2)] || [array_to_string(v[i : i + 2], ' ') for i in range(1, len(v) - 1)]) AS phrase FROM k")
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of four, then three tokens of a claim."""
    k = read(spark, sf_dir, "claimguard_benchmark").select("case_id", t.tokens(F.col("claim")).alias("v"))
    return k.select("case_id", F.explode(F.concat(t.phrases(F.col("v"), 4), t.phrases(F.col("v"), 3))).alias("phrase"))


def _sql_strip(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace({x}, {rx(t.NARRATIVE)}, '\\1', 'g'), {rx(t.PARENTHETICAL)}, '', 'g'), {rx(t.NUMERIC)}, '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({plain}, '\s+([.,;:!?])', '\1', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT claim_id, {_sql_strip('sentence')} AS stripped FROM claim")
def citation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "claim").select("claim_id", t.strip_citations(F.col("sentence")).alias("stripped"))


@query(rf"WITH b AS (SELECT DISTINCT citation_id, regexp_split_to_array(trim(raw_text, '[]'), '\s*[,;]\s*') AS parts FROM citation WHERE regexp_full_match(raw_text, {rx(t.NUMERIC)})), p AS (SELECT citation_id, unnest(parts) AS p FROM b),"
       r" e AS (SELECT citation_id, p, CAST(nullif(regexp_extract(p, '^(\d+)\s*(?:-|–|—)\s*(\d+)$', 1), '') AS BIGINT) AS a, CAST(nullif(regexp_extract(p, '^(\d+)\s*(?:-|–|—)\s*(\d+)$', 2), '') AS BIGINT) AS z FROM p)"
       " SELECT DISTINCT citation_id, unnest(CASE WHEN a IS NULL THEN [CAST(p AS BIGINT)] WHEN a <= z AND z - a <= 50 THEN range(a, z + 1) ELSE [a, z] END) AS number FROM e WHERE a IS NOT NULL OR regexp_full_match(p, '[0-9]+')")
def citation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of bracketed groups; a range of at most 50 is written out, a longer or falling one gives its ends."""
    c = read(spark, sf_dir, "citation").select("citation_id", "raw_text").distinct().where(F.col("raw_text").rlike(f"^{t.NUMERIC}$"))
    p = c.select("citation_id", F.explode(F.split(F.regexp_replace("raw_text", r"[\[\]]", ""), r"\s*[,;]\s*")).alias("p"))
    span = r"^(\d+)\s*(?:-|–|—)\s*(\d+)$"
    a, z = F.regexp_extract("p", span, 1).try_cast("bigint"), F.regexp_extract("p", span, 2).try_cast("bigint")
    e = p.select("citation_id", "p", a.alias("a"), z.alias("z"))
    one = F.array(F.col("p").try_cast("bigint"))
    numbers = F.when(F.col("a").isNull(), one).when((F.col("a") <= F.col("z")) & (F.col("z") - F.col("a") <= 50), F.sequence("a", F.greatest("a", "z"))).otherwise(F.array("a", "z"))
    return e.select("citation_id", F.explode(numbers).alias("number")).where("number is not null").distinct()


@query(r"SELECT DISTINCT citation_id, trim(regexp_replace(lower(author_hint || ' ' || cited_year), '[^a-z0-9]+', ' ', 'g')) AS marker FROM citation WHERE author_hint IS NOT NULL AND cited_year IS NOT NULL")
def citation_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "citation").where("author_hint is not null and cited_year is not null")
    return c.select("citation_id", t.marker(F.concat_ws(" ", "author_hint", "cited_year")).alias("marker")).distinct()


@query(rf"SELECT ref_id, coalesce(nullif(regexp_extract(raw_text, '^\s*\[(\d+)\]\s+', 1), ''), nullif(regexp_extract(raw_text, '^\s*(\d+)[.)]\s+', 1), '')) AS idx, lower(nullif(regexp_replace(regexp_extract(raw_text, {rx(t.DOI)}, 1), '[.,;:)\]]+$', ''), '')) AS doi, CAST(nullif(regexp_extract(raw_text, '\b((?:19|20)\d{{2}})\b', 1), '') AS INTEGER) AS year FROM parsed_reference")
def reference_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, identifier and year of bibliography entries."""
    raw = F.col("raw_text")
    return read(spark, sf_dir, "parsed_reference").select("ref_id", t.reference_index(raw).alias("idx"), t.doi(raw).alias("doi"), t.first_year(raw).alias("year"))


@query("SELECT record_id, regexp_replace(lower(crossref_title), '[^a-z0-9]+', '', 'g') AS title_key FROM crossref_record")
def exact_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "crossref_record").select("record_id", t.title_key(F.col("crossref_title")).alias("title_key"))


@query(r"SELECT claim_id, CASE WHEN classification_confidence >= 0.8e0 THEN 'strong' WHEN classification_confidence >= 0.55e0 THEN 'medium' WHEN classification_confidence >= 0.3e0 THEN 'weak' ELSE 'very weak' END AS band FROM claim")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce(F.col("classification_confidence").cast("string").try_cast("double"), F.lit(0.0))
    return read(spark, sf_dir, "claim").select("claim_id", F.when(c >= 0.8, "strong").when(c >= 0.55, "medium").when(c >= 0.3, "weak").otherwise("very weak").alias("band"))


@query("SELECT case_id, CASE WHEN lower(trim(expected_missing_citation)) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(expected_missing_citation)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS missing FROM rq_claim_annotations")
def tri_state_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "rq_claim_annotations").select("case_id", t.boolean(F.col("expected_missing_citation")).alias("missing"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", wide=True).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("WITH v AS (SELECT doc_id, regexp_extract(text, '\"status\": \"([a-z_]+)\"', 1) AS status, regexp_extract(text, '\"confidence\": ([0-9.]+)', 1) AS c FROM documents WHERE text LIKE '%\"status\"%')"
       f" SELECT doc_id, status, {r3('least(1e0, greatest(0e0, CAST(c AS DOUBLE)))')} AS confidence FROM v WHERE status IN ('supported', 'partially_supported', 'not_supported', 'contradicted', 'insufficient_evidence') AND c <> ''")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts written as JSON inside running text: status of the fixed domain, confidence clamped."""
    d = read(spark, sf_dir, "documents", wide=True).where(F.col("text").contains('"status"'))
    v = d.select("doc_id", F.regexp_extract("text", '"status": "([a-z_]+)"', 1).alias("status"), F.regexp_extract("text", '"confidence": ([0-9.]+)', 1).try_cast("double").alias("c"))
    known = F.col("status").isin("supported", "partially_supported", "not_supported", "contradicted", "insufficient_evidence")
    return v.where(known & F.col("c").isNotNull()).select("doc_id", "status", round_half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "c"))).alias("confidence"))


@query(r"WITH w AS (SELECT claim_id, [x for x in regexp_split_to_array(sentence, '\s+') if x <> ''] AS v FROM claim), inv AS (SELECT claim_id, unnest(v) AS word, unnest(range(len(v))) AS pos FROM w) SELECT claim_id, string_agg(word, ' ' ORDER BY pos) AS rebuilt FROM inv GROUP BY 1")
def abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rebuilt from an inverted index word -> positions (built here from claims); at one place the last word wins."""
    w = read(spark, sf_dir, "claim").select("claim_id", F.posexplode(t.words(F.col("sentence"))).alias("pos", "word"))
    index = w.groupBy("claim_id", "word").agg(F.collect_list("pos").alias("places"))
    back = index.select("claim_id", "word", F.explode("places").alias("pos")).groupBy("claim_id", "pos").agg(F.max("word").alias("word"))
    return back.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("rebuilt"))


_OPEN = r"[array_to_string(regexp_extract_all(lower(s), '[a-z]+')[1:2], ' ') for s in " + sql_parts(r"regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')") + "]"


def style_columns(text: F.Column) -> list[F.Column]:
    """Inputs of the style score: mean and variation of sentence lengths, transitions, share of repeated openers."""
    s = t.style_sentences(text)
    lengths = F.transform(s, lambda x: t.word_count(x).cast("double"))
    openers = F.filter(F.transform(s, lambda x: F.array_join(F.slice(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)), 1, 2), " ")), lambda o: o != "")
    return [t.word_count(text).alias("words"), lengths.alias("lengths"), openers.alias("openers"), F.regexp_count(F.lower(text), F.lit(r"\b(furthermore|moreover|additionally|overall|in conclusion|notably)\b")).alias("transitions")]


def style_scores_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, score, label): higher for even sentence lengths, repeated openers and formulaic transitions."""
    c = df.select(key, *style_columns(F.col(text)))
    n = F.greatest(F.lit(1), F.size("lengths")).cast("double")
    c = c.withColumn("mean", F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x) / n)
    c = c.withColumn("cv", F.sqrt(F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n) / F.greatest(F.lit(1.0), "mean"))
    repeated = F.when(F.size("openers") >= 2, 1.0 - F.size(F.array_distinct("openers")) / F.size("openers")).otherwise(0.0)
    raw = (0.42 - F.col("cv")) * 0.9 + F.col("transitions") * 0.06 + repeated * 0.35
    c = c.withColumn("score", round_half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))))
    label = F.when(F.col("words") < 40, "insufficient_text").when(F.col("score") >= 0.62, "likely_ai").when(F.col("score") >= 0.42, "uncertain").otherwise("likely_human")
    # generated rows keep later filters from being pushed into the score, which would be computed for them again
    row = F.struct(F.when(F.col("words") < 40, 0.0).otherwise(F.col("score")).alias("score"), label.alias("label"))
    return c.select(key, F.explode(F.array(row)).alias("r")).select(key, "r.score", "r.label")


_STYLE = (
    "s AS (SELECT doc_id, source, text, " + _WORDS + " AS w, [CAST(len([y for y in regexp_split_to_array(x, '\\s+') if y <> '']) AS DOUBLE) for x in " + sql_parts(r"regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g')") + f"] AS l, [o for o in {_OPEN} if o <> ''] AS o FROM documents),"
    " m AS (SELECT *, coalesce(list_sum(l), 0) / greatest(1, len(l)) AS mean FROM s), v AS (SELECT *, sqrt(coalesce(list_sum([(x - mean) * (x - mean) for x in l]), 0) / greatest(1, len(l))) / greatest(1e0, mean) AS cv, CASE WHEN len(o) >= 2 THEN 1e0 - CAST(len(list_distinct(o)) AS DOUBLE) / len(o) ELSE 0e0 END AS rep, len(regexp_extract_all(lower(text), '\\b(furthermore|moreover|additionally|overall|in conclusion|notably)\\b')) AS tr FROM m),"
    f" sc AS (SELECT doc_id, source, len(w) AS n, {r3('least(1e0, greatest(0e0, (0.42e0 - cv) * 0.9e0 + tr * 0.06e0 + rep * 0.35e0))')} AS score FROM v),"
    " styled AS (SELECT doc_id, source, CASE WHEN n < 40 THEN 0e0 ELSE score END AS score, CASE WHEN n < 40 THEN 'insufficient_text' WHEN score >= 0.62e0 THEN 'likely_ai' WHEN score >= 0.42e0 THEN 'uncertain' ELSE 'likely_human' END AS label FROM sc)"
)


@query(f"WITH {_STYLE} SELECT doc_id, score, label FROM styled")
def style_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_scores_of(read(spark, sf_dir, "documents", wide=True), "doc_id", "text")


@query(f"WITH {_STYLE} SELECT source, label, count(*) AS cnt FROM styled GROUP BY 1, 2")
def style_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", wide=True)
    scored = style_scores_of(d.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text")
    return scored.groupBy("k.source", "label").agg(F.count("*").alias("cnt"))


@query(f"SELECT source, {r3('CAST(count(*) FILTER (text LIKE $$%al.%$$) AS DOUBLE) / count(*)')} AS with_authors FROM documents GROUP BY source")
def citation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", wide=True).groupBy("source").agg(ratio(F.count_if(F.col("text").contains("al.")), F.count("*")).alias("with_authors"))


@register_detector("style")
def _style_detector(df: DataFrame, key: str, text: str) -> DataFrame:
    s = style_scores_of(df, key, text)
    return s.select(key, F.when(F.col("label") != "insufficient_text", F.col("score")).alias("score"))


@query(f"WITH {_STYLE} SELECT doc_id, CASE WHEN label <> 'insufficient_text' THEN score END AS score, CASE WHEN label = 'insufficient_text' THEN label WHEN score >= 0.6e0 THEN 'likely_ai' ELSE 'likely_human' END AS label, 'style' AS detector FROM styled")
def detector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the registered style detector at a threshold of 0.6."""
    return detected("style", read(spark, sf_dir, "documents", wide=True), "doc_id", "text", 0.6)
