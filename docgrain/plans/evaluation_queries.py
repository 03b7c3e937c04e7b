"""Queries of the evaluation algebra over claims and three rule predictors, and over embeddings; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrain.functions.numbers import r3, ratio, round_half_up
from docgrain.operators import evaluation as ev
from docgrain.operators import tables
from docgrain.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The claim types in report order.
TYPES = ("factual_claim", "methodological_statement", "opinion_or_interpretation", "background_or_definition", "non_claim")
_LIST = ", ".join(f"'{t}'" for t in TYPES)


def query(sql: str | None = None) -> Callable:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, tool, expected, predicted): three rule predictors over claims; the third leaves cases out."""
    c = read(spark, sf_dir, "claim").select("claim_id", "claim_type", "section", "sentence")
    by_digit = F.when(F.col("sentence").rlike("[0-9]"), "factual_claim").when(F.col("section") == "methods", "methodological_statement").otherwise("opinion_or_interpretation")
    by_id = F.when(F.col("claim_id") % 5 == 0, "non_claim").otherwise(F.col("claim_type"))
    by_length = F.when(F.col("claim_id") % 3 == 0, "missing").when(F.length("sentence") > 100, F.col("claim_type")).otherwise("background_or_definition")
    made = F.array(*[F.struct(F.lit(n).alias("tool"), p.alias("predicted")) for n, p in (("digit", by_digit), ("id", by_id), ("length", by_length))])
    return c.select(F.col("claim_id").alias("case_id"), F.col("claim_type").alias("expected"), F.explode(made).alias("m")).select("case_id", "m.tool", "expected", "m.predicted")


TOOLS = """tools AS (
 SELECT claim_id AS case_id, 'digit' AS tool, claim_type AS expected, CASE WHEN regexp_matches(sentence, '[0-9]') THEN 'factual_claim' WHEN section = 'methods' THEN 'methodological_statement' ELSE 'opinion_or_interpretation' END AS predicted FROM claim
 UNION ALL SELECT claim_id, 'id', claim_type, CASE WHEN claim_id % 5 = 0 THEN 'non_claim' ELSE claim_type END FROM claim
 UNION ALL SELECT claim_id, 'length', claim_type, CASE WHEN claim_id % 3 = 0 THEN 'missing' WHEN length(sentence) > 100 THEN claim_type ELSE 'background_or_definition' END FROM claim)"""


def _div(a: str, b: str) -> str:
    return r3(f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0e0 END")


def _f1(p: str, r: str) -> str:
    return r3(f"CASE WHEN {p} + {r} > 0 THEN 2e0 * {p} * {r} / ({p} + {r}) ELSE 0e0 END")


LABELS = f"""{TOOLS}, lab AS (SELECT tool, expected AS label FROM tools UNION SELECT tool, predicted FROM tools),
 pl AS (SELECT l.tool, l.label, count(*) FILTER (t.expected = l.label AND t.predicted = l.label) AS tp, count(*) FILTER (t.expected = l.label) AS support, count(*) FILTER (t.predicted = l.label) AS predicted_count
   FROM lab l JOIN tools t ON t.tool = l.tool WHERE l.label IS NOT NULL GROUP BY 1, 2),
 pr AS (SELECT *, {_div('tp', 'predicted_count')} AS p, {_div('tp', 'support')} AS r FROM pl),
 pf AS (SELECT *, {_f1('p', 'r')} AS f FROM pr)"""


@query(f"WITH {TOOLS} SELECT tool, expected, predicted, count(*) AS cnt FROM tools GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(tools(spark, sf_dir), ["tool"])


@query(f"WITH {TOOLS} SELECT expected, " + ", ".join(f"count(*) FILTER (predicted = '{t}') AS n_{t}" for t in TYPES) + " FROM tools GROUP BY expected")
def confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_wide(tools(spark, sf_dir), TYPES)


@query(f"WITH {LABELS} SELECT tool, label, tp, predicted_count - tp AS fp, support - tp AS fn, support, predicted_count, p AS precision, r AS recall, f AS f1 FROM pf")
def per_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.per_label(tools(spark, sf_dir), ["tool"])


@query(f"WITH {LABELS}, u AS (SELECT tool, label, tp, predicted_count, support, CASE WHEN predicted_count > 0 THEN CAST(tp AS DOUBLE) / CAST(predicted_count AS DOUBLE) ELSE 0e0 END AS a, CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) ELSE 0e0 END AS b FROM pl)"
       f" SELECT tool, label, tp, predicted_count - tp AS fp, support - tp AS fn, support, predicted_count, {r3('a')} AS precision, {r3('b')} AS recall, {_f1('a', 'b')} AS f1 FROM u")
def per_label_metrics_unrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.per_label(tools(spark, sf_dir), ["tool"], rounded=False)


@query(f"WITH {LABELS} SELECT tool, {r3('sum(p) / count(*)')} AS macro_precision, {r3('sum(r) / count(*)')} AS macro_recall, {r3('sum(f) / count(*)')} AS macro_f1 FROM pf WHERE support > 0 GROUP BY tool")
def macro_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.macro(tools(spark, sf_dir), ["tool"])


@query(f"WITH {LABELS} SELECT tool, {r3('sum(p) / 5e0')} AS macro_precision, {r3('sum(r) / 5e0')} AS macro_recall, {r3('sum(f) / 5e0')} AS macro_f1 FROM pf WHERE label IN ({_LIST}) GROUP BY tool")
def macro_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.macro(tools(spark, sf_dir), ["tool"], labels=TYPES)


_TWO = "'factual_claim', 'methodological_statement'"


@query(f"WITH {TOOLS}, c AS (SELECT tool, count(*) FILTER (expected = predicted AND expected IN ({_TWO})) AS tp, count(*) FILTER (predicted IN ({_TWO}) AND expected IS DISTINCT FROM predicted) AS fp, count(*) FILTER (expected IN ({_TWO}) AND expected IS DISTINCT FROM predicted) AS fn FROM tools GROUP BY tool),"
       f" m AS (SELECT *, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r FROM c) SELECT tool, tp, fp, fn, p AS micro_precision, r AS micro_recall, {_f1('p', 'r')} AS micro_f1 FROM m")
def micro_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.micro(tools(spark, sf_dir), TYPES[:2], ["tool"])


def _binary_sql(rounded: bool) -> str:
    counts = "c AS (SELECT lang, count(*) AS n, count(*) FILTER (y AND s) AS tp, count(*) FILTER (NOT y AND NOT s) AS tn, count(*) FILTER (NOT y AND s) AS fp, count(*) FILTER (y AND NOT s) AS fn FROM (SELECT lang, coalesce(missing_citation, false) AS y, coalesce(classification_confidence < 0.7e0, false) AS s FROM claim) GROUP BY lang)"
    p, r = ("p", "r") if rounded else ("CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0e0 END", "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0e0 END")
    return f"WITH {counts}, m AS (SELECT *, {_div('tp', 'tp + fp')} AS p, {_div('tp', 'tp + fn')} AS r FROM c) SELECT lang, n, {_div('tp + tn', 'n')} AS accuracy, p AS precision, r AS recall, {_f1(f'({p})', f'({r})')} AS f1, tp, tn, fp, fn FROM m"


@query(_binary_sql(True))
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.binary(read(spark, sf_dir, "claim"), F.col("missing_citation"), F.col("classification_confidence") < 0.7, ["lang"])


@query(_binary_sql(False))
def binary_metrics_unrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.binary(read(spark, sf_dir, "claim"), F.col("missing_citation"), F.col("classification_confidence") < 0.7, ["lang"], rounded=False)


@query("WITH s AS (SELECT lang, classification_confidence AS x, coalesce(missing_citation, false) AS y FROM claim WHERE classification_confidence IS NOT NULL),"
       " r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2e0 AS mid FROM s),"
       " a AS (SELECT lang, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, coalesce(sum(mid) FILTER (y), 0) AS ranks FROM r GROUP BY lang)"
       f" SELECT lang, positives, negatives, CASE WHEN positives > 0 AND negatives > 0 THEN {r3('(ranks - positives * (positives + 1) / 2e0) / (CAST(positives AS DOUBLE) * negatives)')} END AS auroc FROM a")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.auroc(read(spark, sf_dir, "claim"), "classification_confidence", F.coalesce(F.col("missing_citation"), F.lit(False)), ["lang"])


_AVAILABLE = LABELS.replace("FROM lab l JOIN tools t ON t.tool = l.tool WHERE", "FROM lab l JOIN tools t ON t.tool = l.tool AND t.predicted <> 'missing' WHERE")


@query(f"WITH {_AVAILABLE}, e AS (SELECT DISTINCT expected AS label FROM tools WHERE expected IS NOT NULL), m AS (SELECT tool, {r3('sum(f) / (SELECT count(*) FROM e)')} AS macro_f1, sum(tp) AS tp, sum(predicted_count) AS pc, sum(support) AS su FROM pf JOIN e USING (label) GROUP BY tool),"
       f" b AS (SELECT tool, count(*) AS cases, {_div('count(*) FILTER (predicted <> $$missing$$)', 'count(*)')} AS coverage, {_div('count(*) FILTER (predicted <> $$missing$$ AND predicted = expected)', 'count(*) FILTER (predicted <> $$missing$$)')} AS accuracy FROM tools GROUP BY tool)"
       f" SELECT tool, cases, coverage, accuracy, coalesce(macro_f1, 0e0) AS macro_f1, {_f1(_div('tp', 'pc'), _div('tp', 'su'))} AS micro_f1, row_number() OVER (ORDER BY macro_f1 DESC, coverage DESC, tool) AS place FROM b LEFT JOIN m USING (tool)")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.leaderboard(tools(spark, sf_dir))


@query(f"WITH {TOOLS} SELECT a.tool AS tool_a, b.tool AS tool_b, count(*) AS shared, {_div('count(*) FILTER (a.predicted = b.predicted)', 'count(*)')} AS agreement FROM tools a JOIN tools b ON a.case_id = b.case_id AND a.tool < b.tool WHERE a.predicted <> 'missing' AND b.predicted <> 'missing' GROUP BY 1, 2")
def pairwise_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pairwise_agreement(tools(spark, sf_dir).where("predicted != 'missing'"))


@query(f"WITH {TOOLS}, e AS (SELECT case_id, count(*) AS tools, count(*) FILTER (predicted <> 'missing') AS valid, count(DISTINCT CASE WHEN predicted <> 'missing' THEN predicted END) AS d FROM tools GROUP BY case_id)"
       " SELECT case_id, tools, valid, CASE WHEN valid = tools AND d = 1 THEN 'agreement' WHEN valid >= 2 AND d > 1 THEN 'disagreement' ELSE 'incomplete' END AS agreement FROM e")
def report_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.agreement_class(tools(spark, sf_dir))


@query(f"WITH {TOOLS} SELECT case_id, max(predicted) FILTER (tool = 'digit') AS digit, max(predicted) FILTER (tool = 'id') AS id, max(predicted) FILTER (tool = 'length' AND predicted <> 'missing') AS length FROM tools GROUP BY case_id")
def report_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full alignment of the reports by case: a case absent from a report is null there."""
    return tools(spark, sf_dir).where("predicted != 'missing'").groupBy("case_id").pivot("tool", ["digit", "id", "length"]).agg(F.max("predicted"))


@query(f"WITH {TOOLS}, w AS (SELECT tool, expected, predicted, count(*) AS cnt, min(case_id) AS f FROM tools WHERE expected <> predicted GROUP BY 1, 2, 3) SELECT tool, expected, predicted, cnt FROM w QUALIFY row_number() OVER (PARTITION BY tool ORDER BY cnt DESC, f) = 1")
def typical_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.typical_failure(tools(spark, sf_dir), ["tool"], "case_id")


@query("SELECT claim_type AS majority, count(*) AS cnt FROM claim WHERE claim_type IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, min(claim_id) LIMIT 1")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.majority_label(read(spark, sf_dir, "claim").where("claim_type is not null"), "claim_type", "claim_id")


_BACK = "backend AS (SELECT doc_id, coalesce(source, 'none') AS backend, lang AS model, CASE WHEN n_chars IS NULL THEN NULL ELSE CAST(n_chars AS DOUBLE) / 7e0 END AS latency_ms, doc_id % 11 = 0 AS failed, CASE WHEN source = 'wiki_article' THEN NULL ELSE n_chars END AS tokens FROM documents)"


@query(f"WITH {_BACK} SELECT backend, count(*) AS calls, count(*) FILTER (failed) AS errors, {r3('sum(latency_ms) FILTER (NOT failed) / greatest(1, count(latency_ms) FILTER (NOT failed))', 1)} AS mean_latency_ms, string_agg(DISTINCT model, ',' ORDER BY model) FILTER (NOT failed) AS models, sum(tokens) AS tokens FROM {'backend'} GROUP BY backend")
def backend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, errors, mean latency and sorted distinct models of the rows without error, and token sums that stay null when never reported."""
    d = read(spark, sf_dir, "documents")
    n = F.col("n_chars")
    rows = d.select(F.coalesce("source", F.lit("none")).alias("backend"), F.col("lang").alias("model"), (n.cast("double") / 7.0).alias("latency_ms"), (F.col("doc_id") % 11 == 0).alias("failed"), F.when(F.col("source") == "wiki_article", None).otherwise(n).alias("tokens"))
    good = lambda c: F.when(~F.col("failed"), F.col(c))
    return rows.groupBy("backend").agg(
        F.count("*").alias("calls"), F.count_if("failed").alias("errors"),
        round_half_up(F.sum(good("latency_ms")) / F.greatest(F.lit(1), F.count(good("latency_ms"))), 1).alias("mean_latency_ms"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(good("model"))), ","), F.lit("")).alias("models"), F.sum("tokens").alias("tokens"),
    )


@query("SELECT claim_type AS value, count(*) AS cnt FROM claim WHERE claim_type IS NOT NULL AND claim_type <> '' GROUP BY 1 UNION ALL SELECT 'section:' || section, count(*) FROM claim WHERE section IS NOT NULL AND section <> '' GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "claim").select(F.explode(F.array("claim_type", F.concat(F.lit("section:"), F.when(F.col("section") != "", F.col("section"))))).alias("value"))
    return c.where("value is not null and value != ''").groupBy("value").agg(F.count("*").alias("cnt"))


@query("SELECT document, count(*) AS sentences, count(*) FILTER (citation_context = 'same_sentence') AS cited, count(*) FILTER (claim_type = 'factual_claim') AS factual, count(*) FILTER (claim_type = 'factual_claim' AND missing_citation) AS factual_missing, count(*) FILTER (lang IS NULL) AS no_lang FROM claim GROUP BY document")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "claim").groupBy("document").agg(
        F.count("*").alias("sentences"), F.count_if(c("citation_context") == "same_sentence").alias("cited"), F.count_if(c("claim_type") == "factual_claim").alias("factual"),
        F.count_if((c("claim_type") == "factual_claim") & c("missing_citation")).alias("factual_missing"), F.count_if(c("lang").isNull()).alias("no_lang"),
    )


@query("WITH s AS (SELECT document, count(*) FILTER (missing_citation) AS missing, count(*) FILTER (missing_citation AND claim_type = 'factual_claim') AS high, count(*) FILTER (classification_confidence < 0.4e0) AS conflicts, count(*) FILTER (classification_confidence BETWEEN 0.4e0 AND 0.6e0) AS open_checks FROM claim GROUP BY document)"
       " SELECT document, CASE WHEN conflicts > 0 OR high > 0 THEN 'elevated' WHEN missing > 0 OR open_checks > 0 THEN 'medium' ELSE 'low' END AS priority, conflicts, missing, open_checks FROM s")
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf, miss = F.col("classification_confidence"), F.col("missing_citation")
    s = read(spark, sf_dir, "claim").groupBy("document").agg(
        F.count_if(miss).alias("missing"), F.count_if(miss & (F.col("claim_type") == "factual_claim")).alias("high"), F.count_if(conf < 0.4).alias("conflicts"), F.count_if(conf.between(0.4, 0.6)).alias("open_checks")
    )
    level = F.when((F.col("conflicts") > 0) | (F.col("high") > 0), "elevated").when((F.col("missing") > 0) | (F.col("open_checks") > 0), "medium").otherwise("low")
    return s.select("document", level.alias("priority"), "conflicts", "missing", "open_checks")


@query(f"SELECT d.source, {r3('avg(CASE WHEN d.text LIKE $$%[%$$ THEN CAST(length(d.text) AS DOUBLE) END)')} AS mean_cited, {r3('avg(CASE WHEN d.text NOT LIKE $$%[%$$ THEN CAST(length(d.text) AS DOUBLE) END)')} AS mean_uncited FROM documents d GROUP BY d.source")
def cited_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a score over cited and uncited texts, null where there are none."""
    cited, n = F.col("text").contains("["), F.length("text").cast("double")
    return read(spark, sf_dir, "documents").groupBy("source").agg(round_half_up(F.avg(F.when(cited, n))).alias("mean_cited"), round_half_up(F.avg(F.when(~cited, n))).alias("mean_uncited"))


@query(f"SELECT lang, count(*) AS docs, sum(length(text)) AS chars, {r3('avg(CAST(length(text) AS DOUBLE))', 1)} AS mean_chars, min(length(text)) AS shortest, max(length(text)) AS longest, median(length(text)) AS median_chars FROM documents GROUP BY lang")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(n).alias("chars"), round_half_up(F.avg(n.cast("double")), 1).alias("mean_chars"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.median(n).alias("median_chars")
    )


@query(f"SELECT l.max_len, {r3('avg(CASE WHEN length(d.text) <= l.max_len THEN 1e0 ELSE 0e0 END)', 4)} AS covered FROM documents d CROSS JOIN (VALUES (256), (512), (1024), (2048), (4096)) l(max_len) WHERE d.text IS NOT NULL GROUP BY l.max_len")
def coverage_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts up to each length: one pass with a column per length, turned into rows."""
    lengths = (256, 512, 1024, 2048, 4096)
    wide = read(spark, sf_dir, "documents").where("text is not null").agg(*[round_half_up(F.avg(F.when(F.length("text") <= n, 1.0).otherwise(0.0)), 4).alias(str(n)) for n in lengths])
    return wide.unpivot([], [str(n) for n in lengths], "max_len", "covered").select(F.col("max_len").cast("int").alias("max_len"), "covered")


_EXP = "exps AS (SELECT coalesce(source, 'none') AS method, length(text) % 3 AS overlap, 256 * (1 + doc_id % 4) AS chunk_size, doc_id % 3 AS seed, (doc_id * 37 % 101) / 101e0 AS accuracy, doc_id FROM documents)"


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment rows (method, overlap, chunk_size, seed, accuracy) derived from documents."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("method"), (F.length("text") % 3).alias("overlap"), (256 * (1 + d % 4)).alias("chunk_size"), (d % 3).alias("seed"), (d * 37 % 101 / F.lit(101.0)).alias("accuracy"), "doc_id")


@query(f"WITH {_EXP} SELECT doc_id, method, chunk_size, accuracy FROM exps WHERE method LIKE 'student%' OR (chunk_size IN (256, 1024) AND contains(method, 'review')) OR (overlap = 1 AND regexp_matches(method, '^(wiki|qa)'))")
def selected_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows chosen by a prefix, by a set with a part, or by equality with a pattern."""
    m = F.col("method")
    chosen = m.startswith("student") | (F.col("chunk_size").isin(256, 1024) & m.contains("review")) | ((F.col("overlap") == 1) & m.rlike("^(wiki|qa)"))
    return experiments(spark, sf_dir).where(chosen).select("doc_id", "method", "chunk_size", "accuracy")


@query(f"WITH {_EXP} SELECT method, {r3('avg(accuracy) FILTER (overlap = 0)')} AS o0, {r3('avg(accuracy) FILTER (overlap = 1)')} AS o1, {r3('avg(accuracy) FILTER (overlap = 2)')} AS o2 FROM exps GROUP BY method")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = experiments(spark, sf_dir).groupBy("method").pivot("overlap", [0, 1, 2]).agg(F.avg("accuracy"))
    return p.select("method", *[round_half_up(F.col(str(k))).alias(f"o{k}") for k in range(3)])


@query(f"WITH {_EXP} SELECT method, " + ", ".join(f"max(accuracy) FILTER (chunk_size = {n}) AS c{n}" for n in (256, 512, 768, 1024)) + " FROM exps GROUP BY method")
def pivot_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = experiments(spark, sf_dir).groupBy("method").pivot("chunk_size", [256, 512, 768, 1024]).agg(F.max("accuracy"))
    return p.select("method", *[F.col(str(n)).alias(f"c{n}") for n in (256, 512, 768, 1024)])


@query(f"WITH {_EXP} SELECT method, chunk_size, count(DISTINCT seed) AS seeds, {r3('avg(accuracy)')} AS mean_accuracy, {r3('stddev_pop(accuracy)')} AS std_accuracy FROM exps GROUP BY 1, 2")
def seed_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments(spark, sf_dir).groupBy("method", "chunk_size").agg(F.count_distinct("seed").alias("seeds"), round_half_up(F.avg("accuracy")).alias("mean_accuracy"), round_half_up(F.stddev_pop("accuracy")).alias("std_accuracy"))


@query(f"WITH {_EXP} SELECT method, doc_id, chunk_size, accuracy FROM exps QUALIFY row_number() OVER (PARTITION BY method ORDER BY accuracy DESC, doc_id) = 1")
def argmax_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = experiments(spark, sf_dir).groupBy("method").agg(F.max_by(F.struct("doc_id", "chunk_size", "accuracy"), F.struct("accuracy", -F.col("doc_id"))).alias("b"))
    return best.select("method", "b.*")


_MEANS = f"{_EXP}, means AS (SELECT method, chunk_size, {r3('avg(accuracy)')} AS m FROM exps GROUP BY 1, 2)"


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments(spark, sf_dir).groupBy("method", "chunk_size").agg(round_half_up(F.avg("accuracy")).alias("m"))


@query(f"WITH {_MEANS}, w AS (SELECT chunk_size, max(m) FILTER (method = 'wiki_article') AS a, max(m) FILTER (method <> 'wiki_article') AS others FROM means GROUP BY 1) SELECT min(chunk_size) FILTER (a > others) AS first_x FROM w")
def first_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("method") == "wiki_article"
    wide = means(spark, sf_dir).groupBy("chunk_size").agg(F.max(F.when(own, F.col("m"))).alias("a"), F.max(F.when(~own, F.col("m"))).alias("others"))
    return tables.first_crossover(wide, "chunk_size", F.col("a") > F.col("others"))


@query(f"WITH {_MEANS}, p AS (SELECT method, chunk_size AS peak_x, m AS peak_y FROM means QUALIFY row_number() OVER (PARTITION BY method ORDER BY m DESC, chunk_size) = 1)"
       " SELECT p.method, p.peak_x, p.peak_y, min(q.chunk_size) FILTER (q.chunk_size > p.peak_x AND q.m < p.peak_y - 0.05e0) AS drop_x FROM p JOIN means q ON q.method = p.method GROUP BY 1, 2, 3")
def peak_then_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.peak_and_drop(means(spark, sf_dir), ["method"], "chunk_size", "m", 0.05)


@query(f"WITH {_MEANS} SELECT chunk_size, {r3('max(m) - min(m)')} AS gap, arg_max(method, (m, method)) AS best_method FROM means GROUP BY chunk_size")
def architecture_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return means(spark, sf_dir).groupBy("chunk_size").agg(round_half_up(F.max("m") - F.min("m")).alias("gap"), F.max_by("method", F.struct("m", "method")).alias("best_method"))


@query(f"WITH {_MEANS}, o AS (SELECT chunk_size, method, lag(method) OVER w AS before, m - lag(m) OVER w AS d FROM means WINDOW w AS (PARTITION BY chunk_size ORDER BY method)) SELECT chunk_size, before, method, {r3('d')} AS gap FROM o WHERE before IS NOT NULL")
def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap of each method to the one before it, by name, at every chunk size."""
    w = W.partitionBy("chunk_size").orderBy("method")
    o = means(spark, sf_dir).select("chunk_size", "method", F.lag("method").over(w).alias("before"), (F.col("m") - F.lag("m").over(w)).alias("d")).where("before is not null")
    return o.select("chunk_size", "before", "method", round_half_up(F.col("d")).alias("gap"))


@query(f"WITH {_MEANS}, o AS (SELECT *, lag(m) OVER (PARTITION BY method ORDER BY chunk_size) AS before FROM means), d AS (SELECT method, chunk_size, {r3('abs(m - before)')} AS change FROM o WHERE before IS NOT NULL) SELECT * FROM d QUALIFY row_number() OVER (ORDER BY change DESC, method, chunk_size) = 1")
def largest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = means(spark, sf_dir).withColumn("before", F.lag("m").over(W.partitionBy("method").orderBy("chunk_size"))).where("before is not null")
    d = o.select("method", "chunk_size", round_half_up(F.abs(F.col("m") - F.col("before"))).alias("change"))
    return d.orderBy(F.desc("change"), "method", "chunk_size").limit(1)


@query(f"WITH {_MEANS} SELECT a.method, a.chunk_size, a.m AS base, b.m AS other, {r3('b.m - a.m + 1e0')} AS gain_plus_one FROM means a JOIN means b ON a.chunk_size = b.chunk_size AND abs(a.m - b.m) <= 1e-8 + 0.1e0 * abs(b.m) AND a.method < b.method WHERE b.method = 'wiki_article'")
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows whose value lies close to another row's: an equality and a band."""
    a = means(spark, sf_dir).select("method", "chunk_size", F.col("m").alias("base"))
    b = means(spark, sf_dir).where("method = 'wiki_article'").select("chunk_size", F.col("method").alias("om"), F.col("m").alias("other"))
    near = tables.band_join(a, b, ["chunk_size"], "base", "other", relative=0.1).where("method < om")
    return near.select("method", "chunk_size", "base", "other", round_half_up(F.col("other") - F.col("base") + 1.0).alias("gain_plus_one"))


@query(f"WITH {TOOLS}, c AS (SELECT expected, predicted, count(*) AS cnt FROM tools WHERE tool = 'digit' GROUP BY 1, 2), t AS (SELECT *, sum(cnt) OVER (PARTITION BY expected) AS n FROM c) SELECT expected, predicted, cnt, {_div('cnt', 'n')} AS rate FROM t WHERE expected <> predicted")
def off_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions with their rate within the true class."""
    from pyspark.sql import Window as W

    c = ev.confusion(tools(spark, sf_dir).where("tool = 'digit'")).withColumn("n", F.sum("cnt").over(W.partitionBy("expected")))
    return c.where("expected != predicted").select("expected", "predicted", "cnt", ratio(F.col("cnt"), F.col("n")).alias("rate"))


@query(f"WITH {TOOLS} SELECT expected AS class, tool, {r3('avg(CASE WHEN expected = predicted THEN 1e0 ELSE 0e0 END)', 4)} AS accuracy FROM tools GROUP BY 1, 2")
def per_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools(spark, sf_dir).groupBy(F.col("expected").alias("class"), "tool").agg(round_half_up(F.avg(F.when(ev.hit(), 1.0).otherwise(0.0)), 4).alias("accuracy"))


@query(f"WITH {TOOLS}, w AS (SELECT case_id, bool_or(expected = predicted) FILTER (tool = 'digit') AS a, bool_or(expected = predicted) FILTER (tool = 'id') AS b FROM tools GROUP BY 1) SELECT case_id, CASE WHEN a AND NOT b THEN 'digit wins' WHEN b AND NOT a THEN 'id wins' WHEN NOT a AND NOT b THEN 'all wrong' ELSE 'all right' END AS outcome FROM w")
def model_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tools(spark, sf_dir).groupBy("case_id").agg(*[F.bool_or(F.when(F.col("tool") == t, ev.hit())).alias(n) for n, t in (("a", "digit"), ("b", "id"))])
    a, b = F.col("a"), F.col("b")
    return w.select("case_id", F.when(a & ~b, "digit wins").when(b & ~a, "id wins").when(~a & ~b, "all wrong").otherwise("all right").alias("outcome"))


@query("SELECT claim_id, claim_type FROM claim WHERE claim_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim_type ORDER BY md5('7:' || claim_id), claim_id) <= 20")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows per class, chosen by hash: the sampling operator itself."""
    return tables.balanced_sample(read(spark, sf_dir, "claim").where("claim_type is not null").select("claim_id", "claim_type"), "claim_type", "claim_id", 20, 7)


@query("SELECT c.claim_id FROM claim c WHERE NOT EXISTS (SELECT 1 FROM citation t WHERE t.claim_id = c.claim_id)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims for which the ledger (here: citations) has no entry yet."""
    return tables.pending(read(spark, sf_dir, "claim").select("claim_id"), read(spark, sf_dir, "citation"), "claim_id")


@query("SELECT doc_id, source, loaded_at FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY loaded_at, doc_id) = 1")
def keep_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "loaded_at").withColumn("p", F.struct("loaded_at", "doc_id"))
    return tables.keep_first(d, ["source"], "p").drop("p")


@query("SELECT claim_id, claim_type, classification_confidence, row_number() OVER (PARTITION BY claim_type ORDER BY classification_confidence DESC, claim_id) AS rank FROM claim QUALIFY rank <= 3")
def confident_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most confident cases of each type: a top-k report."""
    c = read(spark, sf_dir, "claim").select("claim_id", "claim_type", "classification_confidence")
    return tables.top_k(c, ["claim_type"], [F.desc_nulls_last("classification_confidence"), F.col("claim_id")], 3)


@query("SELECT label, CASE label WHEN 'factual_claim' THEN 0 WHEN 'methodological_statement' THEN 1 WHEN 'opinion_or_interpretation' THEN 2 WHEN 'background_or_definition' THEN 3 WHEN 'non_claim' THEN 4 ELSE 5 END AS place FROM (SELECT claim_type AS label FROM claim UNION SELECT expected_claim_type FROM rq_claim_annotations) WHERE label IS NOT NULL")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of observed labels with the place in the fixed order."""
    both = read(spark, sf_dir, "claim").select(F.col("claim_type").alias("label")).union(read(spark, sf_dir, "rq_claim_annotations").select("expected_claim_type")).distinct().where("label is not null")
    place = F.coalesce(F.array_position(F.lit(list(TYPES)), F.col("label")), F.lit(0)) - 1
    return both.select("label", F.when(place < 0, 5).otherwise(place).cast("int").alias("place"))


@query("SELECT document FROM claim INTERSECT SELECT document FROM rq_claim_annotations")
def shared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "claim").select("document").intersect(read(spark, sf_dir, "rq_claim_annotations").select("document"))


@query("SELECT document FROM parsed_reference EXCEPT SELECT document FROM rq_claim_annotations")
def documents_without_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with references but without annotated claims."""
    return read(spark, sf_dir, "parsed_reference").select("document").subtract(read(spark, sf_dir, "rq_claim_annotations").select("document"))


@query("SELECT m.method, s.chunk_size, o.overlap, m.method || '/' || s.chunk_size || '/' || o.overlap AS config_id FROM (VALUES ('fixed'), ('sentence'), ('recursive')) m(method) CROSS JOIN (VALUES (128), (256), (512), (1024)) s(chunk_size) CROSS JOIN (VALUES (0), (64)) o(overlap)")
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment grid: product of three fixed value lists, by generators."""
    one = spark.range(1).select(F.explode(F.lit(["fixed", "sentence", "recursive"])).alias("method"))
    grid = one.select("method", F.explode(F.lit([128, 256, 512, 1024])).alias("chunk_size")).select("*", F.explode(F.lit([0, 64])).alias("overlap"))
    return grid.withColumn("config_id", F.concat_ws("/", "method", "chunk_size", "overlap"))
