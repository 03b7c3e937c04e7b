"""Evidence retrieval and verdicts: lexical scores, dense scores, top-k and rerank, five-way judgement.

Token arrays are columns made once per text, before any join. Candidates of a claim come through an equality (its own
case or reference) or through an inverted list on tokens; pairs without a shared token score 0 and are never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.functions.numbers import clamp, ratio, round_half_up
from docgrain.operators import tables

# Tokens too general to count for coverage, and the thresholds of the judgement.
GENERAL = ("study", "paper", "result", "show", "found", "report", "claim", "prior")
MIN_SCORE, TOP = 0.08, 5
# Cue patterns of contradiction and missing support.
NEGATION = r"\b(no|not|never|without|failed to|fails to|does not|do not|did not|cannot)\b"
ABSOLUTES = r"\b(eliminate|eliminates|eliminated|all|always|never|requires no)\b"
DEPENDS = r"\b(hallucinat|depends?|requires?|preprocess)\w*\b"
UP, NOT_UP = r"\b(improves?|improved|increases?|increased|outperforms?|higher)\b", r"\b(no significant|did not improve|does not improve|worse|lower|decreased|reduced)\b"
DOWN, NOT_DOWN = r"\b(reduces?|reduced|decreases?|decreased|lower)\b", r"\b(increased|higher|worse|did not reduce|does not reduce)\b"
NEEDS = r"\b(depends?|requires?|preprocess\w*)\b"
UNTESTED = r"\b(does not test|did not test|not evaluated|not evaluate|no evidence|not mention|unrelated)\b"
SILENT = r"\b(the source|this source|the article)\b.{0,80}\b(does not|did not|fails to)\b"


def lexical_score(query: Column, passage: Column) -> Column:
    """Hybrid score of two token arrays: cosine of counts, containment, Jaccard, bigrams, bonus for a shared phrase."""
    qd, pd_ = F.array_distinct(query), F.array_distinct(passage)
    shared = F.array_intersect(qd, pd_)
    count = lambda toks, w: F.size(F.filter(toks, lambda x: x == w)).cast("double")
    dot = F.aggregate(shared, F.lit(0.0), lambda a, w: a + count(query, w) * count(passage, w))
    norm = lambda toks, d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, w: a + count(toks, w) * count(toks, w)))
    length = norm(query, qd) * norm(passage, pd_)
    cosine = F.when(length > 0, dot / length).otherwise(0.0)
    containment, jaccard = ratio(F.size(shared), F.size(qd), None), ratio(F.size(shared), F.size(F.array_union(qd, pd_)), None)
    qb = t.bigrams(query)
    pairs = ratio(F.size(F.array_intersect(qb, t.bigrams(passage))), F.size(qb), None)
    joined = F.array_join(passage, " ")
    runs = F.concat(t.phrases(query, 4), t.phrases(query, 3))
    bonus = F.when(F.exists(runs, lambda p: F.contains(joined, p)), 0.06).otherwise(0.0)
    total = 0.40 * cosine + 0.32 * containment + 0.12 * jaccard + 0.16 * pairs + bonus
    return F.when((F.size(qd) == 0) | (F.size(pd_) == 0), 0.0).otherwise(round_half_up(F.least(F.lit(1.0), total)))


def contradiction(claim: Column, evidence: Column) -> Column:
    c, e = F.lower(claim), F.lower(evidence)
    rules = ((c.rlike(ABSOLUTES) & e.rlike(NEGATION), 0.75), (c.rlike(ABSOLUTES) & e.rlike(DEPENDS), 0.65), (c.rlike(UP) & e.rlike(NOT_UP), 0.75), (c.rlike(DOWN) & e.rlike(NOT_DOWN), 0.75), (c.contains("requires no") & e.rlike(NEEDS), 0.8))
    return F.greatest(*[F.when(condition, F.lit(strength)).otherwise(0.0) for condition, strength in rules])


def untested(evidence: Column) -> Column:
    e = F.lower(evidence)
    return F.when(e.rlike(UNTESTED), 0.7).when(e.rlike(SILENT), 0.6).otherwise(0.0)


def coverage(claim_tokens: Column, evidence_tokens: Column) -> Column:
    """Share of the claim's telling tokens that the evidence has."""
    own = F.array_except(F.array_distinct(claim_tokens), F.lit(list(GENERAL)))
    return F.when(F.size(evidence_tokens) > 0, ratio(F.size(F.array_intersect(own, evidence_tokens)), F.size(own))).otherwise(0.0)


def judge(df: DataFrame) -> DataFrame:
    """(…, status, confidence) of rows with claim, combined, best, mean_top, claim_tokens."""
    c = df.withColumns({
        "coverage": coverage(F.col("claim_tokens"), t.tokens(F.col("combined"))), "against": contradiction(F.col("claim"), F.col("combined")), "silent": untested(F.col("combined")),
    })
    best, cov = F.col("best"), F.col("coverage")

    def confidence(cue: Column, cap: float = 0.92) -> Column:
        return round_half_up(clamp(best * 0.42 + F.col("mean_top") * 0.20 + cov * 0.28 + cue * 0.10, 0.05, cap))

    rules = (
        (best.isNull(), "insufficient_evidence", F.lit(0.0)),
        (F.col("against") >= 0.45, "contradicted", confidence(F.col("against"))),
        (F.col("silent") >= 0.45, "not_supported", confidence(F.col("silent"))),
        ((best < 0.14) & (cov < 0.25), "insufficient_evidence", round_half_up(F.greatest(F.lit(0.05), best))),
        ((best >= 0.52) & (cov >= 0.55), "supported", confidence(F.lit(0.15))),
        ((best >= 0.25) | (cov >= 0.35), "partially_supported", confidence(F.lit(0.0), 0.78)),
    )
    status, conf = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for condition, name, value in rules:
        status, conf = status.when(condition, name), conf.when(condition, value)
    return c.withColumns({"status": status.otherwise("not_supported"), "confidence": conf.otherwise(confidence(F.lit(0.0), 0.62))})


def gathered(ranked: DataFrame, key: str) -> DataFrame:
    """Per claim the evidence of its ranked passages: joined text of the first five, best and mean of the first three."""
    top = ranked.where(f"rank <= {TOP} and score >= {MIN_SCORE}")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda s: s["passage"]), " ")  # at most five
    return top.groupBy(key).agg(texts.alias("combined"), F.max("score").alias("best"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("mean_top"))


def rerank(candidates: DataFrame, query: str, position: str, first: str, second: str, wide: int, keep: int) -> DataFrame:
    """The ``keep`` best by ``second`` among the ``wide`` best by ``first``."""
    pool = tables.top_k(candidates, [query], [F.desc(first), F.col(position)], wide, "first_rank")
    return tables.top_k(pool, [query], [F.desc(second), F.col("first_rank")], keep, "rank")
