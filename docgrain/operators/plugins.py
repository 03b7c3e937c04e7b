"""Pluggable verifiers and detectors: a registry from a name to a DataFrame transformation, prompts, parsed answers.

A verifier takes rows with ``claim`` and ``evidence`` (ranked texts) and adds status, confidence, error. Failures of a row
give insufficient_evidence with the error kept; in strict mode they raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions.numbers import clamp, round_half_up

Transformation = Callable[[DataFrame], DataFrame]
_VERIFIERS: dict[str, Transformation] = {}
# The verdicts in report order.
VERDICTS = ("supported", "partially_supported", "not_supported", "contradicted", "insufficient_evidence")


def register(name: str) -> Callable[[Transformation], Transformation]:
    def add(run: Transformation) -> Transformation:
        _VERIFIERS[name.lower()] = run
        return run

    return add


def verifier(name: str) -> Transformation:
    try:
        return _VERIFIERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown verifier {name!r}; known are {', '.join(sorted(_VERIFIERS))}") from None


#: Detectors of machine-written text: a name to a function from (key, text) rows to (key, score) rows, score None where the text is too short.
_DETECTORS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}


def register_detector(name: str) -> Callable:
    def add(run: Callable[[DataFrame, str, str], DataFrame]) -> Callable[[DataFrame, str, str], DataFrame]:
        _DETECTORS[name.lower()] = run
        return run

    return add


def detected(name: str, df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(key, score, label, detector) by a registered detector: likely_ai from ``threshold`` on, insufficient_text without a score."""
    if name.lower() not in _DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known are {', '.join(sorted(_DETECTORS))}")
    score = F.col("score")
    label = F.when(score.isNull(), "insufficient_text").when(score >= threshold, "likely_ai").otherwise("likely_human")
    return _DETECTORS[name.lower()](df, key, text).select(key, score, label.alias("label"), F.lit(name.lower()).alias("detector"))


def prompt(claim: Column, evidence: Column, most: int = 3500) -> Column:
    """A request for a verdict from at most five evidence texts, the context cut to ``most`` characters."""
    numbered = F.transform(F.slice(evidence, 1, 5), lambda e, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), e))
    context = F.left(F.array_join(numbered, "\n"), F.lit(most))
    ask = "Judge whether the evidence supports the claim. Answer with a JSON object with status (" + ", ".join(VERDICTS) + "), confidence from 0 to 1, and rationale.\nClaim: "
    return F.concat(F.lit(ask), claim, F.lit("\nEvidence:\n"), F.when(F.size(evidence) > 0, context).otherwise("none"))


def answer(text: Column) -> Column:
    """struct(status, confidence, rationale, error) from a model's answer: the first JSON object in it, fenced or not."""
    parsed = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "status string, confidence double, rationale string")
    known = parsed["status"].isin(*VERDICTS)
    return F.struct(
        F.when(known, parsed["status"]).otherwise("insufficient_evidence").alias("status"),
        F.when(known, round_half_up(clamp(F.coalesce(parsed["confidence"], F.lit(0.0))))).otherwise(0.0).alias("confidence"),
        F.coalesce(parsed["rationale"], F.lit("no rationale given")).alias("rationale"),
        F.when(~F.coalesce(known, F.lit(False)), "answer without a known verdict").alias("error"),
    )


def from_function(ask: Callable[[str], str], strict: bool = False) -> Transformation:
    """A verifier from a function of the prompt, called row by row on the executors: a row whose call fails keeps
    the error, or raises when strict."""

    def run(df: DataFrame) -> DataFrame:
        asked = df.withColumn("__prompt", prompt(F.col("claim"), F.col("evidence")))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields if f.name != "__prompt") + ", `__answer` string, `__error` string"

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                answers, errors = [], []
                for p in b["__prompt"]:
                    try:
                        answers.append(ask(p))
                        errors.append(None)
                    except Exception as e:
                        if strict:
                            raise
                        answers.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield b.drop(columns="__prompt").assign(__answer=answers, __error=errors)

        got = asked.mapInPandas(call, schema).withColumn("__v", answer(F.col("__answer")))
        return got.select(*df.columns, F.coalesce("__v.status", F.lit("insufficient_evidence")).alias("status"), F.coalesce("__v.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("__error", "__v.error").alias("error"))

    return run


@register("heuristic")
def _heuristic(df: DataFrame) -> DataFrame:
    from docgrain.functions import text as t
    from docgrain.operators import retrieval

    scores = F.transform("evidence", lambda e: retrieval.lexical_score(t.tokens(F.col("claim")), t.tokens(e)))
    top = F.slice(F.sort_array(scores, asc=False), 1, 3)
    n = F.greatest(F.lit(1), F.size(top))
    ready = df.withColumns({"combined": F.array_join("evidence", " "), "best": F.array_max(scores), "mean_top": F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / n, "claim_tokens": t.tokens(F.col("claim"))})
    return retrieval.judge(ready).select(*df.columns, "status", "confidence", F.lit(None).cast("string").alias("error"))
