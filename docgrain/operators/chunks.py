"""Stateful text windows that no expression states well: one Arrow pass over (key, text), in proportion to the text.

All give (key, chunk_no, chunk); null and blank texts give no rows; repeated rows give repeated chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.session import spread

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\[])|(?<=;)\s+(?=[A-Z0-9])")
_STYLE = re.compile(r"(?<=[.!?])\s+")
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _split(pattern: re.Pattern, text: str) -> list[str]:
    return [s for p in pattern.split(text) if (s := p.strip())]


def fixed_words(text: str, size: int, overlap: int) -> list[str]:
    words = text.split()
    return [" ".join(words[k : k + size]) for k in range(0, len(words), max(1, size - overlap))]


def overlapping(text: str, size: int = 95, overlap: int = 20) -> list[str]:
    """Sentences packed up to ``size`` words, each chunk begun with the last ``overlap`` words of the one before; a longer
    sentence stays whole unless it is all there is."""
    if len(text.split()) <= size:
        return [" ".join(text.split())] if text.split() else []
    out: list[str] = []
    held: list[str] = []
    for sentence in _split(_SENTENCE, text):
        words = sentence.split()
        if held and len(held) + len(words) > size:
            out.append(" ".join(held))
            held = held[-overlap:] if overlap else []
        held = held + words
    if held:
        out.append(" ".join(held))
    return out if len(out) > 1 or len(out[0].split()) <= size else fixed_words(text, size, overlap)


def bounded(text: str, target: int = 120, most: int = 180, tail: int = 40) -> list[str]:
    """Sentence windows: closed once ``target`` words are held and the next sentence would exceed ``most``; a last window
    under ``tail`` words joins its forerunner."""
    if len(text.split()) <= most:
        return [text] if text.strip() else []
    windows: list[list[str]] = [[]]
    held = 0
    for sentence in _split(_STYLE, text):
        n = len(sentence.split())
        if windows[-1] and held >= target and held + n > most:
            windows.append([])
            held = 0
        windows[-1].append(sentence)
        held += n
    if len(windows) > 1 and held < tail:
        last = windows.pop()
        windows[-1] += last
    return [" ".join(w) for w in windows if w] or [text]


def sentence_chars(text: str, size: int = 512, overlap: int = 64) -> list[str]:
    """Sentences packed up to ``size`` characters (blanks between them not counted); whole trailing sentences of at
    most ``overlap`` characters are repeated."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for sentence in _split(_STYLE, text):
        if held and total + len(sentence) > size:
            out.append(" ".join(held))
            kept: list[str] = []
            total = 0
            for s in reversed(held):
                if total + len(s) > overlap:
                    break
                kept.insert(0, s)
                total += len(s)
            held = kept
        held.append(sentence)
        total += len(sentence)
    return [*out, " ".join(held)] if held else out


def recursive(text: str, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the first separator that occurs, pieces packed up to ``size`` characters; a longer piece is cut by the
    separators after it; whole parts of at most ``overlap`` characters are repeated."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    here = next((k for k, s in enumerate(separators) if s in text), None)
    if here is None:
        step = max(1, size - overlap)
        return [c for k in range(0, len(text), step) if (c := text[k : k + size].strip())]
    glue, rest = separators[here], separators[here + 1 :]
    out: list[str] = []
    held: list[str] = []
    for part in text.split(glue):
        if len(part) > size:
            if held:
                out.append(glue.join(held))
                held = []
            out += recursive(part, size, overlap, rest)
            continue
        if held and len(glue.join([*held, part])) > size:
            out.append(glue.join(held))
            while held and (len(glue.join(held)) > overlap or len(glue.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    if held:
        out.append(glue.join(held))
    return [c for o in out if (c := o.strip())]


def windows(df: DataFrame, key: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """As ``chunked`` for keys of any type, which stay in the JVM's rows: only texts and their chunks pass through Python."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut(x) if x is not None else [])

    return spread(df).select(key, F.posexplode(pieces(F.col(text))).alias("chunk_no", "chunk"))


def chunked(df: DataFrame, key: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    """(key, chunk_no, chunk) for every row, by a function from text to chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, c) for k, t in zip(batch["k"], batch["t"], strict=True) for n, c in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["k", "chunk_no", "chunk"])

    narrow = df.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    return spread(narrow).mapInPandas(run, "k bigint, chunk_no int, chunk string").withColumnRenamed("k", key)
