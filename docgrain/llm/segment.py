"""Splitting oversized texts at natural boundaries, with overlap.

Lexical cohesion: between every two sentences the words of the block before and of the block after are compared by
cosine; a valley's depth is how far the similarity lies below the nearest peaks on both sides. Pieces are cut greedily
from the start: within the size window the gap with the deepest valley is taken (the last of equal ones), without a
sentence gap the last word boundary, and inside a word only where the window holds no boundary. The next piece begins
at the natural boundary that makes the overlap largest within its limit, at a word's beginning.

Defined results: null texts and texts up to the limit give no piece (there is nothing to split); blanks belong to the
pieces, so these cover the text whole; a text without any boundary is cut at the limit with full overlap; repeated
rows give repeated pieces; other columns are not read. Work and memory follow the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.leak import pieces as chunked
from docgrain.llm.tokens import SINGLE, table, words
from docgrain.session import spread

LIMIT, OVERLAP = 1800, 150
#: A piece is at least this part of the limit, so that a deep valley near its start can't make tiny pieces.
LEAST = 0.5
#: Sentences in a block and hash buckets of the words' counts.
BLOCK, BUCKETS = 3, 128
_WHITE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…؟۔।॥"], np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "。！？｡．"], np.uint32)
_CLOSE = np.array([ord(c) for c in "\"'”’»」』】）)]"], np.uint32)


def _flags(values: np.ndarray) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[values] = True
    return out


WHITE, STOP, WIDE, CLOSE = map(_flags, (_WHITE, _STOPS, _WIDE_STOPS, _CLOSE))


def boundaries(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which a sentence or line begins, and at which a word begins."""
    n = len(code)
    white, stop, wide, close = WHITE[code], STOP[code], WIDE[code], CLOSE[code]
    single = (table()[code] & SINGLE) > 0
    word = np.zeros(n, bool)
    word[1:] = ~(white | stop | wide | close)[1:] & (white[:-1] | single[1:] | single[:-1])
    # the last character before the blanks that end here, closing marks passed over
    index = np.arange(n)
    solid = np.maximum.accumulate(np.where(white, -1, index))
    core = np.maximum.accumulate(np.where(white | close, -1, index))
    before = np.concatenate(([-1], solid[:-1]))
    ends = np.zeros(n, bool)
    has = before >= 0
    last = np.where(has, core[np.maximum(before, 0)], -1)
    ends[last >= 0] = (stop | wide)[last[last >= 0]]
    begins = word & ends & np.concatenate(([False], white[:-1]))
    begins[1:] |= ~white[1:] & ~close[1:] & ~wide[1:] & (wide[:-1] | close[:-1]) & np.concatenate(([False], wide[:-2]))[: n - 1] | ~white[1:] & ~close[1:] & ~wide[1:] & wide[:-1]
    # a line break before the word
    newline = np.maximum.accumulate(np.where(code == 10, index, -1))
    begins |= word & (np.concatenate(([-1], newline[:-1])) > before) & has
    return np.flatnonzero(begins), np.flatnonzero(word)


def depths(gap: np.ndarray, start: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at every gap of one text."""
    if not len(gap):
        return np.zeros(0)
    sentence = np.searchsorted(gap, start, "right")
    counts = np.bincount(sentence * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=(len(gap) + 1) * BUCKETS)
    total = np.zeros((len(gap) + 2, BUCKETS), np.float32)
    np.cumsum(counts.reshape(len(gap) + 1, BUCKETS), axis=0, out=total[1:])
    at = np.arange(1, len(gap) + 1)
    left = total[at] - total[np.maximum(at - BLOCK, 0)]
    right = total[np.minimum(at + BLOCK, len(gap) + 1)] - total[at]
    norm = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
    like = np.einsum("ij,ij->i", left, right) / np.maximum(norm, 1e-9)
    # peaks are sought on the smoothed curve, so that noise on a slope does not end the climb
    padded = np.concatenate((like[:1], like, like[-1:]))
    smooth = (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4
    return _peaks(smooth) + _peaks(smooth[::-1])[::-1] - 2 * like


def _peaks(like: np.ndarray) -> np.ndarray:
    """For every gap the height reached climbing to the left while the similarity does not fall."""
    # runs in which the values do not fall towards the left share their first value as peak
    starts = np.ones(len(like), bool)
    starts[1:] = like[1:] > like[:-1]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(like)), 0))
    return np.maximum(like[first], like)


def cuts(size: int, gap: np.ndarray, depth: np.ndarray, word: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of ``size`` characters."""
    out, start = [], 0
    while size - start > limit:
        # gaps within the window: from its least size to the limit
        low = np.searchsorted(gap, start + max(int(limit * LEAST), overlap + 1))
        high = np.searchsorted(gap, start + limit, "right")
        natural = True
        if high > low:
            window = depth[low:high]
            end = int(gap[low + len(window) - 1 - int(np.argmax(window[::-1]))])
        else:
            k = np.searchsorted(word, start + limit, "right") - 1
            if k >= 0 and word[k] > start + overlap:
                end = int(word[k])
            else:
                end, natural = start + limit, False
        out.append((start, end))
        k = np.searchsorted(word, end - overlap)
        start = int(word[k]) if k < len(word) and word[k] < end else end if natural else end - overlap
    out.append((start, size))
    return out


def split(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, int]]:
    """(index of the text, piece number from 1, start, length) for the texts longer than ``limit``."""
    long = [k for k, t in enumerate(texts) if len(t) > limit]
    if not long:
        return
    w = words([texts[k] for k in long])
    for n, k in enumerate(long):
        text = texts[k]
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        gap, word = boundaries(code)
        own = slice(w.first[n], w.first[n + 1])
        depth = depths(gap, w.start[own] - w.base[n], w.hashes[own])
        for number, (a, b) in enumerate(cuts(len(text), gap, depth, word, limit, overlap), 1):
            yield k, number, a, b - a


def split_oversized(df: DataFrame, key: str, column: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(doc_id, piece_no, start_char, n_chars[, piece]) of every text longer than ``limit``; narrow, no shuffle."""
    if not 0 <= overlap < limit * LEAST:
        raise ValueError("the overlap must be smaller than the least size of a piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunked(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))):
                rows = list(split([t for _, t in chunk], limit, overlap))
                found = {
                    "doc_id": pa.array([chunk[k][0] for k, *_ in rows], pa.int64()),
                    "piece_no": pa.array([p for _, p, _, _ in rows], pa.int32()),
                    "start_char": pa.array([s for _, _, s, _ in rows], pa.int32()),
                    "n_chars": pa.array([n for *_, n in rows], pa.int32()),
                }
                if with_text:
                    found["piece"] = pa.array([chunk[k][1][s : s + n] for k, _, s, n in rows], pa.string())
                yield pa.RecordBatch.from_pydict(found)

    schema = "doc_id bigint, piece_no int, start_char int, n_chars int" + (", piece string" if with_text else "")
    narrow = df.select(F.col(key).cast("bigint").alias("k"), F.col(column).cast("string").alias("t"))
    return spread(narrow.where(F.length("t") > limit)).mapInArrow(run, schema)
