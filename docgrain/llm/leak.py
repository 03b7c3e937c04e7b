"""Evaluation texts leaking into training text.

Spaced-seed hashing: a fixed mask of four word positions, three of them with one ignored position, is hashed at every
word of test items and documents. Document hashes meet the test hashes in the map stage; around every hit the words
of item and document are compared along the hit's diagonal, and a document contains an item if a continuous part of at
least half the item's words, beginning and ending with agreeing words, agrees in all but one word of five.

The masks lose nothing at that rate: with at most one changed word in five, every part of seven or more words holds
four agreeing words under one of the masks. Shorter items are compared by the mask ``short`` of all their words or by
runs of up to three words.

Defined results: null or empty documents and items match nothing; an item with fewer than three words must occur
whole; repeated documents are reported each; the text is read whole, whatever its length; other columns are not read.
The test set is used in blocks of a bounded number of hashes, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.tokens import words
from docgrain.session import spread

MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: For items whose half is shorter than seven words.
SHORT = ((0,), (0, 1), (0, 1, 2))
#: A block of test items holds at most so many words (each gives one hash a mask: 2 MB of hashes).
BLOCK_WORDS = 60_000
PART = 0.5
#: At most so many changed words in so many.
CHANGED = (1, 5)
BITS = 20
#: Code points of text handled at once.
CHUNK = 4_000_000


def seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every word at which it fits."""
    n = max(0, len(h) - mask[-1])
    out = np.full(n, 0xD6E8FEB86659FD93 + len(mask), np.uint64)
    for k, offset in enumerate(mask):
        out = (out ^ h[offset : offset + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        out ^= out >> np.uint64(31)
    return out


class Block:
    """The seeds of a block of items, sorted by hash, with a bit table that lets most words be passed over."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        w = words([text for _, text in items], marks=True)
        self.keys = [key for key, _ in items]
        self.words = [w.hashes[w.first[k] : w.first[k + 1]] for k in range(len(items))]
        self.tables = []
        for number, mask in enumerate((*MASKS, *SHORT)):
            hashes, part, place = [], [], []
            for k, own in enumerate(self.words):
                half = int(np.ceil(len(own) * PART))
                small = 3 if half >= 5 else 2 if half >= 3 else 1
                if half >= 7 if number < len(MASKS) else (half < 7 and len(mask) == min(small, len(own))):
                    found = seeds(own, mask)
                    hashes.append(found)
                    part.append(np.full(len(found), k))
                    place.append(np.arange(len(found)))
            if hashes:
                h, p, q = np.concatenate(hashes), np.concatenate(part), np.concatenate(place)
                order = np.argsort(h, kind="stable")
                h, p, q = h[order], p[order], q[order]
                bits = np.zeros(1 << BITS, bool)
                bits[h >> np.uint64(64 - BITS)] = True
                self.tables.append((mask, h, p, q, bits))

    def matches(self, texts: list[str]) -> set[tuple[int, int]]:
        """(row, item key) of all texts that contain an item."""
        w = words(texts, marks=True)
        tried: set[tuple[int, int, int]] = set()
        found: set[tuple[int, int]] = set()
        for mask, h, part, place, bits in self.tables:
            own = seeds(w.hashes, mask)
            at = np.flatnonzero(bits[own >> np.uint64(64 - BITS)])
            if len(at):
                at = at[w.row[at] == w.row[at + mask[-1]]]
            low, high = np.searchsorted(h, own[at], "left"), np.searchsorted(h, own[at], "right")
            count = high - low
            if not count.any():
                continue
            spot = np.repeat(at, count)
            entry = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            hits = np.unique(np.stack([w.row[spot], part[entry], spot - place[entry]]), axis=1)
            for row, k, diagonal in hits.T.tolist():
                if (row, self.keys[k]) in found or (row, k, diagonal) in tried:
                    continue
                tried.add((row, k, diagonal))
                if self.verified(w.hashes, w.first[row], w.first[row + 1], diagonal, self.words[k]):
                    found.add((row, self.keys[k]))
        return found

    @staticmethod
    def verified(h: np.ndarray, first: int, end: int, diagonal: int, item: np.ndarray) -> bool:
        """Whether a part of at least half the item, first and last word agreeing, has at most one other word in five.

        A part from the i-th to the j-th agreeing word fits if 5 (j - i + 1) >= 4 (its length), that is if g(j) >= g(i) - 1
        with g(k) = 5 k - 4 place(k); the least g among the starts far enough before j decides in linear time."""
        n = len(item)
        low, high = max(0, first - diagonal), min(n, end - diagonal)
        need = max(int(np.ceil(n * PART)), 1) if n >= 3 else n
        if high - low < need:
            return False
        place = np.flatnonzero(h[diagonal + low : diagonal + high] == item[low:high])
        g = CHANGED[1] * np.arange(len(place)) - (CHANGED[1] - CHANGED[0]) * place
        start = np.searchsorted(place, place - need + 1, "right") - 1
        fits = start >= 0
        return bool((g[fits] >= np.minimum.accumulate(g)[start[fits]] - CHANGED[0]).any()) if fits.any() else False


def blocks(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for key, text in items:
        n = len(text.split()) + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += n
    if block:
        yield block


def pieces(values: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Texts in chunks of bounded length; one longer text is a chunk of its own."""
    chunk: list[tuple[int, str]] = []
    size = 0
    for value in values:
        if chunk and size + len(value[1]) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(value)
        size += len(value[1])
    if chunk:
        yield chunk


def leaked(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_texts: list[str]) -> DataFrame:
    """Distinct (item, doc) pairs: the document contains one of the item's texts, whole, in part or altered.

    Items stream from the test table to the driver in blocks; the documents are read once per block and never move.
    """
    rows = items.select(F.col(item_key).cast("bigint").alias("k"), *[F.col(c).cast("string").alias(f"t{n}") for n, c in enumerate(item_texts)])
    narrow = docs.select(F.col(doc_key).cast("bigint").alias("d"), F.col(doc_text).cast("string").alias("t")).where("d is not null and t is not null")
    parts = ((r.k, r[f"t{n}"]) for r in rows.distinct().toLocalIterator() if r.k is not None for n in range(len(item_texts)) if r[f"t{n}"])
    result: DataFrame | None = None
    for block in blocks(sorted(parts)):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            seeds_of = Block(block)
            for batch in batches:
                pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                for chunk in pieces(pairs):
                    found = sorted((item, chunk[row][0]) for row, item in seeds_of.matches([t for _, t in chunk]))
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["item", "doc"], dtype="int64"), preserve_index=False)

        one = spread(narrow).mapInArrow(run, "item bigint, doc bigint")
        result = one if result is None else result.unionByName(one)
    if result is None:
        return narrow.sparkSession.createDataFrame([], "item bigint, doc bigint")
    return result.distinct()
