"""Folded word hashes of many texts at once, with numpy over code points.

Folding removes case, accents, invisible characters and the differences between look-alike letters; everything that
is neither letter nor digit separates words; a hyphen at a line's end joins. Letters of scripts written without blanks
are words of their own. Words are 64-bit polynomial hashes, so equal folded words have equal hashes anywhere.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from docgrain.llm.lookalike import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

BASE = np.uint64(0x9E3779B97F4A7C15)
SINGLE = 1 << 22  # bit of code points that are words of their own
GONE, BREAK = 0, 1
#: Marks inserted into running text: numeric citation brackets and tags.
MARKS = re.compile(r"\[\s?\d[\d\s,;&–—\-]*(?:and[\d\s,;&–—\-]+)*\]|</?[a-zA-Z]{1,6}\s?/?>")
# Further letters drawn much alike. Both sides of every comparison are folded, so this only adds equality.
NEAR, NEAR_AS = "κкαρτтυιηнмвѵգոս", "kkapttuinhmbvqnu"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe"}
_LIGATURE = re.compile("[" + "".join(_LIGATURES) + "]")


def _single(code: int) -> bool:
    return 0x0E00 <= code < 0x0E80 or 0x3040 <= code < 0x3100 or 0x3400 <= code < 0xA000 or 0xF900 <= code < 0xFB00


@functools.cache
def table() -> np.ndarray:
    """What every code point of the basic plane folds to: GONE, BREAK or a letter (beyond that plane: itself)."""
    alike = dict(zip(CYRILLIC + GREEK + NEAR, CYRILLIC_AS + GREEK_AS + NEAR_AS, strict=True))
    out = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x10000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn", "Me") and not 0x0900 <= code < 0x0E00:
            out[code] = GONE
            continue
        if code > 0x7F:
            c = unicodedata.normalize("NFKD", c)[:1]
            c = alike.get(c, c)
            c = unicodedata.normalize("NFKD", c)[:1]
        c = c.lower()[:1]
        c = alike.get(c, c)
        if _single(code):
            out[code] = code | SINGLE
        elif c.isalnum() or unicodedata.category(c)[0] == "M":
            out[code] = ord(c)
        else:
            out[code] = BREAK
    return out


@dataclass
class Words:
    """Words of a batch: hash, row, and the code point span of each in the joined text; ``base`` is each row's start."""

    hashes: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    base: np.ndarray
    first: np.ndarray  # index of each row's first word, and the number of words at the end
    whole: np.ndarray  # words of two or more letters, or of one letter in scripts without blanks


def words(texts: list[str], marks: bool = False) -> Words:
    """Words of ``texts``; ``marks`` blanks out inserted citation brackets and tags first. Empty texts have no words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if marks:  # in every text by itself, so that no mark reaches over into the next
        blank = lambda m: "\u200b" * (m.end() - m.start() - 1) + " "
        texts = [MARKS.sub(blank, t) if "[" in t or "<" in t else t for t in texts]
    joined = "\n".join(texts)
    expand = None
    if _LIGATURE.search(joined):  # one character for several: the first letter stays in place, spans stay right
        expand = [(m.start(), _LIGATURES[m.group(0)]) for m in _LIGATURE.finditer(joined)]
    base = np.concatenate(([0], np.cumsum(sizes[:-1] + 1))) if len(texts) else np.zeros(0, np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    fold = table()[code]
    at = None
    if expand:
        extra = np.ones(len(code), np.int64)
        for k, text in expand:
            extra[k] = len(text)
        at = np.repeat(np.arange(len(code)), extra)
        fold = fold[at]
        where = np.concatenate(([0], np.cumsum(extra)))
        for k, text in expand:
            fold[where[k] : where[k] + len(text)] = [ord(c) for c in text]
        code = code[at]
    if len(code) > 1:
        # a hyphen at a line's end joins the parts of a word
        line = np.flatnonzero((code[:-1] == 45) & (code[1:] == 10))
        line = line[(line > 0) & (line + 2 < len(code))]
        line = line[(fold[line - 1] > BREAK) & (code[line + 2] >= 97)]
        if len(base) > 1:
            origin = line + 1 if at is None else at[line + 1]
            line = line[~np.isin(origin, base[1:] - 1)]
        fold[line] = fold[line + 1] = GONE
    kept = np.flatnonzero(fold != GONE)
    fold = fold[kept]
    letter = fold > BREAK
    single = (fold & SINGLE) > 0
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | single[1:] | single[:-1]
    close = letter.copy()
    close[:-1] &= ~letter[1:] | single[1:] | single[:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
    n = len(fold)
    power = np.full(n + 1, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((fold.astype(np.uint64) + np.uint64(7)) * letter * power[:-1], out=total[1:])
    # equal words have equal hashes wherever they stand: the power of the start is divided out
    inverse = np.full(n + 1, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    h = (total[e] - total[s]) * inverse[s]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    start, end = kept[s], kept[e - 1] + 1
    if at is not None:
        start, end = at[start], at[end - 1] + 1
    row = np.searchsorted(base, start, "right") - 1
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    return Words(h, row, start, end, base, first, (e - s > 1) | single[s])
