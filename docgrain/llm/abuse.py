"""Abusive, hateful or sexual content: nearest labelled examples by exact TF-IDF cosine.

Every sentence of every document is compared with labelled examples. Terms are folded words and pairs of adjacent
words of the examples; words unknown to the examples count in a sentence's length with a fixed weight. Disguises are
undone first: stretched letters, letters set apart, letters replaced by signs. Document frequencies of the index terms
are counted over all documents. The index is an inverted index whose postings are blocks of examples with the largest
weight of each block; blocks whose bound stays under the least useful cosine are skipped, which loses nothing, and the
rest is scored exactly. The nearest examples vote with weights that fall with distance; a logistic curve, fitted by judging
each example without all examples of its group, turns the votes into a probability. A document has the score of its worst sentence, and that
sentence and its nearest example are the evidence.

Defined results: null text has no score (null); empty text scores 0; repeated rows are scored each; texts are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.abuse_examples import examples as default_examples
from docgrain.llm.leak import pieces
from docgrain.llm.tokens import Words, words
from docgrain.session import spread

BLOCK = 32
#: Cosines below are no neighbours; so many neighbours vote; the weight of a vote is the cosine to this power.
LEAST, NEIGHBOURS, POWER = 0.2, 9, 4
#: The score from which a document is reported. The curve is fitted without an example's own group, so it is a careful one.
THRESHOLD = 0.4
#: At most so many labelled examples are used.
MOST_EXAMPLES = 20_000
#: (sentence, 1 for abusive or 0, group): examples of one group are made alike.
Examples = tuple[tuple[str, int, int], ...]
BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)


def offensive(examples: Examples) -> dict[tuple[str, int], list[str]]:
    """Words a sign may hide, by first letter and length: those of the abusive examples, ones that harmless examples
    lack first."""
    found: dict[str, bool] = {}
    for text, label, _ in examples:
        for w in re.findall(r"[a-z]{3,}", text.lower()):
            found[w] = found.get(w, False) or not label
    by: dict[tuple[str, int], list[str]] = {}
    for w in sorted(found, key=lambda w: (found[w], w)):
        by.setdefault((w[0], len(w)), []).append(w)
    return by


_SIGNS = {"*": "[a-z]", "#": "[a-z]", "@": "a", "$": "s", "!": "[il]", "0": "o", "1": "[il]", "3": "e", "4": "a", "5": "s", "7": "t"}
_HIDDEN = re.compile(r"(?<![\w*@$])[A-Za-z][A-Za-z]{0,12}(?:[*@$!#013457]+[A-Za-z]{0,12})+")
_MAY_HIDE = re.compile(r"(?<=[A-Za-z])(?:[*@$!#013457][*@$!#013457A-Za-z]*[A-Za-z]|\*\*|\$)")
_MAY_PART = re.compile(r"([.\-_ ])[^\W\d_]\1[^\W\d_](?!\w)")
_APART = re.compile(r"(?<!\w)[^\W\d_]([.\-_ ])(?:[^\W\d_]\1){1,}[^\W\d_](?!\w)")
_LONG = re.compile(r"([A-Za-z])\1{2,}")


def stretched(texts: list[str]) -> np.ndarray:
    """Which texts hold a letter three times in a row."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) | 32
    at = np.flatnonzero((code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]) & (code[2:] >= 97) & (code[2:] <= 122))
    out = np.zeros(len(texts), bool)
    if len(at):
        out[np.searchsorted(np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))), at, "right")] = True
    return out


def _reveal(match: re.Match, hidden: dict[tuple[str, int], list[str]]) -> str:
    text = match.group(0)
    low = text.lower()
    for size in range(len(low), 2, -1):  # signs at the end may be punctuation
        if any(c.isalpha() for c in low[size:]):
            break
        pattern = "".join(_SIGNS.get(c, c) for c in low[:size])
        for w in hidden.get((low[0], size), ()):
            if re.fullmatch(pattern, w):
                return w + text[size:]
    return text


def undisguised(text: str, hidden: dict[tuple[str, int], list[str]], long: bool = True) -> str:
    """``text`` with stretched (``long``), spaced and sign-replaced words written plainly."""
    if long:
        text = _LONG.sub(r"\1", text)
    if _MAY_PART.search(text):
        text = _APART.sub(lambda m: m.group(0).replace(m.group(1), ""), text)
    return _HIDDEN.sub(lambda m: _reveal(m, hidden), text) if _MAY_HIDE.search(text) else text


_END = np.zeros(0x110000, bool)
_END[[ord(c) for c in ".!?…؟।॥。！？｡"]] = True


def sentences(joined: str, w: Words) -> np.ndarray:
    """For every word the number of its sentence; rows never share one."""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    after = np.append(code[1:], 32)
    wide = (code >= 0x3000) & (code != 0xFF0E)
    cut = _END[code] & (wide | (after < 48) | (after > 0x7F) | (after == 93) | (after == 125))
    # a line break ends a sentence unless the next line goes on in small letters
    cut |= (code == 10) & ~((after >= 97) & (after <= 122))
    total = np.concatenate(([0], np.cumsum(cut)))
    number = total[np.minimum(w.start, n)]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (w.row[1:] != w.row[:-1])
    return np.cumsum(new) - 1


class Index:
    """Terms and blocked postings of the labelled examples; ``weigh`` sets the weights once frequencies are known."""

    def __init__(self, examples: Examples) -> None:
        self.known: tuple[int, int] | None = None
        examples = tuple(sorted(examples, key=lambda e: -e[1]))  # abusive examples come first
        self.hidden = offensive(examples)
        self.texts = [t for t, _, _ in examples]
        self.labels = np.array([y for _, y, _ in examples], int)
        self.groups = np.array([g for _, _, g in examples])
        w = words([undisguised(t, self.hidden) for t in self.texts])
        pair = self.pairs(w.hashes)
        same = w.row[1:] == w.row[:-1]
        row = np.concatenate((w.row[w.whole], w.row[:-1][same]))
        term = np.concatenate((w.hashes[w.whole], pair[same]))
        self.terms = np.unique(term)
        self.is_word = np.isin(self.terms, w.hashes)
        self.abusive_blocks = -(-int(self.labels.sum()) // BLOCK)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.terms >> np.uint64(64 - BITS)] = True
        entry = np.unique(np.stack([row, np.searchsorted(self.terms, term)]), axis=1)
        self.row, self.term = entry
        self.blocks = -(-len(self.texts) // BLOCK)

    @staticmethod
    def pairs(h: np.ndarray) -> np.ndarray:
        out = (h[:-1] * MIX) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
        return (out ^ (out >> np.uint64(31))) * MIX

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash among the terms, -1 for the others."""
        out = np.full(len(h), -1, np.int64)
        may = np.flatnonzero(self.bits[h >> np.uint64(64 - BITS)])
        at = np.minimum(np.searchsorted(self.terms, h[may]), len(self.terms) - 1)
        good = self.terms[at] == h[may]
        out[may[good]] = at[good]
        return out

    def weigh(self, df: np.ndarray, docs: int) -> None:
        """Sets all weights; a Python worker that runs several tasks does so once."""
        known = (docs, hash(df.tobytes()))
        if self.known == known:
            return
        self.known = known
        self.idf = np.log((docs + 1) / (df + 1)) + 1
        # pairs carry less than words: they repeat what their words say
        self.weight = np.where(self.is_word, self.idf, 0.5 * self.idf).astype(np.float32)
        self.other = np.float32(np.median(self.idf[self.is_word]) if self.is_word.any() else 1)
        value = self.weight[self.term].astype(np.float64)
        norm = np.sqrt(np.bincount(self.row, value**2, len(self.texts)))
        value = (value / np.maximum(norm, 1e-9)[self.row]).astype(np.float32)
        block = self.row // BLOCK
        slot = np.full((len(self.terms), self.blocks), -1, np.int32)
        cell = np.unique(self.term * self.blocks + block)
        slot.ravel()[cell] = np.arange(len(cell))
        self.slot = slot
        self.postings = np.zeros((len(cell) + 1, BLOCK), np.float32)  # the last row is empty
        self.postings[slot[self.term, block], self.row % BLOCK] = value
        self.most = np.zeros((len(self.terms), self.blocks), np.float32)
        self.most.ravel()[cell] = self.postings[:-1].max(1)
        self.curve = self.calibrated()

    def queries(self, w: Words, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sentence, term, weight over the sentence's norm) of the index terms in each sentence, each once."""
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        one = self.find(w.hashes)
        two = self.find(self.pairs(w.hashes)) if len(w.hashes) > 1 else np.zeros(0, np.int64)
        good = np.flatnonzero(two >= 0)
        good = good[sentence[good] == sentence[good + 1]]
        other = np.bincount(sentence[(one < 0) & w.whole], minlength=n)
        hit = np.flatnonzero(one >= 0)
        key = np.unique(np.concatenate((sentence[hit] * len(self.terms) + one[hit], sentence[good] * len(self.terms) + two[good])))
        s, t = key // len(self.terms), key % len(self.terms)
        value = self.weight[t]
        norm = np.sqrt(np.bincount(s, value.astype(np.float64) ** 2, n) + other * float(self.other) ** 2)
        return s, t, (value / np.maximum(norm, 1e-9)[s]).astype(np.float32)

    def cosines(self, s: np.ndarray, t: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sentence numbers, cosines with all examples) for the sentences that have a cosine of at least LEAST.

        A block's bound is the sum over terms of weight times the block's largest weight; skipped blocks stay 0."""
        if not len(s):
            return
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        # the cheapest bound first: all blocks of abusive examples together; without one near there is no score
        top = np.add.reduceat(value * self.most[:, : self.abusive_blocks].max(1)[t], first)
        alive = np.repeat(top >= LEAST, np.diff(np.append(first, len(s))))
        s, t, value = s[alive], t[alive], value[alive]
        if not len(s):
            return
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        ids = s[first]
        edges = np.append(first, len(s))
        for begin in range(0, len(ids), 4096):
            end = min(begin + 4096, len(ids))
            a, b = edges[begin], edges[end]
            local = first[begin:end] - a
            bound = np.add.reduceat(value[a:b, None] * self.most[t[a:b]], local, axis=0)
            open_ = (bound >= LEAST) & (bound[:, : self.abusive_blocks].max(1) >= LEAST)[:, None]
            query = np.repeat(np.arange(end - begin), np.diff(edges[begin : end + 1]))
            term_at, block_at = np.nonzero(open_[query] & (self.slot[t[a:b]] >= 0))
            score = np.zeros((end - begin, self.blocks, BLOCK), np.float32)
            rows = query[term_at] * self.blocks + block_at
            part = value[a:b][term_at, None] * self.postings[self.slot[t[a:b][term_at], block_at]]
            if len(rows):
                order = np.argsort(rows, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) > 0)))
                score.reshape(-1, BLOCK)[rows[order][starts]] = np.add.reduceat(part[order], starts, axis=0)
            score = score.reshape(end - begin, -1)[:, : len(self.texts)]
            useful = score[:, : int(self.labels.sum())].max(1) >= LEAST
            if useful.any():
                yield ids[begin:end][useful], score[useful]

    def votes(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the calibration (for, against, bias) and the nearest abusive example of each row."""
        k = min(NEIGHBOURS, score.shape[1])
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        c = np.take_along_axis(score, near, 1)
        c = np.where(c >= LEAST, c, 0) ** POWER
        y = self.labels[near]
        mine, theirs = (c * y).sum(1), (c * (1 - y)).sum(1)
        best = np.where(self.labels == 1, score, 0)
        share = (mine - theirs) / np.maximum(mine + theirs, 1e-12)
        return np.stack([share, best.max(1), np.ones(len(score))], 1), best.argmax(1)

    def calibrated(self) -> np.ndarray:
        """Logistic weights of the votes, fitted over the examples, each judged without its own group."""
        full = np.zeros((len(self.texts), len(self.terms)), np.float32)
        full[self.row, self.term] = self.weight[self.term]
        full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)
        score = full @ full.T
        score[self.groups[:, None] == self.groups[None, :]] = 0
        x, _ = self.votes(score)
        y = self.labels
        beta = np.zeros(3)
        each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-x @ beta))
            grad = x.T @ (each * (p - y)) + 0.5 * beta
            hess = (x * (each * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
            beta -= np.linalg.solve(hess, grad)
        return beta


@functools.cache
def index(examples: Examples) -> Index:
    return Index(examples)


def read_examples(labelled: DataFrame, text: str, label: str, group: str | None = None, most: int = MOST_EXAMPLES) -> Examples:
    """Examples from a table: of more than ``most`` rows those with the smallest hashes. Rows with a null text or label are left
    out; of repeated texts one stays; without ``group`` every text is a group of its own."""
    own = F.col(group).cast("string") if group else F.col(text).cast("string")
    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y"), own.alias("g")).where("t is not null and y is not null")
    rows = rows.groupBy("t").agg(F.max("y").alias("y"), F.max("g").alias("g")).orderBy(F.xxhash64("t"), "t").limit(most).collect()
    numbers = {g: k for k, g in enumerate(sorted({r.g or "" for r in rows}))}
    return tuple(sorted((r.t, int(r.y > 0), numbers[r.g or ""]) for r in rows))


def document_frequencies(docs: DataFrame, column: str, examples: Examples) -> tuple[np.ndarray, int]:
    """In how many documents each index term occurs, and the number of documents; summed in the map stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index(examples)
        count, seen = np.zeros(len(own.terms), np.int64), 0
        for batch in batches:
            for chunk in pieces([(0, t) for t in batch.column(0).to_pylist()]):
                w = words([t for _, t in chunk])
                one = own.find(w.hashes)
                key = w.row[one >= 0] * len(own.terms) + one[one >= 0]
                if len(w.hashes) > 1:
                    two = own.find(own.pairs(w.hashes))
                    two[w.row[1:] != w.row[:-1]] = -1
                    key = np.concatenate((key, w.row[:-1][two >= 0] * len(own.terms) + two[two >= 0]))
                count += np.bincount(np.unique(key) % len(own.terms), minlength=len(own.terms))
                seen += len(chunk)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], seen))], names=["term", "n"])

    texts = docs.select(F.col(column).cast("string").alias("t")).where("t is not null")
    counts = spread(texts).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, seen = np.zeros(len(index(examples).terms), np.int64), 0
    for r in counts:
        if r.term < 0:
            seen = r.n
        else:
            df[r.term] = r.n
    return df, seen


def score_texts(own: Index, texts: list[str]) -> list[tuple[float, str | None, str | None]]:
    """(score, worst sentence, nearest abusive example) of each text."""
    plain = [undisguised(t, own.hidden, long) for t, long in zip(texts, stretched(texts).tolist(), strict=True)]
    w = words(plain)
    out: list[tuple[float, str | None, str | None]] = [(0.0, None, None)] * len(texts)
    if not len(w.hashes):
        return out
    joined = "\n".join(plain)
    sentence = sentences(joined, w)
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    last = np.append(first[1:], len(sentence)) - 1
    for ids, score in own.cosines(*own.queries(w, sentence)):
        x, near = own.votes(score)
        p = np.where(x[:, 1] >= LEAST, 1 / (1 + np.exp(-x @ own.curve)), 0)
        for s, value, example in zip(ids.tolist(), p.tolist(), near.tolist(), strict=True):
            row = int(w.row[first[s]])
            if value > out[row][0]:
                out[row] = (value, joined[w.start[first[s]] : w.end[last[s]]], own.texts[example])
    return out


def score_documents(docs: DataFrame, key: str, column: str, carry: tuple[str, ...] = (), examples: Examples | None = None) -> DataFrame:
    """(doc_id, carried columns, score, evidence, nearest) of every document; null text has a null score. ``examples`` are the
    labelled sentences (see ``read_examples``), by default those of this package."""
    examples = tuple(default_examples()) if examples is None else examples
    df, seen = document_frequencies(docs, column, examples)
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index(examples)
        own.weigh(df, seen)
        for batch in batches:
            texts = batch.column(1 + width).to_pylist()
            found: list[tuple[float | None, str | None, str | None]] = []
            for chunk in pieces([(k, t or "") for k, t in enumerate(texts)]):
                found += score_texts(own, [t for _, t in chunk])
            found = [(None, None, None) if t is None else f for t, f in zip(texts, found, strict=True)]
            columns = [pa.array([f[n] for f in found], kind) for n, kind in enumerate((pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + width], *columns], names=["doc_id", *carry, "score", "evidence", "nearest"])

    narrow = docs.select(F.col(key).cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in carry], F.col(column).cast("string").alias("__text"))
    schema = ", ".join(["doc_id bigint", *[f"`{c}` string" for c in carry], "score double, evidence string, nearest string"])
    return spread(narrow).mapInArrow(run, schema)


def rates(scored: DataFrame, group: str, threshold: float = THRESHOLD) -> DataFrame:
    """Documents and abusive documents per group, and their share; null is a group of its own."""
    return scored.groupBy(group).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("score") >= threshold).alias("abusive"),
        F.avg(F.when(F.col("score") >= threshold, 1.0).otherwise(0.0)).alias("rate"),
    )
