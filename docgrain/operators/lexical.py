"""Lexical search over a corpus, or within reports: the best chunks for every claim by the whole hybrid score.

Claims come to the map stage in blocks of a bounded size, the corpus is read once a block and never shuffled: each batch of
chunks is multiplied with the block's token and bigram counts, the phrase bonus is sought only where it could lift a chunk to
the batch's best, and only the best of a batch leave it. Within reports claims and passages are packed into blocks, which meet by
their report and are multiplied in the same way.

Defined results: claims without tokens find nothing; of equal scores the chunk with the smaller key is first; chunks without a
common token, or under the least score, are not found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.operators import tables
from docgrain.operators.retrieval import MIN_SCORE

#: Claims of one pass over the corpus, and chunks multiplied at once.
BLOCK, ROWS = 512, 512
#: About so many passages of a report are in one block.
PASSAGES = 2048
# Weights of cosine, containment, Jaccard and bigrams, and the bonus for a shared phrase of three tokens.
COSINE, CONTAINED, JACCARD, PAIRS, BONUS = 0.40, 0.32, 0.12, 0.16, 0.06


class Claims:
    """Counts of a block of claims over its own tokens and bigrams."""

    def __init__(self, block: list[tuple[int, list[str]]]) -> None:
        self.ids = [i for i, _ in block]
        vocabulary = sorted({w for _, toks in block for w in toks})
        place = {w: k for k, w in enumerate(vocabulary)}
        self.words = pa.array(vocabulary, pa.string())
        own = [np.array([place[w] for w in toks], np.int64) for _, toks in block]
        self.counts = np.zeros((len(vocabulary), len(block)))
        for k, v in enumerate(own):
            np.add.at(self.counts[:, k], v, 1)
        self.size = (self.counts > 0).sum(0)
        self.norm = np.sqrt((self.counts**2).sum(0))
        pairs = [np.unique(v[:-1] * len(vocabulary) + v[1:]) for v in own]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.has_pair = np.zeros((len(self.pairs), len(block)))
        for k, v in enumerate(pairs):
            self.has_pair[np.searchsorted(self.pairs, v), k] = 1
        self.pair_size = self.has_pair.sum(0)
        self.runs = [[" ".join(toks[k : k + 3]) for k in range(len(toks) - 2)] for _, toks in block]

    def scores(self, toks: pa.Array) -> np.ndarray:
        """The score without the bonus of every chunk (rows) and claim; 0 without a common token."""
        rows, flat, parent = len(toks), toks.flatten(), pc.list_parent_indices(toks).to_numpy()
        if not len(flat):
            return np.zeros((rows, len(self.ids)))
        code = flat.dictionary_encode()
        seen, n = np.unique(parent * len(code.dictionary) + code.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, word = seen // len(code.dictionary), seen % len(code.dictionary)
        size, norm = np.bincount(row, minlength=rows), np.sqrt(np.bincount(row, n.astype(float) ** 2, rows))
        known = pc.fill_null(pc.index_in(code.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        # only the words and, below, the pairs that the batch has are multiplied; all are whole numbers, so sums are exact
        good = known[word] >= 0
        used, column = np.unique(known[word][good], return_inverse=True)
        counts = np.zeros((rows, len(used)))
        counts[row[good], column] = n[good]
        own = self.counts[used]
        dot, shared = counts @ own, (counts > 0).astype(float) @ (own > 0)
        at = known[code.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        key = np.where((parent[1:] == parent[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0), at[:-1] * len(self.words) + at[1:], -1)
        near = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        hit = np.flatnonzero(self.pairs[near] == key) if len(self.pairs) else np.zeros(0, np.int64)
        met, column = np.unique(near[hit], return_inverse=True)
        pairs = np.zeros((rows, len(met)))
        pairs[parent[:-1][hit], column] = 1
        with np.errstate(divide="ignore", invalid="ignore"):
            out = COSINE * (dot / (self.norm * norm[:, None])) + CONTAINED * (shared / self.size) + JACCARD * (shared / (self.size + size[:, None] - shared))
            out += PAIRS * np.nan_to_num(pairs @ self.has_pair[met] / self.pair_size)
        return np.where(shared > 0, out, 0.0)

    def best(self, toks: pa.Array, keys: list[tuple], k: int, allowed: np.ndarray | None = None) -> Iterator[tuple]:
        """(claim, *key, score) of the ``k`` best chunks of a batch for each claim, of those it is allowed to use."""
        raw = self.scores(toks) if allowed is None else np.where(allowed, self.scores(toks), 0.0)
        top = np.partition(raw, -k, axis=0)[-k] if len(raw) > k else np.zeros(raw.shape[1])
        least = np.maximum(top, MIN_SCORE) - BONUS - 0.002  # rounding may lift a score by half a thousandth
        joined: dict[int, str] = {}
        for claim in np.flatnonzero((raw >= np.maximum(least, 1e-12)).any(0)):
            found = []
            for row in np.flatnonzero((raw[:, claim] >= least[claim]) & (raw[:, claim] > 0)):
                text = joined.get(row) or joined.setdefault(row, " ".join(toks[int(row)].as_py()))
                bonus = BONUS if any(r in text for r in self.runs[claim]) else 0.0
                found.append((-float(np.floor(min(1.0, raw[row, claim] + bonus) * 1000 + 0.5) / 1000), *keys[row]))
            for score, *key in sorted(found)[:k]:
                if -score >= MIN_SCORE:
                    yield self.ids[claim], *key, -score


def top_chunks(claims: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, chunk_no, score, rank) for ``claims`` (q, toks) and ``chunks`` (doc_id, chunk_no, toks)."""

    def found(block: list[tuple[int, list[str]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Claims(block)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                    rows = list(own.best(pa.concat_arrays([batch.column(2)]), keys, k))
                    columns = list(zip(*rows, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["q", "doc_id", "chunk_no", "score"])

        narrow = chunks.select(F.col("doc_id").cast("bigint"), F.col("chunk_no").cast("int"), "toks").where("size(toks) > 0")
        return narrow.mapInArrow(run, "q bigint, doc_id bigint, chunk_no int, score double")

    result: DataFrame | None = None
    block: list[tuple[int, list[str]]] = []
    for r in claims.select("q", "toks").where("size(toks) > 0").toLocalIterator():
        block.append((r.q, r.toks))
        if len(block) == BLOCK:
            result, block = found(block) if result is None else result.unionByName(found(block)), []
    if block:
        result = found(block) if result is None else result.unionByName(found(block))
    if result is None:
        return claims.sparkSession.createDataFrame([], "q bigint, doc_id bigint, chunk_no int, score double, rank int")
    return tables.top_k(result, ["q"], [F.desc("score"), F.col("doc_id"), F.col("chunk_no")], k)


FOUND = "claim_id bigint, kind int, id bigint, pos int, chunk_no int, row bigint, score double"


def _blocks(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """(document, ``name`` block number, ``name``): the rows of each report in blocks of about ``size``, by the hash of ``key``."""
    n = df.groupBy("document").agg(F.ceil(F.count("*") / size).alias("__n"))
    cut = df.join(n, "document").withColumn(f"{name}_block", F.pmod(F.xxhash64(key), F.col("__n")))
    return cut.groupBy("document", f"{name}_block").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "document"])).alias(name))


def top_passages(claims: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """(claim_id, pos, row, score, rank) of the ``k`` best passages of every claim in its report: ``claims`` (claim_id, document, refs,
    toks) and ``passages`` (document, reference_index, pos, row, toks), both tables that are cheap to read twice. A claim without refs
    may use all passages, others those of these references and of none. pos is the struct (kind, id, pos, chunk_no), row names a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for asked, given in zip(batch.column(0), batch.column(1), strict=True):
                block = asked.values
                own = Claims([(i, t.split(" ")) for i, t in zip(block.field("claim_id").to_pylist(), block.field("toks").to_pylist(), strict=True)])
                refs = block.field("refs").to_pylist()
                free = np.array([not r for r in refs])
                citing: dict[str, list[int]] = {}
                for n, r in enumerate(refs):
                    for ref in r or ():
                        citing.setdefault(ref, []).append(n)
                flat = given.values
                index = flat.field("reference_index").to_pylist()
                allowed = np.ones((len(index), len(refs)), bool)
                for n, ref in enumerate(index):
                    if ref is not None:
                        allowed[n] = free
                        allowed[n, citing.get(ref, [])] = True
                pos = flat.field("pos")
                keys = list(zip(*[pos.field(c).to_pylist() for c in ("kind", "id", "pos", "chunk_no")], flat.field("row").to_pylist(), strict=True))
                rows += own.best(pc.split_pattern(flat.field("toks"), " "), keys, k, allowed)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    told = lambda df: df.where("size(toks) > 0").withColumn("toks", F.array_join("toks", " "))
    asked = _blocks(told(claims).select("document", F.col("claim_id").cast("bigint"), "refs", "toks"), "claim_id", BLOCK, "claims")
    given = _blocks(told(passages).select("document", "reference_index", "pos", "row", "toks"), "row", PASSAGES, "passages")
    # a hot report's pairs of blocks are spread over many tasks
    met = asked.join(given, "document").repartition("document", "claims_block", "passages_block").select("claims", "passages")
    found = met.mapInArrow(run, FOUND).select("claim_id", F.struct("kind", "id", "pos", "chunk_no").alias("pos"), "row", "score")
    return tables.top_k(found, ["claim_id"], [F.desc("score"), F.col("pos")], k)
