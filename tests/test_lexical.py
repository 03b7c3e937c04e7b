from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from docgrain.operators import dense, lexical, retrieval


def test_blocks_find_what_scoring_every_pair_finds(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    monkeypatch.setattr(lexical, "ROWS", 11)
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(14)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    chunks = [(k // 3, k % 3, text(rnd.randrange(0, 12))) for k in range(90)] + [(40, 0, ["w1", "w2", "w3"])] * 2
    claims = [(q, text(rnd.randrange(0, 7))) for q in range(8)]
    c, q = spark.createDataFrame(chunks, "doc_id bigint, chunk_no int, toks array<string>"), spark.createDataFrame(claims, "q bigint, toks array<string>")
    got = {(r.q, r["rank"]): (r.doc_id, r.chunk_no, r.score) for r in lexical.top_chunks(q, c, 4).collect()}
    every = q.withColumnRenamed("toks", "x").crossJoin(c).select("q", "doc_id", "chunk_no", retrieval.lexical_score(F.col("x"), F.col("toks")).alias("s")).where("s >= 0.08").collect()
    want = {}
    for k in range(8):
        for n, r in enumerate(sorted((r for r in every if r.q == k), key=lambda r: (-r.s, r.doc_id, r.chunk_no))[:4], 1):
            want[k, n] = (r.doc_id, r.chunk_no, r.s)
    assert got == want
    assert lexical.top_chunks(q.limit(0), c, 4).count() == 0 and lexical.top_chunks(q, c.limit(0), 4).count() == 0


def test_dense_blocks_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 5)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(43, 6)).round(2)
    rows = [(i, v[i].tolist()) for i in range(43)] + [(50, None), (51, [1.0]), (52, v[3].tolist())]
    df = spark.createDataFrame(rows, "i bigint, e array<double>")
    got = {(r.query_id, r["rank"]): r.match_id for r in dense.top_matches(df, df.where("i % 7 = 0"), "i", "e", 3).collect()}
    ids, m = [*range(43), 52], np.vstack([v, v[3]])
    for q in range(0, 43, 7):
        best = sorted((x for x in zip(-(m @ v[q]), ids, strict=True) if x[1] != q))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in best]
    assert dense.top_matches(df.limit(0), df.limit(0), "i", "e", 3).count() == 0


def test_blocks_of_a_report_find_what_scoring_every_pair_finds(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 3)
    monkeypatch.setattr(lexical, "PASSAGES", 7)
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(14)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    claims = [(q, rnd.choice(["hot", "hot", "hot", "small"]), rnd.choice([[], ["1"], ["2", "3"], ["9"]]), text(rnd.randrange(0, 7))) for q in range(20)]
    passages = [(rnd.choice(["hot", "hot", "small", "other", None]), rnd.choice([None, "1", "2", "3"]), (k % 4, k // 4, 0, 0), k, text(rnd.randrange(0, 12))) for k in range(120)]
    passages += [("hot", None, (0, 99, 0, 0), 120, ["w1", "w2", "w3"]), ("hot", None, (0, 99, 0, 0), 121, ["w1", "w2", "w3"])]  # a repeated row
    c = spark.createDataFrame(claims, "claim_id bigint, document string, refs array<string>, toks array<string>")
    p = spark.createDataFrame(passages, "document string, reference_index string, pos struct<kind:int,id:bigint,pos:int,chunk_no:int>, row bigint, toks array<string>")
    got = {(r.claim_id, r["rank"]): (tuple(r.pos), r.score) for r in lexical.top_passages(c, p, 4).collect()}
    may = (F.size("refs") == 0) | F.col("reference_index").isNull() | F.array_contains("refs", F.col("reference_index"))
    every = c.withColumnRenamed("toks", "x").join(p, "document").where(may).select("claim_id", "pos", retrieval.lexical_score(F.col("x"), F.col("toks")).alias("s")).where("s >= 0.08").collect()
    want = {}
    for q in range(20):
        for n, r in enumerate(sorted((r for r in every if r.claim_id == q), key=lambda r: (-r.s, r.pos))[:4], 1):
            want[q, n] = (tuple(r.pos), r.s)
    assert got == want and len(want) > 40
    assert lexical.top_passages(c.limit(0), p, 4).count() == 0 and lexical.top_passages(c, p.limit(0), 4).count() == 0
