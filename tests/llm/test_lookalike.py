from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from docgrain.llm import lookalike as la


def canonical(spark, *values):
    df = spark.createDataFrame([(i, v, "other") for i, v in enumerate(values)], "id int, t string, value string")
    return [r.c for r in la.canonicalize(df, "t", "c").orderBy("id").collect()]


def test_equal_looks_meet_and_different_looks_stay_apart(spark):
    same = ["Ａ ﬁle…", "A file...", "А fi​le...", "A fi­le..."]
    assert len(set(canonical(spark, *same))) == 1
    assert canonical(spark, "Café", "Café")[0] == canonical(spark, "Café", "Café")[1]
    assert canonical(spark, "Part Ⅱ", "Part II") == ["Part II", "Part II"]
    different = ["Cafe", "Café", "cafe", "Cafe.", "Ca fe", "a-b", "a–b", "a—b", '"a"', "“a”", "a  b", "a b"]
    assert len(set(canonical(spark, *different))) == len(different)
    assert canonical(spark, "a‐b", "a‑b", "a-b") == ["a-b"] * 3


def test_nulls_empties_and_repeats(spark):
    assert canonical(spark, None, "", "x", "x") == [None, "", "x", "x"]
    assert la.classes(spark.createDataFrame([], "t string"), "t").count() == 0
    assert len(canonical(spark, "long " * 50_000)[0]) == 250_000


def test_pairs_against_brute_force(spark):
    base = ["Deep nets", "Deep nets", "Dеep nets", "Deep nets", "deep nets", "Ｄeep nets", None, "Ére", "Ére"]
    rows = [(i, v) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "id bigint, value string")

    def key(v):
        one, to, many = la.tables()
        for c, t in many.items():
            v = v.replace(c, t)
        kept = v.translate({ord(c): (to[k] if k < len(to) else None) for k, c in enumerate(one)})
        return unicodedata.normalize("NFD", kept)

    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and key(x) == key(y))
    assert sorted(map(tuple, la.lookalike_pairs(df, df).collect())) == want
    other = df.select((F.col("id") + 100).alias("id"), "value")
    both = la.lookalike_pairs(df, other).collect()
    assert sorted((r.id_a, r.id_b - 100) for r in both) == sorted((a, b) for a, x in rows for b, y in rows if x and y and x != y and key(x) == key(y))
