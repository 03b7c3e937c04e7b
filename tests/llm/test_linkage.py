from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from docgrain.llm import linkage as k

REF = "ref_id bigint, parsed_title string, parsed_year int, authors array<string>, parsed_venue string, raw_text string, score string"
REC = "record_id bigint, crossref_title string, crossref_year int, crossref_authors string, crossref_venue string, crossref_score double, profile string"
T = "A Study of Sparse Query Rewriting and Citation Matching in Noisy Reports"


def linked(spark, refs, recs):
    r = spark.createDataFrame([(*x, "clash") for x in refs], REF)
    c = spark.createDataFrame([(*x, "clash") for x in recs], REC)
    return {(x.ref_id, x.record_id): x.confidence for x in k.link(r, c).collect()}


def test_matches_and_hard_negatives(spark):
    refs = [
        (1, T, 2011, ["Ada Long", "Bo Short"], "Review of Tests", f"Long, A., Short, B. (2011). {T}. Review of Tests."),
        (2, T.lower().replace("sparse", "spasre"), None, ["A. Long"], None, None),
        (3, "A Study of Sparse Query Rewriting and Citation Matching in Noisy", 2011, ["Long, Ada"], "RT", None),
        (4, f"Erratum: {T}", 2012, ["Ada Long"], None, None),
        (5, T, 2019, ["Cy Dee"], "Other Journal", None),
        (6, f"{T}, Part I", 2011, ["Ada Long"], None, None),
        (7, None, 2011, ["Ada Long"], None, None), (8, "", None, None, None, None), (9, T, None, None, None, None), (10, "Тест", None, None, None, None),
    ]
    recs = [
        (100, T, 2011, "Long, Ada; Short, B.", "Rev. Tests", 0.9), (101, T, 2010, "Long, Ada; Short, Bo", "Preprint Repository", None), (102, f"{T}, Part II", 2011, "Long, A.", None, 0.8),
        (103, "A Study of Dense Query Rewriting and Table Extraction in Noisy Reports", 2011, "Long, Ada", "Rev. Tests", 0.99), (104, None, 2011, "Long, Ada", None, 0.9), (105, None, None, None, None, None),
    ]
    got = linked(spark, refs, recs)
    assert {(1, 100), (1, 101), (2, 100), (2, 101), (3, 100), (3, 101)} <= set(got)
    assert not {r for r, _ in got} & {4, 5, 6, 7, 8, 10}
    assert not {c for _, c in got} & {102, 103, 104, 105}
    assert all(0.5 <= v <= 1 for v in got.values())


def test_repeats_give_the_pairs_of_each_row_and_empty_tables_none(spark):
    ref, rec = (1, T, 2011, ["Ada Long"], None, None), (100, T, 2011, "Long, Ada", None, 0.9)
    assert set(linked(spark, [ref, (2, *ref[1:])], [rec, (101, *rec[1:])])) == set(itertools.product((1, 2), (100, 101)))
    assert linked(spark, [], [rec]) == {} and linked(spark, [ref], []) == {}


def test_likeness_of_titles():
    words = k.title_parts(T)[2]
    assert k.title_like(words, words) == 1
    assert k.title_like(words, words[:-1]) > 0.85
    assert k.title_like(words, [*words[:3], "dense", *words[4:]]) < 0.5
    assert k.title_parts("Comment on: X, Part Ⅱ.")[:2] == ("comm", 2)
    assert k.title_parts("Low-Rank X & Y [online]")[2] == ["lowrank", "x", "and", "y"]


def test_the_alternation_finds_the_minimum(spark):
    # 3 max(0, 0.9 - a) + 3 max(0, 0.8 - b) + 4 max(0, a + b - 1): exclusive, the better one wins
    rules = [("x", "a", 1.0, 4.0, -1.0, 0.5), ("x", "b", 1.0, 4.0, -1.0, 0.5)]
    terms = spark.createDataFrame(rules, "rule string, var string, coef double, w double, d double, start double")
    priors = spark.createDataFrame([("a", [(3.0, -1.0, 0.9)]), ("b", [(2.0, -1.0, 0.8)]), ("c", [(1.0, 1.0, 0.0)])], "var string, prior array<struct<w:double,s:double,b:double>>")
    got = {r["var"]: r.value for r in k.alternate(terms, priors).collect()}

    def loss(a, b):
        return 3 * max(0, 0.9 - a) + 2 * max(0, 0.8 - b) + 4 * max(0, a + b - 1)

    grid = min((loss(a / 100, b / 100), a / 100, b / 100) for a in range(101) for b in range(101))
    assert loss(got["a"], got["b"]) == pytest.approx(grid[0], abs=0.02)
    with pytest.warns(UserWarning, match="2 rounds"):
        k.alternate(terms, priors, rounds=2, tolerance=-1.0).count()


def test_own_rules_against_grid(spark):
    """The least of a variable's hinges and its distance to a mean."""
    import random

    rnd = random.Random(3)
    rows = [([(rnd.uniform(0.2, 4), rnd.choice([-1.0, 1.0]), rnd.uniform(-0.2, 1.2)) for _ in range(rnd.randrange(5))], rnd.uniform(-0.5, 1.5), rnd.choice([0.5, 2.0, 8.0])) for _ in range(40)]
    df = spark.createDataFrame(rows, "prior array<struct<w:double,s:double,b:double>>, mean double, weight double")
    for r in df.withColumn("y", k._least(F.col("prior"), F.col("mean"), F.col("weight"))).collect():
        loss = lambda y, r=r: sum(w * max(0, s * (y - b)) for w, s, b in r.prior) + r.weight / 2 * (y - r["mean"]) ** 2
        assert 0 <= r.y <= 1 and loss(r.y) <= min(loss(x / 400) for x in range(401)) + 1e-9


def test_closed_form_minimum_against_grid(spark):
    rows = [(1.0, 0.0, 1.0, None, 0.4, True), (0.8, None, 0.0, 0.0, None, True), (0.9, 1.0, 1.0, 1.0, 0.3, False), (0.7, 0.5, 0.0, 1.0, 0.9, True)]
    df = spark.createDataFrame(rows, "title double, people double, year double, venue double, score double, kinds boolean")
    w = k.WEIGHTS
    for r in k.minimise(df, w).collect():
        def loss(c, r=r):
            total = w["title"] * abs(r.title - c) + (w["authors"] * max(0, c - r.people) if r.people is not None else 0)
            total += ((w["alone_year"] if r.people is None else w["year"]) * max(0, c - r.year)) if r.year is not None else 0
            total += ((w["alone_venue"] if r.people is None else w["venue"]) * max(0, c - r.venue)) if r.venue is not None else 0
            total += w["score"] * max(0, c - r.score) if r.score is not None else 0
            return total + (0 if r.kinds else w["kind"] * c)

        assert loss(r.local) == pytest.approx(min(loss(x / 200) for x in range(201)), abs=1e-9)


def test_confidence_falls_with_the_evidence(spark):
    whole, cut = (1, T, 2011, ["Ada Long"], None, None), (2, " ".join(T.split()[:9]), 2011, ["Ada Long"], None, None)
    got = linked(spark, [whole, cut], [(100, T, 2011, "Long, Ada", None, 0.9)])
    assert got[1, 100] > got[2, 100] >= 0.5
    assert F.lit(1) is not None


def test_short_titles_and_cjk_runs_meet_despite_a_slip(spark):
    title = "Scheividaxを用いた文単位の根拠検索"
    refs = [
        (1, title.replace("Schei", "Scehi"), 2007, ["Bo Daunnak"], None, None), (2, title.replace("単位", "位単"), None, ["Bo Daunnak"], None, None),
        (3, title.replace("Schei", "Scehi").replace("単位", "位単"), 2007, None, None, None), (4, "Transprency", 2007, ["Bo Daunnak"], None, None), (5, title.replace("Scheividax", "Feinimon"), 2007, ["Bo Daunnak"], None, None),
    ]
    recs = [(100, title, 2007, "Daunnak, Bo", None, 0.9), (101, "Transparency", 2007, "Daunnak, Bo", None, 0.9)]
    assert set(linked(spark, refs, recs)) == {(1, 100), (2, 100), (3, 100), (4, 101)}


def test_a_cut_end_may_be_of_any_length(spark):
    title = "Adversarial Difference Maps Revisited: Peer Review Triage on Legal Transcripts of Courts in Nine Countries"
    refs = [(1, title.split(":")[0], 2006, ["Bo Boreiten", "Al Momollul"], None, None), (2, title.split(":")[0], 2006, ["Cy Dee"], None, None)]
    recs = [(100, title, 2006, "Boreiten, Bo; Momollul, Al", None, 0.9)]
    assert set(linked(spark, refs, recs)) == {(1, 100)}
    assert set(linked(spark, [(1, title, *refs[0][2:])], [(100, title.split(":")[0], *recs[0][2:])])) == {(1, 100)}
    words = k.title_parts(title)[2]
    assert k.title_like(words[:4], words) == k.title_like(words, words[:4]) >= 0.6


def test_the_disk_holds_one_turn(spark, tmp_path, monkeypatch):
    """Shuffle files go with each write, tables once nothing reads them; each key belongs to one turn."""
    from pathlib import Path

    from docgrain import session

    shuffled = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {p for p in shuffled.rglob("shuffle_*")}
    before, left = files(), []

    def watched(df, name):
        written = session.materialize(df, name)
        if name != "linkage-round":  # between rounds is the one row that says how far they moved
            left.append(files() - before)
        return written

    monkeypatch.setattr(k, "materialize", watched)
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    found = linked_frame(spark, 40)
    assert left and not any(left)
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} <= {"linkage-refs", "linkage-records", "linkage-scored", "linkage-round"}
    assert {(r.ref_id, r.record_id) for r in found.collect()} == {(i, 1000 + i) for i in range(40)}
    keys = [k._keys(k.title_parts(T)[2], ["long", "short"], [2011], True, turn) for turn in range(k.TURNS)]
    monkeypatch.setattr(k, "TURNS", 1)
    assert sorted(itertools.chain(*keys)) == k._keys(k.title_parts(T)[2], ["long", "short"], [2011], True, 0)


def linked_frame(spark, n):
    titles = [f"Measuring {w}{v}ation of {v}{w}ive Archives under {w}al Drift" for w, v in itertools.product(("bor", "kel", "tam", "vun", "pri"), ("dax", "fim", "gos", "hul", "jek", "lom", "nar", "ruk"))][:n]
    refs = [(i, t, 2011, ["Ada Long"], None, None, "x") for i, t in enumerate(titles)]
    recs = [(1000 + i, t, 2011 + i % 2, "Long, Ada", None, 0.9, "x") for i, t in enumerate(titles)]
    return k.link(spark.createDataFrame(refs, REF), spark.createDataFrame(recs, REC))


def test_years_side_by_side_meet_where_one_side_names_nobody():
    words = k.title_parts(T)[2]
    meet = lambda a, b: any(set(k._keys(words, *a, True, t)) & set(k._keys(words[4:], *b, False, t)) for t in range(k.TURNS))
    for named, other in ((["long"], []), ([], ["long"]), ([], [])):
        assert [meet((named, [2011]), (other, [y])) for y in (2009, 2010, 2011, 2012, 2013)] == [False, True, True, True, False]
        assert meet((named, []), (other, [1999])) and meet((named, [2011]), (other, [])) and meet((named, []), (other, []))
        assert meet((named, [1990, 2011]), (other, [1991]))


def test_no_table_is_broadcast_by_an_inferred_size(spark, monkeypatch):
    plans = []

    def noted(df, name, write=k.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(k, "materialize", noted)
    refs = spark.createDataFrame([(1, T, 2011, ["Ada Long"], None, None, "")], REF)
    recs = spark.createDataFrame([(i, T, 2011, "Long, Ada", None, 0.9, "") for i in (100, 101)], REC)
    found = k.link(refs, recs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)  # the least table there is stays below any threshold
    assert len(found.collect()) == 2 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
