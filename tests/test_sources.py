from __future__ import annotations

import io
import json
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.operators import dense, plugins, tables
from docgrain.sources import readers, sinks
from docgrain.streaming import resume


def test_texts_fall_back_to_the_code_page(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Größe", "utf-8")
    (tmp_path / "b.txt").write_bytes("Größe".encode("cp1252"))
    assert [r.text for r in readers.texts(spark, str(tmp_path)).collect()] == ["Größe", "Größe"]


def test_pdf_text(spark, tmp_path):
    body = zlib.compress(b"BT (Hello) Tj 0 -12 Td [(Wor) -20 (ld) -300 (a\\(b\\))] TJ ET")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\nstream\n" + body + b"\nendstream\nendobj")
    assert readers.documents(spark, str(tmp_path)).first().text == "Hello\nWorld a(b)"
    (tmp_path / "c.doc").write_text("x")
    with pytest.raises(Exception, match="unsupported"):
        readers.documents(spark, str(tmp_path)).collect()


def test_checked_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('case_id,label,claim\n1,yes,"a, ""b"""\n,,\n2,no,c\n')
    df = readers.checked_csv(spark, str(path), ["case_id", "label"], {"label": ["yes", "no"]})
    assert [tuple(r) for r in df.orderBy("case_id").collect()] == [("1", "yes", 'a, "b"'), ("2", "no", "c")]
    with pytest.raises(ValueError, match="missing"):
        readers.checked_csv(spark, str(path), ["nothing"])
    with pytest.raises(Exception, match="unknown value"):
        readers.checked_csv(spark, str(path), ["case_id"], {"label": ["yes"]}).collect()


def test_predictions(spark, tmp_path):
    rows = [{"case_id": "1", "label": "a"}, {"case_id": "1", "predicted": "b"}, {"case_id": "2", "predicted": "c"}]
    for name, content in (("a.json", json.dumps(rows)), ("b.json", json.dumps({"predictions": rows}))):
        (tmp_path / name).write_text(content)
        got = {r.case_id: r.predicted for r in readers.predictions(spark, str(tmp_path / name)).collect()}
        assert got == {"1": "b", "2": "c"}
    (tmp_path / "c.csv").write_text("case_id,label\n1,x\n")
    assert readers.predictions(spark, str(tmp_path / "c.csv")).first().predicted == "x"


def test_archive_and_pairs(spark, tmp_path):
    data = b'{"a": 1}\n\n{"a": 2}\n'
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("d/claims.jsonl")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert [r.line for r in readers.archive_lines(spark, str(tmp_path / "x.tar.gz"), "claims.jsonl").collect()] == ['{"a": 1}', '{"a": 2}']
    (tmp_path / "p.json").write_text(json.dumps({"original": ["a b c", "d"], "sampled": ["e f g", "h"]}))
    assert readers.paired_texts(spark, str(tmp_path / "p.json"), "original", "sampled", 3).count() == 1
    with pytest.raises(ValueError):
        readers.verified(str(tmp_path / "p.json"), "0")


def test_payloads_share_a_schema(spark):
    payloads = [
        (1, "crossref", '{"message": {"items": [{"title": ["T"], "DOI": "10.1/X", "author": [{"family": "F"}], "issued": {"date-parts": [[2001]]}, "update-to": [{"type": "retraction"}]}]}}'),
        (2, "scholar", '{"data": [{"title": "S", "year": 2002, "externalIds": {"DOI": "10.1/Y"}, "authors": [{"name": "A B"}]}]}'),
        (3, "alex", '{"results": [{"display_name": "O", "publication_year": 2003, "doi": "https://doi.org/10.1/Z", "is_retracted": false}]}'),
        (4, "crossref", "broken"),
    ]
    df = spark.createDataFrame(payloads, "k int, source string, payload string")
    got = {r.k: (r.title, r.year, r.doi, r.retracted) for r in readers.payload_candidates(df, "k", "source", "payload").collect()}
    assert got == {1: ("T", 2001, "10.1/x", True), 2: ("S", 2002, "10.1/y", False), 3: ("O", 2003, "10.1/z", False)}


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, array('a', '', null, 'b') AS tags, named_struct('org_id', 'x', 'n', 2) AS meta, 'u' AS user_id")
    assert sinks.without_accounts(df).columns == ["id", "tags", "meta"]
    sinks.write_json(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"id": 1, "tags": ["a", "", None, "b"], "meta": {"n": 2}}
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().tags == "a; b"
    assert sinks.markdown_table(df.select("id", "user_id"), "id").first().markdown.splitlines()[2] == "| 1 | u |"


def test_ledger_and_stream_resume(spark, tmp_path):
    source, ledger, place = (str(tmp_path / n) for n in ("in", "ledger", "checkpoint"))
    df = spark.range(5).withColumn("v", F.lit("x"))
    df.union(df).write.parquet(source)
    for _ in range(2):
        resume.process_available(spark, source, df.schema, "id", lambda d: d.select("id"), ledger, place).awaitTermination(120)
    spark.range(3, 8).withColumn("v", F.lit("y")).write.mode("append").parquet(source)
    resume.process_available(spark, source, df.schema, "id", lambda d: d.select("id"), ledger, place).awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(ledger).collect()) == list(range(8))


def test_dense_search_in_blocks_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(dense, "BLOCK", 3)
    v = np.random.default_rng(1).normal(size=(40, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(40)] + [(100, None), (101, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, e array<double>").repartition(5)
    got = dense.top_matches(df, df.where("id % 5 = 0"), "id", "e", 4).collect()
    for q in range(0, 40, 5):
        order = sorted((i for i in range(40) if i != q), key=lambda i: (-float(v[q] @ v[i]), i))[:4]
        assert [r.match_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == order
    assert dense.top_matches(df, df.limit(0), "id", "e", 4).count() == 0


def test_archives_stream_in_blocks(spark, tmp_path, monkeypatch):
    data = b"".join(b'{"a": %d}\n' % k for k in range(25))
    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as tar:
        for name in ("d/other.txt", "d/claims.jsonl"):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    monkeypatch.setattr(readers, "LINES", 10)
    got = readers.archive_lines(spark, str(tmp_path / "y.tar.gz"), "claims.jsonl").collect()
    assert sorted((r.line_no, r.line) for r in got) == [(k, f'{{"a": {k}}}') for k in range(25)]


def test_claims_meet_their_documents(spark):
    claims = [
        {"id": 1, "claim": "A", "evidence": {"7": [{"label": "SUPPORT"}, {"label": "CONTRADICT"}], "8": [{"label": "SUPPORT"}]}, "cited_doc_ids": [7]}, {"id": 2, "claim": "B", "evidence": {}, "cited_doc_ids": [8, 7]},
        {"id": 3, "claim": "C", "evidence": {}, "cited_doc_ids": []}, {"id": 4, "claim": "", "evidence": {}, "cited_doc_ids": [7]}, {"id": 5, "claim": "E", "evidence": {}, "cited_doc_ids": [99]},
    ]
    corpus = [{"doc_id": 7, "title": "T", "abstract": ["x", "y"]}, {"doc_id": 8, "title": "U", "abstract": []}]
    lines = lambda rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "line string")
    got = sorted(tuple(r) for r in readers.claim_documents(lines(claims), lines(corpus)).collect())
    assert got == [(1, "A", "7", "CONTRADICT", "T. x y"), (1, "A", "7", "SUPPORT", "T. x y"), (1, "A", "8", "SUPPORT", "U."), (2, "B", "8", "NOT_ENOUGH_INFO", "U."), (5, "E", "99", "NOT_ENOUGH_INFO", ".")]


def test_output_texts(spark):
    payloads = ['{"output_text": "a"}', '{"output": [{"type": "x"}, {"type": "message", "content": [{"type": "output_text", "text": ""}, {"type": "output_text", "text": "b"}]}]}', "{}", "no json", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    assert [r.o for r in df.withColumn("o", readers.output_text(F.col("p"))).orderBy("i").collect()] == ["a", "b", None, None, None]


def test_strict_booleans(spark):
    read = lambda x, **kw: spark.createDataFrame([(x,)], "x string").select(t.strict_boolean(F.col("x"), **kw).alias("b")).first().b
    assert read(" Yes") is True and read("0") is False and read("n/a", optional=True) is None and read(None, optional=True) is None
    for bad in ("maybe", "y", ""):
        with pytest.raises(Exception, match="invalid boolean"):
            read(bad)


def test_a_review_shows_ten_sentences(spark):
    rows = [(k, "d", f"s{k}", k % 2 == 0) for k in range(60)] + [(100, "e", "fine", False), (101, None, "lost", True)]
    got = {r.document: r.markdown for r in sinks.document_review(spark.createDataFrame(rows, "claim_id int, document string, sentence string, missing_citation boolean"), "document").collect()}
    assert got["d"] == "## d\n60 sentences, 30 without a citation\n" + "\n".join(f"- s{k}" for k in range(0, 20, 2)) and got["e"].endswith("0 without a citation\n")


def test_small_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,\n2,x\n")
    assert [r.b for r in readers.results(spark, str(tmp_path / "r.csv"), ["b"]).orderBy("a").collect()] == ["None", "x"]
    assert [r.v for r in spark.createDataFrame([(1, "A ; ;B;"), (2, None)], "i int, x string").select("i", readers.listed(F.col("x")).alias("v")).orderBy("i").collect()] == [["A", "B"], []]
    shape = "title string, section_names array<string>, paragraphs array<array<string>>, qas array<struct<question: string, answers: array<string>>>"
    rows = [("t", ["S", None], [["a b", "c"], ["d"]], [("q", [" ", "x", "y"]), ("r", [None])]), ("short", ["S"], [["a"]], [("q", ["x"])])]
    assert [tuple(r) for r in readers.question_answers(spark.createDataFrame(rows, shape), 5).collect()] == [("t", "\n## S\n\na b\nc\nd", "q", "x")]


def test_a_join_that_loses_rows_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert tables.matched(a.where("k = 1"), b, "k").first().v == "x"
    with pytest.raises(Exception, match="no match for k 2"):
        tables.matched(a, b, "k").collect()
    with pytest.raises(ValueError, match="known are"):
        plugins.detected("none", a, "k", "k", 0.5)
