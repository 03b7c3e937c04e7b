"""Queries do the whole job where the rows of the small tables ask for less."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.operators import retrieval
from docgrain.plans import catalogue


def run(spark, tmp_path, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return catalogue.QUERIES[name](spark, str(tmp_path)).collect()


CITATION = "citation_id bigint, document string, raw_text string, citation_type string, cited_year int, author_hint string"
REFERENCE = "ref_id bigint, document string, reference_index string, raw_text string, authors array<string>, parsed_year int"


def test_numbers_inside_a_range_resolve(spark, tmp_path):
    cited = [(1, "d", "[12-15]", "numeric", None, None), (2, "d", "[1, 13 – 14 and 99]", "numeric", None, None), (3, "d", "[1-90]", "numeric", None, None), (4, "e", "[12-15]", "numeric", None, None), (5, "d", "[15-12]", "numeric", None, None)]
    refs = [(100 + i, "d", str(i), "", None, None) for i in (1, 12, 13, 14, 15, 90)]
    got = run(spark, tmp_path, "citation_resolve_numeric", citation=(cited, CITATION), parsed_reference=(refs, REFERENCE))
    want = {1: (12, 13, 14, 15), 2: (1, 13, 14), 3: (1, 90), 5: (12, 15)}
    assert sorted((r.citation_id, int(r.marker), r.ref_id) for r in got) == [(c, m, 100 + m) for c, ms in want.items() for m in ms]
    assert {r.citation_id: r.indices for r in catalogue.QUERIES["cited_reference_lists"](spark, str(tmp_path)).collect()}[1] == "12; 13; 14; 15"


def test_long_texts_are_encoded_with_a_large_vocabulary(spark, tmp_path):
    words = [f"w{i}" for i in range(1500)]
    texts = [(i, " ".join(words[k : k + 150])) for i, k in enumerate([*range(0, 1500, 150)] * 2)]
    got = run(spark, tmp_path, "encode_padded", documents=([*texts, (99, " ".join(["w0"] * 300))], "doc_id bigint, text string"))
    coded = {r.doc_id: r.encoded.split() for r in got}
    assert all(len(v) == 200 for v in coded.values())
    assert all("1" not in coded[i] and coded[i][149] != "0" and coded[i][150:] == ["0"] * 50 for i in range(20))
    assert set(coded[99]) == {"2"}
    assert len(catalogue.QUERIES["vocabulary_top"](spark, str(tmp_path)).collect()) == 1500


def test_a_context_is_bounded_by_characters_alone(spark, tmp_path):
    rows = [*((i, "short", i, "Ten signs.") for i in range(40)), *((100 + i, "long", i, "x" * 50) for i in range(300)), (900, "short", None, "last")]
    got = run(spark, tmp_path, "document_context", claim=(rows, "claim_id bigint, document string, sentence_index int, sentence string"))
    assert {r.document: r.context for r in got} == {"short": " ".join(["Ten signs."] * 40 + ["last"]), "long": " ".join(["x" * 50] * 300)[:3500]}


def test_authors_are_found_as_parts_of_names_and_texts(spark, tmp_path):
    hints = ["Smith-Jones", "O’Neil", "Müller", "Listed", "Jones", "Li", "Absent", "Listed"]
    cited = [(i, "d", "", "author_year", 2001 if i < 7 else 1999, h) for i, h in enumerate(hints)]
    refs = [(10, "d", None, "Smith-Jones, A., O’Neil, B. 2001. X.", None, 2001), (11, "d", None, "Anon. X.", ["Max Müller", "Ann Listed"], 2001), (12, "d", None, "Listed again", None, None), (9, "e", None, "Absent", None, None)]
    got = run(spark, tmp_path, "citation_resolve_author_year", citation=(cited, CITATION), parsed_reference=(refs, REFERENCE))
    assert {r.citation_id: r.ref_id for r in got} == {0: 10, 1: 10, 2: 11, 3: 11, 4: 10, 5: 11, 7: 12}


def test_damaged_titles_get_candidates_and_authors_count(spark, tmp_path):
    title = "Robust Rule Induction for Retraction Screening in Scanned Theses"
    refs = [
        (1, title, 2020, ["Ada Long"], None), (2, title.replace("Induction", "Inductoin"), None, ["LONG Ada"], None), (3, title[:38], 2021, None, None), (4, title.replace("Robust", "R\u043ebust"), 1990, ["Long, A."], None),
        (5, "Проверка", 2020, None, None), (6, "Gardening in Spring", 2020, ["Ada Long"], None),
    ]
    recs = [(100, title, 2020, "Long, Ada", None), (101, "Проверка", 2020, None, None)]
    ref, rec = "ref_id bigint, parsed_title string, parsed_year int, authors array<string>, parsed_venue string", "record_id bigint, crossref_title string, crossref_year int, crossref_authors string, crossref_venue string"
    got = {(r.ref_id, r.record_id): r.score for r in run(spark, tmp_path, "bib_match_score", parsed_reference=(refs, ref), crossref_record=(recs, rec))}
    assert set(got) == {(1, 100), (2, 100), (3, 100), (4, 100), (5, 101)}
    assert got[1, 100] == 0.84
    status = {r.ref_id: (r.record_id, r.status) for r in catalogue.QUERIES["bib_status"](spark, str(tmp_path)).collect()}
    assert status[1] == (100, "verified") and status[2] == (100, "partially_matched") and status[6] == (None, "unverified")


def test_corpus_search_ranks_by_the_whole_score(spark, tmp_path):
    words = "alpha bravo carbon delta ember falcon garnet harbor island jungle".split()
    texts = [(i, " ".join([*(words[(i * k + k) % 10] for k in range(1, 4 + i % 7)), f"filler{i}", *words[i % 8 : i % 8 + i % 4]])) for i in range(60)]
    claims = [(1, "Alpha bravo carbon delta ember."), (2, "falcon harbor"), (3, "island jungle alpha")]
    got = run(spark, tmp_path, "lexical_topk", documents=(texts, "doc_id bigint, text string"), claimguard_benchmark=(claims, "case_id bigint, claim string"))
    d = spark.createDataFrame(texts, "doc_id bigint, text string").crossJoin(spark.createDataFrame(claims, "case_id bigint, claim string"))
    all_scores = d.select("case_id", F.col("doc_id").alias("p"), retrieval.lexical_score(t.tokens(F.col("claim")), t.tokens(F.col("text"))).alias("s")).collect()
    want = [(c, *x) for c, _ in claims for x in [(r.p, r.s) for r in sorted(all_scores, key=lambda r: (-r.s, r.p)) if r.case_id == c and r.s >= 0.08][:5]]
    assert [(r.case_id, r.doc_id, r.score) for r in sorted(got, key=lambda r: (r.case_id, r["rank"]))] == want
