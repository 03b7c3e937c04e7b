from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.operators import bibliography as bib
from docgrain.operators import chunks, citations, claims, plugins, retrieval


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("v")).first().v


def test_sentences(spark):
    text = "2 Methods\nWe use it, e.g. here. See Fig. 3 now. \"Yes.\" It holds [1].  Next one!"
    assert value(spark, t.sentences, text) == ["2 Methods.", "We use it, e.g. here.", 'See Fig. 3 now. "Yes." It holds [1].', "Next one!"]
    assert value(spark, t.sentences, "") == []
    assert value(spark, t.sentences, None) is None


def test_items_are_trimmed_of_blanks_only(spark):
    assert value(spark, t.style_sentences, "0 a. 1 b! 2 c") == ["0 a.", "1 b!", "2 c"]


def test_sections_last_heading_wins(spark):
    s = value(spark, t.sections, "Body\nReferences\nold\nReferences:\nnew\nEvidence Passages\n[1] x")
    assert (s.main_text, s.references_text, s.evidence_text) == ("Body", "new", "[1] x")
    assert value(spark, t.sections, " no heading ").main_text == " no heading "


def test_tokens_and_counts(spark):
    assert value(spark, t.tokens, "The studies were training models, used it") == ["study", "train", "model", "used"]
    assert value(spark, t.word_count, "") == 0
    assert value(spark, t.word_count, " a  b ") == 2


def test_fixed_chunks(spark):
    assert value(spark, lambda c: t.fixed_word_chunks(c, 4, 1), "a b c d e f") == ["a b c d", "d e f"]
    assert value(spark, lambda c: t.fixed_char_chunks(c, 4, 1), "abcdefg") == ["abcd", "defg", "g"]
    with pytest.raises(ValueError):
        t.fixed_char_chunks(F.lit(""), 3, 3)


def test_strip_citations(spark):
    assert value(spark, t.strip_citations, "Smith et al. (2020) show gains [1, 2] here (Doe, 2019) .") == "Smith et al. show gains here."


def test_identifiers(spark):
    assert value(spark, t.doi, "See DOI: 10.1234/AbC.5).") == "10.1234/abc.5"
    assert value(spark, t.reference_index, "[12] X") == "12" and value(spark, t.reference_index, "3. X") == "3" and value(spark, t.reference_index, "X") is None
    assert value(spark, t.first_year, "in 1889 and 2003") == 2003
    assert [value(spark, t.boolean, x) for x in (" Yes", "0", "na", None)] == [True, False, None, None]


def test_citation_extraction_priority_and_offsets(spark):
    sentences = [
        "Smith and Lee (2019, 2020) agree (see Doe, 2018; 2019) with [3-5; 8].", "(2020) and (1999a, 2000 [7]) [9-2]", "ß𝒳 (in 2001; Doe, 2002) and (Table 1; in 2003) [1–99]", "(Doe, 2001 [4]) Doe (2001) Doe (2001)", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(sentences)), "i int, s string").withColumn("p", F.lit(2))
    got: dict = {}
    for r in citations.citations(df, "i", "p", "s").collect():
        assert sentences[r.i][r.start_char : r.end_char] == r.raw_text and r.group_id == f"s2:c{r.start_char}"
        got.setdefault(r.i, []).append((r.start_char, r.marker, r.citation_type, r.author_hint))
    year, told, number = "author_year", "author_year_narrative", "numeric"
    assert {i: sorted(v) for i, v in got.items()} == {
        0: [(0, "smith and lee 2019", told, "Lee"), (0, "smith and lee 2020", told, "Lee"), (33, "doe 2018", year, "Doe"), (33, "doe 2019", year, "Doe"), *[(60, n, number, None) for n in "3458"]],
        1: [(24, "7", number, None), (29, "2", number, None), (29, "9", number, None)],
        2: [(28, "in 2003", year, None), (47, "1", number, None), (47, "99", number, None)],
        3: [(0, "doe 2001", year, "Doe"), (16, "doe 2001", told, "Doe"), (27, "doe 2001", told, "Doe")],
    }


def test_entry_fields(spark):
    rows = [
        (1, "[12] Smith, J., & Lee, A. (2019). A careful study of things. Journal of Things, 3, 1-9. https://doi.org/10.1234/AbC."),
        (2, "J. Smith, A.-B. Lee, and C. Poe, “x” no. Deep nets of many kinds, Proceedings of Nets, 2001."),
        (3, 'A. Smith and B. Poe, "Quoted words of a title," Trans. Nets, vol. 3, 2001.'), (4, "3. Only words"), (5, ""), (6, None),
    ]
    got = {r.i: tuple(r)[1:] for r in bib.entry_fields(spark.createDataFrame(rows, "i int, e string"), "i", "e").collect()}
    assert got[1] == ("12", "A careful study of things", ["Smith", "Lee"], 2019, "10.1234/abc", "Journal of Things, 3, 1-9")
    assert got[3] == (None, "Quoted words of a title", ["Smith", "Poe"], 2001, None, "Trans")
    assert got[4] == ("3", "Only words", ["Only"], None, None, None) or got[4][:2] == ("3", "Only words")
    assert got[5] == (None, None, [], None, None, None) and 6 not in got


def test_classifier_rules(spark):
    rows = [
        (1, "The new method improved accuracy by 12% in 2021.", False), (2, "We trained a model on the data set.", False), (3, "The results might be promising for schools.", False),
        (4, "A transformer is a neural architecture used for text.", False), (5, "Previous studies reported large gains [3].", True), (6, "Too short.", False),
    ]
    df = spark.createDataFrame(rows, "i int, s string, c boolean")
    got = {r.i: r.claim_type for r in claims.scored(df, "s", F.col("c")).collect()}
    assert got == {1: "factual_claim", 2: "methodological_statement", 3: "opinion_or_interpretation", 4: "background_or_definition", 5: "factual_claim", 6: "non_claim"}


def test_order_state(spark):
    rows = [("d", 0, "Prior work reported strong gains [1]."), ("d", 1, "This finding improved all later systems by a margin."), ("d", 2, "2 Methods."), ("d", 3, "The system achieved 90 percent accuracy."), ("e", 0, None)]
    df = spark.createDataFrame(rows, "doc string, i int, s string")
    got = {(r.doc, r.i): r for r in claims.classify(df, "doc", "i", "s", F.col("s").rlike(t.NUMERIC)).collect()}
    assert got["d", 1].citation_context == "previous_sentence" and not got["d", 1].missing_citation
    assert got["d", 3].section == "method" and not got["d", 3].missing_citation
    assert got["e", 0].claim_type == "non_claim" and got["e", 0].section == "unknown"


def test_verdicts(spark):
    rows = [
        ("The filter improves retrieval accuracy on long reports", ["The filter improves retrieval accuracy on long reports in every test."], "supported"),
        ("The filter improves retrieval accuracy", ["The filter did not improve retrieval accuracy at all."], "contradicted"),
        ("The filter reads tables", ["The article does not test tables."], "not_supported"),
        ("The filter reads tables", [], "insufficient_evidence"),
    ]
    df = spark.createDataFrame(rows, "claim string, evidence array<string>, want string")
    assert [(r.status, r.want) for r in plugins.verifier("heuristic")(df).collect()] == [(w, w) for *_, w in rows]
    with pytest.raises(ValueError):
        plugins.verifier("nobody")


def test_plugin_answers_and_errors(spark):
    df = spark.createDataFrame([("ok", ["e"]), ("bad", ["e"]), ("odd", ["e"])], "claim string, evidence array<string>")

    def ask(prompt):
        if "Claim: bad" in prompt:
            raise RuntimeError("down")
        return '```json\n{"status": "supported", "confidence": 1.7}\n```' if "Claim: ok" in prompt else "no idea"

    got = {r.claim: r for r in plugins.from_function(ask)(df).collect()}
    assert (got["ok"].status, got["ok"].confidence) == ("supported", 1.0)
    assert got["bad"].status == "insufficient_evidence" and "down" in got["bad"].error
    assert got["odd"].status == "insufficient_evidence" and got["odd"].error


def test_lexical_score_bounds(spark):
    df = spark.createDataFrame([("red cars drive fast", "red cars drive fast"), ("red cars", "blue boats"), ("", "x")], "a string, b string")
    got = [r.s for r in df.select(retrieval.lexical_score(t.tokens(F.col("a")), t.tokens(F.col("b"))).alias("s")).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_chunk_windows():
    words = " ".join(f"w{k}" for k in range(130))
    got = chunks.overlapping(words, 40, 10)
    assert len(got) > 1 and "w30" in got[0].split() and "w30" in got[1].split()
    one = "This sentence has exactly six words. " * 60
    windows = chunks.bounded(one)
    assert len(windows) > 1 and all(len(w.split()) >= 40 for w in windows) and " ".join(windows) == one.strip()
    assert all(len(c) <= 50 for c in chunks.recursive("para one.\n\n" + "word " * 60, 50, 10))
    assert chunks.recursive("") == [] and chunks.sentence_chars(" ") == []
    assert chunks.sentence_chars("Aa bb. Cc dd. Ee ff.", 14, 6) == ["Aa bb. Cc dd.", "Cc dd. Ee ff."]


def test_reference_fields(spark):
    apa = "[3] Smith, J., & Doe, A. (2019). A study of long reports in schools. Journal of Tests. doi:10.1234/ABC.1"
    ieee = "J. Smith and A. Doe, “A study of long reports,” J. Tests, vol. 3, 2019."
    rows = bib.entry_fields(spark.createDataFrame([(1, apa), (2, ieee)], "i int, e string"), "i", "e").collect()
    assert {r.i: (r.title, r.authors) for r in rows} == {1: ("A study of long reports in schools", ["Smith", "Doe"]), 2: ("A study of long reports", ["Smith", "Doe"])}


def test_likeness_bounds(spark):
    assert bib.likeness("Deep learning for text", "Deep learning for texts") > 0.75
    assert bib.likeness("Learning deep text models", "Text models deep learning https://x.org/a") > 0.7
    assert bib.likeness("Gardening in spring", "Quantum error correction") < 0.45
    assert bib.normalized("DOI: 10.1234/AB") == "10 1234 ab" and bib.likeness(None, "x") == 0.0
    df = spark.createDataFrame([(0.3, 2001, 2010, True)], "t double, a int, b int, d boolean")
    score = df.select(bib.match_score(F.col("t"), F.col("a"), F.col("b"), F.col("d"), F.lit(0.0), F.lit(0.0)).alias("s")).first().s
    assert score < 0.65
