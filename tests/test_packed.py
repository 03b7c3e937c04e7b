from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from docgrain.operators import packed
from docgrain.operators.packed import split_citations, split_entries, split_names, split_packed


def names(text):
    return split_names(pa.array([text])).to_pylist()[0]


def cites(text):
    return split_citations(pa.array([text])).to_pylist()[0]


def entries(text):
    return split_entries(pa.array([text])).to_pylist()[0]


def test_names_in_all_layouts():
    assert names('"Ada Long","Short, Bo"') == ["Ada Long", "Short, Bo"]
    assert names('Ada Long;"Short, Bo"; Cy Dee and Eve Fox') == ["Ada Long", "Short, Bo", "Cy Dee", "Eve Fox"]
    assert names("Ada Long, Bo Short, and Cy Dee") == ["Ada Long", "Bo Short", "Cy Dee"]
    assert names("Ada Long & Bo Short") == ["Ada Long", "Bo Short"]
    assert names("Long, A., van Short, B. C., & Dee, C.") == ["Long, A.", "van Short, B. C.", "Dee, C."]
    assert names("Long, Ada") == ["Long, Ada"]
    assert names("A\tB\tC") == ["A", "B", "C"]
    assert names("A | B") == ["A", "B"]
    assert names("A / B / et al.") == ["A", "B"]
    assert names("A; ; B;") == ["A", "B"]
    assert names('"He said ""Bo"" once"') == ['He said "Bo" once']
    assert names('"Foundation for Peer Review, Citation and Proof"') == ["Foundation for Peer Review, Citation and Proof"]


def test_names_keep_repeats_and_read_odd_quotes_as_text():
    assert names("A; A") == ["A", "A"]
    assert names('A "B; C') == ['A "B', "C"]


def test_citation_groups():
    assert cites("[3-5; 8]") == ["3", "4", "5", "8"]
    assert cites("[1 & 4 – 6][9]") == ["1", "4", "5", "6", "9"]
    assert cites("[9-3]") == ["9", "3"]
    assert cites("[1-3-5]") == ["1", "2", "3", "4", "5"] and cites("[5-3-4]") == ["5", "3", "4"]
    assert cites("[12345678901, 2]") == ["12345678901", "2"] and cites("[007, 1234567890123456789012-3]") == ["7", "1234567890123456789012", "3"]
    assert cites("(see Long et al., 2003, 2011b, p. 4; Dee & Fox 1999)") == ["Long et al. 2003", "Long et al. 2011b", "Dee & Fox 1999"]
    assert cites("Long and Dee (2001, 2002)") == ["Long and Dee 2001", "Long and Dee 2002"]
    assert cites('("Long, 2007", "Dee et al., 2017")') == ["Long 2007", "Dee et al. 2017"]


def test_long_ranges_are_whole_and_written_in_turns(monkeypatch):
    whole = [str(n) for n in range(1, 90_001)]
    assert cites("[1-90000]") == whole
    monkeypatch.setattr(packed, "WRITTEN", 7)
    fields = pa.array(["[2; 5-20, 9]", None, "(Dee, 2001; 2002)", "[]", "[3]"])
    got = [(int(r), int(p), v) for parent, place, value in packed.citation_parts(fields).written() for r, p, v in zip(parent, place, value.to_pylist(), strict=True)]
    want = [str(n) for n in (2, *range(5, 21), 9)]
    assert got == [(0, k, v) for k, v in enumerate(want, 1)] + [(2, 1, "Dee 2001"), (2, 2, "Dee 2002"), (4, 1, "3")]


def test_entries():
    a, b = "[1] Long, A. (2003). First thing here. Journal of Tests.", "[2] B. Dee. Second thing. In Journal of Tests, 2004. doi:10.5555/x.1"
    assert entries(f"{a} {b}") == [a, b]
    assert entries(f"{a}\n\n{b}") == [a, b]
    assert entries(f"{a}||{b}") == [a, b]
    assert entries(f"{a}\t{b}\t") == [a, b]
    assert entries(f'"{a}";"{b}"') == [a, b]
    wrapped = "Long, A. (2003). First thing\nhere and there. Journal of Tests."
    assert entries(wrapped) == [wrapped.replace("\n", " ")]
    assert entries("Long, A. (2003). One. Journal.\r\nDee, B. (2004). Two. Journal.") == ["Long, A. (2003). One. Journal.", "Dee, B. (2004). Two. Journal."]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÄß中 ", min_size=1, max_size=6).filter(lambda s: s.strip()), min_size=1, max_size=6), st.sampled_from([";", "|", "\t", "\n"]))
def test_simple_delimiters_round_trip(values, delimiter):
    assert names(delimiter.join(values)) == [v.strip() for v in values]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='ab;,|"\n [](19)20 –中', max_size=30)), max_size=20))
def test_any_text_is_survived_and_rows_do_not_mix(texts):
    for split in (split_names, split_entries, split_citations):
        whole = split(pa.array(texts, pa.string())).to_pylist()
        assert whole == [split(pa.array([t], pa.string())).to_pylist()[0] for t in texts]
        assert all(v == v.strip() and v for row in whole for v in row)


def test_numeric_groups_against_brute_force():
    groups = [f"[{a}{sep}{b}-{b + c}]" for a in (1, 12) for b in (3, 20) for c in (0, 2) for sep in (",", "; ", " and ", " & ")]
    for g in groups:
        want = []
        for part in re.split(r",|;|and|&", g.strip("[]")):
            x = [int(n) for n in part.split("-")]
            want += [str(n) for n in range(x[0], x[-1] + 1)]
        assert cites(g) == want


def test_operator_defined_results(spark):
    rows = [(1, "A; B", "x"), (1, "A; B", "y"), (2, None, "z"), (3, "  ", "z"), (None, "C", "z"), (4, "D;" * 20_000, "z")]
    df = spark.createDataFrame(rows, "key bigint, field string, value_text string")
    got = split_packed(df, "key", "field", "names")
    assert got.columns == ["row_id", "value_pos", "value_text"]
    found = got.collect()
    assert sorted((r.value_pos, r.value_text) for r in found if r.row_id == 1) == [(1, "A"), (1, "A"), (2, "B"), (2, "B")]
    assert [r.value_text for r in found if r.row_id is None] == ["C"]
    assert sum(r.row_id == 4 for r in found) == 20_000
    assert not [r for r in found if r.row_id in (2, 3)]
    assert split_packed(df.limit(0), "key", "field", "entries").count() == 0
