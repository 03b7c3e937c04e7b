from __future__ import annotations

import pytest

from docgrain.llm import sentences as s

PLAIN = [
    "The model was trained on long reports. It was tested on short ones.", "We added 96. Our tutor agreed with the plan.", "Dr. Long met Prof. Short in the lab.", "Dr. Fox left the room early.", "Dr. Dee stayed. Nobody knew.",
    "It ended at noon. The reports were lost.", "See Fig. 3 for more. It is clear.", "The reports were lost. We asked again.", "Our tutor agreed with the plan.", "It is clear.", "Nobody knew.", "We asked again.",
]


@pytest.fixture(scope="module")
def weights():
    return s.fit(PLAIN * 5)


def split(text, weights):
    return [text[a : a + n] for a, n in s.units(text, weights)]


@pytest.mark.parametrize(
    "units",
    [
        ["The reports were lost.", "We asked again."],
        ["Dr. Long stayed at 3.5 points.", "It is clear."],
        ['He wrote "It fails. Try again." in the margin.', "We asked again."],
        ["It held (They were right.) and we added more.", "Nobody knew."],
        ["It is clear.[8-11 and 13]", "Our tutor agreed with the plan."],
        ["Did it hold?!", "We asked again."],
    ],
)
def test_boundaries(units, weights):
    assert split(" ".join(units), weights) == units


def test_scripts_without_blanks_or_stops(weights):
    assert split("结果令人惊讶！图5显示了影响。我们检查了9条。", weights) == ["结果令人惊讶！", "图5显示了影响。", "我们检查了9条。"]
    assert split("审稿人写道：“缺少引用。请补充。”然后退回了。结果令人惊讶！", weights) == ["审稿人写道：“缺少引用。请补充。”然后退回了。", "结果令人惊讶！"]
    assert split("ผลลัพธ์น่าประหลาดใจมาก ข้อผิดพลาดลดลงร้อยละ5", weights) == ["ผลลัพธ์น่าประหลาดใจมาก", "ข้อผิดพลาดลดลงร้อยละ5"]


def test_empty_lines_end_units_and_line_breaks_do_not(weights):
    assert split("2 Methods\n\nWe asked\nagain. Nobody knew.", weights) == ["2 Methods", "We asked\nagain.", "Nobody knew."]


def test_nothing_and_very_much(weights):
    assert split("", weights) == [] and split(" \n\n ", weights) == []
    assert split("no stop at all", weights) == ["no stop at all"]
    assert len(split("It is clear. " * 20_000, weights)) == 20_000


def test_units_do_not_overlap_and_cover_all_but_blanks(weights):
    text = 'A "quote. Here" and (more. text). ¿Qué? 1. Two... three! «Да. Нет.» и всё.\n\nEnd'
    spans = s.units(text, weights)
    assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert "".join(text[a : a + n] for a, n in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_held_out_accuracy():
    from pathlib import Path

    import duckdb

    data = Path("/root/testdata/sf0.01/claim.parquet")
    if not data.exists():
        pytest.skip("no test tables here")
    rows = [r[0] for r in duckdb.sql(f"SELECT sentence FROM '{data}' WHERE sentence IS NOT NULL ORDER BY claim_id").fetchall()]
    w = s.fit(rows[::2])
    x, y = s.reliable(rows)
    known = [(a, b) for a, b in zip(x, y, strict=True)]
    right = sum((w[a].sum() + w[s.SPACE] > 0) == bool(b) for a, b in known)
    assert len(known) > 300 and right / len(known) > 0.97


def test_operator(spark):
    rows = [(1, "It is clear. Nobody knew.", "x"), (1, "It is clear. Nobody knew.", "x"), (2, None, "y"), (3, "", "y")]
    df = spark.createDataFrame(rows, "key bigint, sentence string, unit_no string")
    got = s.split_sentences(df, "key", "sentence", s.train(df, "sentence")).collect()
    assert sorted((r.row_id, r.unit_no, r.start_char, r.n_chars) for r in got) == [(1, 1, 0, 12), (1, 1, 0, 12), (1, 2, 13, 12), (1, 2, 13, 12)]
    assert s.split_sentences(df.limit(0), "key", "sentence", s.train(df.limit(0), "sentence")).count() == 0


def test_thai_is_found_wherever_it_stands(weights):
    """A blank is judged by what stands around it, not by how the text begins."""
    latin, thai = "The reports were lost. We asked again. " * 30, "เราเดินกลับบ้านด้วยกัน แม่ทำแกงไว้รอ " * 30
    first, last = split(latin + "\n" + thai, weights), split(thai + "\n" + latin, weights)
    assert first.count("แม่ทำแกงไว้รอ") >= 29 and last.count("แม่ทำแกงไว้รอ") >= 29
    assert first.count("We asked again.") >= 28 and last.count("We asked again.") >= 28


def test_quotes_and_tokens_of_any_length(weights):
    inner = "nobody knew of it, " * 60
    assert split(f"She wrote 'It is {inner}so. Nobody knew.' in the margin. We asked again.", weights) == [f"She wrote 'It is {inner}so. Nobody knew.' in the margin.", "We asked again."]
    word = "x" * 300
    assert split(f"We call it {word}. Nobody knew. {word.capitalize()} is long.", weights) == [f"We call it {word}.", "Nobody knew.", f"{word.capitalize()} is long."]
