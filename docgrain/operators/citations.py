"""Citation extraction as column expressions, all within the JVM.

One scan with the alternation of the three mark patterns lists the marks of a sentence in order: none of the three can
begin where another does, and a narrative mark takes its own parenthesis with it. A parenthesis that names nobody gives way
to the numeric marks inside it. Offsets follow by adding up: a mark's text can't occur between the end of the last mark
and its own place, or the scan would have stopped there. A mark is then unfolded by its first sign into years or numbers.

One row per year or number. Null texts give no rows; offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as t

ANY = f"(?:{t.NARRATIVE})|(?:{t.PARENTHETICAL})|(?:{t.NUMERIC})"
# Words that lead into a citation; a parenthesis of nothing but years; names.
CUE = r"(?i)^(?:see|e\.g\.|cf\.|for example|for review|reviewed in)\s+"
ONLY_YEARS = r"^\(\s*(?:19|20)\d{2}[a-z]?(?:\s*,\s*(?:19|20)\d{2}[a-z]?)*\s*\)$"
NAME, HINT = r"[A-Z][A-Za-z'’-]+", r"[A-Z][A-Za-z'-]+"
LONGEST_RANGE = 50
_ROW = "array<struct<marker:string,citation_type:string,year:int,author_hint:string>>"


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def hint(authors: Column) -> Column:
    """The last capitalised word of the last group of names, "et al." left out; null without one."""
    group = F.regexp_replace(_last(F.split(authors, ";")), r"(?i)\bet\s+al\.?", "")
    return _last(F.regexp_extract_all(group, F.lit(HINT), F.lit(0)))


def before_year(item: Column) -> Column:
    """What stands before the first year, led in by no cue, and by "and" for any joining sign."""
    text = F.regexp_replace(F.regexp_replace(item, r"^\s+", ""), CUE, "")
    text = F.regexp_replace(text, rf"(?s){t.YEAR}.*$", "")
    return F.regexp_replace(F.regexp_replace(text, r"^[\s,]+|[\s,]+$", ""), r"\s+(?:and|&)\s+", " and ")


def _years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(t.YEAR), F.lit(1))


def _dated(authors: Column, years: Column, kind: str) -> Column:
    return F.transform(years, lambda y: F.struct(t.marker(F.concat_ws(" ", authors, y)).alias("marker"), F.lit(kind).alias("citation_type"), y.cast("int").alias("year"), hint(authors).alias("author_hint")))


def _narrative(mark: Column) -> Column:
    return _dated(F.regexp_extract(mark, t.NARRATIVE, 1), _years(F.regexp_extract(mark, t.NARRATIVE, 2)), "author_year_narrative")


def _parenthesis(mark: Column) -> Column:
    """Items apart by semicolons; one without names has those of the last that had some."""
    items = F.filter(F.split(F.substr(mark, F.lit(2), F.length(mark) - 2), ";"), lambda i: i.rlike(t.YEAR))
    named = t.let(items, lambda v: F.transform(v, lambda i, k: F.struct(_last(F.filter(F.transform(F.slice(v, 1, k + 1), before_year), lambda a: a != "")).alias("who"), i.alias("item"))))
    return F.flatten(F.transform(F.filter(named, lambda n: n["who"].isNotNull()), lambda n: _dated(n["who"], _years(n["item"]), "author_year")))


def numbers(text: Column) -> Column:
    """Numbers of a text in order, each once; rising ranges of at most LONGEST_RANGE written out, others by their ends."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+(?:\s*[-–—]\s*\d+)?"), F.lit(0))

    def expanded(part: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(part, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))
        a, z = ends[0], F.element_at(ends, -1)
        return F.when((a <= z) & (z - a <= LONGEST_RANGE), F.sequence(a, F.greatest(a, z))).otherwise(ends)

    return F.array_distinct(F.filter(F.flatten(F.transform(parts, expanded)), lambda n: n.isNotNull()))


def _numeric(mark: Column) -> Column:
    return F.transform(numbers(mark), lambda n: F.struct(n.cast("string").alias("marker"), F.lit("numeric").alias("citation_type"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("author_hint")))


def marks(sentence: Column) -> Column:
    """array(struct(raw_text, start_char, end_char)) of the accepted marks in order."""
    refused = lambda m: m.startswith("(") & (m.rlike(ONLY_YEARS) | ~before_year(F.substr(m, F.lit(2), F.length(m) - 2)).rlike(NAME))
    inner = lambda m: F.regexp_extract_all(m, F.lit(t.NUMERIC), F.lit(0))
    found = F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit(ANY), F.lit(0)), lambda m: F.when(refused(m), inner(m)).otherwise(F.array(m))))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<raw_text:string,start_char:int,end_char:int>>").alias("out"))

    def step(state: Column, mark: Column) -> Column:
        at = _place(sentence, mark, state["end"])
        end = (at + F.length(mark)).cast("int")
        return F.struct(end.alias("end"), F.concat(state["out"], F.array(F.struct(mark.alias("raw_text"), at.alias("start_char"), end.alias("end_char")))).alias("out"))

    return F.aggregate(found, start, step)["out"]


def _place(text: Column, part: Column, after: Column) -> Column:
    """0-based place of ``part`` in ``text`` from ``after`` on."""
    return (F.call_function("locate", part, text, after + 1) - 1).cast("int")


def unfolded(mark: Column) -> Column:
    """The rows of one mark: struct(marker, citation_type, year, author_hint)."""
    return F.when(mark.startswith("["), _numeric(mark)).when(mark.startswith("("), _parenthesis(mark)).otherwise(_narrative(mark)).cast(_ROW)


def citations(df: DataFrame, key: str, position: str, sentence: str) -> DataFrame:
    """One row per citation with offsets and the group id s<position>:c<start>."""
    narrow = df.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(position), F.lit(0)).cast("int").alias("p"), F.col(sentence).cast("string").alias("s")).where("s is not null")
    placed = narrow.where(F.col("s").rlike(ANY)).select(key, "p", F.inline(marks(F.col("s"))))
    rows = placed.select(key, "p", "raw_text", "start_char", "end_char", F.inline(unfolded(F.col("raw_text"))))
    group = F.concat(F.lit("s"), F.col("p"), F.lit(":c"), F.col("start_char"))
    return rows.select(key, "raw_text", "marker", "citation_type", "year", "author_hint", "start_char", "end_char", group.alias("group_id"))
