"""Visually identical text with different characters: one consistent form for texts that look the same.

A value is first mapped, inside the JVM, to look-alike letters, plain blanks and hyphens, with invisible characters
removed. Mapped values are grouped in SQL under the accent-sensitive Unicode collation, under which composed and
decomposed accents are equal and case, accents and punctuation are not. The class's canonical member is the
smallest value that needs no mapping, else the smallest value, both by code point, and is joined back.

Defined results: null stays null and is in no class; the empty text is a class of its own; every distinct value is
handled once, so repeated rows cost one row of the class table; rows keep their other columns, whatever their names.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.session import materialize

# Letters of other scripts with the shape of a Latin letter.
CYRILLIC = "асеорхуіјѕԁԛԝһёїАВСЕНІЈКМОРЅТХԚԜЁЇ"
CYRILLIC_AS = "aceopxyijsdqwhëïABCEHIJKMOPSTXQWËÏ"
GREEK = "ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
GREEK_AS = "ovcjABEZHIKMNOPTYXCJ"
ARMENIAN, ARMENIAN_AS = "օոսհցՏԼՕՍ", "onuhgSLOU"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ"
# Hyphens of any kind (dashes differ in length and stay).
HYPHENS = "‐‑﹣－"


@functools.cache
def tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, several): characters mapped one to one, characters to delete at the end of ``from``, and characters
    that stand for several. Built by rule from the Unicode character data of the basic plane."""
    one = dict(zip(CYRILLIC + GREEK + ARMENIAN + CHEROKEE, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS, strict=True)) | dict.fromkeys(HYPHENS, "-")
    several: dict[str, str] = {}
    gone: list[str] = []
    for code in range(0xA0, 0xFFFE):
        c = chr(code)
        kind = unicodedata.category(c)
        if c in one or kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Zs":
            one[c] = " "
        elif (kind == "Cf" and not unicodedata.name(c, "").startswith(("ARABIC", "SYRIAC"))) or 0xFE00 <= code <= 0xFE0F or c == "͏":
            gone.append(c)
        else:
            name, tag = unicodedata.name(c, ""), unicodedata.decomposition(c).partition(" ")[0]
            if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and ("LIGATURE" in name and name.startswith("LATIN") or "ROMAN NUMERAL" in name or code in (0x2024, 0x2025, 0x2026))):
                to = unicodedata.normalize("NFKC", c)
                to = one.get(to, to)
                if len(to) == 1:
                    one[c] = to
                else:
                    several[c] = to
    return "".join(one) + "".join(gone), "".join(one.values()), several


def mapped(col: Column) -> Column:
    """``col`` with look-alike characters mapped and invisible ones removed; null stays null."""
    source, target, several = tables()
    whole = col
    for c, text in several.items():
        whole = F.replace(whole, F.lit(c), F.lit(text))
    col = F.when(col.rlike(f"[{''.join(several)}]"), whole).otherwise(col)
    return F.when(col.rlike("[^\\x00-\\x7f]"), F.translate(col, source, target)).otherwise(col)


def classes(values: DataFrame, column: str) -> DataFrame:
    """(value, canonical, members) of every distinct non-null value of ``column``."""
    spark = values.sparkSession
    distinct = values.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return spark.sql(
        """
        WITH m AS (SELECT value, look COLLATE UNICODE AS look, value != look AS changed FROM {m}),
        c AS (SELECT look, min(struct(changed, value)).value AS canonical, count(*) AS members FROM m GROUP BY look)
        SELECT m.value, c.canonical, c.members FROM m JOIN c ON m.look = c.look
        """,
        m=distinct.select("value", mapped(F.col("value")).alias("look")),
    )


def canonicalize(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the canonical form of ``column`` as ``out`` (null where the text is null)."""
    found = classes(df, column).select(F.col("value").alias("__value"), F.col("canonical").alias(out))
    return df.join(found, df[column] == F.col("__value"), "left").drop("__value")


def lookalike_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) of rows of ``left`` and ``right`` (id, value) whose values look the same and are unequal.

    One grouping by look finds the classes of two or more different values with their canonical members; it is joined back and
    only rows of such classes are written and go on. The same frame on both sides gives id_a < id_b.
    """
    same = left is right
    side = lambda df, name: df.select(F.lit(name).alias("side"), "id", F.col("value").cast("string").alias("value")).where("value is not null")
    both = side(left, "a") if same else side(left, "a").unionByName(side(right, "b"))
    rows = both.sparkSession.sql(
        """
        WITH m AS (SELECT side, id, value, look COLLATE UNICODE AS look, value != look AS changed FROM {m}),
        c AS (SELECT look, min(struct(changed, value)).value AS canonical FROM m GROUP BY look HAVING min(value) != max(value))
        SELECT m.side, m.id, m.value, c.canonical FROM m JOIN c ON m.look = c.look
        """,
        m=both.withColumn("look", mapped(F.col("value"))),
    )
    rows = materialize(rows, "lookalike-rows")
    a = rows.where("side = 'a'").select(F.col("id").alias("id_a"), F.col("value").alias("value_a"), "canonical")
    b = rows.where(f"side = '{'a' if same else 'b'}'").select(F.col("id").alias("id_b"), F.col("value").alias("value_b"), "canonical")
    pairs = a.join(b, "canonical").where("value_a != value_b")
    return (pairs.where("id_a < id_b") if same else pairs).select("id_a", "id_b")
