"""Text functions as column expressions, all within the JVM.

They work on ASCII classes, so that other engines give the same results; null text gives null, or an empty array where
arrays are built. Sentinels stand for cut points: \\x01 and \\x02 never occur in the results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of retrieval and of fuzzy matching.
RETRIEVAL_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "with")
MATCH_STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to")
# Abbreviations whose stop ends no sentence, and names of sections.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "Dr.", "Prof.", "Fig.", "Eq.", "vs.")
SECTIONS = r"abstract|introduction|related work|background|methods?|methodology|experiments?|results?|discussion|conclusions?|limitations?"
# Patterns of citations, years and identifiers.
YEAR = r"\b((?:19|20)\d{2})[a-z]?\b"
NARRATIVE = r"([A-Z][A-Za-z'’-]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][A-Za-z'’-]+|\s+et\s+al\.?)?)\s*\(((?:19|20)\d{2}[a-z]?(?:\s*,\s*(?:19|20)\d{2}[a-z]?)*)\)"
PARENTHETICAL = r"\([^()]*?\b(?:19|20)\d{2}[a-z]?[^()]*\)"
NUMERIC = r"\[\d+(?:\s*(?:,|;|-|–|—)\s*\d+)*\]"
DOI = r"(?i)(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
CUT = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once: inside another lambda an expression would be evaluated for every element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """Whitespace words; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def stem(token: Column) -> Column:
    """First fitting rule: ies to y, then ing, ed and s dropped, each above a least length."""
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("ing") & (n > 5), F.substring(token, F.lit(1), n - 3))
        .when(token.endswith("ed") & (n > 4), F.substring(token, F.lit(1), n - 2))
        .when(token.endswith("s") & (n > 3), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def tokens(text: Column) -> Column:
    """Stemmed retrieval tokens in order."""
    raw = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(raw, lambda t: (F.length(t) > 2) & ~t.isin(*RETRIEVAL_STOPWORDS)), stem)


def review_tokens(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "<br\\s*/?>", " "), r"[^a-z0-9\s]", " ")
    return words(plain)


def bigrams(toks: Column) -> Column:
    empty = F.array().cast("array<string>")
    pairs = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - 1), lambda k: F.concat_ws(" ", F.element_at(v, k), F.element_at(v, k + 1)))
    return let(toks, lambda v: F.when(F.size(v) > 1, F.array_distinct(pairs(v))).otherwise(empty))


def phrases(toks: Column, size: int) -> Column:
    """All runs of ``size`` tokens, joined by blanks."""
    empty = F.array().cast("array<string>")
    runs = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - size + 1), lambda k: F.array_join(F.slice(v, k, size), " "))
    return let(toks, lambda v: F.when(F.size(v) >= size, runs(v)).otherwise(empty))


def sentences(text: Column) -> Column:
    """Sentences: section titles closed by a stop, blanks collapsed, abbreviations protected, cut after . ! ? before a
    capital, digit or opening bracket."""
    body = collapse(F.regexp_replace(text, rf"(?imd)^\s*((?:\d+(?:\.\d+)*)?\s*(?:{SECTIONS}))\s*$", "$1. "))
    for k, a in enumerate(ABBREVIATIONS):
        body = F.replace(body, F.lit(a), F.lit(f"\x02{k}\x02"))
    parts = F.split(F.regexp_replace(body, r"([.!?])\s+([A-Z0-9\[\(])", f"$1{CUT}$2"), CUT)

    def restored(p: Column) -> Column:
        for k, a in enumerate(ABBREVIATIONS):
            p = F.replace(p, F.lit(f"\x02{k}\x02"), F.lit(a))
        return p

    return non_empty(F.transform(parts, restored))


def style_sentences(text: Column) -> Column:
    """Cut after . ! ? and blanks, whatever follows."""
    return non_empty(F.split(F.regexp_replace(text, r"([.!?])\s+", f"$1{CUT}"), CUT))


def retrieval_sentences(text: Column) -> Column:
    """Cut after . ! ? before a capital, digit or square bracket, and after a semicolon before a capital or digit."""
    cut = F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+([A-Z0-9\[])", f"$1{CUT}$2"), r"(;)\s+([A-Z0-9])", f"$1{CUT}$2")
    return non_empty(F.split(cut, CUT))


def evidence_paragraphs(text: Column) -> Column:
    """Cut at blank lines and at a line's end after a stop."""
    cut = F.regexp_replace(F.regexp_replace(text, r"\n\s*\n", CUT), r"(\.)\s*\n", f"$1{CUT}")
    return F.filter(F.transform(F.split(cut, CUT), collapse), lambda p: p != "")


def style_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\n\s*\n", CUT), CUT), collapse), lambda p: p != "")


def strip_citations(sentence: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(sentence, NARRATIVE, "$1"), PARENTHETICAL, ""), NUMERIC, "")
    return collapse(F.regexp_replace(plain, r"\s+([.,;:!?])", "$1"))


def marker(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def title_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def doi(text: Column) -> Column:
    found = F.regexp_extract(text, DOI, 1)
    return F.lower(F.nullif(F.regexp_replace(found, r"[.,;:)\]]+$", ""), F.lit("")))


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def reference_index(text: Column) -> Column:
    bracket, number = F.regexp_extract(text, r"^\s*\[(\d+)\]\s+", 1), F.regexp_extract(text, r"^\s*(\d+)[.)]\s+", 1)
    return F.coalesce(F.nullif(bracket, F.lit("")), F.nullif(number, F.lit("")))


def boolean(text: Column) -> Column:
    """true, 1, yes and their opposites; null for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1", "yes", "y", "t"), True).when(t.isin("false", "0", "no", "n", "f"), False)


def strict_boolean(text: Column, optional: bool = False) -> Column:
    """true, 1, yes and false, 0, no; with ``optional`` null for an empty text, na, n/a and none; anything else raises when read."""
    v = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    known = F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)
    known = known.when(v.isin("", "na", "n/a", "none"), F.lit(None).cast("boolean")) if optional else known
    return known.otherwise(F.raise_error(F.concat(F.lit("invalid boolean: "), v)).cast("boolean"))


def fixed_word_chunks(text: Column, size: int, overlap: int) -> Column:
    """Chunks of ``size`` words, each starting size - overlap words after the last; the tail may lie in its forerunner."""
    stride = max(1, size - overlap)
    empty = F.array().cast("array<string>")
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(stride)), lambda k: F.array_join(F.slice(w, k, size), " "))
    return let(words(text), lambda w: F.when(F.size(w) > 0, cut(w)).otherwise(empty))


def fixed_char_chunks(text: Column, size: int, overlap: int) -> Column:
    """Stripped windows of ``size`` characters; empty ones are left out."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda k: F.regexp_replace(F.substring(text, k, F.lit(size)), r"^\s+|\s+$", "")), lambda c: c != "")


def sections(text: Column) -> Column:
    """struct(main_text, references_text, evidence_text): heading lines cut the text, the last of equal headings wins;
    without a heading the text is the main text as it is."""
    marked = F.regexp_replace(text, r"(?imd)^[ \t]*(?:references|bibliography|works cited)[ \t]*:?[ \t]*$", f"{CUT}R")
    marked = F.regexp_replace(marked, r"(?imd)^[ \t]*(?:evidence passages?|sample evidence)[ \t]*:?[ \t]*$", f"{CUT}E")
    parts = F.split(marked, CUT)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    last = lambda kind: F.coalesce(strip(F.substring(F.try_element_at(F.filter(F.slice(parts, 2, 1_000_000), lambda p: p.startswith(kind)), F.lit(-1)), 2, 2_000_000_000)), F.lit(""))
    return F.struct(
        F.when(F.size(parts) > 1, strip(parts[0])).otherwise(text).alias("main_text"), last("R").alias("references_text"), last("E").alias("evidence_text")
    )
