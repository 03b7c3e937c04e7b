"""Matching entities across sources without keys by soft logic.

References and records are reduced to profiles (equal rows once). Candidates share all content words of the title,
or an author's surname with a part of them, or, where one side names nobody, the year with a larger part; no key is capped. Every candidate
pair is a variable between 0 and 1, and so is the sameness of two records that compete for one reference. Weighted rules
become hinge losses:

* titles alike -> match, match -> titles alike, match -> authors, year, venue agree, match -> good service score;
* different kinds (erratum, comment, part of a series) -> no match;
* exclusivity: two matches of one reference -> the records are the same publication;
* transitivity: a match and the sameness of two records -> the other match;
* sameness of records follows their likeness.

The sum of the losses is convex. Pairs no rule couples are minimised in closed form; the rest by alternating directions:
every rule on several variables keeps copies of them and moves them by the closed-form step of its hinge; every variable
then takes the exact minimum of its own rules and of its distance to the mean of its copies. Both are DataFrame joins keyed by
rule and by variable, repeated until no copy and no variable moves by more than TOLERANCE. The values are the confidences.

Defined results: a null or empty title matches nothing; null years, venues, authors and scores drop their rule; repeated
rows give the pairs of each row; ties keep both records; empty tables give no pairs; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import warnings
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgrain.functions.text import let
from docgrain.llm import names
from docgrain.llm.lookalike import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS
from docgrain.session import discard, materialize, measured_broadcasts, spread

#: Weights of the rules, step size of the alternation, confidence from which a pair is a match.
WEIGHTS = {"title": 3.0, "authors": 4.0, "year": 1.0, "venue": 0.5, "score": 0.2, "alone_year": 2.0, "alone_venue": 1.5, "kind": 20.0, "exclusive": 3.0, "transitive": 2.0, "same": 3.0}
RHO, CONFIDENT = 2.0, 0.5
#: The alternation ends when nothing moves by more, or, with a warning, after so many rounds.
TOLERANCE, MOST_ROUNDS = 0.001, 200
#: Most that a title's cut end costs.
CUT = 0.35
#: Signs of a part of a word that blocks.
GRAM = 4
#: Keys are joined, and candidates compared, in so many turns: the disk holds the shuffles of one turn.
TURNS = 4

_ALIKE = str.maketrans(dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)))
# Words that say nothing of a title's topic.
_SMALL = frozenset("a an the of in on for and with to from by at as is are how what study evidence revisited der die das und von bei zur mit le la les de des du et sur en el los las y con и в на с о".split())
_KIND = re.compile(r"^\W*(erratum|corrigendum|correction|comments?\s+on|reply\s+to|response\s+to|retraction\s+(?:of|note)|addendum)\b\W*", re.I)
_PART = re.compile(r"\W+(?:part|pt|teil|partie|parte)\.?\s*(i{1,3}|iv|vi{0,3}|ix|x|\d+)\W*$", re.I)
_TAIL = re.compile(r"(?:\s*[\[(](?:online|electronic resource|preprint|pdf|internet)[\])]|[\s.,;:]+(?:preprint|online|in\s+proc(?:\.|eedings\b).{0,60}))\W*$", re.I)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


class _Folding(dict):
    """What each character becomes; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        text = "".join(c for c in unicodedata.normalize("NFKC", chr(code)) if unicodedata.category(c) != "Cf")
        text = text.translate(_ALIKE).lower().replace("ł", "l").replace("ø", "o").replace("ß", "ss")
        self[code] = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return self[code]


_FOLDING = _Folding()


def plain(text: str | None) -> str:
    """Small letters without accents and signs that can't be seen, look-alikes mapped."""
    return "" if not text else text.lower() if text.isascii() else text.translate(_FOLDING)


@functools.lru_cache(50_000)
def _surname(name: str) -> str | None:
    found = names.parse(name) if name else None
    return found[1] if found else None


@functools.lru_cache(20_000)
def title_parts(title: str | None) -> tuple[str, int, list[str]]:
    """(kind, part, words) of a title; the list is shared and not to be changed."""
    text = re.sub(r"(?<=\w)[-‐‑‒–—](?=\w)", "", _TAIL.sub("", plain(title)).replace("&", " and "))
    kind = ""
    if m := _KIND.match(text):
        kind, text = m.group(1)[:4], text[m.end() :]
    part = 0
    if m := _PART.search(text):
        value = m.group(1)
        part, text = int(value) if value.isdigit() else _ROMAN[value], text[: m.start()]
    return kind, part, re.findall(r"[぀-ヿ㐀-鿿가-힯]+|[^\W_぀-ヿ㐀-鿿가-힯]+", text)


def content(words: list[str]) -> list[str]:
    return [w for w in words if w not in _SMALL] or words


def venue_key(venue: str | None) -> str:
    """First letters of a venue's words: equal for full and shortened forms."""
    words = [w for w in re.findall(r"\w+", plain(venue)) if w not in ("of", "the", "on", "in", "for", "and")]
    return words[0] if len(words) == 1 else "".join(w[0] for w in words)


def surnames(authors: list[str]) -> list[str]:
    return sorted({p for a in authors if (p := _surname(a))})


def title_like(a: list[str], b: list[str]) -> float:
    """Likeness of two titles: words must agree in order but for slips, a missing first word and a cut end."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m or min(n, m) > 2 and 2 * len(set(a) & set(b)) < min(n, m):
        return 0.0  # with fewer equal words the slips alone cost more than is allowed
    big = 9.0
    before = [0.0] + [0.25 if j == 1 else big for j in range(1, m + 1)]
    for i in range(1, n + 1):
        row = [0.25 if i == 1 else big] + [0.0] * m
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            if x == y:
                cost = 0.0
            elif min(len(x), len(y)) > 2 and names.one_slip(x, y):
                cost = 0.12
            elif (i == n or j == m) and (x.startswith(y) or y.startswith(x)):
                cost = 0.15
            elif min(len(x), len(y)) > 4 and names.lcs_ratio(x, y) >= 0.8:
                cost = 0.25
            else:
                cost = 0.75
            row[j] = min(before[j - 1] + cost, before[j] + 0.6, row[j - 1] + 0.6)
        before = row
        if i == n:
            last = row
    # a cut end: the longer title's further words cost little, however many they are
    ends = last[m]
    short = min(n, m)
    if m > n:
        ends = min(ends, *[last[j] + min(CUT, 0.07 * (m - j)) for j in range(1, m)]) if n >= 4 else ends
    elif n > m and m >= 4:
        ends = min(ends, *[_tail(a[:i], b) + min(CUT, 0.07 * (n - i)) for i in range(m - 1, min(n, m + 2))])
    return max(0.0, 1.0 - ends * (1.0 if short > 3 else 1.5))


def _tail(a: list[str], b: list[str]) -> float:
    """Cost of aligning whole ``a`` with whole ``b`` word by word from the end, a missing first word allowed."""
    if len(a) - len(b) not in (0, 1, -1):
        return 9.0
    if len(a) != len(b):
        a, b = (a[1:], b) if len(a) > len(b) else (a, b[1:])
        extra = 0.25
    else:
        extra = 0.0
    cost = extra
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x != y:
            last = k == len(a) - 1 and (x.startswith(y) or y.startswith(x))
            cost += 0.12 if min(len(x), len(y)) > 2 and names.one_slip(x, y) else 0.15 if last else 0.25 if min(len(x), len(y)) > 4 and names.lcs_ratio(x, y) >= 0.8 else 0.75
    return cost


def overlap(a: list[str], b: list[str]) -> float | None:
    """Share of the shorter list's surnames found in the other, slips allowed; None when one is empty."""
    if not a or not b:
        return None
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return sum(any(x == y or min(len(x), len(y)) > 4 and names.one_slip(x, y) for y in b) for x in a) / len(a)


PROFILE = "kind string, part int, words array<string>, years array<int>, venue string, people array<string>"
#: How a profile is named: its place in the order of the digests of the columns, which are of 16 bytes.
ID = "bigint"


def _in_turn(text: str, turn: int) -> bool:
    return zlib.crc32(text.encode()) % TURNS == turn


def _keys(words: list[str], people: list[str], years: list[int], reference: bool, turn: int) -> list[str]:
    """Blocking keys of one turn, which a key's part of the title decides: all content words; a part of the title with a surname, or, where one side names nobody, with the
    year (years side by side meet, an unknown year meets all). Parts are all words but one, without order, two
    neighbouring words, and, beside a year, the first and the last four. One or two words have no such parts and a run
    of CJK signs is one word: their parts are each word and its runs of four signs."""
    own = content(words)
    bag = sorted(own)
    but_one = {"-" + " ".join(bag[:k] + bag[k + 1 :]) for k in range(len(bag))} if len(bag) > 1 else set()
    but_one |= {"~" + w[k : k + GRAM] for w in own if len(bag) < 3 or _CJK.match(w) for k in range(max(1, len(w) - GRAM + 1))}
    pairs = {" ".join(own[k : k + 2]) for k in range(len(own) - 1)}
    whole = " ".join(bag)
    out = {"t|" + whole} if _in_turn(whole, turn) else set()
    out |= {f"a|{p}|{part}" for part in but_one | pairs if _in_turn(part, turn) for p in people}
    ends = {" ".join(own[:4]) + "^", "^" + " ".join(own[-4:])} if len(own) > 4 else set()
    # records are fewer than references: they bring the years side by side
    if reference:
        when = [*map(str, years), "?"] if years else ["*"]
        sides = ["n"] if people else ["n", "m"]
    else:
        when = ["*", *sorted({str(y + d) for y in years for d in (-1, 0, 1)} or {"?"})]
        sides = ["m"] if people else ["n", "m"]
    out |= {f"{side}|{y}|{part}" for part in but_one | ends if _in_turn(part, turn) for side in sides for y in when}
    return sorted(out)


def _profile(title: str | None, years: list[int | None], venue: str | None, people: list[str]) -> tuple:
    kind, part, words = title_parts(title)
    known = sorted({int(y) for y in years if y is not None and y == y})
    return kind, part, words, known, venue_key(venue), people


_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")


def references(df: DataFrame) -> DataFrame:
    """(row_id, profile columns) of ref_id, parsed_title, parsed_year, authors, parsed_venue, raw_text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, title, year, authors, venue, raw in b.itertuples(index=False):
                people = surnames(list(authors)) if authors is not None else []
                text = plain(raw)
                years = [year, *map(int, _YEAR.findall(re.sub(r"10\.\d{4}\S*|https?:\S+", " ", text))[-1:])]
                _, _, words = title_parts(title)
                # names before the title in the entry itself
                at = text.find(" ".join(words[:2])) if words else -1
                if not people and at > 0:
                    people = sorted({names.fold(w) for w in re.findall(r"[^\W\d_]{3,}(?:-[^\W\d_]+)*", text[:at])} - {"and", "et", "the", "van", "von", "der", ""})
                if not venue and text:
                    venue = None
                rows.append((i, *_profile(title, years, venue, people)))
            yield pd.DataFrame(rows, columns=["row_id", *[c.split()[0] for c in PROFILE.split(", ")]])

    narrow = df.select(F.col("ref_id").cast("bigint"), "parsed_title", F.col("parsed_year").cast("int"), "authors", "parsed_venue", "raw_text").where("parsed_title is not null")
    return spread(narrow).mapInPandas(run, "row_id bigint, " + PROFILE)


def records(df: DataFrame) -> DataFrame:
    """(row_id, profile columns, score) of record_id, crossref_title, crossref_year, crossref_authors, crossref_venue, crossref_score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, *_profile(title, [year], venue, surnames(authors.split(";")) if authors else []), score)
                for i, title, year, authors, venue, score in b.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=["row_id", *[c.split()[0] for c in PROFILE.split(", ")], "score"])

    narrow = df.select(F.col("record_id").cast("bigint"), "crossref_title", F.col("crossref_year").cast("int"), "crossref_authors", "crossref_venue", F.col("crossref_score").cast("double"))
    return narrow.where("crossref_title is not null").mapInPandas(run, "row_id bigint, " + PROFILE + ", score double")


@functools.lru_cache(50_000)
def _title_like(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    return title_like(list(a), list(b))


def _evidence(a: tuple, b: tuple) -> tuple[float, float | None, float | None, float | None, bool]:
    """(title, authors, year, venue, same kind) of two profiles (kind, part, words, years, venue, people)."""
    like = _title_like(tuple(a[2]), tuple(b[2]))
    if like < 0.5:
        return like, None, None, None, False
    kinds = a[0] == b[0] and (a[1] == b[1])
    ya, yb = list(a[3]), list(b[3])
    year = None if not ya or not yb else 1.0 if min(abs(x - y) for x in ya for y in yb) <= 1 else 0.0
    preprint = "pr" in (a[4], b[4])
    venue = None if not a[4] or not b[4] or preprint else 1.0 if a[4] == b[4] else 0.0
    return like, overlap(list(a[5]), list(b[5])), year, venue, kinds


#: With fewer equal words two titles can't be alike (see ``title_like``).
_MAY = "least(size(a_words), size(b_words)) <= 2 or 2 * size(array_intersect(a_words, b_words)) >= least(size(a_words), size(b_words))"
SIDE = ("kind", "part", "words", "years", "venue", "people")


def _compared(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with columns of both sides (prefixed a_ and b_) turned into evidence columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a_side = list(zip(*[b[f"a_{c}"] for c in SIDE], strict=True))
            b_side = list(zip(*[b[f"b_{c}"] for c in SIDE], strict=True))
            found = [_evidence(x, y) for x, y in zip(a_side, b_side, strict=True)]
            out = pd.DataFrame(found, columns=["title", "people", "year", "venue", "kinds"])
            for c in ("people", "year", "venue"):
                out[c] = out[c].astype("float64")
            out.insert(0, left, b[left].to_numpy())
            out.insert(1, right, b[right].to_numpy())
            yield out[(out["title"] >= 0.5)]

    return pairs.mapInPandas(run, f"{left} {ID}, {right} {ID}, title double, people double, year double, venue double, kinds boolean")


def _side(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(F.col("profile").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in SIDE])


def _profiles(df: DataFrame, extra: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their profile, distinct profiles with their columns), both written."""
    columns = [*SIDE, *extra]
    keyed = materialize(df.withColumn("digest", F.unhex(F.md5(F.to_json(F.struct(*columns))))), f"{name}-rows")
    ordered = keyed.drop("row_id").repartitionByRange("digest").dropDuplicates(["digest"]).sortWithinPartitions("digest")
    named = materialize(ordered.withColumn("profile", F.monotonically_increasing_id()), f"{name}-profiles")
    rows = materialize(keyed.select("row_id", "digest").join(named.select("digest", "profile"), "digest").select("row_id", "profile"), name)
    discard(keyed)
    return rows, named


def _keyed(profiles: DataFrame, key: str, reference: bool, turn: int) -> DataFrame:
    """(``key``, key) of every blocking key of ``turn``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [_keys(list(words), list(people), list(years), reference, turn) for words, people, years in zip(b["words"], b["people"], b["years"], strict=True)]
            yield pd.DataFrame({key: b["profile"], "keys": keys})

    found = profiles.where("size(words) > 0").select("profile", "words", "people", "years").mapInPandas(run, f"{key} {ID}, keys array<string>")
    return found.select(key, F.explode(F.transform("keys", lambda k: F.xxhash64(k))).alias("key"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _candidates(refs: DataFrame, recs: DataFrame) -> DataFrame:
    """(r, c) of the profiles that share a key, written turn by turn."""
    met = [
        materialize(_keyed(refs, "r", True, turn).join(_keyed(recs, "c", False, turn), "key").select("r", "c").distinct(), "linkage-met")
        for turn in range(TURNS)
    ]
    found = materialize(_union(met).distinct(), "linkage-candidates")
    for table in met:
        discard(table)
    return found


def _unary(w: dict[str, float]) -> list[tuple[str, str, str, str]]:
    """(weight, bound, sign, condition) of the rules on one pair; sign up: bound -> match, down: match -> bound."""
    return [
        (str(w["title"]), "title", "up", "true"),
        (str(w["title"]), "title", "down", "true"),
        (str(w["authors"]), "people", "down", "people is not null"),
        (f"if(people is null, {w['alone_year']}, {w['year']})", "year", "down", "year is not null"),
        (f"if(people is null, {w['alone_venue']}, {w['venue']})", "venue", "down", "venue is not null"),
        (str(w["score"]), "score", "down", "score is not null"),
        (str(w["kind"]), "0D", "down", "not kinds"),
    ]


def minimise(pairs: DataFrame, w: dict[str, float]) -> DataFrame:
    """``pairs`` with ``local``: the value that minimises a pair's own hinge losses, found among their corners (the
    largest of equal ones)."""
    rules = _unary(w)
    loss = " + ".join(
        f"if({condition}, ({weight}) * greatest(0D, {'c - v' if sign == 'down' else 'v - c'}), 0D)".replace("- v", f"- coalesce({bound}, 0D)").replace("v -", f"coalesce({bound}, 0D) -")
        for weight, bound, sign, condition in rules
    )
    corners = "filter(array_distinct(array(0D, 1D, title, people, year, venue, score)), c -> c is not null)"
    best = f"array_max(transform({corners}, c -> struct(-({loss}) as gain, c as value))).value"
    return pairs.withColumn("local", F.expr(best))


def _least(prior: Column, mean: Column, weight: Column) -> Column:
    """The y in the unit box with the least sum of w * max(0, s * (y - b)) over ``prior`` plus weight / 2 * (y - mean)^2: a
    corner, or the place between two corners where the slope is zero."""
    add = lambda f: lambda y: F.aggregate(prior, F.lit(0.0), lambda a, r: a + f(y, r))
    own = add(lambda y, r: r["w"] * F.greatest(F.lit(0.0), r["s"] * (y - r["b"])))
    slope = add(lambda y, r: F.when(r["s"] * (y - r["b"]) > 0, r["w"] * r["s"]).otherwise(0.0))
    bounds = F.transform(prior, lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["b"])))
    corners = F.array_sort(F.array_distinct(F.concat(bounds, F.array(F.lit(0.0), F.lit(1.0)))))
    between = lambda c: F.transform(F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("low"), F.slice(c, 2, F.size(c)).alias("high")), lambda p: F.greatest(p["low"], F.least(p["high"], mean - slope((p["low"] + p["high"]) / 2) / weight)))
    every = let(corners, lambda c: F.concat(c, between(c)))
    return F.array_min(F.transform(every, lambda y: F.struct((own(y) + weight / 2 * (y - mean) * (y - mean)).alias("loss"), y.alias("y"))))["y"]


def alternate(terms: DataFrame, priors: DataFrame, rounds: int = MOST_ROUNDS, rho: float = RHO, tolerance: float = TOLERANCE) -> DataFrame:
    """(var, value) minimising the sum of hinge losses over the unit box.

    ``terms`` has one row per rule and variable of the rules on several variables, w * max(0, sum(coef * var) + d): rule, var,
    coef, w, d, start. ``priors`` has every variable with its own rules: var, prior array(struct(w, s, b)) for w * max(0,
    s * (var - b)). Scaled-form alternating directions: copies x per row, values z per variable, duals u per row; a round is
    one aggregation and join by variable and one window by rule, and is written. Earlier rounds are deleted.
    """
    state = terms.select("rule", "var", "coef", "w", "d", F.col("start").alias("x"), F.lit(0.0).alias("u"), F.col("start").alias("z"))
    solved = lambda s: s.groupBy("var").agg(F.avg(F.col("x") + F.col("u")).alias("mean"), F.count("*").alias("n")).join(priors, "var").select("var", _least(F.col("prior"), F.col("mean"), rho * F.col("n")).alias("value"))
    own = W.partitionBy("rule")  # at most three rows
    written: DataFrame | None = None
    for _ in range(rounds):
        after = state.join(solved(state), "var").withColumn("u", F.col("u") + F.col("x") - F.col("value"))
        after = after.withColumns({"moved": F.abs(F.col("value") - F.col("z")), "apart": F.abs(F.col("x") - F.col("value")), "v": F.col("value") - F.col("u")})
        after = after.withColumns({"at": F.sum(F.col("coef") * F.col("v")).over(own), "n": F.sum(F.col("coef") * F.col("coef")).over(own)})
        at = F.col("at") + F.col("d")
        step = F.when(at <= 0, 0.0).when(at >= F.col("w") / rho * F.col("n"), F.col("w") / rho).otherwise(at / F.col("n"))
        last, written = written, materialize(after.select("rule", "var", "coef", "w", "d", (F.col("v") - step * F.col("coef")).alias("x"), "u", F.col("value").alias("z"), "moved", "apart"), "linkage-round")
        if last is not None:
            discard(last)
        state = written.drop("moved", "apart")
        rest = written.agg(F.coalesce(F.max(F.greatest("moved", "apart")), F.lit(0.0)).alias("m")).first().m
        if rest <= tolerance:
            break
    else:
        warnings.warn(f"the alternation stopped after {rounds} rounds", stacklevel=2)
    return state.groupBy("var").agg(F.max("z").alias("value"))


def _ground(coupled: DataFrame, likeness: DataFrame, w: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Ground rules of the coupled pairs: rows of (rule, var, coef, w, d, start) of the rules on several variables, and
    (var, prior) with each variable's own rules, both written."""
    shape = "array<struct<var:string,coef:double,start:double>>"
    name = lambda kind, a, b: F.concat_ws("|", F.lit(kind), F.col(a).cast("string"), F.col(b).cast("string"))

    def rows(df: DataFrame) -> DataFrame:
        return df.select("rule", "w", "d", F.explode("args").alias("a")).select("rule", "a.var", "a.coef", "w", "d", "a.start")

    parts = []
    y = coupled.withColumn("var", name("y", "r", "c"))
    own = [f"if({condition}, named_struct('w', double({weight}), 's', {'1D' if sign == 'down' else '-1D'}, 'b', double({bound})), null)" for weight, bound, sign, condition in _unary(w)]
    priors = y.select("var", F.expr(f"filter(array({', '.join(own)}), r -> r is not null)").alias("prior"))
    same = likeness.withColumn("var", name("s", "c1", "c2"))
    both = ", ".join(f"named_struct('w', {w['same']}D, 's', {s}, 'b', like)" for s in ("1D", "-1D"))
    priors = priors.unionByName(same.select("var", F.expr(f"array({both})").alias("prior")))
    a = y.select("r", F.col("c").alias("c1"), F.col("var").alias("v1"), F.col("local").alias("s1"))
    b = y.select("r", F.col("c").alias("c2"), F.col("var").alias("v2"), F.col("local").alias("s2"))
    triple = materialize(a.join(b, "r").where("c1 < c2").join(same.select("c1", "c2", F.col("var").alias("v3"), F.col("like").alias("s3")), ["c1", "c2"]), "linkage-triples")
    for kind, weight, d, c1, c2, c3 in (("x", "exclusive", -1.0, 1.0, 1.0, -1.0), ("t", "transitive", -1.0, 1.0, -1.0, 1.0), ("v", "transitive", -1.0, -1.0, 1.0, 1.0)):
        parts.append(rows(triple.select(
            F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in ("r", "c1", "c2")]).alias("rule"), F.lit(w[weight]).alias("w"), F.lit(d).alias("d"),
            F.expr(f"array(struct(v1 as var, double({c1}) as coef, s1 as start), struct(v2 as var, double({c2}) as coef, s2 as start), struct(v3 as var, double({c3}) as coef, s3 as start))").cast(shape).alias("args"),
        )))
    written = materialize(_union(parts), "linkage-terms"), materialize(priors, "linkage-priors")
    discard(triple)
    return written


def link(refs: DataFrame, recs: DataFrame, weights: dict[str, float] | None = None, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(ref_id, record_id, confidence) of every candidate pair with a confidence of at least CONFIDENT."""
    with measured_broadcasts(refs.sparkSession):
        found, ref_rows, rec_rows = _linked(refs, recs, WEIGHTS | (weights or {}), rounds)
    # read when this has returned, so the joins say themselves that nothing is broadcast
    return (
        found.join(ref_rows.select(F.col("row_id").alias("ref_id"), F.col("profile").alias("r")).hint("merge"), "r")
        .join(rec_rows.select(F.col("row_id").alias("record_id"), F.col("profile").alias("c")).hint("merge"), "c")
        .select("ref_id", "record_id", "confidence")
    )


def _linked(refs: DataFrame, recs: DataFrame, w: dict[str, float], rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(r, c, confidence) of the profiles that match, and the rows of both sides with their profiles."""
    ref_rows, ref_profiles = _profiles(references(refs), [], "linkage-refs")
    rec_rows, rec_profiles = _profiles(records(recs), ["score"], "linkage-records")
    candidates = _candidates(ref_profiles, rec_profiles)
    scored = []
    for turn in range(TURNS):
        mine = lambda df, c, turn=turn: df.where(F.col(c) % TURNS == turn)
        joined = mine(candidates, "r").join(mine(_side(ref_profiles, "a", "r"), "r"), "r").join(_side(rec_profiles, "b", "c"), "c").where(_MAY)
        compared = _compared(joined, "r", "c").join(rec_profiles.select(F.col("profile").alias("c"), "score"), "c")
        scored.append(materialize(minimise(compared, w), "linkage-scored"))
    scored = _union(scored)
    discard(candidates)
    discard(ref_profiles)
    # pairs whose own evidence is against them neither compete nor vouch for others
    alive = scored.where("kinds and local > 0.2")
    crowded = alive.groupBy("r").agg(F.count("*").alias("n")).where("n > 1").select("r")
    coupled = materialize(alive.join(crowded, "r", "left_semi"), "linkage-coupled")
    rivals = (
        coupled.select("r", F.col("c").alias("c1")).join(coupled.select("r", F.col("c").alias("c2")), "r")
        .where("c1 < c2").select("c1", "c2").distinct()
    )
    compared = _compared(rivals.join(_side(rec_profiles, "a", "c1"), "c1").join(_side(rec_profiles, "b", "c2"), "c2"), "c1", "c2")
    compared = minimise(compared.withColumn("score", F.lit(None).cast("double")), w).select("c1", "c2", F.when(F.col("kinds"), F.col("local")).otherwise(0.0).alias("like"))
    likeness = materialize(rivals.join(compared, ["c1", "c2"], "left").select("c1", "c2", F.coalesce("like", F.lit(0.0)).alias("like")), "linkage-rivals")
    discard(rec_profiles)
    terms, priors = _ground(coupled, likeness, w)
    values = alternate(terms, priors, rounds)
    for table in (coupled, likeness, terms, priors):
        discard(table)
    solved = values.where("var like 'y|%'").select(F.split("var", r"\|")[1].cast(ID).alias("r"), F.split("var", r"\|")[2].cast(ID).alias("c"), "value")
    found = scored.where("kinds").join(solved.hint("merge"), ["r", "c"], "left").select("r", "c", F.coalesce("value", "local").alias("confidence"))
    return found.where(F.col("confidence") >= CONFIDENT), ref_rows, rec_rows
