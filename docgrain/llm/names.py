"""Variant spellings of names typed by people.

Every distinct spelling is parsed into a core token (a person's surname with its particles, an organisation's own
name) and its other fields (given name or initials; the initials of an organisation's kind). Spellings with the same core
and other field are one node. Nodes are indexed by the suffixes of their core of at least MIN_SUFFIX letters; the whole
core is the longest. Nodes whose suffix more than COMMON share meet instead by finer keys that lose no pair with the ratios
asked for: the rarest letters of the core, of which two cores that alike have one in common, with the same of the other field. Slips in the last letters are met by the beginning before them with the other field. Nodes that share a key and whose other fields can be one entity's are compared by longest-common-
subsequence ratio, of the cores and of the given names; only pairs that pass become links, and all that follows reads links.

A mistyped core is a core with a single spelling; it is the one other core it is linked to with the greatest ratio; a given name is another's
nickname by the table, or by what the data teach: two given names that occur under the same surnames far more often than
by chance. Initials denote the only given name with that initial under the surname; a surname alone denotes its only
bearer. Ambiguous spellings stay apart, as a spelling never denotes two entities.

Defined results: null and blank spellings denote nobody; equal spellings are one; spellings without letters are left
out; an empty table gives no pairs; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.llm.lookalike import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS
from docgrain.session import discard, materialize

MIN_SUFFIX, COMMON = 3, 400
#: Least longest-common-subsequence ratio of two cores, and of two given names.
RATIO, GIVEN_RATIO = 0.8, 0.75
#: Given names are learned to be one person's if they occur together under at least so many surnames with at least this log
#: likelihood ratio against chance. Surnames with more given names than the last number are layered by their size.
TOGETHER, LIKELY, MOST_GIVEN = 3, 8.0, 64

# Common nicknames of several languages; the first of each line is the full name. A caller may give others.
NICKNAMES = """
abigail abby gail|albert al bert|alexander alex sasha|alexandra alex sasha|andrew andy drew|anthony tony|barbara barb|benjamin ben
catherine cathy kate|katherine kathy kate katie|charles charlie chuck|christopher chris|daniel dan danny|david dave|deborah debbie|donald don
edward ed eddie ted ned|elizabeth liz beth betty|ekaterina katya|eugene gene|francisco paco pancho|frederick fred|gerald gerry|giovanni gianni
gregory greg|henry hank harry|ignacio nacho|ivan vanya|james jim jimmy|jennifer jen jenny|john jack|jonathan jon|jose pepe|joseph joe
kenneth ken|lawrence larry|leonard leo len|louis lou|manuel manolo|margaret maggie meg peggy|maria mascha|matthew matt|michael mike mick
mikhail misha|mohammed mohamed muhammad mohammad|nicholas nick|nikolai kolya|patricia pat patty|peter pete|philip phil|rebecca becky|richard rick dick
robert bob rob bobby|ronald ron|samuel sam|sebastian basti|stephen steve|steven steve|susan sue|theodore ted theo|thomas tom tommy|timothy tim
victoria vicky|vladimir vova|walter walt|wilhelm willi|william bill will billy|yekaterina katya
"""
_TITLE = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|sir|ph\.?d)\.?\s+)+", re.I)
_PARTICLES = frozenset("van von der den de del della di da la le du dos bin ibn al el ter zu".split())
_KIND = re.compile(r"^(?:institute|inst|foundation|found|laboratory|lab|society|soc|committee|comm|centre|center|ctr|department|dept|university|univ|association|assoc|council|agency|group|consortium)$")
_SMALL = frozenset("for of on and the in de des fur und et y".split())
_ALIKE = str.maketrans(dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)))
_PLAIN = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "", "'": "", "-": ""})
_INITIALS = re.compile(r"^[^\W\d_](?:\.?-?[^\W\d_]?\.)?$|^[^\W\d_]\.(?:-?[^\W\d_]\.)*$|^[^\W\d_a-z](?:-[^\W\d_a-z])+$")


def fold(text: str) -> str:
    """Small letters without accents and signs; accents written as a second vowel are dropped too."""
    text = text.translate(_ALIKE).lower().translate(_PLAIN)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if c.isalpha())
    return re.sub(r"([aou])e|aa", lambda m: m.group(1) or "a", text)


def listed_roots(nicknames: str) -> list[tuple[str, str]]:
    """(name, full name) of the table, also of each full name itself."""
    lines = [[fold(n) for n in line.split()] for line in nicknames.replace("\n", "|").split("|") if line.strip()]
    return sorted({(n, names[0]) for names in lines for n in names})


_GIVEN = frozenset(n for n, _ in listed_roots(NICKNAMES))


def parse(name: str) -> tuple[str, str, str, str] | None:
    """(kind p or o, core, other field, middle initials): the other field is a person's folded given name, "x." for an
    initial or "", or an organisation's initials."""
    text = re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) != "Cf")).strip()
    text = _TITLE.sub("", text)
    words = [w for w in re.split(r"[\s,]+", text.replace("&", " and ")) if w]
    bare = [re.sub(r"\W", "", w).lower() for w in words]
    if not any(any(c.isalpha() for c in w) for w in words):
        return None
    kind = [k for k, w in enumerate(bare) if _KIND.match(w)]
    if kind and (len(words) > 2 or "." in words[kind[0]]) and not (len(kind) == 1 and kind[0] == len(words) - 1 and "," in text):
        start = 1 if bare[0] == "the" else 0
        if kind[0] > start:
            own, rest = bare[start : kind[0]], bare[kind[0] :]
        else:
            own, rest = bare[-1:], bare[kind[0] : -1]
        return "o", fold("".join(own)), "".join(fold(w)[:1] for w in rest if w not in _SMALL and w), ""
    last = words[-1]
    if len(words) == 2 + (bare[0] == "the") and "," not in text and re.fullmatch(r"[^\W\d_a-z]{3,5}", last) and last.isupper() and not words[-2].isupper() and fold(words[-2]) not in _GIVEN:
        return "o", fold(words[-2]), fold(last), ""
    head, comma, tail = text.partition(",")
    if comma and tail.strip():
        sur, given = head.split(), tail.split()
        while given and given[-1].lower() in _PARTICLES:
            sur.insert(0, given.pop())
    else:
        tokens = text.replace(",", " ").split()
        caps = [len(re.sub(r"\W", "", w)) > 2 and w.isupper() for w in tokens]
        if any(caps) and not all(caps):
            first = caps.index(True)
            while first > 0 and tokens[first - 1].lower() in _PARTICLES:
                first -= 1
            end = len(caps) - caps[::-1].index(True)
            sur, given = tokens[first:end], tokens[:first] + tokens[end:]
        elif len(tokens) > 1 and re.fullmatch(r"[^\W\d_a-z]{1,3}|[^\W\d_a-z](?:-[^\W\d_a-z])+", tokens[-1]) and tokens[-1].isupper():
            sur, given = tokens[:-1], [f"{c}." for c in tokens[-1] if c != "-"]
        else:
            at = len(tokens) - 1
            while at > 1 and tokens[at - 1].lower() in _PARTICLES:
                at -= 1
            if at == 1 and tokens[0].lower() in _PARTICLES:
                at = 0
            sur, given = tokens[at:], tokens[:at]
    core = fold("".join(sur))
    if not core:
        return None
    if not given:
        return "p", core, "", ""
    if _INITIALS.match(given[0]) or re.fullmatch(r"[^\W\d_a-z]{2}", given[0]) and len(given) == 1 and given[0].isupper():
        letters = [fold(c) for g in given for c in re.findall(r"[^\W\d_]", g)]
        return "p", core, letters[0][:1] + ".", "".join(letters[1:])
    return "p", core, fold(given[0]), "".join(fold(g)[:1] for g in given[1:])


def one_slip(a: str, b: str) -> bool:
    """Whether one letter put in, left out or replaced, or two neighbours exchanged, turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the lengths' sum, by bit rows."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    for c in b:
        m = row & at.get(c, 0)
        row = (row + m | row - m) & (1 << len(a)) - 1
    return 2 * (len(a) - row.bit_count()) / max(1, len(a) + len(b))


def double(name: str, core: str) -> tuple[str | None, list[str]]:
    """For a person's spelling the core if its last two words are one double surname, and the halves of a double surname."""
    words = name.replace(",", " ").split()
    joined = fold("".join(words[-2:])) if len(words) == 3 and "," not in name and all(len(w) > 3 and w[-1] != "." for w in words) else None
    halves = [fold(h) for w in words for h in w.split("-") if "-" in w and fold(w) == core]
    return joined, [h for h in halves if len(h) > 3]


def _parsed(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, *p, *(double(n, p[1]) if p[0] == "p" else (None, []))) for n in batch["name"] if n and (p := parse(n))]
            yield pd.DataFrame(rows, columns=["name", "kind", "core", "other", "middle", "joined", "halves"])

    return names.mapInPandas(run, "name string, kind string, core string, other string, middle string, joined string, halves array<string>")


def _undoubled(parsed: DataFrame) -> DataFrame:
    """Double surnames written with a blank, or by one half only, get the core of the whole where just one fits."""
    whole = parsed.where("size(halves) > 0").select("core", "halves").distinct()
    joined = whole.select(F.col("core").alias("joined")).distinct().withColumn("found", F.lit(True))
    parsed = parsed.join(joined, "joined", "left").withColumn("core", F.when(F.col("found"), F.col("joined")).otherwise(F.col("core"))).drop("found")
    support = parsed.groupBy("kind", "core").agg(F.count("*").alias("spellings")).where("kind = 'p' and spellings = 1").select("core")
    half = whole.select(F.explode("halves").alias("core"), F.col("core").alias("to"))
    half = half.groupBy("core").agg(F.min("to").alias("to"), F.max("to").alias("last")).where("to = last").drop("last").join(support, "core")
    full = parsed.where("size(halves) > 0").groupBy(F.col("core").alias("to")).agg(F.collect_set(F.substring("other", 1, 1)).alias("initials"))  # at most one a letter
    half = half.join(full, "to")
    parsed = parsed.join(half, "core", "left")
    fits = F.col("to").isNotNull() & (F.col("kind") == "p") & F.array_contains("initials", F.substring("other", 1, 1))
    return parsed.withColumn("core", F.when(fits, F.col("to")).otherwise(F.col("core"))).select("name", "kind", "core", "other", "middle")


#: Writes a table that the later steps read.
Put = Callable[[DataFrame, str], DataFrame]
FULL = "other != '' and other not like '%.'"


def _roots(parsed: DataFrame, nicknames: str, put: Put) -> DataFrame:
    """(other, roots): the full names a given name may stand for, by the table and as learned; others have no row."""
    spark = parsed.sparkSession
    listed = spark.createDataFrame(listed_roots(nicknames) or [("", "")], "other string, root string")
    given = parsed.where("kind = 'p'").where(FULL).select("core", "other").distinct()
    usual = given.groupBy("other").agg(F.count("*").cast("double").alias("surnames"))
    # by chance two names are under a surname as often as under any other; of the surnames with very many given names those
    # of like size are one layer, and have two of them as often as their pairs say
    size = given.groupBy("core").agg(F.count("*").cast("double").alias("k")).withColumn("layer", F.when(F.col("k") > MOST_GIVEN, F.floor(F.log2("k"))).otherwise(-1))
    share = F.when(F.col("layer") < 0, 1 / F.count("*")).otherwise(F.sum(F.col("k") * (F.col("k") - 1)) / F.sum("k") / F.sum("k"))
    shares = size.groupBy("layer").agg(share.alias("share"))  # few
    within = given.join(size, "core").groupBy("other", "layer").agg(F.count("*").cast("double").alias("n"))
    counted = given.join(usual.where(F.col("surnames") >= TOGETHER).select("other"), "other")  # no other can be under so many
    a, b = counted.select("core", F.col("other").alias("x")), counted.select("core", F.col("other").alias("y"))
    pairs = a.join(b, "core").where("x < y").groupBy("x", "y").agg(F.count("*").cast("double").alias("n")).where(F.col("n") >= TOGETHER)
    of = lambda c, k: usual.select(F.col("other").alias(c), F.col("surnames").alias(k))
    inside = lambda c: within.select(F.col("other").alias(c), "layer", F.col("n").alias(f"in_{c}"))
    both = pairs.join(inside("x"), "x").join(inside("y"), ["y", "layer"]).join(F.broadcast(shares), "layer")
    chances = both.groupBy("x", "y").agg(F.sum(F.col("in_x") * F.col("in_y") * F.col("share")).alias("chance"))
    pairs = pairs.join(chances, ["x", "y"]).join(of("x", "nx"), "x").join(of("y", "ny"), "y")
    chance = F.col("chance")
    likely = F.col("n") * F.log(F.col("n") / chance) - F.col("n") + chance
    pairs = put(pairs.where((F.col("n") > chance) & (likely >= LIKELY)).select("x", "y", "nx", "ny"), "names-learned")
    pairs = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("ny").alias("nx"), F.col("nx").alias("ny")))
    # a name's roots are its more usual partners, without those that are a more usual partner's variants themselves
    up = pairs.where("ny > nx or ny = nx and y < x").select("x", "y")
    below = up.select("x", F.col("y").alias("z")).join(up.select(F.col("x").alias("z"), "y"), "z").select("x", F.col("z").alias("y"))
    learned = up.join(below, ["x", "y"], "left_anti").select(F.col("x").alias("other"), F.col("y").alias("root"))
    known = listed.groupBy("other").agg(F.min("root").alias("full"), F.count("*").alias("n")).where("n = 1").select(F.col("other").alias("root"), "full")
    learned = learned.join(F.broadcast(known), "root", "left").select("other", F.coalesce("full", "root").alias("root"))  # the table
    both = learned.unionByName(listed).where("other != ''")
    return both.groupBy("other").agg(F.array_sort(F.collect_set("root")).alias("roots"))  # roots of one name are few


_USUAL = {c: k for k, c in enumerate("qxjzvwyfbkpgcmdhultsroniea")}


def _rarest(text: str) -> list[str]:
    """The letters of ``text``, each with its number among equal ones, the rarest letters first (a fixed order)."""
    seen: dict[str, int] = {}
    out = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        out.append((_USUAL.get(c, -1), c, seen[c]))
    return [f"{c}{k}" for _, c, k in sorted(out)]


def _alike(text: str, ratio: float, first: bool, ending: int = 0) -> list[str]:
    """Keys of which two texts of at least that longest-common-subsequence ratio share one, ``first`` and not ``first``. For
    texts of n and m letters the subsequence has at least c = ratio * (n + m) / 2, so the n - c + 1 rarest letters of the one
    and the m - c + 1 of the other have one in common. The last ``ending`` letters are known to be equal."""
    n = len(text)
    letters = _rarest(text[: n - ending])
    out = []
    for m in range(max(1, ending, math.ceil(n * ratio / (2 - ratio) - 1e-9)), math.floor(n * (2 - ratio) / ratio + 1e-9) + 1):
        common = math.ceil(ratio * (n + m) / 2 - 1e-9)
        if common > min(n, m):
            continue
        sizes = f"{n},{m}" if first else f"{m},{n}"
        out += [f"{sizes},{x}" for x in letters[: n - common + 1]] if common > ending else [sizes]
    return out


def _fields(kind: str, other: str, roots: list[str], initials: list[str], first: bool, within: bool) -> list[str]:
    """Keys of the other field: of two that can be one entity's the one's ``first`` and the other's not ``first`` share one.
    ``within``: both have the same core."""
    if kind == "o":
        if first:
            return [f"o{other[0]}", "o-"] if other else ["o*"]
        return [f"o{other[0]}", "o*"] if other else ["o-", "o*"]
    if other == "":
        return [] if not within else ["e*"] if first else ["e-", "e*"]
    whole = ["e-"] if first else ["e*"]
    if other.endswith("."):
        short = [f"i{c}" for c in initials] if first else [x for c in initials for x in (f"i{c}", f"j{c}")]
        return short + whole if within else short
    near = _alike(other, GIVEN_RATIO, first) if within else _rarest(other)[: len(other) - math.ceil(len(other) * GIVEN_RATIO / (2 - GIVEN_RATIO) - 1e-9) + 1]
    out = [f"{'j' if first else 'i'}{c}" for c in initials] + [f"r{r}" for r in roots] + [f"g{x}" for x in near if len(other) > 3]
    return out + whole if within else out


def _finer(nodes: DataFrame) -> DataFrame:
    """(node, first, key) of nodes (with within: whether their whole core is common). Cores that differ are compared only where
    one has a single spelling, as no others can be a slip; that one comes first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for node, kind, core, other, spellings, roots, initials, within in batch.itertuples(index=False):
                ending = min(MIN_SUFFIX, len(core))
                for first in (True, False):
                    keys = [f"{kind}={core}|{f}" for f in _fields(kind, other, roots, initials, first, True)] if within else []
                    if not first or spellings == 1:
                        cores, fields = _alike(core, RATIO, first, ending), _fields(kind, other, roots, initials, first, False)
                        keys += [f"{kind}~{core[-ending:]}|{c}|{f}" for c, f in itertools.product(cores, fields)]
                    rows.append((node, first, keys))
            yield pd.DataFrame(rows, columns=["node", "first", "keys"])

    found = nodes.select("node", "kind", "core", "other", "spellings", "roots", "initials", "within").mapInPandas(run, "node long, first boolean, keys array<string>")
    return found.select("node", "first", F.explode(F.transform("keys", lambda k: F.xxhash64(k))).alias("key"))


def _keys(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` once for every key that few share, and those whose suffixes are common, with within."""
    size = F.length("core")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(size - MIN_SUFFIX + 1, F.lit(1))), lambda k: F.substr("core", k))
    suffix = nodes.withColumn("suffix", F.explode(cut))
    suffix = suffix.join(suffix.groupBy("kind", "suffix").agg(F.count("*").alias("n")), ["kind", "suffix"])
    plain = suffix.where(F.col("n") <= COMMON).withColumn("key", F.col("suffix"))
    common = suffix.where(F.col("n") > COMMON).groupBy("node").agg(F.max(F.col("suffix") == F.col("core")).alias("within"))
    # a slip in the last letters leaves no common suffix, but the beginning before them, here with the other field
    field = F.explode(F.when(F.size("initials") > 0, F.col("initials")).otherwise(F.array(F.lit(""))))
    cut = F.filter(F.array(size - 4, size - 3), lambda n: n > 1)
    begun = nodes.withColumn("field", field).withColumn("n", F.explode(cut)).withColumn("key", F.concat_ws("^", F.left("core", F.col("n")), "field"))
    keep = [*nodes.columns, "key"]
    return plain.select(keep).unionByName(begun.select(keep)), nodes.join(common, "node")


def _links(nodes: DataFrame, put: Put) -> DataFrame:
    """(kind, core_a, other_a, core_b, other_b, spellings_b, slip, ratio, given), both ways round: nodes that share a suffix
    key, with a longest-common-subsequence ratio of at least RATIO; ``slip``: only the likeness of the given names joins them."""
    keyed, crowded = _keys(nodes)
    keyed, finer = put(keyed, "names-keys"), put(_finer(crowded), "names-finer")
    columns = ("core", "other", "spellings", "roots", "initials")
    side = lambda s: keyed.select("kind", "key", *[F.col(c).alias(f"{c}_{s}") for c in columns])
    met = finer.where("first").select(F.col("node").alias("x"), "key").join(finer.where("not first").select(F.col("node").alias("y"), "key"), "key")
    met = put(met.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "names-met")
    met = met.unionByName(met.select(F.col("y").alias("x"), F.col("x").alias("y")))
    node = lambda s, c, *own: nodes.select(F.col("node").alias(c), *own, *[F.col(k).alias(f"{k}_{s}") for k in columns])
    met = met.join(node("a", "x", "kind"), "x").join(node("b", "y"), "y").drop("x", "y")
    a, b = F.col("other_a"), F.col("other_b")
    short = a.like("%.") | b.like("%.")
    same = (a == b) | F.arrays_overlap("roots_a", "roots_b")
    near = ~short & (F.least(F.length(a), F.length(b)) > 3) & (2.0 * F.least(F.length(a), F.length(b)) >= GIVEN_RATIO * (F.length(a) + F.length(b)))
    empty = ((a == "") | (b == "")) & (F.col("core_a") == F.col("core_b"))
    person = empty | (a != "") & (b != "") & F.when(short, F.arrays_overlap("initials_a", "initials_b")).otherwise(same | near)
    body = F.startswith(a, b) | F.startswith(b, a)
    shorter, both = F.least(F.length("core_a"), F.length("core_b")), F.length("core_a") + F.length("core_b")
    pairs = (
        side("a").join(side("b"), ["kind", "key"]).drop("key").unionByName(met).where("core_a != core_b or other_a != other_b")
        .where(2.0 * shorter >= RATIO * both).where(F.when(F.col("kind") == "o", body).otherwise(person))
        .select("kind", "core_a", "other_a", "core_b", "other_b", "spellings_b", ((F.col("kind") == "p") & ~empty & ~short & ~same).alias("slip")).distinct()
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["ratio"] = [1.0 if x == y else lcs_ratio(x, y) for x, y in zip(batch["core_a"], batch["core_b"], strict=True)]
            batch["given"] = [lcs_ratio(x, y) if slip else 1.0 for x, y, slip in zip(batch["other_a"], batch["other_b"], batch["slip"], strict=True)]
            yield batch[(batch["ratio"] >= RATIO) & (batch["given"] >= GIVEN_RATIO)]

    return pairs.mapInPandas(judge, "kind string, core_a string, other_a string, core_b string, other_b string, spellings_b long, slip boolean, ratio double, given double")


def _only(df: DataFrame, by: list[str], value: str, out: str, ratio: str | None = None) -> DataFrame:
    """``value`` of the groups that have just one, or just one of the greatest ``ratio``."""
    one = df.withColumn("__ratio", F.col(ratio) if ratio else F.lit(1.0)).groupBy(*by, "__ratio").agg(F.min(value).alias("__first"), F.max(value).alias("__last"))
    best = one.groupBy(*by).agg(F.max(F.struct("__ratio", "__first", "__last")).alias("__b"))
    return best.where("__b.__first = __b.__last").select(*by, F.col("__b.__first").alias(out))


def _given_names(full: DataFrame, links: DataFrame) -> DataFrame:
    """(core, other, root) for the full given names (core, other, spellings, roots, usual) under each surname."""
    n = F.size("roots")
    sure = full.where(n <= 1).select("core", "other", F.coalesce(F.try_element_at("roots", F.lit(1)), "other").alias("root"), (n == 1).alias("known"), "usual")
    near = links.join(sure.select("core", F.col("other").alias("other_b"), F.col("root").alias("sure_root"), F.col("known").alias("sure_known"), F.col("usual").alias("sure_usual")), ["core", "other_b"])
    # a nickname of several names is the one that occurs under the surname
    several = full.where(n > 1).select("core", F.col("other").alias("other_a"), "roots").join(near, ["core", "other_a"]).where("array_contains(roots, sure_root)")
    # an unknown given name with one spelling is a slip of the only known, or more usual, one near to it
    odd = full.where((n == 0) & (F.col("spellings") == 1)).select("core", F.col("other").alias("other_a"), "usual").join(near.where("slip"), ["core", "other_a"])
    odd = odd.where("sure_known or sure_usual > usual or sure_usual = usual and other_b < other_a")
    found = _only(several.select("core", "other_a", "sure_root", "given").unionByName(odd.select("core", "other_a", "sure_root", "given")), ["core", "other_a"], "sure_root", "found", "given")
    own = full.join(sure.select("core", "other", "root"), ["core", "other"], "left").join(found.withColumnRenamed("other_a", "other"), ["core", "other"], "left")
    return own.select("core", "other", F.coalesce("found", "root", "other").alias("root"))


def entities(names: DataFrame, column: str, nicknames: str = NICKNAMES) -> DataFrame:
    """(name, entity) of every distinct spelling; the entity is a key, equal for spellings of one person or organisation."""
    written: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        written.append(materialize(df, name))
        return written[-1]

    distinct = names.select(F.col(column).cast("string").alias("name")).where("name is not null").distinct()
    parsed = put(_parsed(distinct), "names-parsed")
    parsed = put(_undoubled(parsed), "names-whole")
    roots = put(_roots(parsed, nicknames, put), "names-roots")
    first = lambda c: F.substring(c, 1, 1)
    nodes = parsed.select("kind", "core", "other").distinct().join(parsed.groupBy("kind", "core").agg(F.count("*").alias("spellings")), ["kind", "core"])
    nodes = nodes.join(roots, "other", "left").withColumn("roots", F.when(F.col("kind") == "p", F.coalesce("roots", F.array("other"))).otherwise(F.array().cast("array<string>")))
    nodes = nodes.withColumn("initials", F.array_distinct(F.filter(F.concat(F.array(first("other")), F.transform("roots", first)), lambda c: c != "")))
    nodes = put(nodes.withColumn("node", F.monotonically_increasing_id()), "names-nodes")
    links = put(_links(nodes, put), "names-links")
    # a core with one spelling is a slip of the core it is linked to best, if that is one; of two such the first stays
    single = parsed.groupBy("kind", "core").agg(F.count("*").alias("spellings")).where("spellings = 1").select("kind", F.col("core").alias("core_a"))
    slips = links.where("core_a != core_b and other_a != ''").join(single, ["kind", "core_a"])
    slips = slips.where("spellings_b > 1 or core_b < core_a and other_a = other_b and other_a not like '%.'")
    fixed = put(_only(slips, ["kind", "core_a"], "core_b", "to", "ratio").withColumnRenamed("core_a", "core"), "names-fixed")
    whole = lambda df, c: df.join(fixed.withColumnRenamed("core", c), ["kind", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")
    parsed = put(whole(parsed, "core"), "names-cores")
    links = whole(whole(links, "core_a"), "core_b").where("core_a = core_b and other_a != other_b")
    links = put(links.groupBy("kind", F.col("core_a").alias("core"), "other_a", "other_b").agg(F.min("slip").alias("slip"), F.max("given").alias("given")), "names-within")
    persons, organisations = parsed.where("kind = 'p'"), parsed.where("kind = 'o'")
    full = persons.where(FULL).groupBy("core", "other").agg(F.count("*").alias("spellings"))
    full = full.join(full.groupBy("other").agg(F.count("*").alias("usual")), "other").join(roots, "other", "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))
    own = links.where("kind = 'p'").drop("kind")
    given = put(_given_names(full, own), "names-given")
    people = persons.where(FULL).join(given, ["core", "other"]).select("name", "core", "root")
    # initials: the only given name they are linked to; without any they stand together, with several alone
    bearers = given.select("core", F.col("other").alias("other_b"), "root")
    initials = own.where("other_a like '%.'").join(bearers, ["core", "other_b"]).groupBy("core", F.col("other_a").alias("other")).agg(F.min("root").alias("root"), F.max("root").alias("last"))
    short = persons.where("other like '%.'").join(initials, ["core", "other"], "left")
    alone = F.concat(F.lit("?"), F.col("name"))
    short = short.select("name", "core", F.when(F.col("root") == F.col("last"), F.col("root")).when(F.col("root").isNotNull(), alone).otherwise(F.col("other")).alias("root"))
    # a surname alone: the only bearer it is linked to
    shown = bearers.unionByName(short.where("root like '%.' and root not like '?%'").select("core", F.col("root").alias("other_b"), "root").distinct())
    only = own.where("other_a = ''").join(shown, ["core", "other_b"])
    bare = persons.where("other = ''").join(_only(only, ["core"], "root", "root"), "core", "left").select("name", "core", F.coalesce("root", F.lit("")).alias("root"))
    people = people.unionByName(short).unionByName(bare).select("name", F.concat_ws("/", F.lit("p"), "core", "root").alias("entity"))
    # an organisation's cut or abbreviated kind is the only whole kind it begins
    begun = links.where("kind = 'o' and other_a != other_b and startswith(other_b, other_a)").select("core", F.col("other_a").alias("other"), F.col("other_b").alias("whole"))
    wholes = begun.join(begun.select("core", F.col("other").alias("whole")).distinct(), ["core", "whole"], "left_anti")
    settled = wholes.groupBy("core", "other").agg(F.min("whole").alias("root"), F.max("whole").alias("last"))
    settled = settled.select("core", "other", F.when(F.col("root") == F.col("last"), F.col("root")).otherwise(F.concat(F.lit("?"), "other")).alias("root"))
    bodies = organisations.join(settled, ["core", "other"], "left").select("name", F.concat_ws("/", F.lit("o"), "core", F.coalesce("root", "other")).alias("entity"))
    found = materialize(people.unionByName(bodies), "names-entities")
    for table in written:  # all that was needed is in the result
        discard(table)
    return found


def variant_pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b) for different spellings of one entity, name_a before name_b by code point."""
    a = found.select("entity", F.col("name").alias("name_a"))
    b = found.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
