from __future__ import annotations

import itertools

import pytest

from docgrain.llm import names as n


def groups(spark, spellings):
    df = spark.createDataFrame([(s, "x") for s in spellings], "name string, core string")
    found: dict[str, set[str]] = {}
    for r in n.entities(df, "name").collect():
        found.setdefault(r.entity, set()).add(r["name"])
    return {frozenset(g) for g in found.values()}


def test_one_persons_spellings(spark):
    ada = {"Adelina Longuvel", "Longuvel, Adelina", "LONGUVEL Adelina", "A. Longuvel", "Longuvel A", "Dr. Adelina Longuvel", "adelina longuvel", "Adelina Lonugvel", "Adelnia Longuvel"}
    bo = {"Björn Longuvel", "Bjorn Longuvel", "Bjoern Longuvel", "B. X. Longuvel"}
    nick = {"Nicholas Fennerol", "Nick Fennerol", "Fennerol, N.", "Fennerol"}
    body = {"Gater Centre for Research Integrity", "The Gater Centre for Research Integrity", "Gater CRI", "Gater Ctr. Res. Integrity", "Centre for Research Integrity, Gater", "GATER CENTRE FOR RESEARCH INTEGRITY", "Gater Centre for Research"}
    assert groups(spark, ada | bo | nick | body) == {frozenset(g) for g in (ada, bo, nick, body)}


def test_ambiguous_spellings_stay_apart(spark):
    assert groups(spark, {"Edward Biatulo", "Elizabeth Biatulo", "E. Biatulo", "Biatulo"}) == {frozenset({x}) for x in ("Edward Biatulo", "Elizabeth Biatulo", "E. Biatulo", "Biatulo")}
    assert len(groups(spark, {"Ada Praubak", "Praubak, A.", "Ada Braukak", "Braukak, A."})) == 2


def test_nicknames_are_learned_without_a_table(spark, monkeypatch):
    surnames = [f"{a}{b}tsunor" for a in ("Bro", "Dra", "Fle", "Gri", "Klu", "Pru", "Sto", "Wex", "Zan", "Tam") for b in ("bel", "dak", "fim", "gor", "hup", "lav", "mik", "nez")]
    apart = [f"{g} {s}" for k, s in enumerate(surnames) for g in ("Ada Ines Olaf Rita Sven Ugo Vera Yann Zita Carl".split()[k % 10], "Dora Egon Gus Hal Kai Lea Max Noa Quin".split()[k % 9])]
    # Wilhelmina is called Mina under ten surnames, which chance does not explain
    both = [f"{g} {s}" for s in surnames[::8] for g in ("Wilhelmina", "Mina")]
    monkeypatch.setattr(n, "NICKNAMES", "")
    df = spark.createDataFrame([(x,) for x in both + apart + ["Wilhelmina Quarvel", "Ada Quarvel"]], "name string")
    found: dict = {}
    for r in n.entities(df, "name", nicknames="").collect():
        found.setdefault(r.entity, set()).add(r["name"])
    together = {frozenset(g) for g in found.values() if len(g) > 1}
    assert together == {frozenset({f"Wilhelmina {s}", f"Mina {s}"}) for s in surnames[::8]}


def test_common_suffixes_are_refined_and_lose_nothing(spark, monkeypatch):
    """Forty cores end alike; with a bound of four nodes a key every suffix of theirs is refined."""
    spellings = [f"{g} {b}rovundsel" for b in ("Ab", "Ke", "Mi", "Tu", "Zo", "Gri", "Fla", "Ne") for g in ("Adam", "Bella", "Carlo", "Dina", "Emil")]
    slips = {"Adam Abrovundsl": "Adam Abrovundsel", "Bella Kerovnudsel": "Bella Kerovundsel", "Carlo Mirovundsek": "Carlo Mirovundsel", "D. Turovunsel": "Dina Turovundsel", "Emli Zorovundsel": "Emil Zorovundsel"}
    want = {frozenset({*([k for k, v in slips.items() if v == s]), s}) for s in spellings}
    assert groups(spark, [*spellings, *slips]) == want
    monkeypatch.setattr(n, "COMMON", 4)
    assert groups(spark, [*spellings, *slips]) == want


def test_ratio_decides(spark, monkeypatch):
    pair = {"Ada Longuvel", "Ada Longuvek", "A. Longuvel"}
    assert groups(spark, pair) == {frozenset(pair)}
    monkeypatch.setattr(n, "RATIO", 0.95)
    assert len(groups(spark, pair)) == 2


def test_nothing_and_repeats(spark):
    assert groups(spark, [None, "", "  ", "...", "Ada Long", "Ada Long"]) == {frozenset({"Ada Long"})}
    df = spark.createDataFrame([], "name string")
    assert n.variant_pairs(n.entities(df, "name")).count() == 0


def test_pairs_are_all_within_an_entity_and_ordered(spark):
    spellings = ["Ada Longuvel", "Longuvel, Ada", "A. Longuvel"]
    df = spark.createDataFrame([(s,) for s in spellings], "name string")
    want = sorted(itertools.combinations(sorted(spellings), 2))
    assert sorted(map(tuple, n.variant_pairs(n.entities(df, "name")).collect())) == want


@pytest.mark.parametrize(
    "spelling, want",
    [
        ("de Lagi, Ada B.", ("p", "delagi", "ada", "b")), ("Ada de Lagi", ("p", "delagi", "ada", "")), ("DE LAGI Ada", ("p", "delagi", "ada", "")), ("Lagi AB", ("p", "lagi", "a.", "b")),
        ("J.-M. Lagi", ("p", "lagi", "j.", "m")), ("Lagi", ("p", "lagi", "", "")), ("Lagi Soc. Open Evid.", ("o", "lagi", "soe", "")), ("Society for Open Evidence Lagi", ("o", "lagi", "soe", "")),
    ],
)
def test_parse(spelling, want):
    assert n.parse(spelling) == want


def test_distances_against_brute_force():
    def slow(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = table[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(table[i - 1][j], table[i][j - 1])
        return 2 * table[-1][-1] / max(1, len(a) + len(b))

    samples = ["".join(p) for size in range(5) for p in itertools.product("ab", repeat=size)]
    assert all(abs(n.lcs_ratio(a, b) - slow(a, b)) < 1e-12 for a in samples for b in samples)
    assert n.one_slip("abcd", "abdc") and n.one_slip("abc", "abxc") and n.one_slip("abc", "ac") and n.one_slip("abc", "axc") and not n.one_slip("abcd", "badc")


def test_common_suffixes_lose_no_pair_that_passes(spark, monkeypatch):
    """With a bound of three nodes a key, cores that differ in the first letter, given names that differ in it, initials of
    common surnames and bare surnames meet as they do without a bound."""
    spellings = [f"{g} {c}" for c in ("Brovundsel", "Kerovundsel", "Mirovundsel", "Vundsel") for g in ("Adelina", "Bartolo", "Carlotta", "Dinara", "Emilio")]
    more = ["Adelina Drovundsel", "Bartolo Cirovundsel", "Edelina Brovundsel", "Y. Vundsel", "Vundsel Y", "C. Vundsel", "Adelina Lonrik", "Lonrik", "Gater Centre for Research Integrity", "Gater CRI", "Gater Centre for Research"]
    want = groups(spark, spellings + more)
    assert frozenset({"Y. Vundsel", "Vundsel Y"}) in want and frozenset({"Adelina Drovundsel", "Adelina Brovundsel", "Edelina Brovundsel"}) in want
    monkeypatch.setattr(n, "COMMON", 3)
    assert groups(spark, spellings + more) == want
    monkeypatch.setattr(n, "COMMON", 0)
    assert groups(spark, spellings + more) == want


def test_finer_keys_against_every_pair():
    words = ["".join(w) for size in range(1, 7) for w in itertools.product("abq", repeat=size)][::3]
    for ratio in (0.8, 0.95):
        ones = {w: set(n._alike(w, ratio, True)) for w in words}
        others = {w: set(n._alike(w, ratio, False)) for w in words}
        assert all(ones[a] & others[b] for a in words for b in words if abs(len(a) - len(b)) < 3 and n.lcs_ratio(a, b) >= ratio)


def test_surnames_of_many_given_names_teach_nicknames_too(spark, monkeypatch):
    """Every surname is over the bound; what is under them as often as their sizes explain is not learned."""
    monkeypatch.setattr(n, "MOST_GIVEN", 1)
    letters = "bdfgklmnprstvwz"
    surnames = [f"{a}o{b}utsunor" for a in letters for b in letters[::2]]
    given = [f"{a}i{b}anot" for a in letters for b in letters]
    rows = [f"{given[(7 * k + j * j) % len(given)]} {s}" for k, s in enumerate(surnames) for j in range(4)]
    both = [f"{g} {s}" for s in surnames[::6] for g in ("Wilhelmina", "Mina")]
    crowd = [f"{g} {s}" for s in ("Ulbrakat", "Ovrestik", "Epsolum") for g in given]
    df = spark.createDataFrame([(x,) for x in rows + both + crowd], "name string")
    parsed = n._parsed(df.distinct()).select("name", "kind", "core", "other", "middle")
    learned = {r.other: r.roots for r in n._roots(parsed, "", lambda t, _: t).collect()}
    assert learned == {"mina": ["wilhelmina"]} or learned == {"wilhelmina": ["mina"]}
