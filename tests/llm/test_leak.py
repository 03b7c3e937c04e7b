from __future__ import annotations

import itertools
import random

from docgrain.llm import leak
from docgrain.llm.tokens import words

CLAIM = "Sentence splitters derived from Rianeta lag behind paired Kataumil abstracts on tablets sold before 2006"


def found(text, item=CLAIM):
    return bool(leak.Block([(1, item)]).matches([text]))


def test_masks_lose_nothing_at_one_in_five():
    for n in range(7, 17):
        for k in range(n // 5 + 1):
            for changed in itertools.combinations(range(n), k):
                ok = [i not in changed for i in range(n)]
                assert any(all(ok[p + o] for o in mask) for mask in leak.MASKS for p in range(n - mask[-1])), (n, changed)


def test_altered_texts_are_found():
    w = CLAIM.split()
    assert found(f"Before. {CLAIM}, and after.")
    assert found("x " + CLAIM.upper().replace(" ", "\n"))
    assert found("see " + " ".join(w[3:11]))
    assert found(CLAIM.replace("derived", "made").replace("tablets", "phones"))
    assert found(CLAIM.replace("Rianeta", "Riа​neta").replace("lag", "ｌａｇ"))
    assert found("Sentence splitters [5, 27] derived from Rianeta <br/> lag behind paired Kataumil abstracts")
    assert found("Sentence splitters derived from Ria-\nneta lag behind paired Kataumil abs-\ntracts")


def test_marks_of_any_length_do_not_part_a_text():
    w = CLAIM.split()
    mark = "[" + ", ".join(map(str, range(1, 60))) + " and 61]"
    assert found(" ".join([*w[:4], mark, *w[4:9]]))
    assert not leak.Block([(1, CLAIM)]).matches(["[1, 2", "3] " + " ".join(w[:5])])


def test_other_texts_are_not():
    w = CLAIM.split()
    rnd = random.Random(1)
    assert not found(" ".join(rnd.sample(w, len(w))))
    assert not found("Our group looked at Rianeta and Kataumil but used neither of them.")
    assert not found(" ".join(w[:5]) + " are common")
    assert not found("") and not found("unrelated " * 5000)


def test_part_just_under_half_is_not_stretched_by_other_words():
    item = [f"w{k}" for k in range(25)]
    whole = " ".join(item)
    for a in (0, 6, 14):
        for before, after in (("", "x y z"), ("x y z", ""), ("x", "y"), ("x y", "z u")):
            assert not found(f"{before} {' '.join(item[a : a + 11])} {after} end", whole)
            assert not found(f"{before} {' '.join(item[a : a + 12])} {after} end", whole)
        part = item[min(a, 12) : min(a, 12) + 13]
        assert found(f"x {' '.join(part)} y", whole) and found(f"x {' '.join([*part[:5], 'q', *part[6:]])} y", whole)
        assert not found(f"x q {' '.join(part[1:])} y", whole)


def test_short_items():
    assert found("say good morning now", "good morning") and not found("good evening", "good morning")
    assert found("a b", "b") and not leak.Block([(1, "")]).matches(["x"])


def test_against_brute_force():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(13, 20)))) for k in range(6)]
    texts = []
    for _ in range(150):
        _, item = rnd.choice(items)
        w = item.split()
        a = rnd.randrange(len(w) // 2)
        part = [rnd.choice(vocabulary) if rnd.random() < 0.2 else x for x in w[a : a + rnd.randint(5, len(w))]]
        texts.append(" ".join(rnd.choice(vocabulary) for _ in range(4)) + " " + " ".join(part) + " end")

    def brute(text, item):
        t, w = text.split(), item.split()
        need = -(-len(w) // 2)
        for d in range(-len(w), len(t)):
            for i in range(len(w)):
                for j in range(i + need, len(w) + 1):
                    if d + i >= 0 and d + j <= len(t) and t[d + i] == w[i] and t[d + j - 1] == w[j - 1] and sum(t[d + x] != w[x] for x in range(i, j)) * 5 <= j - i:
                        return True
        return False

    want = {(r, k) for r, t in enumerate(texts) for k, i in items if brute(t, i)}
    assert leak.Block(items).matches(texts) == want and len(want) > 25


def test_words_are_equal_wherever_they_stand():
    w = words(["Éa ﬁne Day", "x ea fine day", "", "день"])
    assert list(w.hashes[w.first[0] : w.first[1]]) == list(w.hashes[w.first[1] + 1 : w.first[2]])
    assert w.first[3] - w.first[2] == 0 and w.first[4] - w.first[3] == 1


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_WORDS", 40)
    docs = spark.createDataFrame([(1, f"so {CLAIM} it", "x"), (1, f"so {CLAIM} it", "x"), (2, None, "x"), (3, "", "x"), (4, "nothing", "x")], "id bigint, text string, item string")
    items = spark.createDataFrame([(7, CLAIM, None), (8, None, "other words that are never there at all"), (9, "nothing at all to be seen in here", CLAIM), (None, CLAIM, None)], "case bigint, claim string, evidence string")
    got = leak.leaked(docs, "id", "text", items, "case", ["claim", "evidence"])
    assert sorted(map(tuple, got.collect())) == [(7, 1), (9, 1)]
    assert leak.leaked(docs.limit(0), "id", "text", items, "case", ["claim"]).count() == 0
    assert leak.leaked(docs, "id", "text", items.limit(0), "case", ["claim"]).count() == 0
