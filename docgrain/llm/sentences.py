"""Sentence boundaries across languages and scripts.

Candidate boundaries come from the text alone: an empty line is always one; a stop, with its closing quotes and the
citation mark directly after it, is one where it stands outside quotations and brackets; a blank is one where most letters
around it are Thai. A
maximum-entropy (logistic) classifier decides every candidate from its neighbouring tokens, their case, length, digits
and script. It is trained on reliable boundaries of the data itself: ends of rows and of paragraphs are boundaries;
a stop before a small letter is none, nor is one after a token that often carries a stop but never ends a row, or
before a token that often follows a stop but never begins a row.

Defined results: null and blank texts give no units; a text without stops is one unit; repeated rows give repeated
units; other columns are not read. Texts of any length are handled in time in proportion to their length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrain.session import spread

#: The classifier is fitted on at most so many rows, those with the smallest hashes of their text.
TRAINING_ROWS = 20_000
SPACE = 1 << 15

# Abbreviations of several languages, without their stop.
ABBREVIATIONS = frozenset(
    "dr prof mr mrs ms st sr jr no nos nr fig figs eq eqs sec tab vol pp p ch cap chap vs cf al e.g i.e etc approx ca ed eds inc ltd co corp univ dept jan feb mar apr jun jul aug sep sept oct nov dec"
    " z b d h bzw usw bspw abb kap s env ex m mme mlle pág ej núm art trad lic av sra т е д др напр рис см стр г гг им п ул руб в κ π.χ δρ αρ σελ د أ डॉ श्री प्रो".split()
)
STOPS = ".!?…‼⁇⁈⁉؟۔।॥。！？｡．"
CJK_STOPS = "。！？｡．"
# Known boundaries, marked by ¦: they teach the general cases, so that small inputs are split sensibly too.
SEEDS = (
    "The kettle was cold.¦ Rain fell all day.¦ We paid 96.¦ My uncle walked to the shop.¦ Is it late?¦ Nobody slept!¦ The bus came soon.¦ Did she call?!¦ We waited\nagain.¦ Then the lamps went out.¦ It is warm.¦ It was so.¦ It is late.¦ The dog barked.",
    "Dr. Long met Prof. Short and Ms. Dee in the garden.¦ See Fig. 3 and Eq. (5), e.g. the roof, cf. Long (2001).¦ J. K. Long left at 5 p.m. on Monday.¦ He stayed in St. Clair.¦ As in No. 7 and Sec. 9, it rose... then fell.",
    'She sang "It rains. Come in." at the door.¦ He said “Fine. Go on.” and left.¦ "Where is it?" asked one.¦ We call it “a seed. No more.”¦ We ate some more.¦ It held (They were right.) and we wanted more.¦ "All is well."¦ Nobody knew.',
    "It is dark.[8-11 and 13]¦ My uncle slept [3].¦ The river fell (Long, 2001).¦ It rose [1, 2].¦ So it was (see Dee, 2003).¦ Long et al. (2001) agree.¦ The bridge was built by Long et al.¦ It is small.",
    "Der Zug kommt.¦ Am 3. Mai und im 2. Stock war es z. B. kalt.¦ Das gilt bzw. galt lange.¦ „Er schläft. Leise bitte.“ sagte die Mutter.¦ Wir gingen heim.¦ Regnet es?¦ Es regnet.",
    "« Entrez. Il pleut. » dit-elle à la porte.¦ Quel froid !¦ Le chap. 5 le raconte.¦ M. Long a lu p. 7.¦ ¿Llueve hoy?¦ ¡Sí!¦ Según el Dr. Long faltan dos.¦ «No hay pan. Espera.» gritó la vecina.¦ Era tarde.",
    "«Да. Иду.» сказал он.¦ В 2021 г. было тепло, т. е. сухо.¦ Поезд опоздал!¦ Мы ждали.¦ Ο κ. Long έφυγε.¦ Βρέχει πολύ!¦ «Έλα. Κάθισε.» είπε.",
    "今天下雨了！¦图5在墙上。¦她说：“进来。坐下。”然后关了门。¦他在门上写：“小心。慢走。”就离开了。¦你饿了吗？¦我们回家了。¦v2比v1快。¦電車が来た！¦母は「早く。寝なさい。」と言った。¦図6は壁にある。¦v3では止まった。",
    "비가 온다!¦ 그는 \"들어와. 앉아.\"라고 말했다.¦ 배가 고픈가?¦ 집에 갔다.¦ बारिश हुई।¦ माँ ने कहा \"आओ। बैठो।\" और दरवाज़ा बंद किया।¦ डॉ. Long घर गए।¦ गाड़ी आई!",
    "نزل المطر اليوم!¦ هل أنت جائع؟¦ قالت «ادخل. اجلس.» عند الباب.¦ قال د. Long إن القطار تأخر.¦ ذهبنا إلى البيت.",
    "ฝนตกตั้งแต่เช้า¦ เราเดินกลับบ้านด้วยกัน¦ แม่ทำแกงไว้รอ",
)
CLOSERS = "\"'”’»」』】）)]›“"
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_GROUP = re.compile(
    r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|‹[^›]*›|「[^」]*」|『[^』]*』|‘[^’]*[.!?。]’|(?<!\w)'(?=\S)[^']+?[.!?।。]'"
    r"|\((?:[^()]|\([^()]*\))*\)|（[^）]*）|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|【[^】]*】"
)
_CITE = r"\[\s*\d[\d\s,;&\-–—]*(?:and\s+\d[\d\s,;&\-–—]*)*\]"
_STOP = re.compile(rf"[{re.escape(STOPS)};;]+[{re.escape(CLOSERS)}]*(?:\s?{_CITE})*")
_OPEN = "\"'“„«‹「『‘([（【¿¡-–—•*"
#: Stands for the token before a stop that directly follows a bracket or quotation.
BRACKET = "<>"
_ENUMERATOR = re.compile(r"^\s*(?:\d+(?:\.\d+)*|[IVXLC]+|[A-Z](?:\.\d+)*|[a-z])\.$")


def _script(c: str) -> str:
    """A letter's script as the first word of its name; d for digits, blank for no letter."""
    if c < "\x80":
        return "LATIN" if c.isalpha() else "d" if c.isdigit() else ""
    if c.isdigit():
        return "d"
    return unicodedata.name(c, "").partition(" ")[0] if c.isalpha() or unicodedata.category(c)[0] == "M" else ""


def _kind(c: str) -> str:
    if not c:
        return "end"
    if c.isupper():
        return "up"
    if c.islower():
        return "low"
    if c.isdigit():
        return "dig"
    if c.isalpha():
        return "let"
    return "open" if c in _OPEN else "pun"


_WORD = re.compile(r"[^\W_]+(?:[.'’\-][^\W_]+)*")
_LAST = re.compile(r"([^\W_][^\s\"“”«»„()\[\]]*)$")
#: What no token before a stop reaches over.
_EDGE = re.compile(r"[\s\"“”«»„()\[\]。！？｡।॥]")
_HAS_THAI = re.compile("[\u0e00-\u0e7f]")


def _mask(text: str) -> tuple[np.ndarray, dict[int, int]]:
    """Positions inside quotations and brackets, and for the end of each such group its start."""
    inside = np.zeros(len(text) + 1, bool)
    ends: dict[int, int] = {}
    at = 0
    while m := _GROUP.search(text, at):
        inside[m.start() + 1 : m.end()] = True
        ends[m.end()] = m.start()
        at = m.end()
    return inside, ends


def _is_thai(text: str, at: int) -> bool:
    """Whether most letters around ``at`` are Thai."""
    near = text[max(0, at - AROUND) : at + AROUND]
    thai = sum("\u0e00" <= c <= "\u0e7f" for c in near)
    return thai > 0 and thai * 2 > sum(c.isalpha() for c in near)


THAI = "stop= "
#: Letters on either side by which a blank is in Thai text.
AROUND = 60


def _beside(c: str) -> str:
    """What stands beside a blank in Thai."""
    return "end" if c in CLOSERS + "%ๆฯ" + STOPS else _script(c) or "pun"


def _thai(a: str, b: str) -> list[str]:
    return [THAI, f"thai={_beside(a)},{_beside(b)}", f"thai>{_beside(b)}", f"thai<{_beside(a)}"]


def _separates(a: str, b: str) -> bool:
    """Between Thai words, numbers and closing signs on the left and a Thai word on the right a blank separates."""
    return _script(b) == "THAI" and _beside(a) in ("THAI", "d", "end")


def _is_greek(text: str) -> bool:
    return any("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in text)


def candidates(text: str) -> list[tuple[int, int, list[str], str, str]]:
    """For one paragraph (end of the unit before, start of the next, features, token before, token after)."""
    found: list[tuple[int, int, list[str], str, str]] = []
    inside, groups = _mask(text)
    size = len(text)
    thai = _HAS_THAI.search(text) is not None
    if thai:
        for m in re.finditer(r"\s+", text):
            a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if a and b and not inside[m.start()] and _is_thai(text, m.start()):
                found.append((m.start(), m.end(), _thai(a, b), a, b))
    words = [(m.end(), m.group(0)) for m in _WORD.finditer(text)]
    ended = [end for end, _ in words]
    edges = [m.start() for m in _EDGE.finditer(text)]
    greek = None
    for m in _STOP.finditer(text):
        begin = m.start()
        if thai and _is_thai(text, begin):
            continue  # stops end no sentence in Thai
        if text[begin] in ";;":
            greek = _is_greek(text) if greek is None else greek
            if not greek:
                continue
        end = m.end()
        quote = ""
        if inside[begin]:
            # a stop inside a group counts only at the group's very end
            for k in range(begin + 1, end + 1):
                if k in groups and not inside[k]:
                    rest = re.match(rf"(?:\s?{_CITE})*", text[k:])
                    end, quote = k + (rest.end() if rest else 0), text[k - 1]
                    break
            else:
                gap = re.match(r"\s?", text[m.end() :]).end()
                k = m.end() + gap + 1
                if k in groups and (k >= size or not inside[k]):  # French: a blank before the closing mark
                    end, quote = k, text[k - 1]
                else:
                    continue
        stop = text[begin]
        after = re.compile(r"\s*").match(text, end).end()
        if after >= size:
            continue
        blank = after > end
        nxt = text[after]
        direct = re.compile(r"\s?\((?:[^()]*\b(?:19|20)\d{2}[a-z]?\b[^()]*)\)").match(text, end)
        if direct and not blank:
            end = direct.end()
            after = re.compile(r"\s*").match(text, end).end()
            if after >= size:
                continue
            blank, nxt = after > end, text[after]
        if not blank and stop not in CJK_STOPS and _script(nxt) not in ("CJK", "HIRAGANA", "KATAKANA"):
            glued = re.search(r"[^\W\d_]{3}$|[)\]»”\"]$|[^\W_]$" if stop not in ".…" else r"[^\W\d_A-Z]{3}$|[)\]»”\"]$|\d%?$", text[max(0, begin - 3) : begin])
            if not (quote and _kind(nxt) == "let") and not (glued and (_kind(nxt) in ("up", "let") or nxt in "“«„¿¡\"")):
                continue
        k = bisect_left(edges, begin)
        before = _LAST.search(text, edges[k - 1] + 1 if k else 0, begin)
        t = before.group(1) if before else BRACKET
        k = bisect_right(ended, before.start() if before else begin)
        p2 = words[k - 1][1].lower() if k else "^"
        t_low = re.sub(r"\d+", "#", t.lower())
        word = _WORD.search(text, after)
        n = word.group(0) if word else ""
        n_low = re.sub(r"\d+", "#", n.lower())
        nk = _kind(nxt)
        if nk == "low" and (stop in CJK_STOPS or any(c.isupper() or c.isdigit() for c in n)):
            nk = "mix"  # a name such as eBay or v2, or a script that knows no case
        first = _kind(n[:1]) if nk == "open" else nk
        tk = "brk" if t == BRACKET else "num" if t_low.replace("#", "").strip(".,%") == "" and t else "one" if len(t) == 1 else "dot" if "." in t else "short" if len(t) <= 3 else "long"
        case = _kind(t[:1])
        abbr = stop == "." and (t_low in ABBREVIATIONS or t_low.rpartition("-")[2] in ABBREVIATIONS)
        enum = bool(_ENUMERATOR.match(text, 0, begin + 1))
        s1, s2 = (_script(t[-1:]) if t else ""), (_script(n[:1]) if n else "")
        dot = "." if stop == "." else "!"
        features = [
            f"stop={stop}", f"t={t_low}", f"n={n_low}", f"tk={tk},{dot}", f"nk={nk},{first}", f"len={min(len(t), 8)},{dot}", f"case={case},{tk},{dot}",
            f"abbr={abbr},{first}", f"q={bool(quote)},{first},{blank}", f"q={quote},n={n_low}" if quote else "q0", f"s={s1},{s2},{stop}", f"p2={p2},{tk}", f"p2={p2},n={n_low}",
            f"tk={tk},{first},{dot}", f"enum={enum}", f"cite={m.end() - begin > 3 and ']' in m.group(0)}", f"run={min(end - begin, 3)},{first}",
        ]
        found.append((end, after, features, t_low, n_low))
    return sorted(found, key=lambda c: c[:2]) if thai else found


def _slots(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode()) % SPACE for f in features]


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between empty lines."""
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def units(text: str, weights: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of every sentence unit of one text."""
    out = []
    for a, b in paragraphs(text):
        body = text[a:b]
        cuts = [(end, nxt) for end, nxt, f, _, _ in candidates(body) if decide(f, weights)]
        at = 0
        for end, nxt in [*cuts, (len(body), len(body))]:
            piece = body[at:end]
            if stripped := piece.strip():
                out.append((a + at + len(piece) - len(piece.lstrip()), len(stripped)))
            at = max(at, nxt)
    return out


def decide(features: list[str], weights: np.ndarray) -> bool:
    return float(weights[_slots(features)].sum() + weights[SPACE]) > 0


def reliable(texts: list[str]) -> tuple[list[list[int]], list[int]]:
    """Labelled candidates: feature slots and 0 or 1. Candidates nothing reliable is known of are left out."""
    starts, ends, mid_t, mid_n = Counter(), Counter(), Counter(), Counter()
    seen: list[tuple[list[str], str, str]] = []
    x: list[list[int]] = []
    y: list[int] = []
    for text in texts:
        for a, b in paragraphs(text):
            body = text[a:b].strip()
            if not body:
                continue
            if w := _WORD.match(body.lstrip(_OPEN + " ")):
                starts[re.sub(r"\d+", "#", w.group(0).lower())] += 1
            tail = re.sub(rf"(?:\s?{_CITE})+$", "", body)
            tail = tail.rstrip(CLOSERS + " ")
            if tail and tail[-1] in STOPS:
                tail = tail.rstrip(STOPS)
                edge = max((m.end() for m in _EDGE.finditer(tail)), default=0)
                w = _LAST.search(tail, edge)
                ends[re.sub(r"\d+", "#", w.group(1).lower()) if w else BRACKET] += 1
            for _, _, f, t, n in candidates(body):
                if f[0] == THAI:
                    x.append(_slots(f))
                    y.append(int(_separates(t, n)))
                else:
                    mid_t[t] += 1
                    seen.append((f, t, n))

    def never_ends(f: list[str], t: str) -> bool:
        return f[0] == "stop=." and ((mid_t[t] >= 4 and ends[t] == 0) or (t in ABBREVIATIONS and ends[t] * 50 < mid_t[t]))

    # a name after an abbreviation tells nothing of how sentences begin
    mid_n.update(n for f, t, n in seen if not never_ends(f, t))
    for f, t, n in seen:
        low = any(k.startswith("nk=") and k.endswith(("low", "pun")) for k in f)
        is_dot = f[0] == "stop=."
        caseless = any(k.startswith("nk=let") for k in f)
        never_starts = mid_n[n] >= 6 and starts[n] == 0 and (caseless or "#" in t)
        year = is_dot and n == "#" and any(k == "nk=open,dig" for k in f)
        quoted = "q0" not in f
        if low or year or never_ends(f, t) or never_starts or "enum=True" in f:
            label = 0
        elif starts[n] > 0 and (ends[t] > 0 or not is_dot or len(t) > 4):
            label = 1
        elif quoted:
            continue
        elif not is_dot or len(t) > 5:
            label = 1
        else:
            continue
        x.append(_slots(f))
        y.append(label)
    return x, y


def fit(texts: list[str], rounds: int = 120, l2: float = 0.02) -> np.ndarray:
    """Weights of the logistic classifier, the bias last; full-batch gradient steps scaled per weight (AdaGrad)."""
    x, y = reliable(texts)
    for text in SEEDS:
        marked = {m.start() - k for k, m in enumerate(re.finditer("¦", text))}
        for end, _, f, _, _ in candidates(text.replace("¦", "")):
            x += [_slots(f)] * 3
            y += [int(end in marked)] * 3
    for a in ABBREVIATIONS:
        x.append(_slots(["stop=.", f"t={a}", "abbr=True,up", "abbr=True,let"]))
        y.append(0)
    x += [_slots(["enum=True"])] * 5
    y += [0] * 5
    for a in "ก5”,a":
        for b in "ก5“a":
            x += [_slots(_thai(a, b))] * 3
            y += [int(_separates(a, b))] * 3
    width = max(map(len, x))
    slots = np.full((len(x), width), SPACE + 1)
    for k, row in enumerate(x):
        slots[k, : len(row)] = row
    label = np.array(y, float)
    w, g2 = np.zeros(SPACE + 2), np.full(SPACE + 2, 1e-6)
    flat = slots.ravel()
    for _ in range(rounds):
        z = w[slots].sum(1) + w[SPACE]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        g = np.bincount(flat, np.repeat(error, width), SPACE + 2) + l2 * w
        g[SPACE] = error.sum()
        g[SPACE + 1] = 0
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        w[SPACE + 1] = 0
    return w


def train(texts: DataFrame, column: str, rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights from at most ``rows`` texts, those with the smallest hashes: any order and partitioning of the data gives
    the same. A threshold on the hash leaves about twice as many before they are ordered."""
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    known = texts.select(F.col(column).cast("string").alias("text")).where("text is not null").withColumn("h", h)
    share = 2 * rows / max(1, known.count())
    if share < 1:
        known = known.where(F.col("h") < int(share * 2**63))
    picked = known.distinct().orderBy("h", "text").limit(rows)
    return fit(sorted(r.text for r in picked.select("text").collect()))


def split_sentences(df: DataFrame, key: str, column: str, weights: np.ndarray) -> DataFrame:
    """(row_id, unit_no, start_char, n_chars) of every sentence. Narrow: one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, k, s, n)
                for key, text in zip(batch["row_id"], batch["text"], strict=True)
                for k, (s, n) in enumerate(units(text, weights), 1)
            ]
            yield pd.DataFrame(rows, columns=["row_id", "unit_no", "start_char", "n_chars"])

    narrow = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(column).cast("string").alias("text")).where("text is not null")
    return spread(narrow).mapInPandas(run, "row_id bigint, unit_no int, start_char int, n_chars int")
