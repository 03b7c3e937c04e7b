"""Several values packed in one text field: split into one row per value, position kept.

The splitter works on Arrow string buffers, not on Python strings. A batch of fields is one byte array with row
offsets; quote parity is a running count of quote bytes minus the count at the row's start, delimiters are byte
masks outside quotes, and the values are what is left between delimiter bytes. Child offsets follow from the runs of
kept bytes; list arrays hold the values of a row and are flattened with the ordinal of their parent.

Defined results: a null field gives no rows; an empty or blank field gives no rows; a field with an odd number of
quote characters is read as if it had no quotes; empty items and a lone "et al." are no values; repeats are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, BLANKS = 34, np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True

#: Particles that begin a surname written in lower case.
PARTICLE = r"(?:(?:van|von|der|den|de|del|della|di|da|la|le|du|dos|bin|ibn|al|el|ter|zu)\s+)*"
#: Words that tell an organisation from a person.
ORGANISATION = r"\b(?:Institute|Foundation|Found\.|Laboratory|Lab\.|Society|Soc\.|Committee|Centre|Center|Ctr\.|Department|Dept\.|University|Univ\.|Association|Council|Agency|Group|Consortium)(?:\W|$)"
#: What the first author of a bibliography entry looks like.
AUTHOR_START = (
    rf"(?:{PARTICLE}[^\W\d_][\w'’\-]*(?:\s[^\W\d_][\w'’\-]*)?,\s+[^\W\d_a-z]\S*\s*"
    rf"|[^\W\d_a-z]\.(?:[\s\-]*[^\W\d_a-z]\.)*\s+{PARTICLE}[^\W\d_]"
    r"|[^\n]{0,60}?\b(?:Institute|Foundation|Laboratory|Society|Committee|Centre|Center|Department|University|Association|Council)\b)"
)
MARK = r"(?:\[\d+\]|\(\d+\)|\d+\.)"


class Bytes:
    """A batch of text fields as one byte array with row starts and ends."""

    def __init__(self, values: pa.Array) -> None:
        values = pc.fill_null(values.cast(pa.large_string()), "")
        if values.offset:
            values = pa.concat_arrays([pa.array([], pa.large_string()), values])
        n = len(values)
        buffers = values.buffers()
        self.offsets = np.frombuffer(buffers[1], np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(buffers[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
        self.offsets = self.offsets - first
        self.rows = n
        self.row = np.repeat(np.arange(n), np.diff(self.offsets))

    def shifted(self, by: int) -> np.ndarray:
        """The byte ``by`` places on in the same row, 0 beyond the row."""
        out = np.zeros_like(self.data)
        if by > 0:
            out[:-by] = np.where(self.row[by:] == self.row[:-by], self.data[by:], 0)
        elif by < 0:
            out[-by:] = np.where(self.row[-by:] == self.row[:by], self.data[:by], 0)
        else:
            out[:] = self.data
        return out

    def inside_quotes(self) -> tuple[np.ndarray, np.ndarray]:
        """For every byte whether it lies inside quotes; for every row whether it is quoted (even count above 0)."""
        mark = self.data == QUOTE
        before = np.concatenate(([0], np.cumsum(mark)))
        count = before[self.offsets[1:]] - before[self.offsets[:-1]]
        quoted = (count > 0) & (count % 2 == 0)
        parity = ((before[1:] - before[self.offsets[:-1]][self.row]) & 1).astype(bool) & quoted[self.row]
        return parity, quoted

    def any(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[mask], minlength=self.rows) > 0

    def word(self, text: bytes) -> np.ndarray:
        """All bytes of every occurrence of ``text`` within a row, blanks of any kind where it has a blank."""
        size = len(text)
        hit = np.ones(len(self.data), bool)
        for k, byte in enumerate(text):
            at = self.shifted(k)
            hit &= BLANKS[at] if byte == 32 else at == byte
        starts = np.flatnonzero(hit)
        starts = starts[starts + size <= self.offsets[1:][self.row[starts]]] if len(starts) else starts
        out = np.zeros(len(self.data), bool)
        for k in range(size):
            out[starts + k] = True
        return out

    def children(self, drop: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The runs of kept bytes as a string array, and the row of each."""
        keep = ~drop
        if not keep.any():
            return pa.array([], pa.large_string()), np.zeros(0, np.int64)
        begin = keep.copy()
        begin[1:] &= drop[:-1] | (self.row[1:] != self.row[:-1])
        parent = self.row[begin]
        kept = np.flatnonzero(keep)
        sizes = np.diff(np.append(np.flatnonzero(begin[kept]), len(kept)))
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        child = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[keep].tobytes()))
        return child, parent


def _unquote(values: pa.Array) -> pa.Array:
    values = pc.utf8_trim_whitespace(values)
    quoted = pc.and_(pc.and_(pc.starts_with(values, '"'), pc.ends_with(values, '"')), pc.greater(pc.binary_length(values), 1))
    bare = pc.replace_substring(pc.utf8_slice_codeunits(values, 1, -1), '""', '"')
    return pc.utf8_trim_whitespace(pc.if_else(quoted, bare, values))


def _is_value(values: pa.Array) -> np.ndarray:
    good = pc.and_(pc.greater(pc.binary_length(values), 0), pc.invert(pc.match_substring_regex(values, r"^(?i:et\.?\s+al\.?|and\s+others)$")))
    return good.to_numpy(zero_copy_only=False).astype(bool)


def _lists(values: pa.Array, parent: np.ndarray, rows: int) -> pa.LargeListArray:
    """Values without the empty ones and a lone "et al.", as one list per parent."""
    mask = _is_value(values)
    counts = np.bincount(parent[mask], minlength=rows)
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), values.filter(pa.array(mask)))


def split_names(fields: pa.Array) -> pa.LargeListArray:
    """Names of persons and organisations: the strongest delimiter of a field outside quotes decides, in the order
    line break, tab and bar; semicolon (with a closing "and" or "&"); spaced slash; comma with "and" and "&".
    Commas between a surname and its initials or only given name do not separate."""
    b = Bytes(fields)
    if not len(b.data):
        return _lists(pa.array([], pa.large_string()), np.zeros(0, np.int64), b.rows)
    inside, quoted = b.inside_quotes()
    out = ~inside
    hard = np.isin(b.data, [9, 10, 13, 124]) & out
    semi = (b.data == 59) & out
    slash = b.word(b" / ") & out
    joint = (b.word(b" and ") | b.word(b" & ")) & out
    comma = (b.data == 44) & out
    has_hard, has_semi, has_slash = b.any(hard), b.any(semi), b.any(slash)
    kind = np.where(has_hard, 0, np.where(has_semi, 1, np.where(has_slash, 2, 3)))[b.row]
    drop = np.where(kind == 0, hard, np.where(kind == 1, semi | joint, np.where(kind == 2, slash, comma | joint)))
    child, parent = b.children(drop)
    raw = pc.utf8_trim_whitespace(child)
    soft = ~(has_hard | has_semi | has_slash)
    again = (soft & b.any(comma)) | (b.any(joint) & ~has_hard & ~has_slash)
    # a comma directly before "and" leaves an "and " at an item's start
    raw = pc.replace_substring_regex(raw, r"^(?:and|&)\s+|\s*,$", "")
    child = _unquote(raw)
    if again.any():
        child, parent = _rejoin(child, raw, parent, again, soft)
    return _lists(child, parent, b.rows)


_INITIALS = re.compile(r"^(?:[^\W\d_a-z]\.?[\s\-]*){1,4}$")
_SURNAME = re.compile(rf"^{PARTICLE}[^\W\d_][\w'’\-]*$")
_GIVEN = re.compile(r"^[^\W\d_][\w'’\-]*(?:\s+[^\W\d_]\.?)*$")
_ORG = re.compile(ORGANISATION)


def _rejoin(child: pa.Array, raw: pa.Array, parent: np.ndarray, again: np.ndarray, soft: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Joins again what a comma or an "and" inside one name had cut, in the fields marked by ``again``."""
    values, quoted = child.to_pylist(), pc.starts_with(raw, '"').to_pylist()
    out: list[str] = []
    rows: list[int] = []
    k, n = 0, len(values)
    while k < n:
        row = parent[k]
        end = k
        while end < n and parent[end] == row:
            end += 1
        if not again[row]:
            out += values[k:end]
            rows += [row] * (end - k)
            k = end
            continue
        items = [(v, q) for v, q in zip(values[k:end], quoted[k:end], strict=True) if v]
        i = 0
        while i < len(items):
            v, q = items[i]
            nxt = items[i + 1] if i + 1 < len(items) else None
            if not q and nxt and not nxt[1]:
                if soft[row] and _SURNAME.match(v) and (_INITIALS.match(nxt[0]) or (len(items) == 2 and _GIVEN.match(nxt[0]))):
                    out.append(f"{v}, {nxt[0]}")
                    rows.append(row)
                    i += 2
                    continue
                if _ORG.search(v) and re.search(r"\b(?:for|of|on)\b", v) and re.match(r"^\w+$", nxt[0]):
                    joined = v
                    while i + 1 < len(items) and not items[i + 1][1] and re.match(r"^\w+$", items[i + 1][0]):
                        i += 1
                        last = i + 1 >= len(items) or not re.match(r"^\w+$", items[i + 1][0])
                        joined += (" and " if last else ", ") + items[i][0]
                    out.append(joined)
                    rows.append(row)
                    i += 1
                    continue
            out.append(v)
            rows.append(row)
            i += 1
        k = end
    return pa.array(out, pa.large_string()), np.array(rows, np.int64)


_LINE = re.compile(rf"(?:\.|\d|\))\s*?(\r?\n)\s*(?=(?:{MARK}\s*)?{AUTHOR_START})")
_FIRST_MARK = re.compile(r'^\s*"?\s*(\[|\(|)(\d+)(\]|\)|\.)\s')


def _context_cuts(text: str) -> list[tuple[int, int]]:
    """Spans between entries that only their surroundings tell: a line break before a new entry, and the next index
    mark of the same style after the end of an entry."""
    cuts = [m.span(1) for m in _LINE.finditer(text)] if "\n" in text else []
    if m := _FIRST_MARK.match(text):
        left, number, right = m.groups()
        at, number = m.end(), int(number) + 1
        while found := re.compile(rf"(?<=[.;\d/)\"”])(\s*;?\s+)(?={re.escape(left)}{number}{re.escape(right)}\s)").search(text, at):
            cuts.append(found.span(1))
            at, number = found.end(), number + 1
    else:
        for found in re.finditer(rf"(?:\.|\d);(\s+)(?=\[\d+\]\s+{AUTHOR_START})", text):
            cuts.append(found.span(1))
    return cuts


_ENTRY_SEMI = re.compile(rf"(?:(?<=\.)|(?<=\d))\s*(;)\s+(?={AUTHOR_START})")
_YEAR_END = re.compile(r"(?:19|20)\d{2}")


def _semicolon_cuts(text: str) -> list[tuple[int, int]]:
    """Semicolons between whole entries: what stands before since the last cut has a year and a title, not only names."""
    cuts, start = [], 0
    for m in _ENTRY_SEMI.finditer(text):
        body = text[start : m.start(1)]
        if (y := _YEAR_END.search(body)) and len(body) - y.end() > 12 or re.search(r"(?:19|20)\d{2}\.\s*$|10\.\d{4}/\S+\s*$", body):
            cuts.append(m.span(1))
            start = m.end(1)
    return cuts


def split_entries(fields: pa.Array) -> pa.LargeListArray:
    """Bibliography entries: quoted entries, blank lines, tabs, bars, new lines that begin an entry, or running index marks."""
    b = Bytes(fields)
    if not len(b.data):
        return _lists(pa.array([], pa.large_string()), np.zeros(0, np.int64), b.rows)
    inside, quoted = b.inside_quotes()
    lead = pc.starts_with(pc.utf8_ltrim_whitespace(pc.fill_null(fields.cast(pa.large_string()), "")), '"').to_numpy(zero_copy_only=False)
    quoted &= lead
    out = ~(inside & quoted[b.row])
    newline = b.data == 10
    # a blank line: a line break followed, over blanks only, by another one
    blank_line = newline & ((b.shifted(1) == 10) | ((b.shifted(1) == 13) & (b.shifted(2) == 10)) | ((b.shifted(1) == 32) & (b.shifted(2) == 10)))
    bar = (b.data == 124) & (BLANKS[b.shifted(-1)] | BLANKS[b.shifted(1)] | (b.shifted(1) == 124) | (b.shifted(-1) == 124))
    hard = ((b.data == 9) | bar | blank_line) & out
    has_hard = b.any(hard)
    listed = ((b.data == 44) | (b.data == 59)) & out
    drop = np.where(quoted[b.row], listed | hard, hard)
    texts = None
    need = np.flatnonzero(~quoted & ~has_hard & (b.any(newline) | b.any(b.data == 59) | b.any(np.isin(b.data, [91, 40]) & BLANKS[b.shifted(-1)]) | b.any((b.data == 46) & BLANKS[b.shifted(1)])))
    if len(need):
        texts = fields.take(pa.array(need)).to_pylist()
        for row, text in zip(need, texts, strict=True):
            cuts = _context_cuts(text) or (_semicolon_cuts(text) if ";" in text else [])
            for s, e in cuts:
                s, e = len(text[:s].encode()), len(text[:e].encode())
                at = int(b.offsets[row])
                drop[at + s : at + e] = True
    child, parent = b.children(drop)
    child = pc.replace_substring_regex(_unquote(child), r"\s+", " ")
    child = pc.utf8_trim_whitespace(pc.replace_substring_regex(child, r"^[;,]\s+|\s*;$", ""))
    return _lists(child, parent, b.rows)


_DASH = r"\s*(?:-|‐|‑|‒|–|—|−)\s*"


class Parts:
    """Values of a batch not yet written out: a text each, or the whole numbers from ``first`` to ``last``."""

    def __init__(self, rows: int) -> None:
        self.rows = rows
        self.parent = np.zeros(0, np.int64)
        self.first, self.last = self.parent, self.parent - 1
        self.text = pa.array([], pa.large_string())

    def add(self, parent: np.ndarray, text: pa.Array, first: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        """``text`` is null where a part is a run of numbers."""
        none = np.zeros(len(parent), np.int64)
        self.parent, self.text = np.concatenate((self.parent, parent)), pa.concat_arrays([self.text, text.cast(pa.large_string())])
        self.first = np.concatenate((self.first, none if first is None else first))
        self.last = np.concatenate((self.last, none if last is None else last))

    def written(self) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(parent, position in the row, value) of all values in order, at most WRITTEN at a time."""
        order = np.argsort(self.parent, kind="stable")
        parent, text, first = self.parent[order], self.text.take(pa.array(order)), self.first[order]
        ends = np.cumsum(self.last[order] - first + 1)
        starts = np.concatenate(([0], ends))[:-1]
        begins = starts[np.searchsorted(parent, parent, "left")] if len(parent) else starts
        for low in range(0, int(ends[-1]) if len(ends) else 0, WRITTEN):
            place = np.arange(low, min(low + WRITTEN, int(ends[-1])))
            part = np.searchsorted(ends, place, "right")
            number = pa.array(first[part] + place - starts[part]).cast(pa.large_string())
            yield parent[part], place - begins[part] + 1, pc.coalesce(text.take(pa.array(part)), number)


#: Values written at once; a longer run of numbers goes on in the next batch.
WRITTEN = 500_000


def _numbers(fields: pa.Array, parts: Parts) -> None:
    """Numeric groups: a number joined to the one before by a dash stands for all from there on if it is larger, in chains
    too (1-3-5); numbers of more than 18 digits are kept as written, without leading zeros, and open no run."""
    b = Bytes(pc.replace_substring_regex(fields, _DASH, "-"))
    if not len(b.data):
        return
    digit = (b.data >= 48) & (b.data <= 57)
    child, parent = b.children(~digit)
    if not len(child):
        return
    begin = digit.copy()
    begin[1:] &= ~digit[:-1] | (b.row[1:] != b.row[:-1])
    close = digit.copy()
    close[:-1] &= ~digit[1:] | (b.row[1:] != b.row[:-1])
    at, end = np.flatnonzero(begin), np.flatnonzero(close) + 1
    other = np.concatenate(([0], np.cumsum(~digit & (b.data != 45))))
    joined = np.zeros(len(at), bool)
    joined[1:] = (parent[1:] == parent[:-1]) & (other[at[1:]] == other[end[:-1]])
    plain = pc.replace_substring_regex(child, r"^0+(\d)", r"\1")
    small = pc.less_equal(pc.binary_length(plain), 18).to_numpy(zero_copy_only=False).astype(bool)
    value = pc.if_else(pa.array(small), plain, "0").cast(pa.int64()).to_numpy()
    run = np.zeros(len(at), bool)
    run[1:] = joined[1:] & small[1:] & small[:-1] & (value[1:] > value[:-1])
    first = np.where(run, np.concatenate(([0], value[:-1])) + 1, value)
    new = np.ones(len(at), bool)
    new[1:] = ~(joined[1:] & small[1:] & small[:-1] & (value[1:] == value[:-1]))  # 3-3 is 3
    text = pc.if_else(pa.array(small), pa.scalar(None, pa.large_string()), plain)
    parts.add(parent[new], text.filter(pa.array(new)), np.where(small, first, 0)[new], np.where(small, value, 0)[new])


def citation_parts(fields: pa.Array) -> Parts:
    """Citation groups. Numeric: one number per value, rising ranges whole, a falling one by its ends. Author-year:
    "<authors> <year>" for every year, authors carried on."""
    text = pc.fill_null(fields.cast(pa.large_string()), "")
    numeric = pc.match_substring_regex(text, r"^\s*\[").to_numpy(zero_copy_only=False).astype(bool)
    parts = Parts(len(text))
    _numbers(pc.if_else(pa.array(numeric), text, ""), parts)
    # author-year groups: a year ends a value
    b = Bytes(pc.if_else(pa.array(~numeric), text, ""))
    if len(b.data):
        digit = (b.data >= 48) & (b.data <= 57)
        before, run = np.zeros_like(digit), digit.copy()
        before[1:] = digit[:-1] & (b.row[1:] == b.row[:-1])
        for k in range(1, 4):
            run &= (b.shifted(k) >= 48) & (b.shifted(k) <= 57)
        century = ((b.data == 49) & (b.shifted(1) == 57)) | ((b.data == 50) & (b.shifted(1) == 48))
        after = (b.shifted(4) >= 48) & (b.shifted(4) <= 57)
        page = (b.shifted(-2) == 46) & BLANKS[b.shifted(-1)] & (b.shifted(-3) == 112)
        start = np.flatnonzero(run & century & ~before & ~after & ~page)
        row = b.row[start]
        inside = start + 4 <= b.offsets[1:][row] if len(start) else np.zeros(0, bool)
        start, row = start[inside], row[inside]
        letter = np.zeros(len(start), np.int64)
        can = start + 4 < b.offsets[1:][row] if len(start) else np.zeros(0, bool)
        nxt = b.data[np.minimum(start + 4, len(b.data) - 1)]
        more = b.data[np.minimum(start + 5, len(b.data) - 1)]
        same = start + 5 < b.offsets[1:][row] if len(start) else np.zeros(0, bool)
        letter[can & (nxt >= 97) & (nxt <= 122) & ~(same & (more >= 97) & (more <= 122))] = 1
        end = start + 4 + letter
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        begin = np.where(first, b.offsets[:-1][row], np.concatenate(([0], end[:-1]))[: len(row)])
        names = _slices(b.data, begin, start)
        years = _slices(b.data, start, end)
        names = pc.replace_substring_regex(names, r'["()\[\]]', " ")
        names = pc.replace_substring_regex(names, r"(?:^|[\s,;])pp?\.\s*\d+(?:\s*[-–—]\s*\d+)?", " ")
        names = pc.replace_substring_regex(names, r"^[\s,;|/&]+|[\s,;|/]+$", "")
        names = pc.replace_substring_regex(names, r"^(?i:(?:see\s+also|see\s+e\.g\.,?|see|e\.g\.,?|i\.e\.,?|cf\.?|compare|for\s+example,?|for\s+review,?|reviewed\s+in|as\s+in|also)\s*)+(?:\s|$)", "")
        names = pc.utf8_trim_whitespace(pc.replace_substring_regex(names, r"\s+", " "))
        names = pc.replace_substring_regex(names, r"^(?:and|&)$", "")
        named = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False).astype(bool)
        source = np.maximum.accumulate(np.where(named | first, np.arange(len(row)), 0)) if len(row) else np.zeros(0, np.int64)
        names = names.take(pa.array(source))
        found = pc.utf8_trim_whitespace(pc.binary_join_element_wise(names, years, pa.scalar(" ", pa.large_string())))
        good = _is_value(found)
        parts.add(row[good], found.filter(pa.array(good)))
    return parts


def split_citations(fields: pa.Array) -> pa.LargeListArray:
    """The values of ``citation_parts`` as one list per field."""
    parts = citation_parts(fields)
    written = list(parts.written())
    parent = np.concatenate([np.zeros(0, np.int64), *(p for p, _, _ in written)])
    return _lists(pa.concat_arrays([pa.array([], pa.large_string()), *(v for _, _, v in written)]), parent, parts.rows)


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    size = (end - begin).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    at = np.arange(int(offsets[-1])) + np.repeat(begin - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes()))


SPLITTERS = {"entries": split_entries, "names": split_names}


def split_packed(df: DataFrame, key: str, field: str, kind: str) -> DataFrame:
    """One row (row_id, value_pos, value_text) per value of ``field``; ``kind`` is entries, names or citations.

    Narrow: no shuffle, one pass over the two columns. Nulls and blank fields give no rows; repeated rows of ``df``
    give repeated results; other columns of ``df`` are not read, so their names can't clash.
    """

    def values(fields: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        if kind == "citations":
            yield from citation_parts(fields).written()
            return
        lists = SPLITTERS[kind](fields)
        parent, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
        starts = lists.offsets.to_numpy()[:-1]
        yield parent, np.arange(len(flat)) - starts[parent] + 1 if len(flat) else np.zeros(0, np.int64), flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parent, position, value in values(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(parent)), pa.array(position.astype(np.int32)), value.cast(pa.string())],
                    names=["row_id", "value_pos", "value_text"],
                )

    narrow = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(field).cast("string").alias("field")).where("field is not null")
    return narrow.mapInArrow(run, "row_id bigint, value_pos int, value_text string")
