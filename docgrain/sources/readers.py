"""Readers: text and PDF files, checked CSV benchmarks, prediction files, archives.

Every reader gives a fixed schema, reads files in parallel, and states what it does with broken input: undecodable bytes
fall back to a Windows code page, a missing required column raises, blank rows are dropped, a label outside its
domain raises with its place when the row is read.
"""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import re
import tarfile
import zlib
from collections.abc import Iterator, Sequence
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text) of whole files: UTF-8, else Windows-1252."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [_decoded(bytes(c)) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(decode, "path string, text string")


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252", errors="replace")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt and .pdf files; any other suffix is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"))
    checked = files.withColumn("suffix", F.when(F.col("suffix").isin(".txt", ".pdf"), F.col("suffix")).otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), "path"))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [pdf_text(bytes(c)) if s == ".pdf" else _decoded(bytes(c)) for s, c in zip(b["suffix"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": found})

    return checked.mapInPandas(read, "path string, text string")


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_BLOCK = re.compile(rb"\bBT\b(.*?)\bET\b", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|-?\d+(?:\.\d+)?|\bT[*dDmjJ]\b|'|\[|\]", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
# Escapes of string literals and glyph codes of ligatures.
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
_GLYPHS = str.maketrans({"\x0b": "ff", "\x0c": "fi", "\r": "fl", "\x0e": "ffi", "\x0f": "ffl"})
WIDE_KERN = -120


def _literal(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e[:1].isdigit() else _PLAIN.get(e, e)

    return _ESCAPE.sub(one, raw[1:-1]).decode("latin-1").translate(_GLYPHS)


def pdf_text(content: bytes) -> str:
    """Text of a simple PDF: content streams are inflated, shown strings joined, wide kerning is a blank, new text lines
    are line breaks. Encrypted or font-encoded files give what they hold in plain strings."""
    lines: list[str] = []
    for stream in _STREAM.findall(content):
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass
        for block in _BLOCK.findall(stream):
            line, listed = "", False
            for m in _SHOW.finditer(block):
                token = m[0]
                if token[:1] == b"(":
                    line += _literal(token)
                elif token == b"[":
                    listed = True
                elif token == b"]":
                    listed = False
                elif token in (b"Td", b"TD", b"T*", b"Tm", b"'"):
                    line += "\n" if line and not line.endswith("\n") else ""
                elif listed and token[:1] in b"-0123456789" and float(token) < WIDE_KERN:
                    line += " "
            lines.append(line)
    return re.sub(r"[ \t]+", " ", "\n".join(x for x in lines if x.strip())).strip()


def checked_csv(spark: SparkSession, path: str, required: Sequence[str], domains: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """A CSV with header as strings: required columns must exist, rows blank in all of them are dropped, a value
    outside its column's domain raises when read."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    blank = functools.reduce(and_, (F.coalesce(F.trim(c), F.lit("")) == "" for c in required), F.lit(True))
    df = df.where(~blank)
    for c, allowed in (domains or {}).items():
        known = F.trim(c).isin(list(allowed))
        df = df.withColumn(c, F.when(known, F.trim(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} has an unknown value: "), F.coalesce(F.col(c), F.lit("null"))))))
    return df


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, predicted) from CSV, or from JSON that is a list or holds one under "predictions"; "label" stands in for
    "predicted"; of a repeated case the last wins."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("pos", F.monotonically_increasing_id())
        for c in ("predicted", "label"):
            df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
        rows = df.select("case_id", F.coalesce("predicted", "label").alias("predicted"), "pos")
    else:
        item = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("case_id", "predicted", "label")]))
        whole = spark.read.text(path, wholetext=True)
        inner = F.get_json_object("value", "$.predictions")
        listed = F.from_json(F.coalesce(inner, F.col("value")), item)
        rows = whole.select(F.posexplode(listed).alias("pos", "r")).select("r.case_id", F.coalesce("r.predicted", "r.label").alias("predicted"), "pos")
    return rows.groupBy("case_id").agg(F.max_by("predicted", "pos").alias("predicted"))


def results(spark: SparkSession, path: str, words: Sequence[str] = ()) -> DataFrame:
    """A CSV of results with guessed types; absent values of the columns in ``words`` become "None"."""
    return spark.read.csv(path, header=True, inferSchema=True).fillna("None", subset=list(words) or None)


def listed(text: Column) -> Column:
    """The items of a list with ";", trimmed, empty ones left out; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda i: F.trim(i)), lambda i: i != "")


def question_answers(papers: DataFrame, least_words: int = 500) -> DataFrame:
    """(title, document, question, answer) of nested papers (title, section_names, paragraphs per section, qas array of question and
    answers): sections joined to one document, short documents left out, the first non-empty answer of a question."""
    parts = F.flatten(F.transform(F.arrays_zip("section_names", "paragraphs"), lambda s: F.concat(F.when(F.coalesce(s["section_names"], F.lit("")) != "", F.array(F.concat(F.lit("\n## "), s["section_names"], F.lit("\n")))).otherwise(F.array().cast("array<string>")), F.coalesce(s["paragraphs"], F.array().cast("array<string>")))))
    d = papers.select("title", F.array_join(parts, "\n").alias("document"), "qas")
    long = d.where(F.size(F.filter(F.split("document", r"\s+"), lambda w: w != "")) >= least_words)
    q = long.select("title", "document", F.explode("qas").alias("q"))
    answer = F.try_element_at(F.filter("q.answers", lambda a: F.trim(F.coalesce(a, F.lit(""))) != ""), F.lit(1))
    return q.select("title", "document", "q.question", answer.alias("answer")).where("answer is not null")


#: Lines of an archive's member handed on at once.
LINES = 10_000


def archive_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, line_no, line) of a JSONL member of tar.gz archives, read without unpacking them to disk; blank lines are left out.
    The archive is one task's, its members stream through it in blocks of lines."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(c), mode="r|*") as tar:
                    for info in tar:
                        if not (info.name.endswith(member) and info.isfile()):
                            continue
                        numbered = ((p, n, line.decode("utf-8").rstrip("\r\n")) for n, line in enumerate(tar.extractfile(info)) if line.strip())
                        while rows := list(itertools.islice(numbered, LINES)):
                            yield pd.DataFrame(rows, columns=["path", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, line_no int, line string")


def claim_documents(claims: DataFrame, corpus: DataFrame) -> DataFrame:
    """(claim_id, claim, doc_id, label, evidence) from lines of claims and of documents (column ``line``): one row per evidence
    group of a claim; a claim without evidence gives its first cited document with NOT_ENOUGH_INFO; evidence is title and
    abstract, empty for an unknown document. Rows without claim or evidence text are left out."""
    shape = "id bigint, claim string, evidence map<string, array<struct<label: string>>>, cited_doc_ids array<string>"
    c = claims.select(F.from_json("line", shape).alias("c")).select("c.*")
    groups = F.flatten(F.transform(F.map_entries("evidence"), lambda e: F.transform(e["value"], lambda g: F.struct(e["key"].alias("doc_id"), F.coalesce(g["label"], F.lit("")).alias("label")))))
    cited = F.when(F.size("cited_doc_ids") > 0, F.array(F.struct(F.element_at("cited_doc_ids", 1).alias("doc_id"), F.lit("NOT_ENOUGH_INFO").alias("label"))))
    rows = c.select(F.col("id").alias("claim_id"), "claim", F.explode(F.when(F.size("evidence") > 0, groups).otherwise(cited)).alias("g")).select("claim_id", "claim", "g.doc_id", "g.label")
    d = corpus.select(F.from_json("line", "doc_id string, title string, abstract array<string>").alias("d")).select("d.doc_id", "d.title", "d.abstract")
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce(F.array_join("abstract", " "), F.lit(""))))
    joined = rows.join(d.withColumn("evidence", text).select("doc_id", "evidence"), "doc_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(".")))
    return joined.where("claim != '' and evidence != ''").select("claim_id", "claim", "doc_id", "label", "evidence")


def output_text(payload: Column) -> Column:
    """The text of a model response: output_text, else the first non-empty output_text content of a message; null without."""
    p = F.from_json(payload, "output_text string, output array<struct<type: string, content: array<struct<type: string, text: string>>>>")
    parts = F.flatten(F.transform(F.filter(p["output"], lambda i: i["type"] == "message"), lambda i: F.coalesce(i["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    first = F.try_element_at(F.filter(parts, lambda c: (c["type"] == "output_text") & (c["text"] != "")), F.lit(1))["text"]
    return F.coalesce(F.nullif(p["output_text"], F.lit("")), first)


def paired_texts(spark: SparkSession, path: str, first: str, second: str, least_words: int = 40) -> DataFrame:
    """(pos, first, second) from a JSON object of two equally long arrays; pairs with a side under ``least_words`` words
    are left out."""
    schema = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in (first, second)])
    whole = spark.read.schema(schema).json(path, multiLine=True)
    rows = whole.select(F.posexplode(F.arrays_zip(first, second)).alias("pos", "z")).select("pos", f"z.{first}", f"z.{second}")
    long = [F.size(F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")) >= least_words for c in (first, second)]
    return rows.where(long[0] & long[1])


def verified(path: str, digest: str) -> bytes:
    """A file's bytes, checked against its SHA-256."""
    with open(path, "rb") as file:
        content = file.read()
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError(f"digest of {path} does not match")
    return content


# The date fields of a record, the first usable one counts.
DATES = ("published-print", "published-online", "issued", "created")


def payload_candidates(df: DataFrame, key: str, source: str, payload: str) -> DataFrame:
    """(key, source, title, year, doi, authors, retracted) from lookup payloads of three services, one schema for all."""
    crossref = T.StructType.fromDDL("message struct<items: array<struct<title: array<string>, DOI: string, author: array<struct<family: string>>, `published-print`: struct<`date-parts`: array<array<string>>>, `published-online`: struct<`date-parts`: array<array<string>>>, issued: struct<`date-parts`: array<array<string>>>, created: struct<`date-parts`: array<array<string>>>, `update-to`: array<struct<type: string>>, relation: struct<`is-retracted-by`: array<struct<id: string>>>, subtype: string>>>")
    other = T.StructType.fromDDL("data array<struct<title: string, year: int, externalIds: struct<DOI: string>, authors: array<struct<name: string>>>>, results array<struct<display_name: string, publication_year: int, doi: string, is_retracted: boolean, authorships: array<struct<author: struct<display_name: string>>>>>")
    doi = lambda c: F.lower(F.regexp_replace(c, r"(?i)^https?://(?:dx\.)?doi\.org/", ""))
    base = df.select(key, source, F.from_json(payload, crossref).alias("c"), F.from_json(payload, other).alias("o"))
    a = base.select(key, source, F.explode("c.message.items").alias("i")).select(
        key, source, F.try_element_at("i.title", F.lit(1)).alias("title"), F.coalesce(*[F.col("i")[k]["date-parts"][0][0].try_cast("int") for k in DATES]).alias("year"), doi(F.col("i.DOI")).alias("doi"),
        F.transform("i.author", lambda x: x["family"]).alias("authors"), ((F.coalesce(F.size(F.col("i")["update-to"]), F.lit(0)) > 0) | (F.coalesce(F.size(F.col("i.relation")["is-retracted-by"]), F.lit(0)) > 0) | F.coalesce(F.lower("i.subtype").contains("retraction"), F.lit(False))).alias("retracted"),
    )
    b = base.select(key, source, F.explode("o.data").alias("i")).select(key, source, "i.title", F.col("i.year").alias("year"), doi(F.col("i.externalIds.DOI")).alias("doi"), F.transform("i.authors", lambda x: x["name"]).alias("authors"), F.lit(False).alias("retracted"))
    c = base.select(key, source, F.explode("o.results").alias("i")).select(
        key, source, F.col("i.display_name").alias("title"), F.col("i.publication_year").alias("year"), doi(F.col("i.doi")).alias("doi"), F.transform("i.authorships", lambda x: x["author"]["display_name"]).alias("authors"), F.coalesce("i.is_retracted", F.lit(False)).alias("retracted")
    )
    return a.unionByName(b).unionByName(c)
