"""Rule classification of sentences, with state carried over sentence order.

Cue families are data (fixed pattern lists); scores are sums of case expressions; the section and inherited citations
are windows over a document's sentences. Null sentences count as empty and are no claims. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrain.functions import text as t
from docgrain.functions.numbers import round_half_up
from docgrain.operators import tables

# The cue patterns of each family.
FACTUAL = (
    r"\b(found|reported|showed|demonstrated|observed|concluded|indicated|estimated|measured|documented)\b",
    r"\b(improves?|improved|increases?|increased|reduces?|reduced|outperforms?|achieves?|achieved)\b",
    r"\b(is associated with|are associated with|correlates? with|causes?|predicts?|leads? to|results? in)\b",
    r"\b(requires?|contains?|consists? of|depends? on|uses?|relies? on)\b",
    r"\b(has been|have been|is widely|are widely|is commonly|are commonly)\b",
    r"(?:^|[^A-Za-z0-9_])\d+(?:\.\d+)?\s*(?:%[A-Za-z0-9_]|(?:percent|participants|patients|samples|documents|examples)(?:[^A-Za-z0-9_]|$))",
    r"\b(prior work|previous studies|researchers|studies|evidence)\b",
)
METHOD = (
    r"\b(we|this study|this project|our|in this work)\s+(used|use|trained|train|evaluated|evaluate|collected|implemented|fine-tuned|split|compare|compared)\b",
    r"\b(we|our)\s+(dataset|corpus|benchmark|training set|test set|baseline|experiment|model|pipeline)\b",
    r"\b(the|this|our)\s+(dataset|corpus|benchmark)\s+(contains?|includes?|consists? of)\b",
    r"\b(hyperparameter|cross-validation|train/test split|validation split|baseline model)\b",
    r"\b(the|our)\s+(experiments?|models?|notebook|optimizer|batch size|architecture|pipeline)\s+(use|uses|used|is|are|evaluate|evaluates|vary|varies)\b",
    r"\b(is|are)\s+(applied|implemented|trained|evaluated|configured)\b",
)
OPINION = (
    r"\b(we believe|i believe|arguably|probably|promising|important|interesting|notable|surprising)\b",
    r"\b(should|could|may|might|appears|seems|interpret|interpreted as)\b",
)
DEFINITION = (
    r"\b(is defined as|are defined as|refers to|means|is a type of|are a type of)\b",
    r"\b(is an?|are)\s+[a-z -]{0,80}\b(concept|method|architecture|technique|field|approach|model|framework)\b",
    r"\b(can be understood as|is known as|are known as)\b",
)
#: Word boundaries before and after the number by ASCII classes, as engines differ on letters beyond.
NUMBER = r"(?:^|[^A-Za-z0-9_])\d+(?:\.\d+)?(?:[^A-Za-z0-9_]|$)"
FIRST_PERSON = r"\b(we|our|this study|this project|in this work)\b"
OWN_WORK = r"\b(we|our|this study|this project|the notebook)\b"
ABSOLUTE = r"\b(all|always|never|causes?|eliminates?|proves?|\d+(?:\.\d+)?%)\b"
EVIDENCE = r"\b(studies|research|evidence|reported|demonstrated|outperforms?)\b"
FOLLOWS = r"^\s*(this|these|such|they|it|the (?:study|paper|result|finding|method))\b"
NUMBERED_SECTION = rf"(?i)(?:^|\s)\d+(?:\.\d+)*\s+({t.SECTIONS})\b"
PLAIN_SECTION = rf"(?i)^\s*({t.SECTIONS})\b(?:\s*[:.]|\s*$)"
EXEMPT = ("abstract", "method", "methodology", "experiment", "result")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _points(flag: Column, points: int) -> Column:
    return F.when(flag, points).otherwise(0)


def scored(df: DataFrame, sentence: str, cited: Column) -> DataFrame:
    """``df`` with claim_type and classification_confidence of the sentence."""
    s = F.coalesce(F.trim(F.col(sentence)), F.lit(""))
    low = F.lower(s)
    factual = _points(cited, 2) + _points(_any(low, FACTUAL), 2) + _points(low.rlike(NUMBER), 1)
    method = _points(_any(low, METHOD), 3) + _points(low.rlike(FIRST_PERSON), 1)
    opinion, definition = _points(_any(low, OPINION), 2), _points(_any(low, DEFINITION), 3)
    bare = (t.word_count(s) < 4) | s.rlike(r"^[\d\W]+$") | s.rlike("^[A-Z][A-Za-z ]{0,80}$")
    with_scores = df.withColumns({"__f": factual, "__m": method, "__o": opinion, "__d": definition, "__bare": bare})
    f, m, o, d = (F.col(c) for c in ("__f", "__m", "__o", "__d"))
    rules = ((m >= 3, "methodological_statement", m), ((d >= 3) & (f <= 3), "background_or_definition", d), ((o >= 2) & (f < 3), "opinion_or_interpretation", o), (f > 0, "factual_claim", f))
    label, confidence = F.when(F.col("__bare"), "non_claim"), F.when(F.col("__bare"), 0.85)
    for condition, name, score in rules:
        label = label.when(condition, name)
        confidence = confidence.when(condition, F.least(F.lit(0.95), round_half_up(0.55 + score * 0.1, 2)))
    return with_scores.withColumns({"claim_type": label.otherwise("non_claim"), "classification_confidence": confidence.otherwise(0.7)}).drop("__f", "__m", "__o", "__d", "__bare")


def section_of(sentence: Column) -> Column:
    """The section a heading at the sentence's head names, in small letters without trailing s; null without one."""
    head = F.left(sentence, F.lit(240))
    name = F.coalesce(F.nullif(F.regexp_extract(head, NUMBERED_SECTION, 1), F.lit("")), F.nullif(F.regexp_extract(head, PLAIN_SECTION, 1), F.lit("")))
    return F.regexp_replace(F.lower(name), "s+$", "")


def citation_required(claim_type: Column, section: Column, sentence: Column) -> Column:
    return (claim_type == "factual_claim") & ~F.coalesce(section.isin(*EXEMPT), F.lit(False)) & ~F.lower(sentence).rlike(OWN_WORK)


def severity(sentence: Column, missing: Column) -> Column:
    low = F.lower(sentence)
    return F.when(~missing, "none").when(low.rlike(ABSOLUTE) | low.rlike(EVIDENCE), "high").otherwise("medium")


#: Sentences of one document are sorted in blocks of so many places.
BLOCK = 4096


def classify(df: DataFrame, document: str, position: str, sentence: str, cited: Column, block: Column | None = None) -> DataFrame:
    """Classified sentences of documents in order: section carried forward, citations inherited along a chain of
    following sentences; missing flag, context and severity. Both states are the last known value before a row, carried within
    blocks of sentences and over the blocks, so no document is sorted in one task. ``block`` rises with the position, which is a
    number where it is not given."""
    block = F.floor(F.col(position) / BLOCK) if block is None else block
    c = scored(df.withColumn("own", F.coalesce(cited, F.lit(False))), sentence, F.col("own")).withColumn("section", section_of(F.col(sentence)))
    c = tables.carry_blocks(c, document, position, block, F.col("section"), "section").withColumn("section", F.coalesce("section", F.lit("unknown")))
    c = c.withColumn("required", citation_required(F.col("claim_type"), F.col("section"), F.coalesce(F.col(sentence), F.lit(""))))
    eligible = F.col("required") & ~F.col("own") & F.lower(F.col(sentence)).rlike(FOLLOWS)
    # a chain begins at a sentence that cites or may not inherit, and passes on whether that one cites
    begins = F.col("own") | ~F.coalesce(eligible, F.lit(False))
    c = tables.carry_blocks(c, document, position, block, F.when(begins, F.col("own")), "inherited")
    inherits = eligible & F.coalesce(F.col("inherited"), F.lit(False))
    missing = F.col("required") & ~F.col("own") & ~inherits
    context = F.when(F.col("own"), "same_sentence").when(inherits, "previous_sentence").otherwise("none")
    return c.withColumns({"missing_citation": missing, "citation_context": context}).withColumn("flag_severity", severity(F.coalesce(F.col(sentence), F.lit("")), F.col("missing_citation"))).drop("inherited", "required")
