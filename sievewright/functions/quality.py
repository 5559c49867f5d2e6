"""Column functions that compare an original text with its translation; all in 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import is_table_text
from .text import sentences, strip, tokens

# Patterns of the metrics (fixed values).
NUMBER = r"\b\d+(?:[.,]\d+)*\b"
UNIT = r"(?i)\b\d+(?:[.,]\d+)*\s*(?:mg|kg|ml|mcg|µg|IU|units?|%|percent|months?|weeks?|days?|years?|hours?)\b"
MEDICAL = (
    r"\b(?:mg|kg|ml|mcg|µg|IU|units?)\b", r"\b(?:patient|treatment|therapy|drug|medication|dose|dosage)\b",
    r"\b(?:clinical|trial|study|analysis|outcome|endpoint)\b", r"\b(?:efficacy|safety|adverse|effect|reaction|event)\b",
)
STATISTICAL = (
    r"\b(?:hazard ratio|odds ratio|confidence interval|p-value|p value)\b",
    r"\b(?:significant|significance|statistical|analysis|regression)\b",
    r"\b(?:median|mean|average|standard deviation|variance)\b", r"\b(?:correlation|association|relationship|comparison)\b",
)


def found(c: Column, patterns: tuple[str, ...]) -> Column:
    return F.concat(*(F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(0)) for p in patterns))


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def banded(r: Column, above: float, factor: float) -> Column:
    return F.when(r > above, F.least(r, F.lit(1.0))).otherwise(r * factor)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: p != "")


def kept_share(a: Column, b: Column) -> Column:
    """The share of a's distinct items that b has."""
    distinct = F.array_distinct(a)
    return F.size(F.array_intersect(distinct, b)) / F.size(distinct)


def semantic_preservation(a: Column, b: Column) -> Column:
    """Twice the Jaccard similarity of both texts' words, 1 at most."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return (
        F.when(F.size(x) == 0, F.when(F.size(y) == 0, 1.0).otherwise(0.0)).when(F.size(y) == 0, 0.0)
        .otherwise(F.least(F.lit(1.0), 2.0 * F.size(F.array_intersect(x, y)) / union))
    )


def accuracy(a: Column, b: Column) -> Column:
    length = ratio(F.length(strip(b)), F.length(strip(a)))
    size = F.when(length < 0.3, 0.1).when(length < 0.6, 0.6).when(length < 1.5, 1.0).otherwise(0.8)
    said = banded(ratio(F.size(sentences(b)), F.size(sentences(a))), 0.7, 0.8)
    score = size * 0.3 + said * 0.3 + semantic_preservation(a, b) * 0.4
    return F.when((strip(a) == "") | (strip(b) == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def completeness(a: Column, b: Column) -> Column:
    paras = banded(ratio(F.size(paragraphs(b)), F.size(paragraphs(a))), 0.8, 0.9)
    said = banded(ratio(F.size(tokens(b)), F.size(tokens(a))), 0.7, 0.8)
    return (paras + said) / 2


def numerical_integrity(a: Column, b: Column) -> Column:
    x, y = (F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("."))) for c in (a, b))
    return F.when(F.size(x) == 0, F.when(F.size(y) == 0, 1.0).otherwise(0.9)).otherwise(kept_share(x, y))


def unit_preservation(a: Column, b: Column) -> Column:
    x, y = (F.transform(F.regexp_extract_all(c, F.lit(UNIT), F.lit(0)), lambda n: F.replace(F.lower(n), F.lit(" "), F.lit(""))) for c in (a, b))
    return F.when(F.size(x) == 0, 1.0).otherwise(kept_share(x, y))


def medical_terms(a: Column, b: Column) -> Column:
    x, y = (F.transform(found(c, MEDICAL), F.lower) for c in (a, b))
    return F.when(F.size(x) == 0, 1.0).otherwise(F.least(F.lit(1.0), kept_share(x, y) * 1.2))


def term_consistency(x: Column, y: Column) -> Column:
    """Over the distinct terms of x, the mean of the smaller count by the larger one; 1 if neither has terms."""
    distinct = F.array_distinct(x)
    count = lambda items, t: F.size(F.filter(items, lambda i: i == t))
    total = F.aggregate(distinct, F.lit(0.0), lambda s, t: s + F.least(count(x, t), count(y, t)) / F.greatest(count(x, t), count(y, t)))
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(total / F.size(distinct))
    )


def statistical_terms(a: Column, b: Column) -> Column:
    x, y = found(a, STATISTICAL), found(b, STATISTICAL)
    return F.when(F.size(x) == 0, 1.0).otherwise(term_consistency(x, y))


#: Numbers with units, with times, and bare or as ranges (fixed values).
NUMERICAL = (
    r"\b\d+(?:[.,]\d+)*\s*(?:mg|kg|ml|mcg|µg|IU|units?|%|percent)\b", r"\b\d+(?:[.,]\d+)*\s*(?:months?|weeks?|days?|years?|hours?)\b",
    r"\b\d+(?:[.,]\d+)*(?:\s*[-–]\s*\d+(?:[.,]\d+)*)?%?\b",
)


def consistency(a: Column, b: Column) -> Column:
    """The mean over medical, statistical and numerical terms, each term counted once."""
    kinds = (MEDICAL, STATISTICAL, NUMERICAL)
    return sum(term_consistency(F.array_distinct(found(a, k)), F.array_distinct(found(b, k))) for k in kinds) / len(kinds)


#: Frequent English words that a fluent text has one of (fixed values).
ENGLISH_MARKERS = (
    "the and of to a in is it that for on with as be at by this have from or one had but not what all were they we when your "
    "can said there use an each which she do how their if will up other about out many then them would so some her him into "
    "has more two go no way could my than first been who oil its now find long down day did get make may"
).split()


def fluency(c: Column, is_english: Column) -> Column:
    """.3 for another language (.5 where is_english is null), .8 for no frequent English word, no closing mark and no
    capitalised word each, the share of sentences with three words or more, .6 for few distinct words."""
    said = F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda s: s != "")
    whole = F.size(F.filter(said, lambda s: F.size(tokens(s)) >= 3)) / F.greatest(F.size(said), F.lit(1))
    score = F.when(is_english.isNull(), 0.5).when(is_english, 1.0).otherwise(0.3)
    for marker in (r"\b(?:" + "|".join(ENGLISH_MARKERS) + r")\b", r"[.!?]", r"\b[A-Z][a-z]+\b"):
        score = score * F.when(c.rlike(marker), 1.0).otherwise(0.8)
    few = (F.size(F.array_distinct(tokens(c))) / F.greatest(F.size(tokens(c)), F.lit(1)) < 0.5) & (F.size(tokens(c)) > 10)
    return F.when(strip(c) == "", 0.0).otherwise(score * whole * F.when(few, 0.6).otherwise(1.0))


def content_preservation(a: Column, b: Column) -> Column:
    words = ratio(F.size(tokens(b)), F.size(tokens(a)))
    score = F.when(words < 0.4, words * 0.5).when(words < 0.7, words * 0.8).otherwise(F.least(words, F.lit(1.0)))
    return F.when((strip(a) == "") | (strip(b) == ""), 0.0).otherwise(score)


def format_agreement(ha: Column, hb: Column, a: Column, b: Column) -> Column:
    """One chunk: .7 where only one has a heading, .8 where only one is a table."""
    has = lambda h: F.coalesce(h, F.lit("")) != ""
    return F.when(has(ha) != has(hb), 0.7).otherwise(1.0) * F.when(is_table_text(a) != is_table_text(b), 0.8).otherwise(1.0)


def linguistic(fluent: Column, accurate: Column, consistent: Column, complete: Column) -> Column:
    return fluent * 0.3 + accurate * 0.3 + consistent * 0.2 + complete * 0.2


def domain(medical: Column, numeric: Column, statistic: Column, unit: Column) -> Column:
    return medical * 0.3 + numeric * 0.3 + statistic * 0.2 + unit * 0.2


def structural(form: Column, integrity: Column, architecture: Column) -> Column:
    return form * 0.4 + integrity * 0.4 + architecture * 0.2
