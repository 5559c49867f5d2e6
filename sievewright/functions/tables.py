"""Column functions over tables, array<array<string>>: cleaning, scores, headers and row narratives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, tokens

# Patterns of the scores (fixed values).
DOSAGE = (
    r"\d+\s*mg(?:/m²)?(?:\s|$)", r"\d+\s*μg(?:\s|$)", r"\d+\s*ml(?:\s|$)",
    r"\d+\s*(?:mg|μg|ml|g)\s*(?:daily|per\s+day|twice\s+daily)", r"cycle\s+\d+", r"\d+\s*x\s*daily", r"every\s+\d+\s+(?:days|weeks)",
)
PRICING = (r"€\s*\d+(?:[.,]\d+)?", r"\d+(?:[.,]\d+)?\s*€", r"\$\s*\d+(?:[.,]\d+)?", r"cost(?:s)?", r"price(?:s)?", r"treatment\s+cost")
MEDICAL = (
    r"designation\s+of\s+therapy", r"medicinal\s+product", r"appropriate\s+comparator", r"consumption",
    r"treatment\s+(?:mode|schedule)", r"therapeutic\s+indication",
)
NUMERIC_LIKE = (r"\d+([.,]\d+)?", r"\d+([.,]\d+)?\s*[%€$£¥]", r"\d+([.,]\d+)?\s*[-–]\s*\d+([.,]\d+)?", r"[<>=≤≥]\s*\d+([.,]\d+)?")
TABLE_LIKE = (r"[€$£¥]\s*\d+|(\d+[.,]\d*\s*[%€$£¥])", r"[<>=≤≥]\s*\d+|p\s*[<>=]\s*\d", r"(?i)\d+\s*(mg|ml|kg|%|mm|cm|years?|days?)\b")
HEADER_WORDS = (
    "name type value result outcome dose drug treatment group arm study n= patient endpoint efficacy safety adverse event"
).split()
#: Weights of structure, content, lines and domain, and the least score, by level of validation.
LEVELS = {1: ((0.4, 0.4, 0.2, 0.0), 0.6), 2: ((0.4, 0.4, 0.2, 0.0), 0.5), 3: ((0.3, 0.3, 0.1, 0.3), 0.4)}


def any_of(c: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    return c.rlike(flags + "(?:" + "|".join(patterns) + ")")


def clean(t: Column) -> Column:
    """Null cells as empty, white space collapsed, rows without a filled cell dropped."""
    tidy = lambda c: F.when(c.rlike(r"\s\s|[^\S ]|^ | $"), strip(F.regexp_replace(c, r"\s+", " "))).otherwise(F.coalesce(c, F.lit("")))
    cells = F.transform(t, lambda row: F.transform(row, tidy))
    return F.filter(cells, lambda row: F.exists(row, lambda c: c != ""))


def filled(t: Column) -> Column:
    return F.filter(F.transform(F.flatten(t), lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")


def structure_score(t: Column) -> Column:
    """1 for 3 to 50 rows, a first row of 2 to 10 cells, a row length that 70 % share, and 30 to 95 % of cells filled."""
    common = let(F.transform(t, F.size), lambda sizes: F.array_max(F.transform(F.array_distinct(sizes), lambda n: F.size(F.filter(sizes, lambda m: m == n)))))
    density = F.size(filled(t)) / F.greatest(F.size(F.flatten(t)), F.lit(1))
    shape = F.size(t).between(3, 50) & F.size(F.get(t, F.lit(0))).between(2, 10)
    return F.when(shape & (common / F.size(t) >= 0.7) & density.between(0.3, 0.95), 1.0).otherwise(0.0)


def is_numeric(c: Column) -> Column:
    """Numbers without blanks and commas, percentages, comparisons and ranges."""
    plain = F.regexp_replace(strip(c), "[, ]", "")
    number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return plain.rlike(f"^{number}%?$") | strip(c).rlike(r"^[<>=≤≥]\s*[\d.,]+$") | strip(c).rlike(r"^\d+\.?\d*[-–]\d+\.?\d*$")


def is_numeric_like(c: Column) -> Column:
    return c.rlike("^(?:" + "|".join(NUMERIC_LIKE) + ")$")


def content_score(t: Column) -> Column:
    return let(filled(t), score_of_cells)


def score_of_cells(cells: Column) -> Column:
    n = F.size(cells)
    numeric = F.size(F.filter(cells, is_numeric_like)) / n
    short = F.size(F.filter(cells, lambda c: F.size(tokens(c)) <= 5)) / n
    sample = F.array_join(F.slice(cells, 1, 20), " ")
    score = (
        F.when(numeric > 0.3, 0.4).when(numeric > 0.1, 0.2).otherwise(0.0)
        + F.when(short > 0.7, 0.3).when(short > 0.5, 0.15).otherwise(0.0)
        + F.when(any_of(sample, TABLE_LIKE, ""), 0.3).otherwise(0.0)
    )
    return F.when(n < 6, 0.0).otherwise(F.least(score, F.lit(1.0)))


def domain_score(t: Column) -> Column:
    def score(text: Column) -> Column:
        found = F.struct(any_of(text, DOSAGE).alias("dosage"), any_of(text, PRICING).alias("pricing"), any_of(text, MEDICAL).alias("medical"))
        return let(found, lambda f: f["dosage"].cast("int") * 0.4 + f["pricing"].cast("int") * 0.4 + f["medical"].cast("int") * 0.2 + (f["dosage"] & f["pricing"]).cast("int") * 0.2)

    return F.least(let(F.lower(F.array_join(filled(t), " ")), score), F.lit(1.0))


def scores(t: Column) -> Column:
    """The scores that all levels weigh, as one struct, so that a caller computes them once."""
    return F.struct(structure_score(t).alias("structure"), content_score(t).alias("content"), domain_score(t).alias("domain"))


def is_valid(s: Column, lines: Column, level: int) -> Column:
    """Does the weighted sum of scores pass the level? lines: the score of ruled lines, 0 to 1."""
    (a, b, c, d), least = LEVELS[level]
    return s["structure"] * a + s["content"] * b + lines * c + s["domain"] * d > least


def headers(t: Column) -> Column:
    """The first row as headers, empty cells named Column_n, if it looks like headers; else null."""
    first, second = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    named = F.exists(first, lambda c: any_of(c, tuple(HEADER_WORDS)))
    brief = F.forall(first, lambda c: F.size(tokens(c)) <= 4)
    numbers = F.coalesce(F.exists(second, lambda c: is_numeric(c)), F.lit(False))
    names = F.transform(first, lambda c, i: F.when(c == "", F.concat(F.lit("Column_"), (i + 1).cast("string"))).otherwise(c))
    return F.when(named | brief | numbers, names)


def labels(names: Column) -> Column:
    """Headers as they stand before a cell, once a table: without spaces and colons at their ends."""
    return F.transform(names, lambda h: F.concat(F.rtrim(strip(h), F.lit(":")), F.lit(": ")))


def row_text(before: Column, row: Column, n: Column) -> Column:
    """Row n: header: cell; two pairs joined by "and", more by commas and a last ", and". Empty cells are left out, and
    cells without a header; null if no pair is left. before: labels; cells are clean."""
    pair = lambda h, c: F.when(c != "", F.concat(h, c))
    return let(F.array_compact(F.zip_with(before, row, pair)), lambda pairs: pairs_text(pairs, n))


def pairs_text(pairs: Column, n: Column) -> Column:
    k = F.size(pairs)
    told = (
        F.when(k == 1, F.get(pairs, F.lit(0)))
        .when(k == 2, F.array_join(pairs, " and "))
        .otherwise(F.concat(F.array_join(F.slice(pairs, 1, F.greatest(k - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(pairs, -1)))
    )
    return F.when(k > 0, F.concat(F.lit("Row "), n.cast("string"), F.lit(": "), told))


def bare_row_text(row: Column, n: Column) -> Column:
    cells = F.filter(row, lambda c: c != "")
    quoted = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    label = F.concat(F.lit("Row "), n.cast("string"))
    one = F.concat(label, F.lit(": "), F.get(cells, F.lit(0)))
    return F.when(F.size(cells) == 1, one).when(F.size(cells) > 1, F.concat(label, F.lit(" contains: "), quoted))


def narrative(t: Column, title: Column) -> Column:
    """A table as text: title, columns and a line for each row. Rows are cleaned and headers found once a table."""
    return let(clean(t), lambda rows: let(headers(rows), lambda names: told(rows, names, title)))


def told(rows: Column, names: Column, title: Column) -> Column:
    head = F.when(title.isNotNull() & (title != ""), F.concat(F.lit("Table Title: "), title, F.lit("\n\n"))).otherwise(F.lit(""))
    body = let(labels(names), lambda before: F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r, i: row_text(before, r, i + 1)))
    columns = F.concat(F.lit("Table contains the following columns: "), F.array_join(names, ", "))
    with_names = F.array_join(F.concat(F.array(columns), F.array_compact(body)), "\n")
    bare = F.array_join(F.array_compact(F.transform(rows, lambda r, i: bare_row_text(r, i + 1))), "\n")
    return F.when(F.size(rows) == 0, "").otherwise(F.concat(head, F.when(names.isNotNull(), with_names).otherwise(bare)))


def content_class(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike(r"cost|price|€|\$"), "pricing").when(low.rlike(r"\d+\s*(?:mg|μg|ml)"), "dosage")
        .when(low.rlike("patient|study|trial"), "clinical_data").when(low.rlike("treatment|therapy|medicinal"), "treatment_info").otherwise("general")
    )


def flags(text: Column) -> list[Column]:
    return [
        text.rlike(r"(?i)\d+\s*(?:mg|μg|ml)").alias("contains_dosage"),
        text.rlike(r"(?i)[€$]\s*\d+|cost|price").alias("contains_pricing"),
        text.rlike("(?i)sorafenib|lenvatinib|treatment|therapy").alias("contains_medication"),
    ]


def relationships(dosage: Column, pricing: Column, medication: Column) -> Column:
    return F.array_compact(
        F.array(F.when(dosage & medication, "drug-dose"), F.when(pricing & medication, "drug-cost"), F.when(dosage, "dose-frequency"))
    )


#: Patterns of text that holds a table (fixed values).
TABLE_TEXT = (
    r"(?:Row|Column)\s+\d+[:\s]", r"Table\s+(?:Title|contains|shows)", r"\|\s*[^|\n]+\s*\|\s*[^|\n]+\s*\|",
    r"€\s*\d+(?:[.,]\d+)*", r"\d+(?:[.,]\d+)*\s*€",
)
PIPE_SHARE, NUMBER_SHARE = 0.05, 0.3


def is_table_text(c: Column) -> Column:
    """Row labels, table words, lines with several pipes, prices; or many pipes over five lines, or numbers for three in ten words."""
    pipes = (F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))) / F.greatest(F.length(c), F.lit(1))
    numbers = F.regexp_count(c, F.lit(r"\d+(?:\.\d+)?")) / F.greatest(F.size(tokens(c)), F.lit(1))
    return any_of(c, TABLE_TEXT) | ((F.size(F.split(c, "\n")) >= 5) & (pipes > PIPE_SHARE)) | (numbers > NUMBER_SHARE)
