"""Column functions over strings: line tests, cleaning, hints and similarity. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that results depend on (fixed values).
LINK = r"\(?(?:https?://|www\.)\S+\)?"
EMPTY_PARENTHESES = r"\(\s*\)"
CONTENTS = r"(?i)\bof\s+contents\b"
DOT_LINE = r"\.{5,}\s*\d+$"
FOOTNOTE_START = r"^(\[\d+\]|[\d\.]+)\b"
FOOTNOTE_SOURCES = r"(?i)(et al\.|Disponible en ligne|consulté le|NEJM|PubMed|doi)"
YEAR = r"\b(19|20)\d{2}\b"
KEY_NUMBER = r"\d+(?:[.,]\d+)?(?:\s*[€$%])?"
KEY_TERMS = ("sorafenib", "lenvatinib", "treatment", "therapy", "dose", "cost", "patient", "study")
SYMBOL_RUNS = (("$", "$"), ("#", "##"), ("@", "@"), ("+", "+"), ("*", "**"), ("=", "=="), ("-", "--"))
PUNCTUATION = "!?.:;,-_"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"
COMPARATOR_STOP_WORDS = ("the", "a", "an", "in", "on", "at", "for", "with", "by", "to", "of")
COMPARATOR_COMMON_WORDS = ("the", "and", "for", "with", "that", "this", "not", "are", "from", "was", "were")
DOSAGE = r"\b\w+\s+\d+\s*(?:mg|mcg|g|ml)\b"
DRUG_SUFFIX = r"\b\w+(?:mab|nib|zumab|tinib|ciclib|parib|vastatin)\b"
TABLE_HINT = r"(?i)table"
ROW_LABEL = r"Row \d+:"


def let(value: Column, use) -> Column:
    """use(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def tokens(c: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def remove_links(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, LINK, ""), EMPTY_PARENTHESES, ""))


def line_key(c: Column) -> Column:
    """The key that makes repeated lines equal: letters only, lower-cased; letters of any script count."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def is_contents_line(c: Column) -> Column:
    return c.rlike(CONTENTS)


def is_dot_line(c: Column) -> Column:
    return c.rlike(DOT_LINE)


def is_footnote_source(c: Column) -> Column:
    return c.rlike(FOOTNOTE_START) & c.rlike(FOOTNOTE_SOURCES)


def first_year(c: Column) -> Column:
    """The first year of the text, whole, or unknown_year."""
    found = F.regexp_extract(c, YEAR, 0)
    return F.when(found == "", "unknown_year").otherwise(found)


#: What a line says that names the date of a document (fixed values).
DATE_TRIGGERS = (
    "submission date", "submitted on", "report date", "date of submission", "date of issue",
    "soumission", "data di presentazione", "fecha de presentación",
    "datum der einreichung", "fecha de remisión", "submitted:", "issued on", "rapport",
    "published:", "published", "publication date", "date of publication",
)


def submission_year(page: Column, triggers: Sequence[str] = DATE_TRIGGERS) -> Column:
    """The first year of the first line that has a trigger and a year, else the first year of the page, whole, or unknown_year. The
    page is a document's first one."""
    lines = F.split(page, r"\r\n|[\n\r]")
    said = F.filter(lines, lambda x: contains_any(x, triggers) & x.rlike(YEAR))
    return F.when(F.size(said) > 0, first_year(F.get(said, F.lit(0)))).otherwise(F.coalesce(first_year(page), F.lit("unknown_year")))


def key_numbers(c: Column, limit: int = 10) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit(KEY_NUMBER), F.lit(0)), 1, limit)


def key_terms(c: Column, terms: Sequence[str] = KEY_TERMS) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*(F.when(low.contains(t), F.lit(t)) for t in terms)))


def clean_symbols(c: Column, least: int = 5) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, f"\\{s[0]}{{{least},}}", s[1].replace("$", "\\$")), SYMBOL_RUNS, c)


def symbol_fixes(c: Column, least: int = 5) -> Column:
    """How many runs clean_symbols replaces."""
    return sum((F.regexp_count(c, F.lit(f"\\{s}{{{least},}}")) for s, _ in SYMBOL_RUNS), F.lit(0))


def clean_repetition(c: Column) -> Column:
    """Four or more equal words become two; three or more equal phrases of three words become one."""
    c = F.regexp_replace(c, r"(?U)\b(\w+)(?:,\s*\1){3,}", "$1, $1")
    c = F.regexp_replace(c, r"(?U)\b(\w+)(?:\s+\1){3,}", "$1 $1")
    return F.regexp_replace(c, r"(?U)\b(\w+\s+\w+\s+\w+)(?:\s+\1){2,}", "$1")


def clean_punctuation(c: Column, least: int = 4) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, f"[{chr(92)}{p}]{{{least},}}", p), PUNCTUATION, c)


#: What clean_repetition and clean_rows replace, in their order (fixed values).
REPETITION = ((r"(?U)\b(\w+)(?:,\s*\1){3,}", "$1, $1"), (r"(?U)\b(\w+)(?:\s+\1){3,}", "$1 $1"), (r"(?U)\b(\w+\s+\w+\s+\w+)(?:\s+\1){2,}", "$1"))
ROW_FAULTS = ((r"Low (\d+):", "Row $1:"), (r"(Row \d+:)\s*\1+", "$1"), (r"Row (\d+)!!+", "Row $1:"), (r"Row \d+:\s*(\n|$)", ""))


def counted(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """text and n: c after all replacements, and how many were made, each step counting in what the ones before it left."""

    def one(state: Column, step: tuple[str, str]) -> Column:
        return let(state, lambda s: F.struct(F.regexp_replace(s["text"], *step).alias("text"), (s["n"] + F.regexp_count(s["text"], F.lit(step[0]))).alias("n")))

    return reduce(one, steps, F.struct(c.alias("text"), F.lit(0).alias("n")))


def fix_counts(c: Column, table: Column, symbols: int = 5, punctuation: int = 4, repetition: Sequence[tuple[str, str]] = REPETITION) -> Column:
    """rows, symbols, repeated, punctuation and whitespace (0 or 1) fixes of a chunk, in the order in which clean_table_text (for tables) or
    clean_text makes them; null counts as empty. Later counts are of what the steps of `repetition` leave; without any, repeats stay."""
    labelled = lambda x: F.regexp_replace(x, r"(Row \d+:)(?!\s*\n)", "$1\n")
    start = F.coalesce(c, F.lit(""))
    signs = [(f"\\{s}{{{symbols},}}", r.replace("$", "\\$")) for s, r in SYMBOL_RUNS]
    dots = [(f"[{chr(92)}{p}]{{{punctuation},}}", p) for p in PUNCTUATION]

    def spaces(rows: Column, s: Column, r: Column, p: Column) -> Column:
        text = p["text"]
        tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" {2,}", " "), r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")
        return F.struct(rows.alias("rows"), s["n"].alias("symbols"), r["n"].alias("repeated"), p["n"].alias("punctuation"), (tidy != text).cast("int").alias("whitespace"))

    def after_rows(rows: Column) -> Column:
        text = F.when(table, labelled(rows["text"])).otherwise(start)
        n = F.when(table, rows["n"]).otherwise(0)
        return let(counted(text, signs), lambda s: let(counted(s["text"], repetition), lambda r: let(counted(r["text"], dots), lambda p: spaces(n, s, r, p))))

    return let(counted(start, ROW_FAULTS), after_rows)


def clean_heading(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"<([^<>]*)>", "$1"), ROW_LABEL + r"\s*", "")


def clean_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r" {2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]+\n", "\n"))


def clean_rows(c: Column) -> Column:
    """Row labels of tables told as text: misread, doubled, exclaimed and empty ones; then a new line after each label."""
    c = F.regexp_replace(c, r"Low (\d+):", "Row $1:")
    c = F.regexp_replace(c, r"(Row \d+:)\s*\1+", "$1")
    c = F.regexp_replace(c, r"Row (\d+)!!+", "Row $1:")
    c = F.regexp_replace(c, r"Row \d+:\s*(\n|$)", "")
    return F.regexp_replace(c, r"(Row \d+:)(?!\s*\n)", "$1\n")


def clean_text(c: Column, heading: bool = False) -> Column:
    c = clean_punctuation(clean_repetition(clean_symbols(c)))
    return clean_whitespace(clean_heading(c) if heading else c)


def clean_table_text(c: Column) -> Column:
    lines = F.transform(F.split(clean_text(clean_rows(c)), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^Row \d+:$")), "\n")


def is_table_chunk(heading: Column, text: Column) -> Column:
    return F.coalesce(heading, F.lit("")).rlike(TABLE_HINT) | F.coalesce(text, F.lit("")).rlike(ROW_LABEL)


def sentences(c: Column) -> Column:
    parts = F.flatten(F.transform(F.split(c, SENTENCE_BREAK), lambda x: F.split(x, r"\n\s*\n")))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def token_count(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Does the lower-cased text contain one of the terms as a substring?"""
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(or_, (low.contains(t.lower()) for t in terms), F.lit(False))


def count_terms(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms the lower-cased text contains."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((low.contains(t.lower()).cast("int") for t in dict.fromkeys(terms)), F.lit(0))


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("(?i)(?:" + "|".join(patterns) + ")")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def share_within(a: Column, b: Column) -> Column:
    """The share of a's items that b has; 0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def comparator_terms(c: Column) -> Column:
    """Capitalised first words of sentences, dosages and words with drug suffixes, without common words."""
    ws = tokens(c)
    # each word beside the one before it, so that no lambda reaches back into the whole array
    pairs = F.slice(F.zip_with(F.concat(F.array(F.lit(".")), ws), ws, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), 1, F.size(ws))
    first = F.filter(pairs, lambda p: p["a"].rlike(r"[.!?]$") & p["b"].rlike(r"^[.,;:()\[\]{}]*\p{Lu}"))
    starts = F.transform(first, lambda p: F.regexp_replace(p["b"], r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", ""))
    starts = F.filter(starts, lambda x: (F.length(x) > 1) & ~F.lower(x).isin(*COMPARATOR_STOP_WORDS))
    found = F.concat(starts, F.regexp_extract_all(c, F.lit(DOSAGE), F.lit(0)), F.regexp_extract_all(F.lower(c), F.lit(DRUG_SUFFIX), F.lit(0)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.lower(x).isin(*COMPARATOR_COMMON_WORDS))))


def enrich(heading: Column, source_type: Column, text: Column) -> Column:
    """The text behind its heading and source type, leaving out empty and unknown ones."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")).isin("", "unknown"), None).otherwise(F.concat(F.lit(f"**{name}:** "), c))
    head = F.concat_ws(" ", part("Heading", heading), part("Source Type", source_type))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def repair_json(c: Column) -> Column:
    """A model's answer without code fences, cut from the first brace to the last; null where there is none."""
    found = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(found == "", None).otherwise(found)


def file_name(c: Column) -> Column:
    """A name made of letters, digits, blanks, hyphens and underscores, blanks as underscores, lower case, 50 characters."""
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9 _-]", ""), " ", "_")), 1, 50)


def source_type(path: Column) -> Column:
    low = F.lower(F.url_decode(path))
    return (
        F.when(low.contains("hta submission"), "hta_submission").when(low.contains("clinical guideline"), "clinical_guideline").otherwise("unknown")
    )


#: Country codes that a folder may name (fixed values): member states, other European ones, regions and others in use.
COUNTRY_CODES = (
    "AT BE BG HR CY CZ DK EE FI FR DE EL GR HU IE IT LV LT LU MT NL PL PO PT RO SK SI ES SE "
    "CH NO IS UK GB UA RS ME MK AL BA MD XK LI EU EN INT AE TR"
).split()


def country(path: Column) -> Column:
    folder = F.element_at(F.split(path, "/"), -2)
    return F.when(folder.isin(*COUNTRY_CODES), folder).otherwise("unknown")


def year_from_path(path: Column) -> Column:
    return first_year(path)


def case_name(path: Column, cases: Sequence[str] = ("nsclc", "hcc", "sclc", "breast", "lung")) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.element_at(F.filter(parts, lambda x: x.isin(*cases)), 1)


def data_split(path: Column) -> Column:
    return F.when(path.contains("_train_"), "train").when(path.contains("_test_"), "test").otherwise("unknown")
