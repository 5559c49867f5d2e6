"""Pages to documents: reading order, titles, headings by containment, the plain fallback, table passes, semantic chunks,
and the expansion and classing of outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as B
from ..functions import text as T
from .ruled import merged

# Titles of tables, and words that make a short line one (fixed values).
TITLES = (
    r"^\s*Table\s+\d+", r"^\s*Designation\s+of\s+the\s+therapy", r"^\s*Treatment\s+(?:costs|mode|schedule)",
    r"^\s*Medicinal\s+product\s+to\s+be\s+assessed", r"^\s*Appropriate\s+comparator\s+therapy", r"^\s*Consumption:?", r"^\s*Costs:?",
)
TITLE_WORDS = ("treatment", "therapy", "medicinal", "costs", "dosage", "consumption")


def reading_order(words: DataFrame, page: Sequence[str], boundaries: Column, tolerance: float = 3.0) -> DataFrame:
    """Words (text, x0, top) with column (from 1, by the boundaries between columns, ascending) and place in reading order:
    column by column, then down, then across; tops within the tolerance of a grid are one line."""
    column = F.size(F.filter(boundaries, lambda b: b <= F.col("x0"))) + 1
    order = Window.partitionBy(*page).orderBy("column", F.floor(F.col("top") / tolerance), "x0", "text")
    return words.withColumn("column", column).withColumn("place", F.row_number().over(order))


def table_title(lines: DataFrame, page: Sequence[str], line_no: str = "line_no", text: str = "text") -> DataFrame:
    """The last line of each page that reads like a table's title, or has a word of one in 100 characters at most."""
    fits = B.any_of(F.col(text), TITLES) | (T.contains_any(F.col(text), TITLE_WORDS) & (F.length(text) <= 100))
    return lines.where(fits).groupBy(*page).agg(F.trim(F.max_by(text, line_no)).alias("title"))


def mark_headings(lines: DataFrame, headings: DataFrame, page: Sequence[str], line: str = "line", heading: str = "heading") -> DataFrame:
    """lines with is_heading: the line holds the text of one of its page's headings. The headings of a page are gathered
    first, so that each line meets one row."""
    listed = headings.where(F.trim(heading) != "").groupBy(*page).agg(F.collect_set(heading).alias("listed"))
    joined = lines.join(listed, list(page), "left")
    return joined.withColumn("is_heading", F.coalesce(F.exists("listed", lambda h: F.contains(F.col(line), h)), F.lit(False))).drop("listed")


def fallback_sections(pages: DataFrame, key: str, page: str = "page", text: str = "text", cut: int = 5) -> DataFrame:
    """Sections of pages that are plain text: a page starts one if one of its first five lines has at most seven words and
    is in capitals, or has a digit among its first three characters and doesn't begin with "page"; and `cut` pages after
    the last start one begins in any case. Columns: key, section, heading, text, start_page, end_page."""
    first = F.slice(F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != ""), 1, 5)
    capitals = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    looks = lambda x: (F.size(T.tokens(x)) <= 7) & (capitals(x) | (F.substring(x, 1, 3).rlike(r"\d") & ~F.lower(x).startswith("page")))
    found = F.get(F.filter(first, looks), F.lit(0))
    rows = pages.select(key, F.col(page).alias("page"), F.col(text).alias("text"), found.alias("h"))
    # pages since the last start with a heading; every `cut` of them a section begins
    order = Window.partitionBy(key).orderBy("page", "text", "h")
    runs = rows.withColumn("run", F.count("h").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("n", F.row_number().over(Window.partitionBy(key, "run").orderBy("page", "text", "h")))
    numbered = runs.withColumn("section", F.sum(F.when((F.col("n") - 1) % cut == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    heading = F.max(F.when(F.col("n") == 1, F.col("h")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", "text", "h"))), lambda p: p["text"])
    return numbered.groupBy(key, "section").agg(
        F.coalesce(heading, F.lit("")).alias("heading"), F.array_join(texts, "\n").alias("text"), F.min("page").alias("start_page"), F.max("page").alias("end_page")
    )


def detect_tables(tables: DataFrame, key: str, page: str, table: str = "t", lines: str = "ruled") -> DataFrame:
    """Tables with the pass (1 to 3) that accepts them: later passes look only at pages where none before found anything,
    and the second one only at documents with a table of the first."""
    valid = [B.is_valid(F.col("scores"), F.col(lines), n) for n in (1, 2, 3)]
    scored = tables.withColumn("scores", B.scores(F.col(table))).select("*", *(v.alias(f"v{n}") for n, v in enumerate(valid, 1))).drop("scores")
    on_page, in_doc = Window.partitionBy(key, page), Window.partitionBy(key)
    scored = scored.withColumn("p1", F.max(F.col("v1").cast("int")).over(on_page)).withColumn("d1", F.max(F.col("v1").cast("int")).over(in_doc))
    second = (F.col("p1") == 0) & (F.col("d1") == 1) & F.col("v2")
    scored = scored.withColumn("p2", F.max(second.cast("int")).over(on_page))
    taken = F.when(F.col("v1"), 1).when(second, 2).when((F.col("p1") == 0) & (F.col("p2") == 0) & F.col("v3"), 3)
    return scored.withColumn("pass", taken).where(F.col("pass").isNotNull()).drop("v1", "v2", "v3", "p1", "d1", "p2")


def table_summary(tables: DataFrame, key: str, page: str) -> DataFrame:
    """For each document: tables, by flag and by pass, and a map from page to the number of tables."""
    flagged = ("contains_pricing", "contains_dosage", "contains_medication")
    counts = tables.groupBy(key, page).agg(F.count("*").alias("n"), *(F.count_if(F.col(f)).alias(f) for f in flagged), *(F.count_if(F.col("pass") == n).alias(f"pass_{n}") for n in (1, 2, 3)))
    return counts.groupBy(key).agg(
        F.sum("n").alias("tables"), *(F.sum(f).alias(f) for f in flagged), *(F.sum(f"pass_{n}").alias(f"pass_{n}") for n in (1, 2, 3)),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(page, "n")))).alias("by_page"),
    )


def merged_rules(positions: Column, gap: float) -> Column:
    """Sorted positions of ruled lines, those within gap of the last kept one left out (see operators/ruled.py)."""
    return merged(F.array_sort(positions), F.lit(gap))


def semantic_chunks(sentences: DataFrame, by: Sequence[str], order: str, text: str, vector: str, least: int, share: float = 0.75) -> DataFrame:
    """Sentences joined to chunks: a chunk ends where the cosine distance to the next sentence is above the document's
    percentile `share`, unless it would have fewer than `least` characters. Columns: by, chunk (from 1), text."""
    upto = Window.partitionBy(*by).orderBy(order)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    before = F.lag(vector).over(upto)
    cosine = dot(F.col(vector), F.col("before")) / F.sqrt(dot(F.col(vector), F.col(vector)) * dot(F.col("before"), F.col("before")))
    rows = sentences.withColumn("before", before).withColumn("distance", F.when(F.col("before").isNotNull(), 1 - cosine)).drop("before")
    limits = rows.groupBy(*by).agg(F.percentile("distance", F.lit(share)).alias("limit"), F.array_sort(F.collect_list(F.struct(order, "distance", F.col(text).alias("t")))).alias("ss"))

    def step(state: Column, s: Column) -> Column:
        """Only the place where each chunk begins is kept, and how long the last one is."""
        new = (state["n"] == 0) | ((s["distance"] > state["limit"]) & (state["length"] >= least))
        return F.struct(
            state["limit"].alias("limit"), (state["n"] + 1).alias("n"),
            F.when(new, F.length(s["t"])).otherwise(state["length"] + 1 + F.length(s["t"])).alias("length"),
            F.when(new, F.concat(state["starts"], F.array(state["n"] + 1))).otherwise(state["starts"]).alias("starts"),
        )

    start = F.struct(F.col("limit"), F.lit(0).alias("n"), F.lit(0).alias("length"), F.array().cast("array<int>").alias("starts"))
    folded = limits.select(*by, F.transform("ss", lambda s: s["t"]).alias("ts"), F.aggregate("ss", start, step, lambda s: s["starts"]).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("ts") + 1))
    chunks = F.zip_with("starts", ends, lambda a, b: F.array_join(F.slice("ts", a, b - a), " "))
    return folded.select(*by, F.posexplode(chunks).alias("pos", "c")).select(*by, (F.col("pos") + 1).alias("chunk"), F.col("c").alias(text))


def cover_budget(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, items: str, budget: int, most: int, over: float = 1.1) -> DataFrame:
    """Rows whose items add something, in order, while their tokens stay within the budget; one that adds may overshoot up
    to `over` times the budget. A fold over each group's first `most` rows. Columns: by, place, tokens."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("place", place).where(F.col("place") <= most).withColumn("tokens", T.token_count(F.col(text)))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "tokens", F.col(items).alias("items")))).alias("rs"))
    words, picked = dict(df.dtypes)[items], "array<struct<place:int,tokens:int>>"

    def step(s: Column, r: Column) -> Column:
        new = F.size(F.array_except(r["items"], s["covered"])) > 0
        total = s["total"] + r["tokens"]
        take = (total <= budget) | (new & (total <= budget * over))
        more = F.concat(s["kept"], F.array(F.struct(r["place"].alias("place"), r["tokens"].alias("tokens"))))
        return F.struct(
            F.when(take, more).otherwise(s["kept"]).cast(picked).alias("kept"),
            F.when(take, F.array_union(s["covered"], r["items"])).otherwise(s["covered"]).cast(words).alias("covered"),
            F.when(take, total).otherwise(s["total"]).alias("total"),
        )

    start = F.struct(F.array().cast(picked).alias("kept"), F.array().cast(words).alias("covered"), F.lit(0).alias("total"))
    return lists.select(*by, F.explode(F.aggregate("rs", start, step, lambda s: s["kept"])).alias("k")).select(*by, "k.*")


def split_outcomes(df: DataFrame, column: str = "outcomes") -> DataFrame:
    """A row for each item of a comma-separated list, trimmed, without empty ones."""
    items = F.filter(F.transform(F.split(column, ","), lambda x: T.strip(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return df.withColumn("outcome", F.explode(items)).drop(column)


def class_outcomes(rows: DataFrame, dictionary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Outcomes by category and subcategory of the dictionary (name, canonical, category, subcategory; names in lower
    case), synonyms merged under their canonical name, unlisted ones under other; with the sorted countries that report
    them and how often."""
    named = rows.withColumn("name", F.lower("outcome")).join(dictionary, "name", "left")
    columns = [F.coalesce("canonical", "name").alias("outcome"), F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("subcategory", F.lit("other")).alias("subcategory")]
    flat = named.select(*by, "country", *columns)
    return flat.groupBy(*by, "category", "subcategory", "outcome").agg(F.array_sort(F.collect_set("country")).alias("countries"), F.count("*").alias("n"))


def attribute_outcomes(outcomes: DataFrame, countries: DataFrame) -> DataFrame:
    """Outcomes (outcome, reported_by: an array of country and source_type, or null) as records: of those that say who
    reports them, these; others count for every country and source type of the study."""
    said = outcomes.where(F.size("reported_by") > 0).select("outcome", F.explode("reported_by").alias("r")).select("outcome", "r.country", "r.source_type")
    rest = outcomes.where(F.coalesce(F.size("reported_by"), F.lit(0)) <= 0).select("outcome")
    listed = countries.agg(F.collect_set(F.struct("country", "source_type")).alias("l"))
    all_ = rest.crossJoin(F.broadcast(listed)).select("outcome", F.explode("l").alias("r")).select("outcome", "r.country", "r.source_type")  # one row of names
    return said.unionByName(all_)
