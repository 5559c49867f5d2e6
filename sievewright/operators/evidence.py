"""Evidence records: consolidation by exact key, splits, set overlaps, pivots, roll-ups and layout statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ruled import merged


def consolidate(df: DataFrame, keys: Sequence[str], sets: dict[str, str]) -> DataFrame:
    """One row for each trimmed key: the sorted distinct values of the columns in sets (new name: column) and
    occurrence_count. An empty key part is a value."""
    trimmed = df.select(*(F.trim(F.coalesce(k, F.lit(""))).alias(k) for k in keys), *(F.col(c).alias(f"set {n}") for n, c in sets.items()))
    return trimmed.groupBy(*keys).agg(
        *(F.array_sort(F.collect_set(f"set {n}")).alias(n) for n in sets), F.count("*").alias("occurrence_count")
    )


def in_split(df: DataFrame, split: DataFrame, column: str) -> DataFrame:
    """Rows whose value the split (a column of the same name) lists; ALL in it, or an empty split, keeps every row."""
    everything = split.agg((F.count("*") == 0).alias("none"), F.coalesce(F.max(F.col(column) == "ALL"), F.lit(False)).alias("all"))
    kept = df.join(split.select(F.col(column).alias("listed")).distinct(), F.col(column) == F.col("listed"), "left")
    return kept.crossJoin(F.broadcast(everything)).where("none or all or listed is not null").drop("none", "all", "listed")


def latest(df: DataFrame, by: Sequence[str], time: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The row with the greatest time in each group, the greatest tie of equal ones: one aggregation, no window."""
    return df.groupBy(*by).agg(F.max(F.struct(time, tie, *columns)).alias("r")).select(*by, "r.*")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """A count for each row value and each listed column value, 0 where there is none."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Every value of either side with where it occurs: a, b or both."""
    tagged = a.select(column).withColumn("in_a", F.lit(True)).unionByName(b.select(column).withColumn("in_a", F.lit(False)))
    out = tagged.where(F.col(column).isNotNull()).groupBy(column).agg(F.bool_or("in_a").alias("a"), F.bool_or(~F.col("in_a")).alias("b"))
    return out.select(column, F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "a").otherwise("b").alias("side"))


def set_overview(df: DataFrame, by: str, side: Column, item: str) -> DataFrame:
    """For each group the sorted union, intersection and difference of the item sets of side true and false, with sizes."""
    sets = df.withColumn("side", side).groupBy(by).agg(
        F.array_sort(F.collect_set(F.when(F.col("side"), F.col(item)))).alias("x"), F.array_sort(F.collect_set(F.when(~F.col("side"), F.col(item)))).alias("y")
    )
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select(
        by, text(F.array_union("x", "y")).alias("all_items"), text(F.array_intersect("x", "y")).alias("shared"),
        text(F.array_except("x", "y")).alias("only_first"), F.size(F.array_union("x", "y")).alias("n_all"), F.size(F.array_intersect("x", "y")).alias("n_shared"),
    )


def group_stats(df: DataFrame, by: str, text: str, document: str, heading: str) -> DataFrame:
    """Rows, characters, distinct documents and distinct headings (empty ones left out) by group."""
    return df.groupBy(by).agg(
        F.count("*").alias("chunk_count"), F.sum(F.length(text)).alias("total_text_length"), F.countDistinct(document).alias("unique_documents"),
        F.countDistinct(F.when(F.trim(F.coalesce(heading, F.lit(""))) != "", F.col(heading))).alias("unique_headings"),
    )


def overlapping_stats(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """n, mean and population deviation over all rows and over each value of each group column: one pass, grouping sets."""
    sets = ", ".join(["()", *(f"({g})" for g in groups)])
    view = "overlapping_stats_rows"
    names = ", ".join(groups)
    return df.sparkSession.sql(
        f"SELECT {names}, count({value}) AS n, avg({value}) AS mean, stddev_pop({value}) AS sd FROM {{{view}}} GROUP BY GROUPING SETS ({sets})", **{view: df}
    )


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, the least of equal ones first."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def modal_values(df: DataFrame, by: str, column: str) -> DataFrame:
    """The most frequent value by group, the least of equal ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).count()
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(column).alias("v"))).alias("m")).select(by, F.col("m.v").alias("mode"), (-F.col("m.n")).alias("count"))


def with_zeros(counts: DataFrame, listed: DataFrame, column: str, n: str) -> DataFrame:
    """Counts for every listed value, 0 where there are none."""
    return listed.select(column).distinct().join(counts.select(column, n), column, "left").na.fill(0, [n])


def expand(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """A row for each combination of the arrays' items (new column: array); an empty array takes the row with it."""
    for name, array in arrays.items():
        df = df.withColumn(name, F.explode(array))
    return df.drop(*(a for n, a in arrays.items() if n != a))


def nested_count(c: Column) -> Column:
    """How many strings a map of maps of arrays holds; nulls hold none."""
    inner = lambda subs: F.aggregate(F.coalesce(F.map_values(subs), F.array().cast("array<array<string>>")), F.lit(0), lambda n, names: n + F.coalesce(F.array_size(names), F.lit(0)))
    return F.coalesce(F.aggregate(F.map_values(c), F.lit(0), lambda n, subs: n + inner(subs)), F.lit(0))


def zip_positions(a: DataFrame, b: DataFrame, by: Sequence[str], order_a: str, order_b: str) -> DataFrame:
    """Rows of both sides with the same place in their group; the longer side's rest is left out."""
    pos = lambda d, o: d.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(o)))
    return pos(a, order_a).join(pos(b, order_b), [*by, "pos"])


def unseen(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, modified, length) whose signature the manifest (path, signature) lacks."""
    signed = files.withColumn("signature", F.concat_ws("_", F.col("modified").cast("string"), F.col("length").cast("string")))
    return signed.join(manifest, ["path", "signature"], "left_anti")


# --- layout -----------------------------------------------------------------------------------------------------------


def heading_scores(lines: DataFrame, page: Sequence[str]) -> DataFrame:
    """Lines (size, top, bottom, bold_share, text) with heading_score and is_heading (5 or more): font size against the
    page's median, capitals, length, bold type, numbering, and the space above and below."""
    order = Window.partitionBy(*page).orderBy("top", "bottom", "size", "bold_share", "text")
    step = lambda c, high, low: F.when(c >= high, 2).when(c >= low, 1).otherwise(0)
    more = lambda c, high, low: F.when(c > high, 2).when(c > low, 1).otherwise(0)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.greatest(letters, F.lit(1))
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    above = F.coalesce(F.col("top") - F.lag("bottom").over(order), F.lit(100))
    below = F.coalesce(F.lead("top").over(order) - F.col("bottom"), F.lit(100))
    # lines are sorted once: what is sorted within pages is sorted by page, as the median wants it
    spaced = lines.withColumns({"above": above, "below": below})
    rows = spaced.withColumn("median", F.percentile("size", F.lit(0.5)).over(Window.partitionBy(*page)))
    above, below = F.col("above"), F.col("below")
    score = (
        step(F.col("size") / F.col("median"), 1.3, 1.1) + more(upper, 0.8, 0.6) + F.when(words < 6, 2).when(words < 12, 1).otherwise(0)
        + more(F.col("bold_share"), 0.7, 0.3) + F.when(F.col("text").rlike(r"^(\d+(\.\d+)*[.,)]?\s+)"), 2).otherwise(0)
        + F.when((above > 15) & (below > 10), 2).when((above > 10) | (below > 8), 1).otherwise(0)
    )
    return rows.withColumn("heading_score", score).withColumn("is_heading", F.col("heading_score") >= 5).drop("above", "below", "median")


def column_counts(words: DataFrame, page: Sequence[str], x: str = "x0", bins: int = 20, share: float = 0.1) -> DataFrame:
    """For each page the number of text columns: of the bins between the least and the greatest x, those with fewer than
    `share` of the fullest one's words are gaps, and every gap ends a column. Also gaps, the gaps' bins in order."""
    ends = words.groupBy(*page).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.floor((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    bin_no = F.when(F.col("hi") == F.col("lo"), bins // 2).otherwise(F.least(at, F.lit(bins - 1))).cast("int")
    counts = words.join(ends, list(page)).groupBy(*page, bin_no.alias("bin")).count()
    filled = F.filter(F.collect_list(F.struct("bin", "count")), lambda b: b["count"] >= F.max("count") * share)
    out = counts.groupBy(*page).agg(F.transform(filled, lambda b: b["bin"]).alias("filled"))
    gaps = F.array_except(F.sequence(F.lit(0), F.lit(bins - 1)), "filled")
    return out.select(*page, (F.size(gaps) + 1).alias("columns"), gaps.alias("gaps"))


def grid_pages(segments: DataFrame, page: Sequence[str]) -> DataFrame:
    """Pages whose line segments (x0, x1, y0, y1) look like a grid: six or more, three wide and flat, two high and narrow,
    and 30 % of the first five by four crossing."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when((wide > 100) & (high < 3), "h").when((high > 30) & (wide < 3), "v")
    rows = segments.withColumn("kind", kind)
    counts = rows.groupBy(*page).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "h").alias("nh"), F.count_if(F.col("kind") == "v").alias("nv"))
    counts = counts.where("n >= 6 and nh >= 3 and nv >= 2")
    place = F.row_number().over(Window.partitionBy(*page, "kind").orderBy("y0", "x0", "y1", "x1"))
    rows = rows.where("kind is not null").withColumn("place", place)
    h = rows.where("kind = 'h' and place <= 5").select(*page, F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y0").alias("hy"))
    v = rows.where("kind = 'v' and place <= 4").select(*page, F.col("y0").alias("vy0"), F.col("y1").alias("vy1"), F.col("x0").alias("vx"))
    pairs = h.join(v, list(page)).withColumn("crosses", F.col("vx").between(F.col("hx0"), F.col("hx1")) & F.col("hy").between(F.col("vy0"), F.col("vy1")))
    crossing = pairs.groupBy(*page).agg(F.avg(F.col("crosses").cast("int")).alias("crossing"))
    return counts.join(crossing, list(page)).where("crossing >= 0.3").select(*page, "n", "crossing")


def words_to_lines(words: DataFrame, page: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """Words (text, x0, top) joined to lines: a word within the tolerance of its line's first word belongs to the line.
    Columns: page, line_no (from 1), top, text."""
    starts = words.groupBy(*page).agg(merged(F.array_sort(F.collect_set("top")), F.lit(tolerance)).alias("starts"))
    own = F.array_max(F.filter("starts", lambda s: s <= F.col("top")))
    rows = words.join(starts, list(page)).withColumn("line", own)
    lines = rows.groupBy(*page, "line").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("ws"))
    number = F.row_number().over(Window.partitionBy(*page).orderBy("line"))
    return lines.select(*page, number.alias("line_no"), "top", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"))
