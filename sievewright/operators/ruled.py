"""Tables from ruled lines: line segments to rules, rules to crossings, crossings to cells, words to cells.

Lines are shuffled once, by page; what follows are aggregations and windows over rows that lie together, and one join, of cells and
words. Rules meet, and words find their cells, through bins of BIN points, so that pairs are made only where they can touch, also on
a page that holds many of all lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How long, how thin and how much longer than wide a rule is, and which gap separates two (points).
VERTICAL, HORIZONTAL = (25.0, 6.0, 8.0, 5.0), (40.0, 6.0, 12.0, 3.0)
#: How far from a rule's end another one still crosses it.
TOLERANCE = 2.0
BIN = 64.0


def candidates(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, kind (v or h), at, low, high of the segments (x0, y0, x1, y1) that are long and thin enough; others, and those with a null
    coordinate, are dropped."""
    width, height = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    long_v, thin_v, ratio_v, _ = VERTICAL
    long_h, thin_h, ratio_h, _ = HORIZONTAL
    kind = F.when((height > long_v) & (width < thin_v) & (height > width * ratio_v), "v").when((width > long_h) & (height < thin_h) & (width > height * ratio_h), "h")
    v = F.col("kind") == "v"
    ends = (F.when(v, F.col("y0")).otherwise(F.col("x0")), F.when(v, F.col("y1")).otherwise(F.col("x1")))
    rows = segments.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return rows.select(*by, "kind", F.when(v, F.col("x0")).otherwise(F.col("y1")).alias("at"), F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))


def merged(positions: Column, gap: Column) -> Column:
    """Of sorted positions those more than gap behind the last one kept; as many as fit on a page at most."""
    kind = "array<double>"
    step = lambda kept, p: F.when((F.size(kept) == 0) | (p - F.element_at(kept, -1) > gap), F.concat(kept, F.array(p))).otherwise(kept)
    return F.aggregate(positions.cast(kind), F.array().cast(kind), step)


def merged_lines(lines: Column, gap: Column) -> Column:
    """Of lines (at, low, high) sorted by `at` those more than gap behind the last one kept, with the reach of all that are part of them;
    as many as fit on a page at most."""
    line = "struct<at:double,low:double,high:double>"
    start = F.struct(F.array().cast(f"array<{line}>").alias("done"), F.lit(None).cast(line).alias("open"))
    close = lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))

    def step(s: Column, x: Column) -> Column:
        grown = F.struct(s["open"]["at"].alias("at"), F.least(s["open"]["low"], x["low"]).alias("low"), F.greatest(s["open"]["high"], x["high"]).alias("high"))
        apart = s["open"].isNull() | (x["at"] - s["open"]["at"] > gap)
        return F.when(apart, F.struct(close(s).alias("done"), x.alias("open"))).otherwise(F.struct(s["done"].alias("done"), grown.alias("open")))

    return F.aggregate(lines, start, step, close)


def rules(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, kind, at, low, high: rules, a line within the gap of a rule being part of it. Rows of a page stay together from here to its cells,
    so that later steps shuffle nothing."""
    gap = F.when(F.col("kind") == "v", VERTICAL[3]).otherwise(HORIZONTAL[3])
    each = [F.col(c).cast("double").alias(c) for c in ("at", "low", "high")]
    lines = candidates(segments, by).repartition(*by).groupBy(*by, "kind").agg(F.array_sort(F.collect_list(F.struct(*each))).alias("lines"))
    return lines.select(*by, "kind", F.inline(merged_lines(F.col("lines"), gap)))


def bins(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN)))


def crossings(rows: DataFrame, by: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """by, x, y of all crossings of rules, a rule's ends being tolerance longer."""
    v = F.col("kind") == "v"
    first, last = F.when(v, F.col("at")).otherwise(F.col("low") - tolerance), F.when(v, F.col("at")).otherwise(F.col("high") + tolerance)
    rule = F.struct("at", "low", "high")
    near = rows.select(*by, "kind", rule.alias("rule"), bins(first, last).alias("bin")).groupBy(*by, "bin")
    near = near.agg(F.collect_list(F.when(F.col("kind") == "v", F.col("rule"))).alias("vs"), F.collect_list(F.when(F.col("kind") == "h", F.col("rule"))).alias("hs"))
    met = lambda h: F.col("v.at").between(h["low"] - tolerance, h["high"] + tolerance) & h["at"].between(F.col("v.low") - tolerance, F.col("v.high") + tolerance)
    pairs = near.select(*by, F.explode("vs").alias("v"), "hs").select(*by, F.col("v.at").alias("x"), F.explode(F.filter("hs", met)).alias("h"))
    return pairs.select(*by, "x", F.col("h.at").alias("y"))


def cells(met: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, x0, y0, x1, y1, row and col (from 1): a crossing, the next ones on its two rules, and the one opposite, where all four are
    there. Rows and columns count the distinct edges of a page's cells."""
    right = F.lead("x").over(Window.partitionBy(*by, "y").orderBy("x"))
    below = F.lead("y").over(Window.partitionBy(*by, "x").orderBy("y"))
    # a crossing goes to its own place, and with its cell to the place opposite, where one without a cell must have come
    cell = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"))
    here, opposite = F.struct("x", "y", F.lit(None).cast("struct<x0:double,y0:double>").alias("cell")), F.struct(F.col("right").alias("x"), F.col("below").alias("y"), cell.alias("cell"))
    places = met.withColumns({"right": right, "below": below}).select(*by, F.inline(F.filter(F.array(here, opposite), lambda a: a["x"].isNotNull() & a["y"].isNotNull())))
    found = places.groupBy(*by, "x", "y").agg(F.count_if(F.col("cell").isNull()).alias("n"), F.collect_list("cell").alias("cells")).where("n > 0")
    found = found.select(*by, F.inline("cells"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    place = lambda c: F.dense_rank().over(Window.partitionBy(*by).orderBy(c))
    return found.select(*by, "x0", "y0", "x1", "y1", place("y0").alias("row"), place("x0").alias("col"))


def filled(grid: DataFrame, words: DataFrame, by: Sequence[str]) -> DataFrame:
    """The cells with text: the words (x, y of their middle, text) in each, from the left edge to before the right one and from the top to
    before the bottom, in reading order. Cells without words have an empty text."""
    tiles = grid.select("*", bins(F.col("x0"), F.col("x1")).alias("bx")).select("*", bins(F.col("y0"), F.col("y1")).alias("by_"))
    at = words.select(*by, "x", "y", "text", F.floor(F.col("x") / BIN).alias("bx"), F.floor(F.col("y") / BIN).alias("by_"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    kept = [c for c in grid.columns if c not in by]
    held = tiles.join(at, [*by, "bx", "by_"], "left").withColumn("word", F.when(inside, F.struct("y", "x", "text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("word")), lambda w: w["text"]), " ")
    return held.groupBy(*by, *kept).agg(text.alias("text"))


def tables(filled_cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and t: each page's cells as rows of texts, as the table tests take them; places without a cell are empty. And n_cells."""
    rows = filled_cells.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("texts"), F.max("col").alias("width"), F.count("*").alias("n"))
    rows = rows.withColumn("width", F.max("width").over(Window.partitionBy(*by)))
    line = F.transform(F.sequence(F.lit(1), F.col("width")), lambda c: F.coalesce(F.element_at("texts", c), F.lit("")))
    lines = rows.select(*by, "row", line.alias("line"), "n").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("ls"), F.sum("n").alias("n_cells"))
    return lines.select(*by, F.transform("ls", lambda x: x["line"]).alias("t"), "n_cells")
