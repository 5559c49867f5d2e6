"""Groups of strings that differ by few edits, without a dictionary: a segment index for edit distance, then components.

Two strings within k edits agree in one of the k + 1 segments that either is cut into, at a place no farther off than k. Each string
is put into an index by its segments and looked up by its substrings of their lengths, an equi-join; candidates are verified by
their distance. Strings are distinct before they meet, so that repeated rows cost nothing. Components spread the least string
along links, halving paths, with a table of the shared folder a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def segments(length: Column, k: int) -> Column:
    """(number, first character from 1, size) of the k + 1 segments of a string of this length, the longer ones last."""
    parts = k + 1
    size, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    short = parts - longer

    def one(i: Column) -> Column:
        first = F.when(i < short, i * size).otherwise(short * size + (i - short) * (size + 1)) + 1
        return F.struct(i.alias("number"), first.cast("int").alias("first"), F.when(i < short, size).otherwise(size + 1).alias("size"))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), one)


def similar_strings(strings: DataFrame, column: str, k: int = 1) -> DataFrame:
    """a < b and distance: all pairs of distinct strings within k edits. Strings of k characters or fewer have empty segments, which
    agree with every string that is short enough. Null strings are in no pair."""
    rows = strings.select(F.col(column).alias("s")).where(F.col("s").isNotNull()).distinct().withColumn("n", F.length("s"))
    index = rows.select("s", "n", F.explode(segments(F.col("n"), k)).alias("p")).select(F.col("s").alias("a"), F.col("n").alias("an"), "p.number", F.col("p.first").alias("af"), F.expr("substring(s, p.first, p.size)").alias("part"))
    # what a string is looked up by: for each length it may meet, that length's segments, at every place within k of theirs
    met = rows.select("s", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - k), F.col("n"))).alias("an"))
    wanted = met.select("s", "n", "an", F.explode(segments(F.col("an"), k)).alias("p"))
    low, high = F.greatest(F.lit(1), F.col("p.first") - k), F.least(F.col("p.first") + k, F.col("n") - F.col("p.size") + 1)
    places = wanted.withColumn("low", low).withColumn("high", high).where("low <= high")
    probes = places.select(F.col("s").alias("b"), "an", F.col("p.number").alias("number"), F.explode(F.sequence("low", "high")).alias("at"), F.col("p.size").alias("size"))
    probes = probes.select("b", "an", "number", F.expr("substring(b, at, size)").alias("part")).distinct()
    pairs = index.join(probes, ["an", "number", "part"]).where((F.col("an") < F.length("b")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    found = pairs.withColumn("distance", F.levenshtein("a", "b", k)).where(F.col("distance") >= 0)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node and least: the least node of each linked node's component. Links (a, b) are turned to point at least neighbours until none
    changes; each round is written, so that lost executors repeat one round only."""
    edges = links.select("a", "b").where("a <> b").distinct()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        larger = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = larger.where("x <> y").distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(down.select("x", F.col("m").alias("y")))
        small = small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = written(small, "components")
        before, after = edges.count(), new.count()
        if before == after and new.exceptAll(edges).isEmpty():
            break
        edges = new
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
    return stars.unionByName(stars.select(F.col("least").alias("node"), "least").distinct())


def synonym_groups(rows: DataFrame, column: str, k: int = 1) -> DataFrame:
    """column, canonical and n: each distinct string, the most frequent string of its group, the first of equal ones, and its rows. Strings
    without a partner are their own."""
    counts = written(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("node")).agg(F.count("*").alias("n")), "synonym-counts")
    groups = counts.join(components(written(similar_strings(counts, "node", k), "synonym-pairs")), "node", "left").withColumn("least", F.coalesce("least", "node"))
    best = groups.groupBy("least").agg(F.min(F.struct((-F.col("n")).alias("n"), "node")).alias("best"))
    return groups.join(best, "least").select(F.col("node").alias(column), F.col("best.node").alias("canonical"), "n")
