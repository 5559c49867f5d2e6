"""Connected components of a graph of links, by alternating large-star and small-star steps over DataFrames.

Links stay distributed; each step is a group-by and a join, written to the checkpoint folder. Every node ends up linked to
the least node of its component, so that a large component has a hub: minima are found with partial aggregation, and a
node's links are dealt to SALTS tasks that each hold a copy of its minimum. Edge cases: no links give no rows; loops and
repeated links do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


#: Tasks that the links of one node are dealt to.
SALTS = 8


def with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (u, v) with their u's minimum m."""
    salted = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["u", "salt"]).drop("salt")


def signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that a link between different nodes touches; component is its least node."""
    spark = links.sparkSession
    shared_dir(spark)
    links = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct().checkpoint()
    before = signature(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: greater neighbours go to the least of the neighbourhood
        links = with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: lesser neighbours and the node itself go to the least neighbour
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = with_least(links, least).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = moved.where("u <> v").distinct().checkpoint()
        after = signature(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
