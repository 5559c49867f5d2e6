"""Which file a request means: by the exact name with the indication, by the name without it, or by a part of the name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What all names end with (a fixed value).
SUFFIX = "_retrieval_results.json"
#: Characters of the parts that files are indexed by.
GRAM = 3


def grams(c: Column) -> Column:
    """The distinct runs of GRAM characters; a shorter string is its own."""
    size = F.length(c)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM)))
    return F.array_distinct(runs)


def short_grams(c: Column) -> Column:
    """All runs of one to GRAM characters, so that a shorter request is found too."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.array(*(runs(n) for n in range(1, GRAM + 1)))))


def resolve(requests: DataFrame, files: DataFrame, key: str, name: str = "name") -> DataFrame:
    """key, name and rule (1 exact, 2 without the indication, 3 part of the name) for each request (key, source_type, retrieval_type and
    indication, which may be null or empty); null where no file fits. Of several files that the third rule finds the first by
    name. Exact names are an equi-join; parts of names meet through an index of their runs of three characters, by the
    rarest run of what a request asks for, and are verified."""
    known = files.select(F.col(name).alias("name")).where(F.col("name").endswith(SUFFIX)).distinct()
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    asked = requests.select(key, given("source_type").alias("source"), given("retrieval_type").alias("kind"), given("indication").alias("indication"))
    stem = F.concat(F.col("source"), F.when(F.col("kind") != "", F.concat(F.lit("_"), "kind")).otherwise(""))
    first = F.lower(F.get(F.filter(F.split("indication", r"\s+"), lambda w: w != ""), F.lit(0)))
    keys = F.array_compact(F.array(
        F.when(first.isNotNull(), F.struct(F.lit(1).alias("rule"), F.concat(stem, F.lit("_"), first, F.lit(SUFFIX)).alias("name"))),
        F.struct(F.lit(2).alias("rule"), F.concat(stem, F.lit(SUFFIX)).alias("name")),
    ))
    exact = asked.select(key, F.explode(keys).alias("k")).select(key, "k.*").join(known, "name").groupBy(key).agg(F.min(F.struct("rule", "name")).alias("found"))
    rest = asked.join(exact, key, "left_anti")
    # the longer part asks; one without any characters is answered by the first name of all
    part = F.when(F.length("source") >= F.length("kind"), F.col("source")).otherwise(F.col("kind"))
    index = known.select("name", F.explode(short_grams(F.col("name"))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = rest.select(key, "source", "kind", F.explode(F.when(part == "", F.array().cast("array<string>")).otherwise(grams(part))).alias("gram")).join(counts, "gram", "left")
    rarest = wanted.groupBy(key, "source", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    hits = rarest.join(index, "gram").where(F.col("name").contains(F.col("source")) & F.col("name").contains(F.col("kind")))
    parts = hits.groupBy(key).agg(F.struct(F.lit(3).alias("rule"), F.min("name").alias("name")).alias("found"))
    empty = rest.where(part == "").select(key).crossJoin(known.agg(F.min("name").alias("name")).where("name is not null"))  # one row
    found = exact.unionByName(parts).unionByName(empty.select(key, F.struct(F.lit(3).alias("rule"), "name").alias("found")))
    return asked.select(key).join(found, key, "left").select(key, F.col("found.name").alias("name"), F.col("found.rule").alias("rule"))
