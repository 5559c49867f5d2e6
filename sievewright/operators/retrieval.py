"""Vector search, near-duplicate removal, coverage selection and weighted re-ranking.

Ranks follow (distance, id), so that results do not depend on how rows arrive. Greedy steps are folds over sorted arrays
that a top-k has bounded first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import let
from ..sources.shared import batches, written

#: Rows of a broadcast query set at most; above it, queries are joined by a shuffle on the filter column.
BROADCAST_QUERIES = 10_000


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, d: s + d)


def top_k(df: DataFrame, distance: Column, k: int, by: Sequence[str], tie: str) -> DataFrame:
    """The k nearest rows of each group, with distance and rank."""
    ranked = df.withColumn("distance", distance)
    order = Window.partitionBy(*by).orderBy("distance", tie)
    return ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def filtered_search(store: DataFrame, query: DataFrame, k: int, where: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors nearest to a query (a frame of one row, column q) among those that pass the filter; the filter reaches
    the scan, and each task keeps its own k nearest."""
    rows = store.where(where).crossJoin(F.broadcast(query.limit(1)))
    return rows.withColumn("distance", squared_l2(F.col(vector), F.col("q"))).orderBy("distance", key).limit(k)


def search_per_group(store: DataFrame, queries: DataFrame, k: int, group: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query (columns group, query_id, q) the k nearest vectors of its group. A join on the group, broadcast only
    for a checked number of queries."""
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    rows = store.join(F.broadcast(queries) if few else queries, group)
    return top_k(rows, squared_l2(F.col(vector), F.col("q")), k, [group, "query_id"], key)


@dataclass(frozen=True)
class Boost:
    """weight times the number of terms in the text or heading, at most `most`; any: weight once."""

    column: str
    weight: float
    terms: tuple[str, ...]
    most: int | None = None
    any: bool = False

    def score(self) -> Column:
        if not self.terms:
            return F.lit(0.0)
        if self.any:
            return F.when(T.contains_any(F.col(self.column), self.terms), self.weight).otherwise(0.0)
        n = T.count_terms(F.col(self.column), self.terms)
        return (F.least(n, F.lit(self.most)) if self.most else n) * F.lit(self.weight)

    def greatest(self) -> float:
        """What the boost adds at most; a negative weight adds nothing then."""
        n = min(1, len(self.terms)) if self.any else len({t.lower() for t in self.terms})
        return max(0.0, self.weight) * (min(n, self.most) if self.most and not self.any else n)

    def slightest(self) -> float:
        """What the boost adds at least."""
        n = min(1, len(self.terms)) if self.any else len({t.lower() for t in self.terms})
        return min(0.0, self.weight) * (min(n, self.most) if self.most and not self.any else n)


@dataclass(frozen=True)
class Ranking:
    """How chunks of one kind are scored. The terms are those of the domain; heading, drug and mutation terms are per case."""

    name: str
    boosts: tuple[Boost, ...]
    overfetch: int = 1
    coverage: bool = False
    required: tuple[str, ...] = field(default=())


# Term lists of the four rankings (fixed values).
POPULATION = (
    "population", "patients", "eligibility", "inclusion", "exclusion", "biomarker", "mutation", "testing",
    "line of therapy", "prior treatment", "disease stage", "histology", "performance status", "sub-population",
)
COMPARATOR = (
    "comparator", "comparison", "versus", "compared to", "alternative", "standard of care", "best supportive care",
    "placebo", "control arm", "appropriate comparator therapy", "treatment comparison", "indirect comparison",
)
BIOMARKER = ("biomarker", "mutation", "testing", "molecular", "genetic")
EFFICACY = (
    "efficacy", "overall survival", "progression-free survival", "response rate", "duration of response",
    "time to progression", "disease control rate", "objective response", "complete response", "partial response",
    "quality of life", "qol", "patient reported outcomes", "functional status", "health-related quality of life",
    "hrqol", "patient reported outcome measures", "proms", "functional assessment", "symptom burden",
)
SAFETY = (
    "safety", "adverse events", "toxicity", "tolerability", "side effects", "serious adverse events",
    "treatment-emergent", "grade 3", "grade 4",
)
ENDPOINTS = (
    "primary endpoint", "secondary endpoint", "outcomes", "endpoints", "statistical analysis", "hazard ratio",
    "confidence interval", "p-value",
)
GUIDELINE_POPULATION = ("patients", "population", "eligible", "biomarker", "mutation", "line of therapy")
GUIDELINE_COMPARATOR = ("alternative", "versus", "compared", "standard", "option")
RECOMMENDATION = ("recommend", "should", "guideline", "treatment", "therapy")
GUIDELINE_OUTCOMES = (
    "efficacy", "response", "survival", "outcomes", "benefit", "improvement", "quality of life", "qol",
    "patient reported outcomes", "functional status", "health-related quality of life", "hrqol",
    "patient reported outcome measures", "proms", "functional assessment", "symptom burden",
)
GUIDELINE_SAFETY = ("safety", "adverse", "toxicity", "tolerability", "side effects")
EVIDENCE = ("evidence", "level", "grade", "recommendation", "strength")


def submission_population(headings: Sequence[str] = (), drugs: Sequence[str] = (), mutations: Sequence[str] = (), population=POPULATION, comparator=COMPARATOR, biomarker=BIOMARKER, own=("population", "comparator", "comparison", "versus")) -> Ranking:
    return Ranking(
        "submission_population",
        (
            Boost("text", 6.0, tuple(population), 3), Boost("text", 6.0, tuple(comparator), 3), Boost("text", 5.0, tuple(biomarker), 2),
            Boost("heading", 4.0, tuple(headings), any=True), Boost("text", 8.0, tuple(drugs), any=True),
            Boost("text", 7.0, tuple(mutations), any=True), Boost("heading", 8.0, tuple(own), any=True),
        ),
        coverage=True,
    )


def submission_outcomes(headings: Sequence[str] = (), mutations: Sequence[str] = (), efficacy=EFFICACY, safety=SAFETY, endpoints=ENDPOINTS, own=("outcomes", "efficacy", "safety", "endpoints")) -> Ranking:
    return Ranking(
        "submission_outcomes",
        (
            Boost("text", 5.0, tuple(efficacy), 4), Boost("text", 4.0, tuple(safety), 3), Boost("text", 6.0, tuple(endpoints), 3),
            Boost("heading", 3.0, tuple(headings), any=True), Boost("text", 5.0, tuple(mutations), any=True),
            Boost("heading", 7.0, tuple(own), any=True),
        ),
    )


def guideline_population(headings: Sequence[str] = (), drugs: Sequence[str] = (), mutations: Sequence[str] = (), required: Sequence[str] = (), population=GUIDELINE_POPULATION, comparator=GUIDELINE_COMPARATOR, recommendation=RECOMMENDATION) -> Ranking:
    return Ranking(
        "guideline_population",
        (
            Boost("text", 10.0, tuple(mutations)), Boost("heading", 12.0, tuple(mutations), any=True), Boost("text", 3.0, tuple(population)),
            Boost("text", 4.0, tuple(comparator)), Boost("text", 2.5, tuple(recommendation)), Boost("text", 6.0, tuple(drugs), any=True),
            Boost("heading", 5.0, tuple(headings), any=True),
        ),
        overfetch=2, required=tuple(required),
    )


def guideline_outcomes(headings: Sequence[str] = (), mutations: Sequence[str] = (), required: Sequence[str] = (), outcomes=GUIDELINE_OUTCOMES, safety=GUIDELINE_SAFETY, evidence=EVIDENCE, own=("outcomes", "efficacy", "safety", "response")) -> Ranking:
    return Ranking(
        "guideline_outcomes",
        (
            Boost("text", 4.0, tuple(outcomes)), Boost("text", 3.0, tuple(safety)), Boost("text", 3.0, tuple(evidence)),
            Boost("text", 6.0, tuple(mutations)), Boost("heading", 4.0, tuple(headings), any=True), Boost("heading", 8.0, tuple(own), any=True),
        ),
        overfetch=2, required=tuple(required),
    )


def required_terms(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Rows whose text or heading matches any of the patterns, case aside."""
    both = F.concat_ws(" ", F.lower("text"), F.lower(F.coalesce("heading", F.lit(""))))
    return df.where(T.matches_any(both, patterns)) if patterns else df


def rerank(df: DataFrame, ranking: Ranking, by: Sequence[str], order: Sequence[str], final_k: int) -> DataFrame:
    """The final_k best rows (columns text, heading) of each group: the base score is the number of rows in the group less
    the rank in `order` from 0, boosts are added, ties keep that order. Columns base, score and place are added. A row whose rank
    is farther back than all boosts together can't be among the best, so that each task keeps a bounded number of rows a group
    before the shuffle; groups are counted by partial aggregation. Boosts are computed before the ranks, so that a caller who
    selects no text shuffles none."""
    df = required_terms(df, ranking.required).withColumn("boost", sum((b.score() for b in ranking.boosts), F.lit(0.0)))
    k = 2 * final_k if ranking.coverage else final_k
    reach = k + math.ceil(sum(b.greatest() - b.slightest() for b in ranking.boosts))
    sizes = df.groupBy(*by).agg(F.count("*").alias("group_size"))
    near = df.withColumn("order_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("order_rank") <= reach)
    same = [near[c].eqNullSafe(sizes[c]) for c in by]
    ranked = near.join(sizes, reduce(and_, same)).select(*(near[c] for c in near.columns), "group_size")
    scored = ranked.withColumn("base", F.col("group_size") - F.col("order_rank") + 1).drop("group_size", "order_rank")
    scored = scored.withColumn("score", F.col("base") + F.col("boost")).drop("boost")
    place = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("base"))
    return scored.withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= k)


def greedy_unique(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str, most: int, same: str | None = None, similarity: float = 0.7, within: float = 0.9) -> DataFrame:
    """Of each group's first `most` rows (a top-k that bounds the fold) those that no kept row before them resembles: equal
    text, or, where `same` agrees, Jaccard above `similarity` or either token set within the other above `within`.
    Columns: by, key, kept, reason (duplicate, similar or null)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("place", place).where(F.col("place") <= most)
    item = F.struct("place", F.col(key).alias("key"), "text", T.token_set(F.col("text")).alias("words"), (F.col(same).cast("string") if same else F.lit("")).alias("same"))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(lists.dtypes)["items"]
    done = f"array<struct<key:{dict(df.dtypes)[key]},kept:boolean,reason:string>>"

    def step(state: Column, x: Column) -> Column:
        equal = F.exists(state["kept"], lambda k: k["text"] == x["text"])
        n = F.size(x["words"])
        # one intersection a pair: its size and those of both sets decide all three tests
        shared = F.transform(
            F.filter(state["kept"], lambda k: k["same"] == x["same"]),
            lambda k: F.struct(F.size(F.array_intersect(k["words"], x["words"])).alias("i"), F.size(k["words"]).alias("m")),
        )
        close = F.exists(
            shared, lambda s: (s["i"] > (s["m"] + n - s["i"]) * similarity) | (s["i"] > s["m"] * within) | (s["i"] > n * within)
        )

        def add(reason: Column) -> Column:
            row = F.struct(x["key"].alias("key"), reason.isNull().alias("kept"), reason.alias("reason"))
            return F.struct(
                F.when(reason.isNull(), F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).cast(kind).alias("kept"),
                F.concat(state["rows"], F.array(row)).cast(done).alias("rows"),
            )

        return let(F.when(equal, "duplicate").when(close, "similar"), add)

    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast(done).alias("rows"))
    folded = lists.select(*by, F.aggregate("items", start, step, lambda s: s["rows"]).alias("rows"))
    return folded.select(*by, F.explode("rows").alias("r")).select(*by, F.col("r.key").alias(key), "r.kept", "r.reason")


def coverage_select(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str, items: str, final_k: int, most: int) -> DataFrame:
    """Greedy cover: of each group's first `most` rows, again and again the one with most items that none chosen before it
    has, the earliest of equal ones, final_k in all; also rows that add nothing. Columns: by, key, pick (from 1), n_new."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("place", place).where(F.col("place") <= most)
    item = F.struct("place", F.col(key).alias("key"), F.array_distinct(F.col(items)).alias("items"))
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    kind = dict(df.dtypes)[key]
    chosen = f"array<struct<place:int,key:{kind},n_new:int>>"
    words = dict(df.dtypes)[items]

    def step(state: Column, _: Column) -> Column:
        rows = F.transform(state["rows"], lambda r: F.struct(F.size(F.array_except(r["items"], state["covered"])).alias("n"), (-r["place"]).alias("p"), r["key"].alias("key"), r["items"].alias("items")))

        def add(best: Column) -> Column:
            pick = F.struct((-best["p"]).alias("place"), best["key"].alias("key"), best["n"].alias("n_new"))
            more = F.when(best.isNotNull(), F.concat(state["chosen"], F.array(pick))).otherwise(state["chosen"])
            covered = F.when(best.isNotNull(), F.array_union(state["covered"], best["items"])).otherwise(state["covered"])
            left = F.filter(state["rows"], lambda r: best.isNull() | (r["place"] != -best["p"]))
            return F.struct(left.alias("rows"), more.cast(chosen).alias("chosen"), covered.cast(words).alias("covered"))

        return let(F.array_max(rows), add)

    start = F.struct(F.col("rows"), F.array().cast(chosen).alias("chosen"), F.array().cast(words).alias("covered"))
    folded = lists.select(*by, F.aggregate(F.sequence(F.lit(1), F.lit(final_k)), start, step, lambda s: s["chosen"]).alias("chosen"))
    picked = folded.select(*by, F.posexplode("chosen").alias("pos", "c"))
    return picked.select(*by, F.col("c.key").alias(key), (F.col("pos") + 1).alias("pick"), "c.n_new")


def similar_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, items: str, least: float) -> DataFrame:
    """Pairs of rows whose arrays of distinct items have a Jaccard similarity of `least` or more, through the items that can
    decide: in the order of a global count, a set must share one of its first size - ceil(least * size) + 1 items with every
    set that similar to it, so that only those items are joined."""
    ax = a.select(F.col(key_a).alias("ka"), F.col(items).alias("wa"))
    bx = b.select(F.col(key_b).alias("kb"), F.col(items).alias("wb"))
    both = ax.select(F.explode("wa").alias("w")).unionByName(bx.select(F.explode("wb").alias("w")))
    counts = both.groupBy("w").count()

    def prefix(df: DataFrame, key: str, words: str) -> DataFrame:
        rows = df.select(key, F.size(words).alias("n"), F.explode(words).alias("w")).join(counts, "w")
        place = F.row_number().over(Window.partitionBy(key).orderBy("count", "w"))
        return rows.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(key, "w")

    pairs = prefix(ax, "ka", "wa").join(prefix(bx, "kb", "wb"), "w").select("ka", "kb").distinct()
    full = pairs.join(ax, "ka").join(bx, "kb").withColumn("similarity", T.jaccard(F.col("wa"), F.col("wb")))
    return full.where(F.col("similarity") >= least).select(F.col("ka").alias(key_a), F.col("kb").alias(key_b), "similarity")


def rarest(df: DataFrame, keys: Sequence[str], items: str, counts: DataFrame, n: Column) -> DataFrame:
    """keys, size, w and place: of each row's items the n (a column over `size`) that are rarest by counts (w, count), in that
    order; ties by item."""
    rows = df.select(*keys, F.size(items).alias("size"), F.explode(items).alias("w")).join(counts, "w", "left")
    item = F.struct(F.coalesce("count", F.lit(0).cast("long")).alias("count"), "w")
    lists = rows.groupBy(*keys, "size").agg(F.slice(F.array_sort(F.collect_list(item)), 1, n.cast("int")).alias("few"))
    return lists.select(*keys, "size", F.posexplode("few").alias("place", "f")).select(*keys, "size", "place", "f.w")


#: Words whose counts are broadcast at most, and items of a pair that must lie among its rarest ones.
COUNTED, MET = 1 << 19, 4


def frequent(rows: DataFrame, items: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the most frequent items of all rows: those whose count is above the least power of two that at most
    COUNTED items exceed. Counts travel as partial sums a task."""
    counts = written(rows.select(F.explode(items).alias("w")).groupBy("w").count().where("count > 1"), "item-counts")
    level = F.ceil(F.log2("count")).cast("int")  # counts of a level are above 2 ** (level - 1)
    sizes = {r["level"]: r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    least = max(sizes, default=0) + 1
    while least > 1 and sum(n for at, n in sizes.items() if at >= least - 1) <= COUNTED:
        least -= 1
    found = counts.where(level >= least).toArrow()
    w, count = (found.column(c).to_numpy() for c in ("w", "count"))
    order = np.argsort(w)
    return w[order], count[order]


def first_items(rows: DataFrame, counts: tuple[np.ndarray, np.ndarray], least: float) -> DataFrame:
    """k, g, size, place (from 0) and w: of each row's items (ws, distinct hashes) the first ones by (count, hash), items without a count
    before all others, so many that two sets of similarity `least` share MET of them, or all that they must share if fewer.
    Nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in parts:
            lists = batch.column(2)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            w = np.asarray(lists.flatten())
            of = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, w), max(len(known) - 1, 0))
            n = np.where(known[at] == w, count[at], 0) if len(known) else np.zeros(len(w), np.int64)
            order = np.lexsort((w, n, of))
            place = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            keep = place < (size - np.ceil(size * least - 1e-9).astype(np.int64) + MET)[of]
            of = of[keep]
            columns = [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(size[of].astype(np.int32)), pa.array(place[keep].astype(np.int32)), pa.array(w[order][keep])]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "g", "size", "place", "w"])

    kinds = dict(rows.dtypes)
    with batches(rows.sparkSession, 512):
        return written(rows.select("k", "g", "ws").mapInArrow(run, f"k {kinds['k']}, g {kinds['g']}, size int, place int, w long"), "first-items")


def similar_within(df: DataFrame, key: str, items: str, least: float, by: str, hashed: bool = False) -> DataFrame:
    """Pairs ka < kb of rows that agree on `by` and whose arrays of distinct items have a Jaccard similarity of `least` or more.
    Candidates agree on `by`, are of like size and share MET of their first items in one order of all items (see first_items): of the o items
    that a pair must share, the first MET have o - MET behind them in both sets. Frequent items come last in that order, and any order
    finds all pairs. Items are compared by 64-bit hashes (hashed: the items are such); only first items, and whole sets of candidates, are shuffled."""
    ws = F.col(items) if hashed else F.transform(items, lambda w: F.xxhash64(w))
    rows = df.where(F.col(key).isNotNull() & F.col(by).isNotNull()).select(F.col(key).alias("k"), F.col(by).alias("g"), ws.alias("ws"))
    rows = rows.where(F.size("ws") > 0)
    few = first_items(rows, frequent(rows, "ws"), least)
    x, y = few.alias("x"), few.alias("y")
    like = (F.col("x.size") >= least * F.col("y.size") - 1e-9) & (F.col("y.size") >= least * F.col("x.size") - 1e-9)
    both = F.col("x.size") + F.col("y.size")
    behind = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    like &= behind + (MET - 1) >= both * (least / (1 + least)) - 1e-9
    met = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.k") < F.col("y.k")) & like)
    met = met.groupBy(F.col("x.k").alias("ka"), F.col("y.k").alias("kb"), both.alias("both")).agg(F.count("*").alias("n"))
    pairs = written(met.where(F.col("n") >= F.least(F.lit(MET), F.ceil(F.col("both") * (least / (1 + least)) - 1e-9))).drop("n"), "candidate-pairs")
    ids = pairs.select(F.explode(F.array("ka", "kb")).alias("k")).distinct()
    sets = rows.select("k", "ws").join(checked(ids), "k", "left_semi")
    a, b = sets.select(F.col("k").alias("ka"), F.col("ws").alias("wa")), sets.select(F.col("k").alias("kb"), F.col("ws").alias("wb"))
    shared = pairs.join(a, "ka").join(b, "kb").select("ka", "kb", "both", F.size(F.array_intersect("wa", "wb")).alias("shared"))
    return shared.withColumn("similarity", F.col("shared") / (F.col("both") - F.col("shared"))).where(F.col("similarity") >= least).select("ka", "kb", "similarity")


#: Hashes repeat from row to row: a dictionary of up to 16 MB for each file's part, and what a word takes there is a place in it.
DICTIONARY = {"parquet.dictionary.page.size": 1 << 24, "compression": "zstd"}
#: Rows of identifiers that are broadcast at most.
BROADCAST_KEYS = 1 << 20


def checked(keys: DataFrame) -> DataFrame:
    """A table of keys, broadcast where it is small."""
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def hashed_sets(df: DataFrame, key: str, items: str, by: str) -> DataFrame:
    """key, by, digest and hashes (64 bits each, as ws) of each row's array of distinct sorted items, and mark, a hash of it and `by` that is null where
    there are no items or `by` is null. Written once, so that items are made once."""
    mark = F.when((F.size(items) > 0) & F.col(by).isNotNull(), F.xxhash64(by, items))
    digest, ws = F.sha2(F.to_json(items), 256), F.transform(items, lambda w: F.xxhash64(w))
    return written(df.select(key, by, digest.alias("digest"), mark.alias("mark"), ws.alias("ws")), "word-sets", **DICTIONARY)


def set_members(sets: DataFrame, key: str, by: str) -> DataFrame:
    """key, by, mark and representative: the least key of the rows of hashed_sets() that agree on `by` and have equal arrays.
    Only digests of the arrays are shuffled; the table is written once."""
    rows = sets.select(key, by, "digest", "mark")
    least = rows.groupBy(F.col(by).alias("g"), F.col("digest").alias("d")).agg(F.min(key).alias("representative"))
    return written(rows.join(least, F.col(by).eqNullSafe(F.col("g")) & F.col("digest").eqNullSafe(F.col("d"))).select(key, by, "mark", "representative"), "set-members")


def holders_of(df: DataFrame, sets: DataFrame, key: str, set_key: str, items: str, members: str, more: float) -> DataFrame:
    """key, set_key and share of rows that hold more than the share `more` of a set's distinct members. Such a row holds one of any
    floor((1 - more) * size) + 1 members, so that only each set's rarest ones are joined."""
    rows = df.select(key, F.explode(items).alias("w"))
    wanted = sets.where(F.size(members) > 0)
    words = wanted.select(F.explode(members).alias("w")).distinct()
    counts = rows.join(words, "w").groupBy("w").count()
    few = rarest(wanted, [set_key], members, counts, F.floor((1 - more) * F.col("size") + 1e-9) + 1).select(set_key, "w")
    pairs = rows.join(few, "w").select(key, set_key).distinct()
    both = pairs.join(df.select(key, items), key).join(wanted.select(set_key, members), set_key)
    return both.withColumn("share", T.share_within(F.col(members), F.col(items))).where(F.col("share") > more).select(key, set_key, "share")
