"""Intraclass correlations by element and in total, with intervals, and statistics of many measures over overlapping groups.

Correlations come from sums that merge: by element and item, and by element and rater, each rolled up to the total over grouping
sets. Quantiles of F are columns: the incomplete beta function by its continued fraction, its inverse by bisection, both folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .statistics import interpret_icc

#: Halvings of the inverse. The continued fraction takes terms by the root of its greater parameter.
HALVINGS = 64
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """ln of the gamma function of a positive number: Stirling's series eight places higher."""
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    below = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda s, i: s + F.log(z + i))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - below


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for 0 < x < 1."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def term(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            safe = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)

            def half(s: Column, t: Column) -> Column:
                d = 1 / safe(1 + t * s["d"])
                c = safe(1 + t / s["c"])
                return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

            return let(half(s, even), lambda u: half(u, odd))

        first = 1 / F.when(F.abs(1 - (a + b) * x / (a + 1)) < TINY, TINY).otherwise(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        terms = (30 + 6 * F.sqrt(F.greatest(a, b))).cast("int")
        folded = F.aggregate(F.sequence(F.lit(1), terms), start, lambda s, m: term(s, m.cast("double")), lambda s: s["h"])
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
        return front * folded

    direct = x < (a + 1) / (a + b + 2)
    return let(F.struct(F.when(direct, a).otherwise(b).alias("a"), F.when(direct, b).otherwise(a).alias("b"), F.when(direct, x).otherwise(1 - x).alias("x")), lambda s: let(fraction(s["a"], s["b"], s["x"]), lambda v: F.when(direct, v).otherwise(1 - v)))


def f_quantile(p: float, d1: Column, d2: Column) -> Column:
    """The value below which the share p of the F distribution lies."""
    a, b = d1.cast("double") / 2, d2.cast("double") / 2

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        return let(F.struct(mid.alias("mid"), (beta_share(a, b, mid) < p).alias("below")), lambda m: F.struct(F.when(m["below"], m["mid"]).otherwise(s["low"]).alias("low"), F.when(m["below"], s["high"]).otherwise(m["mid"]).alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    x = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
    return let(x, lambda v: d2 * v / (d1 * (1 - v)))


def element_parts(df: DataFrame, element: str, item: str, rater: str, value: str) -> DataFrame:
    """element (null for the total), n, k and the mean squares of each element's complete table of items and raters, and of all complete
    tables one below the other. An element with a missing cell, or fewer than two items or raters, has n only."""
    cells = df.groupBy(F.col(element).alias("element"), F.col(item).alias("item"), F.col(rater).alias("rater")).agg(F.avg(value).alias("x")).where("element is not null")
    rows = cells.groupBy("element", "item").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("c"))
    cols = cells.groupBy("element", "rater").agg(F.sum("x").alias("s"), F.count("*").alias("c"))
    shape = rows.groupBy("element").agg(F.count("*").alias("n"), F.sum("c").alias("cells")).join(cols.groupBy("element").agg(F.count("*").alias("k")), "element")
    whole = shape.select("element", "n", ((F.col("cells") == F.col("n") * F.col("k")) & (F.col("n") >= 2) & (F.col("k") >= 2)).alias("whole"))
    good = whole.where("whole").select("element")
    by_item = rows.join(good, "element").groupingSets([["element"], []], "element").agg(
        F.count("*").alias("n"), F.max("c").alias("k"), F.min("c").alias("k_least"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("rows_")
    )
    by_rater = cols.join(good, "element").groupingSets([["element", "rater"], ["rater"]], "element", "rater").agg(F.sum("s").alias("s"))
    by_rater = by_rater.groupBy("element").agg(F.sum(F.col("s") * F.col("s")).alias("cols_"))
    both = by_item.join(by_rater, by_item["element"].eqNullSafe(by_rater["element"])).drop(by_rater["element"]).where("k = k_least")
    n, k, mean = F.col("n"), F.col("k"), F.col("s") * F.col("s") / (F.col("n") * F.col("k"))
    ssr, ssc = F.col("rows_") / k - mean, F.col("cols_") / n - mean
    figures = both.select(
        "element", "n", "k", (ssr / (n - 1)).alias("ms_rows"), (ssc / (k - 1)).alias("ms_cols"), ((F.col("q") - mean - ssr - ssc) / ((n - 1) * (k - 1))).alias("ms_error")
    )
    bad = whole.where(~F.col("whole")).select("element", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("k", "long"), ("ms_rows", "double"), ("ms_cols", "double"), ("ms_error", "double"))))
    return figures.unionByName(bad)


def element_correlations(df: DataFrame, element: str, item: str, rater: str, value: str, level: float = 0.95) -> DataFrame:
    """element (Total for all), n, k, icc, ci_low, ci_high and grade: absolute agreement of single ratings, within 0 to 1; zeros where an
    element's table isn't complete. An error of nothing has no interval but the value."""
    p = element_parts(df, element, item, rater, value)
    n, k, r, c, e = (F.col(x) for x in ("n", "k", "ms_rows", "ms_cols", "ms_error"))
    under = r + (k - 1) * e + k * (c - e) / n
    exact = F.abs(e) <= 1e-12 * F.greatest(F.abs(r), F.lit(1e-300))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    rest = (1 - level) / 2
    p = p.withColumn("under", under).withColumn("exact", exact)
    value_ = F.when(F.col("under") == 0, 0.0).otherwise(clamp((r - e) / F.col("under")))
    bound = lambda share: F.when(F.col("under") == 0, 0.0).when(F.col("exact"), value_).otherwise(clamp((r - f_quantile(share, n - 1, (n - 1) * (k - 1)) * e) / F.col("under")))
    zero = lambda v: F.coalesce(F.when(k.isNotNull(), v), F.lit(0.0))
    out = p.select(F.coalesce("element", F.lit("Total")).alias("element"), "n", "k", zero(value_).alias("icc"), zero(bound(1 - rest)).alias("ci_low"), zero(bound(rest)).alias("ci_high"))
    return out.withColumn("grade", interpret_icc(F.col("icc")))


def measure_statistics(df: DataFrame, measures: Sequence[str], groups: Sequence[Sequence[str]], totals: Sequence[str] = ()) -> DataFrame:
    """Columns of all groups (null where a row isn't grouped by one), group (their names), n_rows, measure, mean, std (of the population),
    total (for the measures in totals) and count of the values that aren't null; a measure without values has no row. All measures and
    overlapping groups come from one aggregation, whose rows are then unpivoted."""
    columns = list(dict.fromkeys(c for g in groups for c in g))
    parts = [f(m).alias(f"{name}_{i}") for i, m in enumerate(measures) for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("total", F.sum), ("count", F.count))]
    name = F.concat_ws(",", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns)).alias("group")
    wide = df.groupingSets([list(g) for g in groups], *columns).agg(name, F.count("*").alias("n_rows"), *parts)
    each = F.array(*(F.struct(F.lit(m).alias("measure"), *(F.col(f"{x}_{i}").cast("double").alias(x) for x in ("mean", "std")), (F.col(f"total_{i}").cast("double") if m in totals else F.lit(None).cast("double")).alias("total"), F.col(f"count_{i}").alias("count")) for i, m in enumerate(measures)))
    return wide.select(*columns, "group", "n_rows", F.explode(each).alias("x")).select(*columns, "group", "n_rows", "x.*").where("count > 0")


def recommendations(kappa: Column, ai_recall: Column, human_recall: Column, both_missed: Column, ai_only: Column, human_only: Column) -> Column:
    """Names of the rules that fit, in order: agreement and recalls as shares, the others as shares of all comparisons. None fitting is
    satisfactory."""
    rules = [
        (kappa < 0.60, ("investigate_disagreement", "calibrate_criteria")), (ai_recall < 0.70, ("ai_recall_low",)), ((ai_recall >= 0.70) & (ai_recall < 0.80), ("ai_recall_moderate",)),
        (human_recall < 0.75, ("task_challenging", "clarify_guidelines")), (both_missed > 0.15, ("coverage_gap_high", "review_documents")),
        (ai_only > 0.20, ("validate_false_positives",)), (human_only > 0.20, ("ai_misses_information", "improve_recall")),
    ]
    found = F.flatten(F.array(*(F.when(rule, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for rule, names in rules)))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("satisfactory"), F.lit("monitor"))))
