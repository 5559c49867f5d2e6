"""Statistics over long score tables: recall to kappa, spread, confidence intervals and the intraclass correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Degrees of freedom with a quantile of their own; beyond them the normal one is used.
MOST_DF = 200


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, total = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (total - 1) if total else 0.0


def t_cdf(t: float, df: float) -> float:
    tail = beta_fraction(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def f_cdf(f: float, d1: float, d2: float) -> float:
    return beta_fraction(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)) if f > 0 else 0.0


def quantile(cdf, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


@lru_cache
def t_quantiles(p: float = 0.975) -> tuple[float, ...]:
    return tuple(round(quantile(lambda t, n=n: t_cdf(t, n), p, 0, 1000), 6) for n in range(1, MOST_DF + 1))


def f_quantile(p: float, d1: float, d2: float) -> float:
    return quantile(lambda f: f_cdf(f, d1, d2), p, 0, 1e6)


def t_of(df: Column) -> Column:
    """The .975 quantile of t for so many degrees of freedom."""
    values = t_quantiles()
    table = F.array(*(F.lit(v) for v in values))
    return F.when(df > MOST_DF, 1.959964).when(df >= 1, F.get(table, F.least(F.greatest(df, F.lit(1)), F.lit(MOST_DF)).cast("int") - 1))


def mean_score(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sd (sample), cv and rse in %, ci_low and ci_high (95 %, t), q1, median, q3, min and max by group."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    sd = F.coalesce("sd", F.lit(0.0))
    error = sd / F.sqrt("n")
    good = (F.col("n") >= 2) & (F.col("mean") != 0)
    half = F.when(F.col("n") >= 2, t_of(F.col("n") - 1) * error)
    return out.select(
        *by, "n", "mean", sd.alias("sd"),
        F.when(good, sd / F.col("mean") * 100).otherwise(0.0).alias("cv"),
        F.when(good, error / F.col("mean") * 100).otherwise(0.0).alias("rse"),
        F.coalesce(F.col("mean") - half, F.lit(0.0)).alias("ci_low"), F.coalesce(F.col("mean") + half, F.lit(0.0)).alias("ci_high"),
        F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "min", "max",
    )


def icc_parts(df: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """n items, k raters and the mean squares of a two-way analysis of variance of a complete table of one value a cell.
    Sums of squares come from totals by item and by rater, so that only one row an item or rater is shuffled."""
    cells = df.groupBy(item, rater).agg(F.avg(value).alias("x"))
    rows = cells.groupBy(item).agg(F.avg("x").alias("m"), F.count("*").alias("k"))
    cols = cells.groupBy(rater).agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    total = cells.agg(F.avg("x").alias("g"), F.var_pop("x").alias("v"), F.count("*").alias("c"))
    by_row = rows.agg(F.var_pop("m").alias("vr"), F.count("*").alias("n"))
    by_col = cols.agg(F.var_pop("m").alias("vc"), F.count("*").alias("k"))
    one = total.crossJoin(F.broadcast(by_row)).crossJoin(F.broadcast(by_col))  # one row each
    n, k = F.col("n"), F.col("k")
    ssr, ssc, sst = F.col("vr") * n * k, F.col("vc") * n * k, F.col("v") * F.col("c")
    return one.select(
        n.alias("n"), k.alias("k"), (ssr / (n - 1)).alias("ms_rows"), (ssc / (k - 1)).alias("ms_cols"),
        ((sst - ssr - ssc) / ((n - 1) * (k - 1))).alias("ms_error"),
    )


def icc_agreement(df: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """icc_agreement_single, absolute agreement of single ratings, within 0 to 1, with the mean squares it comes from."""
    p = icc_parts(df, item, rater, value)
    n, k, r, c, e = (F.col(x) for x in ("n", "k", "ms_rows", "ms_cols", "ms_error"))
    under = r + (k - 1) * e + k * (c - e) / n
    icc = F.when(under == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r - e) / under)))
    return p.withColumn("icc_agreement_single", icc)


def icc_interval(parts: dict[str, float], level: float = 0.95) -> tuple[float, float]:
    """Bounds of the correlation from one row of icc_parts, by quantiles of F."""
    n, k, r, c, e = (parts[x] for x in ("n", "k", "ms_rows", "ms_cols", "ms_error"))
    under = r + (k - 1) * e + k * (c - e) / n
    if not under:
        return 0.0, 0.0
    high = f_quantile(1 - (1 - level) / 2, n - 1, (n - 1) * (k - 1))
    low = f_quantile((1 - level) / 2, n - 1, (n - 1) * (k - 1))
    clamp = lambda x: max(0.0, min(1.0, x))
    return clamp((r - high * e) / under), clamp((r - low * e) / under)


def kappa(df: DataFrame, by: Sequence[str], a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """n, agreement in % and Cohen's kappa of two scores cut at the threshold, by group; 1 where chance alone agrees wholly."""
    x, y = (F.col(a) >= threshold).cast("int"), (F.col(b) >= threshold).cast("int")
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("po"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return out.select(*by, "n", (F.col("po") * 100).alias("agreement"), F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def concordance(df: DataFrame, by: Sequence[str], a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """Counts by agreement of two scores, and of the disagreements by kind, the first kind that fits."""
    x, y = F.col(a), F.col(b)
    hit, other = x >= threshold, y >= threshold
    diff = F.abs(x - y)
    kind = F.when(hit != other, (
        F.when(diff.between(0.1, 0.4) & F.least(x, y).between(0.3, 0.7), "incomplete_extraction")
        .when(((x == 0) & (y > 0.6)) | ((y == 0) & (x > 0.6)), "complete_omission")
        .when((x > 0.7) & (y < 0.3), "over_extraction")
        .when(x.between(0.3, 0.7) & y.between(0.3, 0.7), "interpretation_diff")
    ))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    kinds = ("incomplete_extraction", "complete_omission", "over_extraction", "interpretation_diff")
    return df.withColumn("kind", F.coalesce(kind, F.lit(""))).groupBy(*by).agg(
        F.count("*").alias("n_total"), count(hit & other).alias("both_correct"), count(~hit & ~other).alias("both_missed"),
        count(hit & ~other).alias("ai_only"), count(~hit & other).alias("human_only"), *(count(F.col("kind") == k).alias(k) for k in kinds),
    )


def ladder(c: Column, steps: Sequence[tuple[float, str]], above: bool, last: str) -> Column:
    """The name of the first step that c is above (or below)."""
    out = F
    for limit, name in steps:
        out = out.when(c > limit if above else c < limit, name)
    return out.otherwise(last)


def interpret_icc(c: Column) -> Column:
    return ladder(c, [(0.75, "Excellent"), (0.6, "Good"), (0.4, "Fair")], True, "Poor")


def interpret_cv(c: Column) -> Column:
    return ladder(c, [(3, "Excellent"), (5, "Very Good"), (10, "Good"), (15, "Fair")], False, "Poor")


def interpret_kappa(c: Column) -> Column:
    steps = [(0.8, "Almost Perfect"), (0.6, "Substantial"), (0.4, "Moderate"), (0.2, "Fair"), (0.0, "Slight")]
    return ladder(c, steps, True, "Poor")


def best_and_worst(df: DataFrame, by: Sequence[str], scenario: str, value: str) -> DataFrame:
    """Scenario with the greatest and the least mean by group, the first name of equal ones, and sensitivity, the range of
    the means in % of their mean."""
    means = df.groupBy(*by, scenario).agg(F.avg(value).alias("mean"))
    out = means.groupBy(*by).agg(
        F.min(F.struct((-F.col("mean")).alias("m"), F.col(scenario).alias("s"))).alias("best"),
        F.min(F.struct(F.col("mean").alias("m"), F.col(scenario).alias("s"))).alias("worst"),
        F.avg("mean").alias("mean"),
        F.stddev_pop("mean").alias("sd"),
    )
    wide = F.when(F.col("mean") == 0, 0.0).otherwise((-F.col("best.m") - F.col("worst.m")) / F.col("mean") * 100)
    return out.select(*by, F.col("best.s").alias("best"), F.col("worst.s").alias("worst"), "mean", "sd", wide.alias("sensitivity"))


def element_scores(df: DataFrame, key: str, value: str, suffix: str = "_score") -> DataFrame:
    """Rows whose key ends in suffix, with the value as a number, 0 where it is none."""
    return df.where(F.col(key).endswith(suffix)).withColumn(value, F.coalesce(F.expr(f"try_cast(`{value}` as double)"), F.lit(0.0)))
