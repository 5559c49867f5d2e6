"""Queries over correlations by element, many measures and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import statistics as S
from .registry import load, query

#: Items and raters of each event type; quantiles of F by the number of items that the SQL may meet.
ITEMS, RATERS, MOST_TYPES = 15, 3, 8
QUANTILES = ", ".join(f"({n}, {S.f_quantile(0.975, n - 1, (n - 1) * (RATERS - 1))}, {S.f_quantile(0.025, n - 1, (n - 1) * (RATERS - 1))})" for n in range(ITEMS, ITEMS * MOST_TYPES + 1, ITEMS))


@query(f"""WITH f(n, high, low) AS (VALUES {QUANTILES}), c AS (SELECT event_type AS e, user_id % {ITEMS} AS i, event_id % {RATERS} AS j, avg(value) AS x FROM events GROUP BY ALL),
w AS (SELECT e, count(DISTINCT i) AS n, count(DISTINCT j) AS k, count(*) = count(DISTINCT i) * count(DISTINCT j) AND count(DISTINCT i) >= 2 AND count(DISTINCT j) >= 2 AS whole FROM c GROUP BY e),
d AS (SELECT e AS element, e || i AS row_, j, x FROM c JOIN w USING (e) WHERE whole UNION ALL SELECT 'Total', e || ' ' || i, j, x FROM c JOIN w USING (e) WHERE whole),
g AS (SELECT element, avg(x) AS g, count(DISTINCT row_) AS n, count(DISTINCT j) AS k FROM d GROUP BY element),
r AS (SELECT element, sum((m - g) ** 2) AS s FROM (SELECT element, row_, avg(x) AS m FROM d GROUP BY ALL) JOIN g USING (element) GROUP BY element),
q AS (SELECT element, sum((m - g) ** 2) AS s FROM (SELECT element, j, avg(x) AS m FROM d GROUP BY ALL) JOIN g USING (element) GROUP BY element),
t AS (SELECT element, sum((x - g) ** 2) AS s FROM d JOIN g USING (element) GROUP BY element),
p AS (SELECT element, n, k, k * r.s / (n - 1) AS msr, n * q.s / (k - 1) AS msc, (t.s - k * r.s - n * q.s) / ((n - 1) * (k - 1)) AS mse FROM g JOIN r USING (element) JOIN q USING (element) JOIN t USING (element)),
u AS (SELECT *, msr + (k - 1) * mse + k * (msc - mse) / n AS under FROM p),
o AS (SELECT element, n, k, greatest(0, least(1, (msr - mse) / under)) AS icc, greatest(0, least(1, (msr - high * mse) / under)) AS ci_low, greatest(0, least(1, (msr - low * mse) / under)) AS ci_high FROM u JOIN f USING (n)
  UNION ALL SELECT e, n, NULL, 0, 0, 0 FROM w WHERE NOT whole)
SELECT element, n, k, round(icc, 5) AS icc, round(ci_low, 5) AS ci_low, round(ci_high, 5) AS ci_high, CASE WHEN icc > 0.75 THEN 'Excellent' WHEN icc > 0.6 THEN 'Good' WHEN icc > 0.4 THEN 'Fair' ELSE 'Poor' END AS grade FROM o""")
def icc_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation of each event type and of all, with 95 % intervals and grades."""
    rows = load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % ITEMS).alias("item"), (F.col("event_id") % RATERS).alias("rater"), "value")
    out = A.element_correlations(rows, "event_type", "item", "rater", "value")
    return out.select("element", "n", "k", *(F.round(c, 5).alias(c) for c in ("icc", "ci_low", "ci_high")), "grade")


#: Fifteen measures of a line item, some of them null, and a time; the same expressions in both dialects.
MEASURES = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "CAST(l_linenumber AS DOUBLE)", "net": "l_extendedprice * (1 - l_discount)",
    "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "unit_price": "l_extendedprice / l_quantity", "large": "CASE WHEN l_quantity > 40 THEN l_quantity END", "small": "CASE WHEN l_quantity < 10 THEN l_quantity END",
    "taxed": "CASE WHEN l_tax > 0.04 THEN l_extendedprice END", "rebate": "CASE WHEN l_discount > 0.05 THEN l_discount END", "first": "CASE WHEN l_linenumber = 1 THEN l_extendedprice END",
    "parts": "CAST(l_partkey % 100 AS DOUBLE)", "suppliers": "CAST(l_suppkey % 10 AS DOUBLE)", "time": "l_quantity / 10 + l_tax",
}
GROUPS = ((), ("l_returnflag",), ("l_linestatus",), ("l_returnflag", "l_linestatus"))


def measures_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{m}' AS measure, {e} AS v FROM lineitem" for m, e in MEASURES.items())
    sets = []
    for g in GROUPS:
        columns = ", ".join(c if c in g else f"NULL AS {c}" for c in ("l_returnflag", "l_linestatus"))
        by = ", ".join(("measure", *g))
        sets.append(f"SELECT {columns}, '{','.join(g)}' AS \"group\", count(*) AS n_rows, measure, avg(v) AS mean, stddev_pop(v) AS std, CASE WHEN measure = 'time' THEN sum(v) END AS total, count(v) AS n FROM m GROUP BY {by}")
    return f"""WITH m AS ({rows}), s AS ({" UNION ALL ".join(sets)})
SELECT l_returnflag, l_linestatus, "group", n_rows, measure, round(mean, 4) AS mean, round(std, 4) AS std, round(total, 3) AS total, n AS "count" FROM s WHERE n > 0"""


@query(measures_sql())
def measure_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen measures over overlapping groups, the total of time alone."""
    rows = load(spark, sf_dir, "lineitem").selectExpr("l_returnflag", "l_linestatus", *(f"{e} AS {m}" for m, e in MEASURES.items()))
    out = A.measure_statistics(rows, list(MEASURES), GROUPS, ["time"])
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "total": F.round("total", 3)})


@query("""WITH k AS (SELECT user_id, value / 100 AS a, (value * 7 - floor(value * 7 / 100) * 100) / 100 AS b FROM events),
s AS (SELECT user_id, count(*) AS n, avg((a >= 0.5)::INT) AS ai, avg((b >= 0.5)::INT) AS human, avg((a < 0.5 AND b < 0.5)::INT) AS missed, avg((a >= 0.5 AND b < 0.5)::INT) AS ai_only, avg((a < 0.5 AND b >= 0.5)::INT) AS human_only, avg(((a >= 0.5) = (b >= 0.5))::INT) AS po FROM k GROUP BY user_id),
e AS (SELECT *, ai * human + (1 - ai) * (1 - human) AS pe FROM s), c AS (SELECT *, CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa FROM e),
r AS (SELECT user_id, kappa, concat_ws('|', CASE WHEN kappa < 0.60 THEN 'investigate_disagreement|calibrate_criteria' END, CASE WHEN ai < 0.70 THEN 'ai_recall_low' END, CASE WHEN ai >= 0.70 AND ai < 0.80 THEN 'ai_recall_moderate' END,
  CASE WHEN human < 0.75 THEN 'task_challenging|clarify_guidelines' END, CASE WHEN missed > 0.15 THEN 'coverage_gap_high|review_documents' END, CASE WHEN ai_only > 0.20 THEN 'validate_false_positives' END, CASE WHEN human_only > 0.20 THEN 'ai_misses_information|improve_recall' END) AS rules FROM c)
SELECT user_id, CASE WHEN kappa > 0.8 THEN 'Almost Perfect' WHEN kappa > 0.6 THEN 'Substantial' WHEN kappa > 0.4 THEN 'Moderate' WHEN kappa > 0.2 THEN 'Fair' WHEN kappa > 0 THEN 'Slight' ELSE 'Poor' END AS grade, CASE WHEN rules = '' THEN 'satisfactory|monitor' ELSE rules END AS rules FROM r""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of two raters' agreement on each user's events, and the rules that it and their recalls meet."""
    v = F.col("value")
    rows = load(spark, sf_dir, "events").select("user_id", (v / 100).alias("a"), ((v * 7 - F.floor(v * 7 / 100) * 100) / 100).alias("b"))
    share = lambda c: F.avg(c.cast("int"))
    hit, other = F.col("a") >= 0.5, F.col("b") >= 0.5
    shares = rows.groupBy("user_id").agg(share(hit).alias("ai"), share(other).alias("human"), share(~hit & ~other).alias("missed"), share(hit & ~other).alias("ai_only"), share(~hit & other).alias("human_only"))
    both = S.kappa(rows, ["user_id"], "a", "b").join(shares, "user_id")
    rules = A.recommendations(*(F.col(c) for c in ("kappa", "ai", "human", "missed", "ai_only", "human_only")))
    return both.select("user_id", S.interpret_kappa(F.col("kappa")).alias("grade"), F.array_join(rules, "|").alias("rules"))
