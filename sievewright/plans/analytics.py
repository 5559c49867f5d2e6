"""Queries over evidence records, sets, groups, scores, tables and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as B
from ..operators import evidence as E
from ..operators import lookup as U
from ..operators import statistics as S
from .registry import load, query


def r6(c: str | Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


# --- groups -----------------------------------------------------------------------------------------------------------


@query("""SELECT lang, count(*) AS chunk_count, sum(length(text))::BIGINT AS total_text_length, count(DISTINCT source) AS unique_documents,
  count(DISTINCT CASE WHEN trim(split_part(text, chr(10), 1)) <> '' THEN split_part(text, chr(10), 1) END) AS unique_headings FROM documents GROUP BY lang""")
def country_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("heading", F.substring_index("text", "\n", 1))
    return E.group_stats(docs, "lang", "text", "source", "heading")


@query("""SELECT lang, source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""")
def quality_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measure over all labelled documents, by language and by source, in one aggregation."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = docs.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return E.overlapping_stats(rows, ["lang", "source"], "n_chars").select("lang", "source", "n", r6("mean", "mean"), r6("sd", "sd"))


@query("SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count DESC, source LIMIT 10")
def value_counts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_values(load(spark, sf_dir, "documents"), "source", 10)


@query("""SELECT user_id, event_type AS mode, count FROM (SELECT user_id, event_type, count(*) AS count, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
  FROM events GROUP BY user_id, event_type) WHERE rn = 1""")
def modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.modal_values(load(spark, sf_dir, "events"), "user_id", "event_type")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LANGS = ("de", "en", "es", "fr")


@query("SELECT source, " + ", ".join(f"count(CASE WHEN lang = '{v}' THEN 1 END) AS {v}" for v in LANGS) + " FROM documents GROUP BY source")
def pivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pivot_counts(load(spark, sf_dir, "documents").select("source", "lang"), "source", "lang", LANGS)


@query("""WITH s AS (SELECT lang, list_sort(list_distinct(list(source) FILTER (n_chars > 2000))) AS x, list_sort(list_distinct(list(source) FILTER (NOT n_chars > 2000))) AS y FROM documents GROUP BY lang),
t AS (SELECT lang, coalesce(x, []) AS x, coalesce(y, []) AS y FROM s)
SELECT lang, array_to_string(list_sort(list_distinct(x || y)), ',') AS all_items, array_to_string(list_sort(list_intersect(x, y)), ',') AS shared,
  array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(y, v))), ',') AS only_first, len(list_distinct(x || y))::INTEGER AS n_all, len(list_intersect(x, y))::INTEGER AS n_shared FROM t""")
def coverage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of long and of short documents by language: union, intersection, difference."""
    return E.set_overview(load(spark, sf_dir, "documents").select("lang", "source", "n_chars"), "lang", F.col("n_chars") > 2000, "source")


@query("""SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NOT NULL AND b.user_id IS NOT NULL THEN 'both' WHEN a.user_id IS NOT NULL THEN 'a' ELSE 'b' END AS side
FROM (SELECT DISTINCT user_id FROM events WHERE value > 90) a FULL OUTER JOIN (SELECT DISTINCT user_id FROM events WHERE value < 5) b ON a.user_id = b.user_id""")
def overlap_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return E.overlap(events.where("value > 90"), events.where("value < 5"), "user_id")


@query("""SELECT trim(o_orderpriority) AS population, trim(c_mktsegment) AS intervention, trim(o_orderstatus) AS comparator, array_to_string(list_sort(list_distinct(list(n_name))), ',') AS countries,
  array_to_string(list_sort(list_distinct(list(r_name))), ',') AS source_types, count(*) AS occurrence_count
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def exact_key_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one population, intervention and comparator as one, with the countries and types that they come from."""
    t = lambda n: load(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    who = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    rows = t("orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("o_orderpriority").alias("population"), F.col("c_mktsegment").alias("intervention"), F.col("o_orderstatus").alias("comparator"), "n_name", "r_name")
    out = E.consolidate(rows, ["population", "intervention", "comparator"], {"countries": "n_name", "source_types": "r_name"})
    return out.withColumn("countries", F.array_join("countries", ",")).withColumn("source_types", F.array_join("source_types", ","))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es')")
def split_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = spark.createDataFrame([("de",), ("es",)], "lang string")
    return E.in_split(load(spark, sf_dir, "documents").select("doc_id", "lang"), split, "lang")


@query("SELECT doc_id, lang FROM documents")
def split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ALL in a split keeps every row."""
    return E.in_split(load(spark, sf_dir, "documents").select("doc_id", "lang"), spark.createDataFrame([("ALL",)], "lang string"), "lang")


@query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest(load(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", ["event_type"])


@query("""SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9800) ON c_nationkey = n_nationkey GROUP BY n_name""")
def map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by country with zero rows for countries without any."""
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 9800").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    counts = rich.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers")
    return E.with_zeros(counts, nations, "n_name", "customers")


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)""")
def cross_case_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("customers"))


@query("""SELECT conv_id, turn, unnest(string_split(role, 's')) AS part, kind FROM conversations, (VALUES ('a'), ('b')) k(kind)""")
def record_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each combination of two lists."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("role", "s").alias("parts"), F.array(F.lit("a"), F.lit("b")).alias("kinds"))
    return E.expand(rows, {"part": "parts", "kind": "kinds"})


@query("""WITH a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE role <> 'user')
SELECT conv_id, pos::INTEGER AS pos, length(a.text)::INTEGER AS len_a, length(b.text)::INTEGER AS len_b FROM a JOIN b USING (conv_id, pos)""")
def position_zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    a = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("ta"), F.length("text").alias("len_a"))
    b = turns.where("role <> 'user'").select("conv_id", F.col("turn").alias("tb"), F.length("text").alias("len_b"))
    return E.zip_positions(a, b, ["conv_id"], "ta", "tb").select("conv_id", "pos", "len_a", "len_b")


@query("""SELECT p_partkey AS path, p_size AS modified, (p_partkey * 3)::BIGINT AS length FROM part WHERE p_size <> 7""")
def unseen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose signature the manifest lacks."""
    files = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("modified"), (F.col("p_partkey") * 3).alias("length"))
    signature = F.concat_ws("_", F.col("modified").cast("string"), F.col("length").cast("string"))
    manifest = files.where("modified = 7").select("path", signature.alias("signature"))
    return E.unseen(files, manifest).select("path", "modified", "length")


# --- validation statistics --------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT lang, avg(quality) AS p, avg(CASE WHEN toxic = 0 THEN quality * 1.0 END) AS r FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round(p, 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(CASE WHEN p + coalesce(r, 0) = 0 THEN 0 ELSE 2 * p * coalesce(r, 0) / (p + coalesce(r, 0)) END, 6) AS f1 FROM s""")
def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = rows.groupBy("lang").agg(S.mean_score(F.col("quality")).alias("p"), S.mean_score(F.when(F.col("toxic") == 0, F.col("quality"))).alias("r"))
    return out.select("lang", r6("p", "precision"), r6("r", "recall"), r6(S.f1(F.col("p"), F.col("r")), "f1"))


@query("""WITH s AS (SELECT lang, count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, round(po * 100, 6) AS agreement, round(CASE WHEN pa * pb + (1 - pa) * (1 - pb) = 1 THEN 1 ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END, 6) AS kappa FROM s""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return S.kappa(rows, ["lang"], "quality", "toxic").select("lang", "n", r6("agreement", "agreement"), r6("kappa", "kappa"))


TWO = "SELECT event_type, a, b FROM (SELECT event_type, value / 100 AS a, (value * 7 - floor(value * 7 / 100) * 100) / 100 AS b FROM events)"


@query(f"""WITH t AS ({TWO}), d AS (SELECT *, abs(a - b) AS diff, (a >= 0.5) AS x, (b >= 0.5) AS y FROM t),
k AS (SELECT *, CASE WHEN x = y THEN '' WHEN diff BETWEEN 0.1 AND 0.4 AND least(a, b) BETWEEN 0.3 AND 0.7 THEN 'incomplete' WHEN (a = 0 AND b > 0.6) OR (b = 0 AND a > 0.6) THEN 'omission'
  WHEN a > 0.7 AND b < 0.3 THEN 'over' WHEN a BETWEEN 0.3 AND 0.7 AND b BETWEEN 0.3 AND 0.7 THEN 'interpretation' ELSE '' END AS kind FROM d)
SELECT event_type, count(*) AS n_total, sum((x AND y)::INT)::BIGINT AS both_correct, sum((NOT x AND NOT y)::INT)::BIGINT AS both_missed, sum((x AND NOT y)::INT)::BIGINT AS ai_only, sum((NOT x AND y)::INT)::BIGINT AS human_only,
  sum((kind = 'incomplete')::INT)::BIGINT AS incomplete_extraction, sum((kind = 'omission')::INT)::BIGINT AS complete_omission, sum((kind = 'over')::INT)::BIGINT AS over_extraction, sum((kind = 'interpretation')::INT)::BIGINT AS interpretation_diff
FROM k GROUP BY event_type""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = load(spark, sf_dir, "events").select("event_type", (v / 100).alias("a"), ((v * 7 - F.floor(v * 7 / 100) * 100) / 100).alias("b"))
    return S.concordance(rows, ["event_type"], "a", "b")


T_VALUES = ", ".join(f"({i + 1}, {v})" for i, v in enumerate(S.t_quantiles()))
SPREAD = f"""t(df, q) AS (VALUES {T_VALUES}),
s AS (SELECT user_id, count(value) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id)"""


@query(f"""WITH {SPREAD} SELECT user_id, n, round(mean, 6) AS mean, round(CASE WHEN n >= 2 AND mean <> 0 THEN sd / mean * 100 ELSE 0 END, 6) AS cv,
  round(CASE WHEN n >= 2 AND mean <> 0 THEN sd / sqrt(n) / mean * 100 ELSE 0 END, 6) AS rse, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM s""")
def cv_rse_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.spread(load(spark, sf_dir, "events"), ["user_id"], "value")
    return out.select("user_id", "n", *(r6(c, c) for c in ("mean", "cv", "rse", "q1", "median", "q3")))


@query(f"""WITH {SPREAD} SELECT user_id, round(coalesce(mean - CASE WHEN n >= 2 THEN coalesce(q, 1.959964) * sd / sqrt(n) END, 0), 5) AS ci_low,
  round(coalesce(mean + CASE WHEN n >= 2 THEN coalesce(q, 1.959964) * sd / sqrt(n) END, 0), 5) AS ci_high FROM s LEFT JOIN t ON df = n - 1""")
def ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.spread(load(spark, sf_dir, "events"), ["user_id"], "value")
    return out.select("user_id", F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"))


@query("""WITH c AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY ALL), g AS (SELECT avg(x) AS g, count(*) AS c, var_pop(x) AS v FROM c),
r AS (SELECT var_pop(m) AS vr, count(*) AS n FROM (SELECT avg(x) AS m FROM c GROUP BY user_id)), k AS (SELECT var_pop(m) AS vc, count(*) AS k FROM (SELECT avg(x) AS m FROM c GROUP BY event_type)),
p AS (SELECT n, k, vr * n * k / (n - 1) AS msr, vc * n * k / (k - 1) AS msc, (v * c - vr * n * k - vc * n * k) / ((n - 1) * (k - 1)) AS mse FROM g, r, k)
SELECT n, k, round(greatest(0, least(1, (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n))), 6) AS icc_agreement_single FROM p""")
def icc_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.icc_agreement(load(spark, sf_dir, "events"), "user_id", "event_type", "value").select("n", "k", r6("icc_agreement_single", "icc_agreement_single"))


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS mean FROM events GROUP BY ALL)
SELECT user_id, arg_min(event_type, (-mean, event_type)) AS best, arg_min(event_type, (mean, event_type)) AS worst, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS sd,
  round(CASE WHEN avg(mean) = 0 THEN 0 ELSE (max(mean) - min(mean)) / avg(mean) * 100 END, 5) AS sensitivity FROM m GROUP BY user_id""")
def best_worst_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.best_and_worst(load(spark, sf_dir, "events"), ["user_id"], "event_type", "value")
    return out.select("user_id", "best", "worst", r6("mean", "mean"), r6("sd", "sd"), F.round("sensitivity", 5).alias("sensitivity"))


@query("""WITH e AS (SELECT event_type, user_id, avg(value / 100) AS r FROM events GROUP BY ALL)
SELECT event_type, round(avg(r), 6) AS total, CASE WHEN avg(r) > 0.75 THEN 'Excellent' WHEN avg(r) > 0.6 THEN 'Good' WHEN avg(r) > 0.4 THEN 'Fair' ELSE 'Poor' END AS icc_grade,
  CASE WHEN stddev_samp(r) / avg(r) * 100 < 3 THEN 'Excellent' WHEN stddev_samp(r) / avg(r) * 100 < 5 THEN 'Very Good' WHEN stddev_samp(r) / avg(r) * 100 < 10 THEN 'Good' WHEN stddev_samp(r) / avg(r) * 100 < 15 THEN 'Fair' ELSE 'Poor' END AS cv_grade FROM e GROUP BY event_type""")
def scenario_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted means of element means by scenario, with their grades."""
    means = load(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg(F.col("value") / 100).alias("r"))
    out = means.groupBy("event_type").agg(F.avg("r").alias("t"), (F.stddev_samp("r") / F.avg("r") * 100).alias("cv"))
    return out.select("event_type", r6("t", "total"), S.interpret_icc(F.col("t")).alias("icc_grade"), S.interpret_cv(F.col("cv")).alias("cv_grade"))


@query("""WITH k AS (SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN '_score' ELSE '_note' END AS name, CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE value::VARCHAR END AS value FROM events)
SELECT event_id, name, round(coalesce(try_cast(value AS DOUBLE), 0), 6) AS value FROM k WHERE ends_with(name, '_score')""")
def element_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_score").otherwise("_note"))
    value = F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("value").cast("string"))
    rows = load(spark, sf_dir, "events").select("event_id", name.alias("name"), value.alias("value"))
    return S.element_scores(rows, "name", "value").select("event_id", "name", r6("value", "value"))


# --- tables and layout ------------------------------------------------------------------------------------------------


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: a header row, then a row for each line item, in the order of numbers and cells."""
    row = F.array(
        F.col("l_linenumber").cast("string"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mg")),
        F.when(F.col("l_discount") > 0.05, "").otherwise(F.concat(F.lit("cost "), F.col("l_returnflag"))), F.col("l_linestatus"),
    )
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), row.alias("r")).alias("s"))
    body = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["r"]).alias("body"))
    head = F.array(F.array(*(F.lit(v) for v in ("Line", "Dose", "Charge", "Status"))))
    return body.select("l_orderkey", F.concat(head, "body").alias("t"))


ROWS_SQL = """rows AS (SELECT l_orderkey, count(*) + 1 AS n, sum(CASE WHEN l_discount > 0.05 THEN 3 ELSE 4 END) + 4 AS filled, max((NOT l_discount > 0.05)::INT) AS cost FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {ROWS_SQL} SELECT l_orderkey, CASE WHEN n BETWEEN 3 AND 50 AND filled / (4 * n) BETWEEN 0.3 AND 0.95 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS structure,
  round(least(1, 0.4 + 0.4 * cost + 0.2 * cost)::DOUBLE, 6) AS domain FROM rows""")
def table_structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return order_tables(spark, sf_dir).select("l_orderkey", B.structure_score(t).alias("structure"), r6(B.domain_score(t), "domain"))


def level_sql(n: int) -> str:
    (a, b, _, d), least = B.LEVELS[n]
    return f"structure * {a:e} + content * {b:e} + domain * {d:e} > {least:e} AS level{n}"


def any_sql(column: str, patterns: tuple[str, ...], flags: str = "(?i)") -> str:
    return f"regexp_matches({column}, '{flags}(?:{'|'.join(patterns)})')"


#: The tables of orders with scores, passes and flags.
TABLES_SQL = rf"""o AS (SELECT l_orderkey, l_linenumber AS n, [l_linenumber::VARCHAR, l_quantity::INTEGER || ' mg', CASE WHEN l_discount > 0.05::DOUBLE THEN '' ELSE 'cost ' || l_returnflag END, l_linestatus] AS r FROM lineitem),
tables AS (SELECT l_orderkey, [['Line', 'Dose', 'Charge', 'Status']] || list(r ORDER BY n, r) AS t FROM o GROUP BY l_orderkey),
cells AS (SELECT l_orderkey, t, array_to_string(flatten(t), ' ') AS text, list_filter(list_transform(flatten(t), lambda c: trim(c)), lambda c: c <> '') AS cs FROM tables),
shares AS (SELECT *, lower(array_to_string(cs, ' ')) AS low, len(list_filter(cs, lambda c: {any_sql("c", ("^(?:" + "|".join(B.NUMERIC_LIKE) + ")$",), "")})) / len(cs) AS numeric,
  len(list_filter(cs, lambda c: len(list_filter(regexp_split_to_array(c, '\s+'), lambda w: w <> '')) <= 5)) / len(cs) AS short FROM cells),
marks AS (SELECT *, {any_sql("low", B.DOSAGE)} AS dosage, {any_sql("low", B.PRICING)} AS pricing, {any_sql("low", B.MEDICAL)} AS medical FROM shares),
scores AS (SELECT *, CASE WHEN len(t) BETWEEN 3 AND 50 AND len(cs) / (len(t) * 4) BETWEEN 3e-1 AND 95e-2 THEN 1e0 ELSE 0e0 END AS structure,
  CASE WHEN len(cs) < 6 THEN 0e0 ELSE least(1e0, CASE WHEN numeric > 3e-1 THEN 4e-1 WHEN numeric > 1e-1 THEN 2e-1 ELSE 0e0 END + CASE WHEN short > 7e-1 THEN 3e-1 WHEN short > 5e-1 THEN 15e-2 ELSE 0e0 END
    + CASE WHEN {any_sql("array_to_string(cs[:20], ' ')", B.TABLE_LIKE, "")} THEN 3e-1 ELSE 0e0 END) END AS content,
  least(1e0, dosage::INT * 4e-1 + pricing::INT * 4e-1 + medical::INT * 2e-1 + (dosage AND pricing)::INT * 2e-1) AS domain FROM marks),
scored AS (SELECT *, {level_sql(1)}, {level_sql(2)}, {level_sql(3)}, regexp_matches(text, '(?i)\d+\s*(?:mg|μg|ml)') AS contains_dosage, regexp_matches(text, '(?i)[€$]\s*\d+|cost|price') AS contains_pricing,
  regexp_matches(text, '(?i)sorafenib|lenvatinib|treatment|therapy') AS contains_medication,
  CASE WHEN regexp_matches(lower(text), 'cost|price|€|\$') THEN 'pricing' WHEN regexp_matches(lower(text), '\d+\s*(?:mg|μg|ml)') THEN 'dosage' WHEN regexp_matches(lower(text), 'patient|study|trial') THEN 'clinical_data'
    WHEN regexp_matches(lower(text), 'treatment|therapy|medicinal') THEN 'treatment_info' ELSE 'general' END AS kind FROM scores)"""


@query(f"""WITH {TABLES_SQL} SELECT l_orderkey, round(content, 6) AS content, (CASE WHEN level1 THEN 1 WHEN level2 THEN 2 WHEN level3 THEN 3 ELSE 0 END)::INTEGER AS level,
  contains_dosage, contains_pricing, contains_medication, kind FROM scored""")
def table_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores, the pass that accepts a table, and its flags and class."""
    text, s = F.array_join(F.flatten("t"), " "), F.col("s")
    level = F.coalesce(*(F.when(B.is_valid(s, F.lit(0.0), n), n) for n in (1, 2, 3)), F.lit(0))
    scored = order_tables(spark, sf_dir).select("l_orderkey", text.alias("text"), B.scores(F.col("t")).alias("s"))
    return scored.select("l_orderkey", r6("s.content", "content"), level.alias("level"), *B.flags(F.col("text")), B.content_class(F.col("text")).alias("kind"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber AS n, [l_linenumber::VARCHAR, l_quantity::INTEGER || ' mg', CASE WHEN l_discount > 0.05::DOUBLE THEN '' ELSE 'cost ' || l_returnflag END, l_linestatus] AS r FROM lineitem),
p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, r) AS i, list_filter(['Line: ' || r[1], 'Dose: ' || r[2], CASE WHEN r[3] <> '' THEN 'Charge: ' || r[3] END, 'Status: ' || r[4]], lambda x: x IS NOT NULL) AS ps FROM o)
SELECT l_orderkey, 'Table Title: Order' || chr(10) || chr(10) || 'Table contains the following columns: Line, Dose, Charge, Status' || chr(10)
  || string_agg('Row ' || i || ': ' || array_to_string(ps[:-2], ', ') || ', and ' || ps[-1], chr(10) ORDER BY i) AS text FROM p GROUP BY l_orderkey""")
def table_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tables(spark, sf_dir).select("l_orderkey", B.narrative(F.col("t"), F.lit("Order")).alias("text"))


@query("""WITH w AS (SELECT l_orderkey % 50 AS page, l_quantity AS x0 FROM lineitem WHERE l_quantity < 12 OR l_quantity > 30), e AS (SELECT page, min(x0) AS lo, max(x0) AS hi FROM w GROUP BY page),
b AS (SELECT page, least(19, floor((x0 - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS c FROM w JOIN e USING (page) GROUP BY ALL), m AS (SELECT page, max(c) AS most FROM b GROUP BY page)
SELECT page, (21 - count(*) FILTER (c >= most * 0.1))::INTEGER AS columns FROM b JOIN m USING (page) GROUP BY page""")
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "lineitem").where("l_quantity < 12 or l_quantity > 30").select((F.col("l_orderkey") % 50).alias("page"), F.col("l_quantity").alias("x0"))
    return E.column_counts(words, ["page"]).select("page", "columns")


LAYOUT = """l AS (SELECT l_orderkey AS page, l_linenumber * 40.0 + l_quantity / 10 AS top, l_linenumber * 40.0 + l_quantity / 10 + 10 + l_tax * 100 AS bottom, l_quantity AS size, l_discount * 10 AS bold_share,
  CASE WHEN l_returnflag = 'A' THEN '1. HEADING ' || l_linenumber ELSE 'some words of running text that go on and on for a line ' || l_linenumber END AS text, l_suppkey FROM lineitem)"""


@query(f"""WITH {LAYOUT}, m AS (SELECT page, quantile_cont(size, 0.5) AS median FROM l GROUP BY page),
s AS (SELECT l.*, median, coalesce(top - lag(bottom) OVER (PARTITION BY page ORDER BY top, bottom, size, bold_share, text), 100) AS above, coalesce(lead(top) OVER (PARTITION BY page ORDER BY top, bottom, size, bold_share, text) - bottom, 100) AS below,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(1, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS upper, len(string_split(text, ' ')) AS words FROM l JOIN m USING (page))
SELECT page, text, top, (CASE WHEN size / median >= 1.3 THEN 2 WHEN size / median >= 1.1 THEN 1 ELSE 0 END + CASE WHEN upper > 0.8 THEN 2 WHEN upper > 0.6 THEN 1 ELSE 0 END
  + CASE WHEN words < 6 THEN 2 WHEN words < 12 THEN 1 ELSE 0 END + CASE WHEN bold_share > 0.7 THEN 2 WHEN bold_share > 0.3 THEN 1 ELSE 0 END + CASE WHEN starts_with(text, '1. ') THEN 2 ELSE 0 END
  + CASE WHEN above > 15 AND below > 10 THEN 2 WHEN above > 10 OR below > 8 THEN 1 ELSE 0 END)::INTEGER AS heading_score FROM s""")
def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    top = n * 40.0 + q / 10
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("1. HEADING "), n.cast("string"))).otherwise(F.concat(F.lit("some words of running text that go on and on for a line "), n.cast("string")))
    lines = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), top.alias("top"), (top + 10 + F.col("l_tax") * 100).alias("bottom"), q.alias("size"), (F.col("l_discount") * 10).alias("bold_share"), text.alias("text")
    )
    return E.heading_scores(lines, ["page"]).select("page", "text", "top", "heading_score")


@query("""WITH s AS (SELECT l_orderkey AS page, l_linenumber, l_quantity AS x0, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity + 200 ELSE l_quantity + 1 END AS x1, l_linenumber * 10.0 AS y0, CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber * 10.0 + 1 ELSE l_linenumber * 10.0 + 50 END AS y1 FROM lineitem),
k AS (SELECT *, CASE WHEN x1 - x0 > 100 AND y1 - y0 < 3 THEN 'h' WHEN y1 - y0 > 30 AND x1 - x0 < 3 THEN 'v' END AS kind FROM s),
c AS (SELECT page, count(*) AS n FROM k GROUP BY page HAVING count(*) >= 6 AND sum((kind = 'h')::INT) >= 3 AND sum((kind = 'v')::INT) >= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY y0, x0, y1, x1) AS place FROM k WHERE kind IS NOT NULL),
x AS (SELECT h.page, avg((v.x0 BETWEEN h.x0 AND h.x1 AND h.y0 BETWEEN v.y0 AND v.y1)::INT) AS crossing FROM p h JOIN p v ON h.page = v.page AND h.kind = 'h' AND v.kind = 'v' AND h.place <= 5 AND v.place <= 4 GROUP BY h.page)
SELECT page, n, round(crossing, 6) AS crossing FROM c JOIN x USING (page) WHERE crossing >= 0.3""")
def grid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    flat = n % 2 == 1
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), q.alias("x0"), F.when(flat, q + 200).otherwise(q + 1).alias("x1"), (n * 10.0).alias("y0"), F.when(flat, n * 10.0 + 1).otherwise(n * 10.0 + 50).alias("y1")
    )
    return E.grid_pages(rows, ["page"]).select("page", "n", r6("crossing", "crossing"))


@query("""WITH RECURSIVE w AS (SELECT l_orderkey AS page, l_returnflag AS text, l_quantity AS y, l_extendedprice AS x0, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_returnflag) AS i FROM lineitem),
f AS (SELECT page, i, 1 AS line_no, y AS top FROM w WHERE i = 1 UNION ALL
  SELECT w.page, w.i, CASE WHEN y - top <= 3 THEN line_no ELSE line_no + 1 END, CASE WHEN y - top <= 3 THEN top ELSE y END FROM f JOIN w ON w.page = f.page AND w.i = f.i + 1)
SELECT page, line_no::INTEGER AS line_no, top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM f JOIN w USING (page, i) GROUP BY page, line_no, top""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page, one an event, joined to lines."""
    words = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("text"), F.col("l_quantity").alias("top"), F.col("l_extendedprice").alias("x0"))
    return E.words_to_lines(words, ["page"])


FILE_NAMES = """concat(lower(replace(p_brand, '#', '')), '_', replace(p_name, ' ', '_'), CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('_', p_size) END, CASE WHEN p_size % 10 = 9 THEN '.txt' ELSE '_retrieval_results.json' END) AS name"""
REQUESTS = (
    "c_custkey", "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'et' ELSE concat('brand', c_custkey % 30) END AS source_type",
    "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'small_ring' WHEN 2 THEN 'red_widget' ELSE 'ring' END AS retrieval_type",
    "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(c_custkey % 50, ' MG') ELSE '  ' END AS indication",
)


@query(f"""WITH f AS (SELECT DISTINCT name FROM (SELECT {FILE_NAMES} FROM part) WHERE ends_with(name, '_retrieval_results.json')),
r AS (SELECT c_custkey, coalesce(source_type, '') AS s, coalesce(retrieval_type, '') AS t, nullif(split_part(trim(coalesce(indication, '')), ' ', 1), '') AS i FROM (SELECT {', '.join(REQUESTS)} FROM customer)),
k AS (SELECT *, s || CASE WHEN t <> '' THEN '_' || t ELSE '' END AS stem FROM r),
h AS (SELECT c_custkey, 1 AS rule, name FROM k JOIN f ON name = stem || '_' || lower(i) || '_retrieval_results.json' UNION ALL SELECT c_custkey, 2, name FROM k JOIN f ON name = stem || '_retrieval_results.json'
  UNION ALL SELECT c_custkey, 3, min(name) FROM k JOIN f ON contains(name, s) AND contains(name, t) GROUP BY c_custkey),
b AS (SELECT c_custkey, arg_min(name, rule) AS name, min(rule) AS rule FROM h GROUP BY c_custkey)
SELECT c_custkey, name, rule::INTEGER AS rule FROM customer LEFT JOIN b USING (c_custkey)""")
def file_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each request means, by the first rule that finds one."""
    files = load(spark, sf_dir, "part").selectExpr(FILE_NAMES)
    return U.resolve(load(spark, sf_dir, "customer").selectExpr(*REQUESTS), files, "c_custkey")
