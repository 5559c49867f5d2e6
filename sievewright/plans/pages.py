"""Queries over pages, table passes, semantic chunks, outcomes and reliability bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as B
from ..functions import text as T
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import statistics as S
from ..operators import synonyms as Y
from ..sources import providers
from .analytics import T_VALUES, TABLES_SQL, order_tables, r6
from .registry import load, query


@query("""SELECT l_orderkey AS page, l_linenumber, l_suppkey, (CASE WHEN l_quantity >= 34 THEN 3 WHEN l_quantity >= 17 THEN 2 ELSE 1 END)::INTEGER AS "column",
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity >= 34 THEN 3 WHEN l_quantity >= 17 THEN 2 ELSE 1 END, floor(l_linenumber * 2.0 / 3), l_quantity, l_suppkey || '-' || l_linenumber || '-' || l_partkey)::INTEGER AS place FROM lineitem""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words: quantity is the position across, the line number the one down."""
    words = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), "l_linenumber", "l_suppkey", F.col("l_quantity").alias("x0"), (F.col("l_linenumber") * 2.0).alias("top"),
        F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("text"),
    )
    return D.reading_order(words, ["page"], F.array(F.lit(17.0), F.lit(34.0))).select("page", "l_linenumber", "l_suppkey", "column", "place")


@query(r"""WITH l AS (SELECT o_custkey AS page, o_orderkey AS line_no, CASE o_orderstatus WHEN 'F' THEN 'Table ' || o_orderkey || ' doses' WHEN 'O' THEN 'plain line ' || o_orderkey ELSE 'treatment ' || o_orderkey || repeat('x', (o_orderkey % 200)::INT) END AS text FROM orders)
SELECT page, trim(arg_max(text, line_no)) AS title FROM l WHERE regexp_matches(text, '(?i)(^\s*Table\s+\d+|^\s*Treatment\s+(?:costs|mode|schedule))') OR (contains(lower(text), 'treatment') AND length(text) <= 100) GROUP BY page""")
def table_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Table "), key, F.lit(" doses"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("plain line "), key))
        .otherwise(F.concat(F.lit("treatment "), key, F.repeat(F.lit("x"), (F.col("o_orderkey") % 200).cast("int"))))
    )
    lines = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("line_no"), text.alias("text"))
    return D.table_title(lines, ["page"])


@query("""SELECT c.conv_id, c.turn, coalesce(bool_or(contains(c.text, h.heading)), false) AS is_heading FROM conversations c
LEFT JOIN (SELECT DISTINCT conv_id, split_part(text, ' ', 2) AS heading FROM conversations WHERE turn % 2 = 0 AND trim(split_part(text, ' ', 2)) <> '') h ON c.conv_id = h.conv_id GROUP BY c.conv_id, c.turn""")
def headings_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold the second word of an even turn of their conversation."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    headings = turns.where("turn % 2 = 0").select("conv_id", F.get(F.split("text", " "), F.lit(1)).alias("heading")).where("heading is not null")
    marked = D.mark_headings(turns, headings, ["conv_id"], "text")
    return marked.groupBy("conv_id", "turn").agg(F.bool_or("is_heading").alias("is_heading"))


@query(r"""WITH RECURSIVE l AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\x0b\f\r')), lambda x: x <> '')[:5] AS ls FROM conversations),
p AS (SELECT conv_id, turn, text, list_filter(ls, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) <= 7
  AND ((upper(x) = x AND lower(x) <> x) OR (regexp_matches(x[:3], '\d') AND NOT starts_with(lower(x), 'page'))))[1] AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM l),
f AS (SELECT conv_id, i, 1 AS section, 1 AS n FROM p WHERE i = 1 UNION ALL
  SELECT p.conv_id, p.i, CASE WHEN h IS NOT NULL OR n >= 5 THEN section + 1 ELSE section END, CASE WHEN h IS NOT NULL OR n >= 5 THEN 1 ELSE n + 1 END FROM f JOIN p ON p.conv_id = f.conv_id AND p.i = f.i + 1)
SELECT conv_id, section::INTEGER AS section, coalesce(max(h), '') AS heading, string_agg(text, chr(10) ORDER BY i) AS text, min(turn) AS start_page, max(turn) AS end_page FROM f JOIN p USING (conv_id, i) GROUP BY conv_id, section""")
def fallback_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the pages of a conversation."""
    return D.fallback_sections(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"""WITH {TABLES_SQL}, k AS (SELECT *, l_orderkey // 100 AS doc, l_orderkey // 10 AS page, level1 AS v1 FROM scored),
a AS (SELECT *, bool_or(v1) OVER (PARTITION BY doc, page) AS p1, bool_or(v1) OVER (PARTITION BY doc) AS d1 FROM k),
b AS (SELECT *, NOT p1 AND d1 AND level2 AS v2 FROM a), c AS (SELECT *, bool_or(v2) OVER (PARTITION BY doc, page) AS p2 FROM b),
q AS (SELECT *, CASE WHEN v1 THEN 1 WHEN v2 THEN 2 WHEN NOT p1 AND NOT p2 AND level3 THEN 3 END AS pass FROM c),
n AS (SELECT doc, page, count(*) AS n, count(*) FILTER (contains_pricing) AS a, count(*) FILTER (contains_dosage) AS b, count(*) FILTER (contains_medication) AS c,
  count(*) FILTER (pass = 1) AS p1, count(*) FILTER (pass = 2) AS p2, count(*) FILTER (pass = 3) AS p3 FROM q WHERE pass IS NOT NULL GROUP BY doc, page)
SELECT doc, sum(n)::BIGINT AS tables, sum(a)::BIGINT AS contains_pricing, sum(b)::BIGINT AS contains_dosage, sum(c)::BIGINT AS contains_medication, sum(p1)::BIGINT AS pass_1, sum(p2)::BIGINT AS pass_2, sum(p3)::BIGINT AS pass_3,
  '{{' || string_agg('"' || page || '":' || n, ',' ORDER BY page) || '}}' AS by_page FROM n GROUP BY doc""")
def table_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of orders, ten to a page and a hundred to a document, through the three passes, summed up by document."""
    tables = order_tables(spark, sf_dir).select(
        "l_orderkey", F.floor(F.col("l_orderkey") / 100).alias("doc"), F.floor(F.col("l_orderkey") / 10).alias("page"), "t",
        F.lit(0.0).alias("ruled"), *B.flags(F.array_join(F.flatten("t"), " ")),
    )
    out = D.table_summary(D.detect_tables(tables, "doc", "page"), "doc", "page")
    return out.withColumn("by_page", F.to_json("by_page"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' sentences joined where hashed embeddings stay close."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))
    rows = providers.embed(rows.select("conv_id", F.struct("turn", "pos").alias("at"), "text"))
    return D.semantic_chunks(rows, ["conv_id"], "at", "text", "embedding", 200)


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, greatest(1, length(text) // 4) AS tokens,
  list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM conversations),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS place, 0::BIGINT AS tokens, 0::BIGINT AS total, []::VARCHAR[] AS covered, false AS taken FROM t UNION ALL
  SELECT conv_id, place, tokens, CASE WHEN taken THEN total + tokens ELSE total END, CASE WHEN taken THEN list_distinct(covered || ws) ELSE covered END, taken FROM (
    SELECT t.conv_id, t.place, t.tokens, total, covered, ws, total + t.tokens <= 100 OR (total + t.tokens <= 100 * 11e-1 AND len(list_filter(ws, lambda w: NOT list_contains(covered, w))) > 0) AS taken
    FROM f JOIN t ON t.conv_id = f.conv_id AND t.place = f.place + 1 WHERE t.place <= 40))
SELECT conv_id, place::INTEGER AS place, tokens::INTEGER AS tokens FROM f WHERE taken""")
def coverage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that add words, within 100 tokens, and a tenth more for those that do."""
    turns = load(spark, sf_dir, "conversations").withColumn("words", T.token_set(F.col("text")))
    return D.cover_budget(turns, ["conv_id"], ["turn"], "text", "words", 100, 40)


LISTS = """o AS (SELECT event_id, event_type || ',  ' || CASE WHEN user_id % 2 = 0 THEN 'Overall  Survival' ELSE 'OS' END || ', ,' || user_id % 5 AS outcomes, 'U' || user_id % 3 AS country FROM events),
s AS (SELECT event_id, country, trim(regexp_replace(unnest(string_split(outcomes, ',')), '\\s+', ' ', 'g')) AS outcome FROM o)"""


@query(f"""WITH {LISTS.replace(chr(92) * 2, chr(92))}, d(name, canonical, category, subcategory) AS (VALUES ('os', 'overall survival', 'efficacy', 'survival'), ('overall survival', 'overall survival', 'efficacy', 'survival'))
SELECT coalesce(category, 'other') AS category, coalesce(subcategory, 'other') AS subcategory, coalesce(canonical, lower(outcome)) AS outcome, array_to_string(list_sort(list_distinct(list(country))), ',') AS countries, count(*) AS n
FROM s LEFT JOIN d ON lower(outcome) = name WHERE outcome <> '' GROUP BY 1, 2, 3""")
def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    text = F.concat("event_type", F.lit(",  "), F.when(user % 2 == 0, "Overall  Survival").otherwise("OS"), F.lit(", ,"), (user % 5).cast("string"))
    rows = load(spark, sf_dir, "events").select(text.alias("outcomes"), F.concat(F.lit("U"), (user % 3).cast("string")).alias("country"))
    names = [(n, "overall survival", "efficacy", "survival") for n in ("os", "overall survival")]
    dictionary = F.broadcast(spark.createDataFrame(names, "name string, canonical string, category string, subcategory string"))  # a fixed list
    out = D.class_outcomes(D.split_outcomes(rows), dictionary)
    return out.withColumn("countries", F.array_join("countries", ","))


@query("""WITH s AS (SELECT p_partkey, p_type, p_size FROM part), a AS (SELECT DISTINCT n_name AS country, r_name AS source_type FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2)
SELECT country, source_type, count(*) AS n FROM (SELECT p_partkey, 'X' || p_size AS country, 'said' AS source_type FROM s WHERE p_size <= 10 UNION ALL SELECT p_partkey, country, source_type FROM s, a WHERE p_size > 10) GROUP BY country, source_type""")
def outcome_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that name their reporter, and others that count for all."""
    said = F.array(F.struct(F.concat(F.lit("X"), F.col("p_size").cast("string")).alias("country"), F.lit("said").alias("source_type")))
    outcomes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("outcome"), F.when(F.col("p_size") <= 10, said).alias("reported_by"))
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region").where("r_regionkey < 2"), F.col("n_regionkey") == F.col("r_regionkey"))
    records = D.attribute_outcomes(outcomes, places.select(F.col("n_name").alias("country"), F.col("r_name").alias("source_type")))
    return records.groupBy("country", "source_type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_type, avg((value >= 50)::INT) AS ai, avg((value * 7 - floor(value * 7 / 100) * 100 >= 50)::INT) AS human, count(*) AS n FROM events GROUP BY event_type)
SELECT round(avg(ai), 6) AS ai, round(avg(human), 6) AS human, round(avg(ai - human), 6) AS difference, sum(n)::BIGINT AS n FROM e""")
def macro_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by element, then over elements, of two raters."""
    v = F.col("value")
    by = load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.avg((v >= 50).cast("int")).alias("ai"), F.avg((v * 7 - F.floor(v * 7 / 100) * 100 >= 50).cast("int")).alias("human"), F.count("*").alias("n")
    )
    return by.agg(r6(F.avg("ai"), "ai"), r6(F.avg("human"), "human"), r6(F.avg(F.col("ai") - F.col("human")), "difference"), F.sum("n").alias("n"))


@query(f"""WITH t(df, q) AS (VALUES {T_VALUES}), m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY event_type),
s AS (SELECT count(*) AS n, avg(mean) AS mean, coalesce(stddev_samp(mean), 0) AS sd, quantile_cont(mean, 0.25) AS q1, quantile_cont(mean, 0.5) AS median, quantile_cont(mean, 0.75) AS q3, min(mean) AS lo, max(mean) AS hi,
  arg_min(event_type, (-mean, event_type)) AS best, arg_min(event_type, (mean, event_type)) AS worst FROM m),
x AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY ALL), g AS (SELECT count(*) AS c, var_pop(x) AS v FROM x),
r AS (SELECT var_pop(m) AS vr, count(*) AS nr FROM (SELECT avg(x) AS m FROM x GROUP BY user_id)), k AS (SELECT var_pop(m) AS vc, count(*) AS k FROM (SELECT avg(x) AS m FROM x GROUP BY event_type)),
p AS (SELECT nr, k, vr * nr * k / (nr - 1) AS msr, vc * nr * k / (k - 1) AS msc, (v * c - vr * nr * k - vc * nr * k) / ((nr - 1) * (k - 1)) AS mse FROM g, r, k),
i AS (SELECT greatest(0, least(1, (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / nr))) AS icc FROM p),
w AS (SELECT *, CASE WHEN n >= 2 AND mean <> 0 THEN sd / mean * 100 ELSE 0 END AS cv, CASE WHEN n >= 2 THEN coalesce(q, 1.959964) * sd / sqrt(n) END AS half FROM s LEFT JOIN t ON df = n - 1)
SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(cv, 6) AS cv, round(cv / sqrt(n), 6) AS rse, round(coalesce(mean - half, 0), 5) AS ci_low, round(coalesce(mean + half, 0), 5) AS ci_high,
  round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lo, 6) AS min, round(hi, 6) AS max, best, worst, round(CASE WHEN mean = 0 THEN 0 ELSE (hi - lo) / mean * 100 END, 6) AS sensitivity, round(icc, 6) AS icc_agreement_single,
  CASE WHEN icc > 0.75 THEN 'Excellent' WHEN icc > 0.6 THEN 'Good' WHEN icc > 0.4 THEN 'Fair' ELSE 'Poor' END AS icc_grade,
  CASE WHEN cv < 3 THEN 'Excellent' WHEN cv < 5 THEN 'Very Good' WHEN cv < 10 THEN 'Good' WHEN cv < 15 THEN 'Fair' ELSE 'Poor' END AS cv_grade FROM w, i""")
def reliability_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread, range, correlation, best and worst scenario in one row: user_id is the item, event_type the scenario."""
    events = load(spark, sf_dir, "events").select("user_id", "event_type", "value")
    means = events.groupBy("event_type").agg(F.avg("value").alias("mean")).withColumn("all", F.lit(1))
    spread = S.spread(means, ["all"], "mean")
    best = S.best_and_worst(events.withColumn("all", F.lit(1)), ["all"], "event_type", "value").select("all", "best", "worst", "sensitivity")
    icc = S.icc_agreement(events, "user_id", "event_type", "value").select(F.lit(1).alias("all"), "icc_agreement_single")
    out = spread.join(best, "all").join(icc, "all").drop("all")
    graded = out.withColumn("icc_grade", S.interpret_icc(F.col("icc_agreement_single"))).withColumn("cv_grade", S.interpret_cv(F.col("cv")))
    figures = ("mean", "sd", "cv", "rse", "q1", "median", "q3", "min", "max", "sensitivity", "icc_agreement_single")
    return graded.withColumns({c: F.round(c, 6) for c in figures} | {c: F.round(c, 5) for c in ("ci_low", "ci_high")})


@query("""WITH c AS (SELECT r_name, n_name, c_mktsegment, count(DISTINCT c_acctbal) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_name, sum(n)::INTEGER AS n FROM c GROUP BY r_name""")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values the nested map of each region holds, by nation and segment."""
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.collect_set(F.col("c_acctbal").cast("string")).alias("names"))
    subs = names.groupBy("r_name", "n_name").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "names"))).alias("subs"))
    nested = subs.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "subs"))).alias("nested"))
    return nested.select("r_name", E.nested_count(F.col("nested")).alias("n"))


@query("""SELECT count(*) AS rows_, count(DISTINCT lang) AS countries, count(DISTINCT source) AS sources, array_to_string(list_sort(list_distinct(list(lang))), ',') AS names FROM documents""")
def store_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("rows_"), F.countDistinct("lang").alias("countries"), F.countDistinct("source").alias("sources"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"))


#: Runs of ten or more letters a-z stand for outcome names; the SQL's distance counts bytes.
NAMES = r"""SELECT unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) AS name FROM conversations"""


def outcome_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), F.lit(0))).alias("name"))


@query(f"""WITH n AS (SELECT DISTINCT name FROM ({NAMES}))
SELECT x.name AS a, y.name AS b, levenshtein(x.name, y.name)::INTEGER AS distance FROM n x JOIN n y ON x.name < y.name AND abs(length(x.name) - length(y.name)) <= 1 AND levenshtein(x.name, y.name) <= 1""")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct names within one edit."""
    return Y.similar_strings(outcome_names(spark, sf_dir), "name", 1)


@query(f"""WITH RECURSIVE c AS (SELECT name, count(*) AS n FROM ({NAMES}) GROUP BY name),
p AS MATERIALIZED (SELECT x.name AS a, y.name AS b FROM c x JOIN c y ON x.name <> y.name AND abs(length(x.name) - length(y.name)) <= 1 AND levenshtein(x.name, y.name) <= 1),
w AS (SELECT name AS node, name AS seen FROM c UNION SELECT w.node, p.b FROM w JOIN p ON p.a = w.seen),
g AS (SELECT node, min(seen) AS least FROM w GROUP BY node)
SELECT name, arg_min(name, (-n, name)) OVER (PARTITION BY least) AS canonical, n FROM c JOIN g ON node = name""")
def synonym_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names merged under the most frequent one of their group."""
    return Y.synonym_groups(outcome_names(spark, sf_dir), "name", 1)
