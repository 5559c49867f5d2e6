"""Queries over language posteriors. The model learns from the documents whose identifier isn't divisible by 5; the others test it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import languages as L
from .registry import load, query

HELD_OUT = "doc_id % 5 = 0"


def model(spark: SparkSession, sf_dir: str) -> L.Model:
    return L.learn(load(spark, sf_dir, "documents").where(f"NOT ({HELD_OUT})"), "text", "lang")


#: Trigrams in SQL with how often each word of a row's has them.
GRAMS = r"""(SELECT {key}, n, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i::BIGINT, 3))) AS gram
  FROM (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g'), ' ')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL))"""
MODEL = f"""WITH learned AS (SELECT * FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL AND lang NOT IN ('', 'unknown')),
c AS (SELECT lang, gram, sum(n) AS n FROM {GRAMS.format(key="lang", rows="learned")} GROUP BY ALL),
t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), v AS (SELECT count(DISTINCT gram) AS v FROM c),
m AS MATERIALIZED (SELECT gram, lang, ln((coalesce(n, 0) + 1) / (total + v)::DOUBLE) AS l FROM (SELECT DISTINCT gram FROM c) CROSS JOIN t CROSS JOIN v LEFT JOIN c USING (gram, lang)),
u AS (SELECT lang, ln(1 / (total + v)::DOUBLE) AS l FROM t, v)"""


def posterior_sql(key: str, rows: str) -> str:
    """CTEs g, s, e and p (key, lang, p) for the rows of a table."""
    return f"""g AS (SELECT {key}, gram, sum(n) AS n FROM {GRAMS.format(key=key, rows=rows)} GROUP BY ALL),
s AS (SELECT {key}, lang, sum(w) AS s FROM (SELECT {key}, u.lang, n * coalesce(m.l, u.l) AS w FROM g CROSS JOIN u LEFT JOIN m ON m.gram = g.gram AND m.lang = u.lang UNION ALL SELECT DISTINCT {key}, u.lang, 0.0 FROM {rows}, u) GROUP BY ALL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY {key})) AS e FROM s), p AS (SELECT {key}, lang, e, e / sum(e) OVER (PARTITION BY {key}) AS p FROM e)"""


@query(f"""{MODEL}, {posterior_sql("doc_id", "documents")}
SELECT doc_id, arg_min(lang, (-e, lang)) AS language, round(max(p), 6) AS p_best, round(max(p) FILTER (lang = 'en'), 6) AS p_en FROM p GROUP BY doc_id""")
def language_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest language of each whole text, its probability and that of English."""
    found = L.posteriors(load(spark, sf_dir, "documents"), ["doc_id"], model(spark, sf_dir))
    return found.select("doc_id", "language", F.round(F.array_max(F.map_values("p")), 6).alias("p_best"), F.round(F.col("p")["en"], 6).alias("p_en"))


@query(f"""{MODEL}, test AS (SELECT * FROM documents WHERE doc_id % 5 = 0 AND lang IN (SELECT lang FROM t)), {posterior_sql("doc_id", "test")},
b AS (SELECT doc_id, arg_min(lang, (-e, lang)) AS language FROM p GROUP BY doc_id)
SELECT lang, count(*) AS n, count(*) FILTER (lang = language) AS n_right FROM test JOIN b USING (doc_id) GROUP BY lang""")
def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many held-out documents of each language are recognised."""
    learned = model(spark, sf_dir)
    rows = load(spark, sf_dir, "documents").where(HELD_OUT).where(F.col("lang").isin(*learned.languages))
    found = L.posteriors(rows, ["doc_id", "lang"], learned)
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("language")).alias("n_right"))


@query(f"""{MODEL}, turns AS (SELECT conv_id * 100000 + turn AS k, * FROM conversations),
dg AS (SELECT * FROM (WITH {posterior_sql("conv_id", "conversations")} SELECT conv_id, arg_min(lang, (-e, lang)) AS document FROM p GROUP BY conv_id)),
tp AS (SELECT * FROM (WITH {posterior_sql("k", "turns")} SELECT * FROM p)),
x AS (SELECT k, conv_id, turn, length(regexp_replace(coalesce(any_value(text), ''), '[^A-Za-z]', '', 'g')) AS letters, any_value(document) AS document, max(p) FILTER (lang = 'en') AS en, max(p) FILTER (lang = document) AS other
  FROM turns JOIN dg USING (conv_id) JOIN tp USING (k) GROUP BY ALL)
SELECT conv_id, turn, document, letters < 2 OR CASE WHEN document <> 'en' THEN en >= 0.90 AND en >= other + 0.20 ELSE en >= 0.85 END AS english FROM x""")
def english_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of a conversation count as English, given the language of the whole conversation."""
    learned, turns = model(spark, sf_dir), load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    whole = L.posteriors(turns, ["conv_id"], learned).select("conv_id", F.col("language").alias("document"))
    each = L.posteriors(turns, ["conv_id", "turn", "text"], learned).join(whole, "conv_id")
    return each.select("conv_id", "turn", "document", L.is_english(F.col("text"), F.col("p"), F.col("document")).alias("english"))
