"""Queries over vectors and ranked passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import vector_index as V
from .registry import load, query
from .scenarios import retrieve_near

# The corpus is invented prose, so that rankings run with its own frequent words in place of the domain's terms.
HEADINGS, DRUGS, MUTATIONS = ("the ", "en"), ("with", "license"), ("tion", "ment")
REQUIRED = ("license", " the[rn]", "entre ")
POPULATION, COMPARATOR, BIOMARKER = ("the", "of", "and", "to", "in"), ("with", "und", "les"), ("license", "was", "der")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the first line is the heading, lang the country, some sources submissions and others guidelines."""
    kind = F.when(F.length("source") == 4, "hta_submission").otherwise("clinical_guideline")
    heading = F.substring_index("text", "\n", 1)
    return load(spark, sf_dir, "documents").select("doc_id", "text", heading.alias("heading"), F.col("lang").alias("country"), kind.alias("source_type"))


CHUNKS = """chunks AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS heading, lang AS country,
  CASE WHEN length(source) = 4 THEN 'hta_submission' ELSE 'clinical_guideline' END AS source_type FROM documents)"""


def has(column: str, terms) -> list[str]:
    return [f"contains(lower({column}), '{t.lower()}')" for t in dict.fromkeys(terms)]


def boost_sql(b: R.Boost) -> str:
    if not b.terms:
        return "0.0"
    if b.any:
        return f"(CASE WHEN {' OR '.join(has(b.column, b.terms))} THEN {b.weight} ELSE 0 END)"
    n = " + ".join(f"{h}::int" for h in has(b.column, b.terms))
    return f"(least({n}, {b.most}) * {b.weight})" if b.most else f"(({n}) * {b.weight})"


def score_sql(r: R.Ranking) -> str:
    return " + ".join(["base::double", *(boost_sql(b) for b in r.boosts)])


def ranking_sql(r: R.Ranking, source_type: str, final_k: int) -> str:
    required = f" AND regexp_matches(lower(text) || ' ' || lower(coalesce(heading, '')), '{'|'.join(r.required)}')" if r.required else ""
    score = score_sql(r)
    k = 2 * final_k if r.coverage else final_k
    return f"""WITH {CHUNKS},
b AS (SELECT *, count(*) OVER (PARTITION BY country) - row_number() OVER (PARTITION BY country ORDER BY doc_id) + 1 AS base
  FROM chunks WHERE source_type = '{source_type}'{required}),
s AS (SELECT country, doc_id, base, {score} AS score FROM b)
SELECT country, doc_id, base, score::double AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, base DESC) AS place FROM s) WHERE place <= {k}"""


def ranked(spark: SparkSession, sf_dir: str, r: R.Ranking, source_type: str, final_k: int) -> DataFrame:
    rows = chunks(spark, sf_dir).where(F.col("source_type") == source_type)
    return R.rerank(rows, r, ["country"], ["doc_id"], final_k).select("country", "doc_id", "base", "score", "place")


SUBMISSION_POPULATION = R.submission_population(HEADINGS, DRUGS, MUTATIONS, POPULATION, COMPARATOR, BIOMARKER, ("the", "la"))
SUBMISSION_OUTCOMES = R.submission_outcomes(HEADINGS, MUTATIONS, POPULATION, COMPARATOR, BIOMARKER, ("the", "la"))
GUIDELINE_POPULATION = R.guideline_population(HEADINGS, DRUGS, MUTATIONS, REQUIRED, POPULATION, COMPARATOR, BIOMARKER)
GUIDELINE_OUTCOMES = R.guideline_outcomes(HEADINGS, MUTATIONS, REQUIRED, POPULATION, COMPARATOR, BIOMARKER, ("the", "la"))


@query(ranking_sql(SUBMISSION_POPULATION, "hta_submission", 15))
def rerank_population_comparator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, SUBMISSION_POPULATION, "hta_submission", 15)


@query(ranking_sql(SUBMISSION_OUTCOMES, "hta_submission", 15))
def rerank_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, SUBMISSION_OUTCOMES, "hta_submission", 15)


@query(ranking_sql(GUIDELINE_POPULATION, "clinical_guideline", 12))
def rerank_guideline_pc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, GUIDELINE_POPULATION, "clinical_guideline", 12)


@query(ranking_sql(GUIDELINE_OUTCOMES, "clinical_guideline", 12))
def rerank_guideline_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, GUIDELINE_OUTCOMES, "clinical_guideline", 12)


@query(f"""WITH {CHUNKS} SELECT doc_id, country, source_type FROM chunks
WHERE regexp_matches(lower(text) || ' ' || lower(coalesce(heading, '')), '{"|".join(REQUIRED)}')""")
def required_terms_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.required_terms(chunks(spark, sf_dir), REQUIRED).select("doc_id", "country", "source_type")


@query("""WITH q AS (SELECT embedding::double[] AS q, label FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(distance, 6) AS distance FROM (
  SELECT vec_id, list_sum([(x[1]::double - x[2]) * (x[1]::double - x[2]) for x in list_zip(embedding, q)]) AS distance
  FROM embeddings e JOIN q ON e.label = q.label) ORDER BY distance, vec_id LIMIT 10""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to vector 0 among those of its label."""
    store = load(spark, sf_dir, "embeddings")
    one = store.where("vec_id = 0").select(F.col("embedding").alias("q"), "label")
    wanted = one.select("label").first()  # one value, so that the filter reaches the scan
    found = R.filtered_search(store, one.select("q"), 10, F.col("label") == F.lit(wanted[0]) if wanted else F.lit(False))
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query("""WITH q AS (SELECT label, vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT e.label, query_id, e.vec_id, list_sum([(x[1]::double - x[2]) * (x[1]::double - x[2]) for x in list_zip(embedding, q.q)]) AS distance
  FROM embeddings e JOIN q ON e.label = q.label)
SELECT label, query_id, vec_id, round(distance, 6) AS distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5""")
def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector the five nearest vectors of its label; one without a label has none."""
    store, queries = (rows.where("label IS NOT NULL") for rows in asked(spark, sf_dir))
    found = V.exact_search(store, queries, 5, label="label", with_label=True)
    return found.select("label", "query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


NEAREST = """WITH q AS (SELECT label, vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, e.vec_id, list_sum([(x[1]::double - x[2]) * (x[1]::double - x[2]) for x in list_zip(embedding, q.q)]) AS distance FROM embeddings e JOIN q ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM r WHERE rank <= 10"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The store, and every twentieth vector as a query."""
    store = load(spark, sf_dir, "embeddings")
    return store, store.where("vec_id % 20 = 0")


def to_six(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(NEAREST.format(on="true"))
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector the ten nearest of the whole store, exactly."""
    store, queries = asked(spark, sf_dir)
    return to_six(V.exact_search(store, queries, 10))


@query(NEAREST.format(on="e.label = q.label"))
def vector_topk_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector the ten nearest of its label, exactly."""
    store, queries = asked(spark, sf_dir)
    return to_six(V.exact_search(store, queries, 10, label="label"))


def indexed(spark: SparkSession, sf_dir: str, *labels: str | None) -> list[DataFrame]:
    """What each search finds, within a label or without one, in one index."""
    store, queries = asked(spark, sf_dir)
    quantiser = V.fit(store, label="label")
    if quantiser is None:
        return [V.ranked(queries, [], 10, "vec_id") for _ in labels]
    index = V.index(store, quantiser, label="label")
    return [V.search(store, index, quantiser, queries, 10, label=label) for label in labels]


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector the ten nearest of the whole store through the index; nine tenths of the exact ones or more."""
    return to_six(*indexed(spark, sf_dir, None))


@query()
def vector_index_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector the ten nearest of its label through the index."""
    return to_six(*indexed(spark, sf_dir, "label"))


@query("""SELECT kind, n_queries, true AS reached FROM (SELECT count(*) AS n_queries FROM embeddings WHERE vec_id % 20 = 0), (VALUES ('all'), ('label')) k(kind)""")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of the exact ten nearest of every twentieth vector, in the store and in its label."""
    store, queries = asked(spark, sf_dir)
    parts = [
        V.recall(found, V.exact_search(store, queries, 10, label=label)).select(
            F.lit(kind).alias("kind"), "n_queries", (F.col("recall") >= 0.9).alias("reached")
        )
        for found, kind, label in zip(indexed(spark, sf_dir, None, "label"), ("all", "label"), (None, "label"), strict=True)
    ]
    return parts[0].unionByName(parts[1])


@query("SELECT DISTINCT lang AS country FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('', 'unknown')")
def country_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ALL stands for."""
    return chunks(spark, sf_dir).where("country is not null and country not in ('', 'unknown')").select("country").distinct()


def best_passages(spark: SparkSession, sf_dir: str, final_k: int) -> DataFrame:
    """The passages that a ranking puts first in each country, with their places; texts are joined to the ranked keys."""
    best = ranked(spark, sf_dir, SUBMISSION_POPULATION, "hta_submission", final_k).select("country", "doc_id", "place")
    return best.join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


SETS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(trim({c}, E' \\t\\n\\r')), '\\s+'), lambda x: x <> '')))"


@query(f"""WITH RECURSIVE ranked AS ({ranking_sql(SUBMISSION_POPULATION, "hta_submission", 70)}),
x AS (SELECT r.country, r.place, r.doc_id, d.text, {SETS.format(c="d.text")} AS ws FROM ranked r JOIN documents d USING (doc_id)),
i AS (SELECT b.country, b.place, a.place AS before, a.text = b.text AS same, len(list_intersect(a.ws, b.ws)) AS n, len(a.ws) AS na, len(b.ws) AS nb FROM x a JOIN x b ON a.country = b.country AND a.place < b.place),
p AS (SELECT x.country, x.place, x.doc_id, coalesce(list(before) FILTER (same), []) AS equals, coalesce(list(before) FILTER (n > (na + nb - n) * 7e-1 OR n > na * 9e-1 OR n > nb * 9e-1), []) AS likes
  FROM x LEFT JOIN i ON x.country = i.country AND x.place = i.place GROUP BY ALL),
f AS (SELECT DISTINCT country, 0::BIGINT AS place, NULL::BIGINT AS doc_id, NULL::VARCHAR AS reason, []::BIGINT[] AS kept FROM p UNION ALL
  SELECT country, place, doc_id, reason, CASE WHEN reason IS NULL THEN kept || [place] ELSE kept END FROM (
    SELECT p.country, p.place, p.doc_id, kept, CASE WHEN list_has_any(equals, kept) THEN 'duplicate' WHEN list_has_any(likes, kept) THEN 'similar' END AS reason FROM f JOIN p ON p.country = f.country AND p.place = f.place + 1))
SELECT country, doc_id, reason IS NULL AS kept, reason FROM f WHERE place > 0""")
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 140 passages that rank first in each country those that none before resembles."""
    return R.greedy_unique(best_passages(spark, sf_dir, 70), ["country"], ["place"], "doc_id", 140)


REPRESENTATIVES = f"""m AS (SELECT doc_id, lang, ws, min(doc_id) OVER (PARTITION BY lang, ws) AS representative FROM (SELECT doc_id, lang, {SETS.format(c="text")} AS ws FROM documents)),
s AS (SELECT * FROM m WHERE doc_id = representative),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws)), 6) AS similarity
  FROM s a JOIN s b ON a.doc_id < b.doc_id AND a.lang = b.lang
  WHERE len(a.ws) > 0 AND len(b.ws) > 0 AND least(len(a.ws), len(b.ws)) >= 0.8 * greatest(len(a.ws), len(b.ws))
  AND len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws)) >= 0.8)"""


def word_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Which document stands for each document's word set in its language, and the pairs of those that stand for others."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", T.token_set(F.col("text")).alias("ws"))
    sets = R.hashed_sets(docs, "doc_id", "ws", "lang")
    members = R.set_members(sets, "doc_id", "lang")
    copies = R.checked(members.where("doc_id > representative").select("doc_id", "mark"))
    own = sets.join(copies, ["doc_id", "mark"], "left_anti")
    return members, R.similar_within(own, "doc_id", "ws", 0.8, "lang", hashed=True)


@query(f"""WITH {REPRESENTATIVES} SELECT * FROM p
UNION ALL SELECT representative AS doc_a, doc_id AS doc_b, 1.0::DOUBLE AS similarity FROM m WHERE doc_id > representative AND len(ws) > 0 AND lang IS NOT NULL""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of one language with word sets of Jaccard similarity .8 or more, by a prefix join. The least document
    stands for all of an equal set: it is paired with each of them, and alone with those of other sets."""
    members, pairs = word_sets(spark, sf_dir)
    equal = members.where("doc_id > representative and mark is not null").select(F.col("representative").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("similarity"))
    return pairs.select(F.col("ka").alias("doc_a"), F.col("kb").alias("doc_b"), F.round("similarity", 6).alias("similarity")).unionByName(equal)


@query(f"""WITH {REPRESENTATIVES}, l AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_a AS doc_id FROM p UNION ALL SELECT doc_b FROM p) GROUP BY doc_id)
SELECT m.doc_id, representative, coalesce(n, 0) AS n_links FROM m LEFT JOIN l ON l.doc_id = representative""")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the one that stands for its word set, and how many other sets are similar to it."""
    members, pairs = word_sets(spark, sf_dir)
    links = pairs.select(F.explode(F.array("ka", "kb")).alias("representative")).groupBy("representative").agg(F.count("*").alias("n"))
    return members.join(links, "representative", "left").select("doc_id", "representative", F.coalesce("n", F.lit(0)).alias("n_links"))


@query(f"""WITH d AS (SELECT doc_id, {SETS.format(c="text")} AS ws FROM documents),
b AS (SELECT item_id, {SETS.format(c="text")} AS bs FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(bs, ws)) / len(bs), 6) AS share FROM b JOIN d ON len(list_intersect(bs, ws)) > 0.9 * len(bs) WHERE len(bs) > 0""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold more than nine tenths of an item's distinct words, found through the item's rarest tenth and one."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.token_set(F.col("text")).alias("ws"))
    items = load(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("bs"))
    found = R.holders_of(docs, items, "doc_id", "item_id", "ws", "bs", 0.9)
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"))


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


EDGE = r"[.,;:()\[\]{}]"
TERMS = rf"""list_sort(list_distinct(list_filter(list_filter(list_transform(
    list_filter(list_zip(['.'] || ws[:-2], ws), lambda p: regexp_matches(p[1], '[.!?]$') AND regexp_matches(p[2], '^{EDGE}*\p{{Lu}}')),
    lambda p: regexp_replace(p[2], '^{EDGE}+|{EDGE}+$', '', 'g')), lambda x: length(x) > 1 AND lower(x) NOT IN ({listed(T.COMPARATOR_STOP_WORDS)}))
  || regexp_extract_all(text, '{T.DOSAGE}') || regexp_extract_all(lower(text), '{T.DRUG_SUFFIX}'), lambda x: lower(x) NOT IN ({listed(T.COMPARATOR_COMMON_WORDS)}))))"""
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, text, {WORDS} AS ws FROM documents), t AS (SELECT doc_id, {TERMS} AS terms FROM w)
SELECT doc_id, len(terms)::INTEGER AS n_terms, array_to_string(terms, '|') AS terms FROM t""")
def comparator_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("doc_id", T.comparator_terms(F.col("text")).alias("terms"))
    return rows.select("doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


@query(f"""WITH RECURSIVE ranked AS ({ranking_sql(SUBMISSION_POPULATION, "hta_submission", 30)}),
w AS (SELECT r.country, r.place, r.doc_id, d.text, {WORDS.replace("text", "d.text")} AS ws FROM ranked r JOIN documents d USING (doc_id)), x AS (SELECT country, place, doc_id, {TERMS} AS terms FROM w),
g AS (SELECT DISTINCT country, 0 AS pick, NULL::BIGINT AS doc_id, 0::BIGINT AS n_new, []::VARCHAR[] AS covered, []::BIGINT[] AS chosen FROM x UNION ALL
  SELECT country, pick + 1, b.doc_id, b.n, covered || b.terms, chosen || [b.place] FROM (
    SELECT country, pick, any_value(covered) AS covered, any_value(chosen) AS chosen, max({{'n': n, 'back': -place, 'place': place, 'doc_id': doc_id, 'terms': terms}}) AS b FROM (
      SELECT g.country, g.pick, covered, chosen, x.place, x.doc_id, terms, len(list_filter(terms, lambda t: NOT list_contains(covered, t))) AS n FROM g JOIN x ON x.country = g.country AND NOT list_contains(chosen, x.place) WHERE g.pick < 10)
    GROUP BY country, pick))
SELECT country, doc_id, pick::INTEGER AS pick, n_new::INTEGER AS n_new FROM g WHERE pick > 0""")
def coverage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten passages of each country that cover most comparator terms of the sixty that rank first."""
    rows = best_passages(spark, sf_dir, 30).select("country", "doc_id", "place", T.comparator_terms(F.col("text")).alias("terms"))
    return R.coverage_select(rows, ["country"], ["place"], "doc_id", "terms", 10, 60)


@query(f"""WITH {CHUNKS} SELECT doc_id, country, source_type, length(text) AS text_length, heading FROM chunks
QUALIFY row_number() OVER (PARTITION BY country, source_type ORDER BY doc_id) <= 5""")
def formatted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five passages of each country and source type, with the fields a result carries."""
    rows = R.top_k(chunks(spark, sf_dir), F.col("doc_id"), 5, ["country", "source_type"], "doc_id")
    return rows.select("doc_id", "country", "source_type", F.length("text").cast("long").alias("text_length"), "heading")


@query(f"""WITH RECURSIVE {CHUNKS}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
d AS (SELECT c.*, list_sum([(x[1]::double - x[2]) * (x[1]::double - x[2]) for x in list_zip(embedding, q)]) AS distance FROM chunks c JOIN embeddings ON vec_id = doc_id, q WHERE source_type = 'hta_submission'),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY distance, doc_id) AS rank FROM d) WHERE rank <= 40),
x AS (SELECT country, rank AS place, doc_id, text, {SETS.format(c="text")} AS ws FROM near),
i AS (SELECT b.country, b.place, a.place AS before, a.text = b.text AS same, len(list_intersect(a.ws, b.ws)) AS n, len(a.ws) AS na, len(b.ws) AS nb FROM x a JOIN x b ON a.country = b.country AND a.place < b.place),
p AS (SELECT x.country, x.place, x.doc_id, coalesce(list(before) FILTER (same OR n > (na + nb - n) * 7e-1 OR n > na * 9e-1 OR n > nb * 9e-1), []) AS likes FROM x LEFT JOIN i ON x.country = i.country AND x.place = i.place GROUP BY ALL),
f AS (SELECT DISTINCT country, 0::BIGINT AS place, NULL::BIGINT AS doc_id, false AS kept, []::BIGINT[] AS before FROM p UNION ALL
  SELECT p.country, p.place, p.doc_id, NOT list_has_any(likes, before), CASE WHEN list_has_any(likes, before) THEN before ELSE before || [p.place] END FROM f JOIN p ON p.country = f.country AND p.place = f.place + 1),
b AS (SELECT n.*, count(*) OVER (PARTITION BY n.country) - row_number() OVER (PARTITION BY n.country ORDER BY rank) + 1 AS base FROM near n JOIN f ON f.country = n.country AND f.place = n.rank AND f.kept),
s AS (SELECT country, doc_id, text, base, {score_sql(SUBMISSION_POPULATION)} AS score FROM b),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, base DESC) AS place FROM s) WHERE place <= 16),
w AS (SELECT country, place, doc_id, text, {WORDS} AS ws FROM r), y AS (SELECT country, place, doc_id, {TERMS} AS terms FROM w),
g AS (SELECT DISTINCT country, 0 AS pick, NULL::BIGINT AS doc_id, []::VARCHAR[] AS covered, []::BIGINT[] AS chosen FROM y UNION ALL
  SELECT country, pick + 1, b.doc_id, covered || b.terms, chosen || [b.place] FROM (
    SELECT country, pick, any_value(covered) AS covered, any_value(chosen) AS chosen, max({{'n': n, 'back': -place, 'place': place, 'doc_id': doc_id, 'terms': terms}}) AS b FROM (
      SELECT g.country, g.pick, covered, chosen, y.place, y.doc_id, terms, len(list_filter(terms, lambda t: NOT list_contains(covered, t))) AS n FROM g JOIN y ON y.country = g.country AND NOT list_contains(chosen, y.place) WHERE g.pick < 8)
    GROUP BY country, pick))
SELECT g.country, g.doc_id, s.base, s.score::DOUBLE AS score, pick::INTEGER AS place FROM g JOIN s ON s.country = g.country AND s.doc_id = g.doc_id WHERE pick > 0""")
def retrieved_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval end to end: in each country the 40 passages nearest to vector 0 (a document's vector has its identifier), near-duplicates
    removed, boosts on top of the rank by distance, and eight chosen by what they cover."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = F.broadcast(vectors.where("doc_id = 0").select(F.col("embedding").alias("q")).limit(1))  # one row
    store = chunks(spark, sf_dir).join(vectors, "doc_id").crossJoin(q).withColumnRenamed("doc_id", "chunk_id")
    found = retrieve_near(store, F.col("q"), "hta_submission", SUBMISSION_POPULATION, 40, 8)
    return found.select("country", F.col("chunk_id").alias("doc_id"), "base", "score", F.col("place").cast("int").alias("place"))
