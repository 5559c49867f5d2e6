"""The opN_ queries: each applies its operator with production parameters to its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, flac, lexical, ngrams, packing, passages, probminhash, quality, secret_scan, sstable, toxicity, urlfilter
from .common import table

BYTE_VOCABULARY = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"
WORD_VOCABULARY = "word_bpe_49k.json"

URL_RULES = (
    urlfilter.Rule("allow", "com", "/"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return verdicts(scored, toxicity.held_out(F.col("doc_id")))


def verdicts(scored: DataFrame, held_out: F.Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids, by the sources' own shares."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return verdicts(scored, quality.held_out(F.col("doc_id")))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' FLAC streams, from reading the stored streams back."""
    return flac.digests(flac.store_texts(table(spark, sf_dir, "documents")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the fixed patterns' spans, and all spans."""
    found = secret_scan.scan_secrets(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    )
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = decontamination.n_hit(F.col("runs"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from sorted-string-table shards."""
    manifest = sstable.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return sstable.read_shards(manifest)


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents, and copies of whole texts."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("glob")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of those that are not held out."""
    return ngrams.score_texts(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the ids of two tokenizers, and how common its links are in the corpus."""
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    written = alignment.write_aligned(found.select("doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "times"))
    return alignment.weighed(written)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_packing, op3_quality, op4_flac, op5_secrets,
        op6_decontamination, op7_sstable, op8_passages, op9_near_duplicates, op10_urls,
        op11_search, op12_scores, op13_alignment,
    )
}

RULE_VALUES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
#: The blocking globs as regular expressions over "." + host + path.
GLOB_REGEX = r"^(.*/ads/.*|.*/login/.*|.*/cgi-bin/.*|.*\.exe|.*\.zip|.*\.swf)$"

#: Terms of a text: runs of ASCII letters, digits and all other non-ASCII characters, A-Z in lower case.
TERMS = rf"regexp_extract_all(translate(text, '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op10_urls": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, q) AS (VALUES {RULE_VALUES}),
m AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches('.' || host || path, '{GLOB_REGEX}', 's') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)""",
    "op11_search": f"""
WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS size FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // size))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN c USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= {lexical.K}""",
}
