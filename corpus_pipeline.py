"""A corpus pipeline of five stages over documents; run() gives the packed pieces.

Every stage but the last returns the columns of documents. What a stage decides takes effect: toxic documents go, one
document of each class of near-duplicates stays, contaminated documents go, secrets are masked, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import decontamination, packing, probminhash, secret_scan, toxicity
from sievewright.llm.common import table, write_table
from sievewright.llm.queries import BYTE_RANKS, BYTE_VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, in one pass: rows travel with their scores, repeated ones on their own."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    docs = docs.select(*COLUMNS)
    return toxicity.with_scores(docs, model).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least identifier of each class."""
    return probminhash.representatives(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a window of a benchmark item."""
    found = decontamination.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(decontamination.n_hit(F.col("runs")) == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars counted anew where one was."""
    masked = secret_scan.redact(docs.select(*COLUMNS), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 ids, by the shares that the sources have here."""
    return packing.pack(docs, public_tokenizers.path(BYTE_VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Tokenizing, ProbMinHash and the classifier are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{name}")
    return docs
