"""Sinks: the stages' results as tables and JSON. A store is replaced by key, so that a changed file leaves no old rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators.evidence import group_stats


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One record for each document and file, its chunks in order."""
    meta = F.struct(*(c for c in chunks.columns if c not in ("doc_id", "text")))
    rows = chunks.groupBy("doc_id", "original_file_path").agg(F.array_sort(F.collect_list(F.struct("split_index", F.struct("text", meta.alias("metadata")).alias("c")))).alias("l"))
    rows.select("doc_id", F.transform("l", lambda x: x["c"]).alias("chunks")).write.mode("overwrite").json(path)


def write_store(rows: DataFrame, path: str) -> None:
    """A new vector store, partitioned by what retrieval filters on."""
    rows.write.mode("overwrite").partitionBy("case", "country", "source_type").parquet(path)


def upsert_store(rows: DataFrame, path: str, key: str = "original_file_path") -> None:
    """Rows added to a store in place of those with the same key: only partitions that hold a changed file are rewritten."""
    spark = rows.sparkSession
    parts = ["case", "country", "source_type"]
    old = spark.read.parquet(path)
    touched = old.join(rows.select(key).distinct(), key, "left_semi").select(*parts).unionByName(rows.select(*parts)).distinct()
    kept = old.join(touched, parts, "left_semi").join(rows.select(key).distinct(), key, "left_anti")
    merged = kept.unionByName(rows, allowMissingColumns=True)
    # written beside the store first: a read of the store may not overwrite itself
    staged = f"{path.rstrip('/')}.staged"
    merged.write.mode("overwrite").partitionBy(*parts).parquet(staged)
    out = spark.read.schema(merged.schema).parquet(staged)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_retrieval(rows: DataFrame, path: str) -> None:
    """Results with their countries' figures, a record for each country."""
    stats = group_stats(rows, "country", "text", "doc_id", "heading")
    listed = rows.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("place", "text", "doc_id", "heading", "source_type"))).alias("chunks"))
    stats.join(listed, "country").write.mode("overwrite").json(path)


def write_records(rows: DataFrame, path: str, by: str = "country") -> None:
    """Extracted records by country, with their number."""
    fields = [c for c in rows.columns if c != by]
    rows.groupBy(by).agg(F.count("*").alias("total"), F.collect_list(F.struct(*fields)).alias("records")).write.mode("overwrite").json(path)


def result_name(indication: str, kind: str, split: str, stamp: str) -> F.Column:
    """The file name of consolidated results."""
    return F.concat_ws("_", file_name(F.lit(indication)), F.lit(kind), F.lit(split), F.lit(stamp))


def write_report(rows: DataFrame, path: str) -> None:
    """name: value lines of one row of figures."""
    names = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns]
    rows.select(F.array_join(F.array(*names), "\n").alias("value")).write.mode("overwrite").text(path)
