"""Incremental reads: new chunk files as a stream; the file source's checkpoint is the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources import schemas, sinks


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    stream = spark.readStream.schema(schemas.CHUNKED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    rows = stream.select(F.url_decode(F.col("_metadata.file_path")).alias("file_path"), F.explode("chunks").alias("c"))
    rows = rows.select("file_path", "c.text", "c.metadata.*").where(F.trim("text") != "")
    return rows.withColumn("case", F.coalesce(T.case_name(F.col("file_path")), F.lit("unknown")))


def follow(spark: SparkSession, path: str, store: str, checkpoint: str) -> StreamingQuery:
    """Bring the store up to date with all files that came since the last call, then end. A file is marked as seen only
    when its rows are in the store, so that a crash repeats rows rather than loses them, and a repeat replaces them."""

    def put(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            parts = F.coalesce("country", F.lit("unknown")), F.coalesce("source_type", F.lit("unknown"))
            rows = batch.withColumn("country", parts[0]).withColumn("source_type", parts[1])
            spark_ = batch.sparkSession
            exists = spark_._jvm.org.apache.hadoop.fs.Path(store)
            fs = exists.getFileSystem(spark_._jsc.hadoopConfiguration())
            (sinks.upsert_store(rows, store, "file_path") if fs.exists(exists) else sinks.write_store(rows, store))
        finally:
            batch.unpersist()

    writer = chunk_stream(spark, path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by time window of a stream or a table; a stream drops what is later than `late`."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
