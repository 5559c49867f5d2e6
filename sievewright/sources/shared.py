"""Tables in the folder that driver and executors share, where a plan's lineage ends."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, one process, as in tests, gets a folder of its own, and a cluster is refused."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.sparkContext.getCheckpointDir()
        if not path:
            own = tempfile.mkdtemp(prefix="sievewright-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            path = f"file://{own}"
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, by: tuple[str, ...] = (), **options) -> DataFrame:
    """df as a table of the shared folder; by: columns that become folders, so that filters on them skip files; options of the writer."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    columns = [c for c in df.columns if c not in by] + list(by)
    return df.sparkSession.read.schema(df.select(*columns).schema).parquet(path).select(*df.columns)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for a context, unless workers find it by PYTHONPATH or the working folder."""
    home = Path(__file__).resolve().parents[2]
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or any(p and Path(p).resolve() == home for p in found):
        return
    name = os.path.join(tempfile.mkdtemp(prefix="sievewright-"), "sievewright")
    context.addPyFile(shutil.make_archive(name, "zip", home, Path(__file__).resolve().parents[1].name))
    _SHIPPED.add(context.applicationId)


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bound the rows of Arrow batches of what runs inside; the session's setting is then as before."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
