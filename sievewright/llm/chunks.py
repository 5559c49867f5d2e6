"""Chunks: runs of documents whose units (words, segments, hashes) are written once each, in a dictionary of the chunk.

A chunk is what one task reads, up to a bound in bytes. Its documents carry codes into its dictionary, so that what is found
out about units travels once a chunk and unit, not once an occurrence: a frequent unit has one row a chunk, and no row grows
with the corpus. by_chunk brings a chunk's dictionary and documents back together, dictionary first, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker, ship

#: Bytes of text after which a chunk is full.
CHUNK_BYTES = 32 << 20
#: Bytes that Spark puts into one Arrow batch at most.
BATCH_BYTES = "32m"
ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned and run inside; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: str = BATCH_BYTES) -> Iterator[None]:
    """Bound the Arrow batches of what runs inside in rows and in bytes."""
    ship(spark)
    with settings(spark, {ROWS: str(rows), BYTES: size}):
        yield


def chunk_number(count: int) -> int:
    """A number for this task's chunk of this count; it holds once the rows that carry it are written."""
    return (TaskContext.get().partitionId() << 24) + count


CODED = "chunk long, code int, unit string, row long, size long, codes binary"


def coded(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """docs (row long, units array of strings) as rows of chunks: one with code and unit for each distinct unit of a chunk, one with
    row, codes (32-bit, by zstd) and their number for each document. To be written before it is used: another run may cut other chunks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(CODED))

    def chunk(number: int, rows: list[pa.Array], units: list[pa.Array], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        encoded = pa.chunked_array([u.cast(pa.large_string()) for u in units]).combine_chunks().dictionary_encode()
        names = encoded.dictionary.cast(pa.string())
        n = len(names)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), names, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=arrow)
        sizes = np.concatenate(counts)
        raw, ends = np.asarray(encoded.indices).astype(np.int32), np.cumsum(sizes).tolist()
        codes = pa.array([pa.compress(raw[a:b].tobytes(), "zstd", asbytes=True) if b > a else b"" for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
        n = len(codes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.concat_arrays(rows), pa.array(sizes.astype(np.int64)), codes], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.Array] = []
        units: list[pa.Array] = []
        counts: list[np.ndarray] = []
        held = number = 0
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            rows.append(batch.column(0))
            units.append(flat)
            counts.append(np.diff(np.asarray(lists.offsets)))
            held += flat.nbytes
            if held >= size:
                yield from chunk(chunk_number(number), rows, units, counts)
                number, held = number + 1, 0
                rows, units, counts = [], [], []
        if rows:
            yield from chunk(chunk_number(number), rows, units, counts)

    return docs.select("row", "units").mapInArrow(in_worker(run, "chunks.coded"), CODED)


def by_chunk(dictionary: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of both (columns chunk, code, null for documents), each chunk in one partition, its dictionary in order of code and then its
    documents."""
    both = dictionary.unionByName(documents, allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_last("code"))


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, bool, pa.RecordBatch]]:
    """(a new chunk begins, these are documents, rows) for the stream of by_chunk, whose first columns are chunk and code."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = np.asarray(batch.column(0))
        documents = np.asarray(batch.column(1).is_null())
        cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (documents[1:] != documents[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield chunk[a] != last, bool(documents[a]), batch.slice(a, b - a)
            last = chunk[a]


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs of sizes[i] elements from starts[i] on, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
