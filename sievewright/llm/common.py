"""What the operators of this package share: input tables, the shared folder, word streams and bounded Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once; whole texts are long, so a batch stays small.
ROWS_PER_BATCH = 512
#: Words whose hashes a Python worker remembers.
MEMO_WORDS = 100_000
#: Rows of a few numbers that Spark hands to Python at once.
NUMBERS_PER_BATCH = 1 << 16

#: A-Z become a-z; what is no letter, digit or byte of a non-ASCII character becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_number(df: DataFrame, key: str) -> F.Column:
    """The identifier as a long; others than whole numbers are refused."""
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {kind}: identifiers must be whole numbers")
    return F.col(key).cast("long")


def unused(name: str, columns: Iterable[str]) -> str:
    """name, with as many underscores as tell it from all columns; Spark's names don't depend on case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, whatever their case: result columns take their place."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bound the rows that one Arrow batch carries to Python, whose workers must find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_SHIPPED: set[str] = set()


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


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a single process, as in tests,
    gets one of its own; a cluster is refused, as its executors wouldn't find it."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not path:
            own = tempfile.mkdtemp(prefix="sievewright-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            path = f"file://{own}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_WRITTEN: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process wrote; results that read them must have been written by then."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete a table of write_table() that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
        for written in [p for p in _WRITTEN if p.rsplit("/", 1)[-1] == name]:
            _WRITTEN.remove(written)
            path = spark._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_table(df: DataFrame, name: str, level: int = 3, batch: int = ROWS_PER_BATCH) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, so lost executors repeat nothing before it.
    level: how hard the files are compressed; batch: rows that Python gets at once meanwhile, more where rows are numbers."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    small_batches(spark, batch)
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        small_batches(spark)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system and path behind a folder's URI."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return pafs.FileSystem.from_uri(uri)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of ASCII letters, digits and all other non-ASCII characters; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


class WordHashes(dict):
    """A bounded memory of 64-bit word hashes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()

#: Functions that forget what a worker remembers between tasks.
REMEMBERED: list[Callable[[], None]] = [_HASHES.clear]
_OWNER: list[str] = []


def give_back() -> None:
    """Hand the memory that a worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def take_over(owner: str) -> None:
    """Forget what a worker remembers of another operator's tasks: workers live on from one stage to the next."""
    if _OWNER != [owner]:
        for forget in REMEMBERED:
            forget()
        _OWNER[:] = [owner]
        gc.collect()
        give_back()


def in_worker(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None) -> Callable:
    """run for mapInArrow; a worker remembers things for one operator only, and keeps no freed memory after a task."""
    owner = owner or f"{run.__module__}.{run.__qualname__}"

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, ws), np.uint64, len(ws))


#: An odd multiplier for rolling hashes over word hashes (a fixed value).
ROLL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit number for each byte of a word.
BYTE_HASHES = mix(np.arange(1, 257, dtype=np.uint64) * ROLL)


def hashed_words(texts: list[bytes | None], letters: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and how many words each text has. The sum of a word's
    bytes' numbers times powers of ROLL, so that all bytes are worked on at once. letters: what each byte becomes, a space
    between words."""
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]).translate(letters) + b" ", np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.r_[0, edges] if len(raw) and inside[0] else edges
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    length = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(length)]))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    begin = np.cumsum(sizes) - sizes
    powers = np.full(int(sizes.max()), ROLL, np.uint64)
    powers[0] = 1
    values = BYTE_HASHES[raw[inside]]
    values *= np.cumprod(powers)[np.arange(len(values)) - np.repeat(begin, sizes)]
    return mix(np.add.reduceat(values, begin) + sizes.astype(np.uint64)), counts


def split_at(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The hashes of each text."""
    ends = np.cumsum(counts).tolist()
    return [h[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def text_groups(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about `size` bytes, so that arrays over them stay small; a longer text is alone."""
    first = held = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > first and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


def word_digest(h: np.ndarray, text: bytes | None) -> bytes:
    """A 128-bit digest of a text's words by their hashes; of the text itself if it has none."""
    return xxhash.xxh3_128_digest(h.tobytes() if len(h) else b"\0" + (text or b""))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= ROLL
        out += h[j : n + j]
    return mix(out)


def minimizers(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost least hash of each run of `window` hashes; of all hashes if there are fewer."""
    if not len(g):
        return np.empty(0, np.int64)
    n = max(1, len(g) - window + 1)
    width = min(window, len(g))
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = g[j : n + j]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str
) -> DataFrame:
    """mapInArrow with plain lists: make() runs once a task, its result turns the columns of a batch into those of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    owner = f"{make.__module__}.{make.__qualname__}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(in_worker(run, owner), schema)


def text_bytes(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the text as UTF-8 bytes, a null text as null."""
    return df.withColumn(column, F.col(column).cast("binary"))


def one_thread() -> None:
    """Keep native libraries from starting threads of their own inside a task."""
    os.environ.update(TOKENIZERS_PARALLELISM="false", RAYON_NUM_THREADS="1")
