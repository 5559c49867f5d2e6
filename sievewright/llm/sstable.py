"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier. Its layout:

    block*   entries: varint shared, varint unshared, varint length of the value, key suffix, value;
             then the entries' zlib stream is followed by its CRC-32 (4 bytes, little endian)
    index    for each block: varint key length, last key, varint offset, varint length
    bloom    varint number of hashes, then the bits
    footer   8 numbers of 8 bytes: index offset, index length, bloom offset, bloom length, entries, ids, id width, magic

A key is empty for a null identifier, else byte 1 and the identifier as 8 big-endian bytes with the sign bit turned, so
that bytes compare as numbers do. A value is the document's ids, little endian, of the vocabulary's width. A lookup asks
the Bloom filter, finds the block by binary search of the index and reads that block alone.

Shards are cut by range of the identifier; their order is that of the ranges. Edge cases: a null text is empty and has
the end id alone; a null identifier comes first; documents with one identifier are ordered by their text; the empty table
gives no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, in_worker, small_batches, whole_number, write_table
from .token_ids import encoder

BLOCK_BYTES = 64 << 10
BITS_PER_KEY, HASHES = 10, 7
MAGIC = 0x5353544B49445331  # "SSTKIDS1"
FOOTER = struct.Struct("<8Q")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def key_number(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key else None


def bloom_bits(key: bytes, n_bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    step = (h >> 32) | 1
    return [(h + i * step) % n_bits for i in range(hashes)]


class Writer:
    """add() keys in ascending order, then close(); only one block, the index and the keys' hashes are held."""

    def __init__(self, out: BinaryIO, width: int = 2) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", bytearray(), []
        self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(xxhash.xxh3_64_intdigest(key))
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = zlib.compress(bytes(self.block), 1)
            data += zlib.crc32(data).to_bytes(4, "little")
            self.out.write(data)
            self.index += varint(len(self.last)) + self.last + varint(self.at) + varint(len(data))
            self.at += len(data)
            self.block.clear()

    def close(self) -> None:
        self.flush()
        n_bits = max(64, len(self.keys) * BITS_PER_KEY)
        bits = np.zeros(n_bits, bool)
        for h in self.keys:
            step = (h >> 32) | 1
            for i in range(HASHES):
                bits[(h + i * step) % n_bits] = True
        bloom = varint(HASHES) + varint(n_bits) + np.packbits(bits, bitorder="little").tobytes()
        self.out.write(bytes(self.index))
        self.out.write(bloom)
        self.out.write(
            FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(bloom), len(self.keys), self.n_ids, self.width, MAGIC)
        )


class Reader:
    """get(key) and scan() over a shard; read(offset, length) fetches bytes, size is the file's."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        at, n, b_at, b_n, self.n, self.n_ids, self.width, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no shard of this format")
        data, i, self.blocks = read(at, n), 0, []
        while i < n:
            k, i = read_varint(data, i)
            key, i = data[i : i + k], i + k
            offset, i = read_varint(data, i)
            length, i = read_varint(data, i)
            self.blocks.append((key, offset, length))
        bloom = read(b_at, b_n)
        self.hashes, i = read_varint(bloom, 0)
        self.n_bits, i = read_varint(bloom, i)
        self.bloom = bloom[i:]

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.blocks[block]
        data = self.read(offset, length)
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError(f"block {block} is damaged")
        data, i, key = zlib.decompress(data[:-4]), 0, b""
        while i < len(data):
            shared, i = read_varint(data, i)
            more, i = read_varint(data, i)
            size, i = read_varint(data, i)
            key = key[:shared] + data[i : i + more]
            i += more
            yield key, data[i : i + size]
            i += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for b in range(len(self.blocks)):
            yield from self.entries(b)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_bits(key, self.n_bits, self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """The values of all entries with this key."""
        if not self.may_hold(key):
            return []
        low, high = 0, len(self.blocks)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.blocks[mid][0] < key else (low, mid)
        out = []
        while low < len(self.blocks):
            out += [v for k, v in self.entries(low) if k == key]
            if self.blocks[low][0] > key:
                break
            low += 1
        return out


def open_shard(path: str) -> Reader:
    fs, where = filesystem(path)
    f = fs.open_input_file(where)
    return Reader(lambda at, n: f.read_at(n, at), f.size())


def write_shards(docs: DataFrame, vocabulary_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents' ids, each followed by end_id, to shards in the shared folder. Returns their manifest, one row a
    shard: shard (its place), path, n_docs, n_ids. A repeated task writes a file of its own; the manifest names the one that counts."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "sstable")
    fs, where = filesystem(folder)
    fs.create_dir(where)
    small_batches(spark)
    rows = docs.select(whole_number(docs, key).alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        shard = TaskContext.get().partitionId()
        fs, where = filesystem(folder)
        name, writer, out, n = f"{shard:07d}-{uuid.uuid4().hex}.sst", None, None, 0
        end = np.array([end_id], np.uint16).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                out = fs.open_output_stream(f"{where}/{name}")
                writer = Writer(out)
            flat, at = enc.encode(batch.column(1))
            raw = flat.astype("<u2").tobytes()
            for k, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                writer.add(key_bytes(k), raw[2 * a : 2 * b] + end)
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int64()), "path": [f"{folder}/{name}"], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())}
            )

    return write_table(rows.mapInArrow(in_worker(run), "shard long, path string, n_docs long, n_ids long"), "sstable-manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Scan all shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 over the ids as little-endian
    unsigned 32-bit numbers, and on demand the ids themselves as such numbers. The manifest, a row a shard, is summed up on the driver."""
    spark = manifest.sparkSession
    shards = sorted((r["shard"], r["path"], r["n_ids"]) for r in manifest.collect())
    starts, total = [], 0
    for _, path, n in shards:
        starts.append((path, total))
        total += n
    schema = READ if with_ids else READ.removesuffix(", ids binary")
    if not starts:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(starts, "path string, base long").repartition(len(starts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, rows, held = open_shard(path), [], 0
                for key, value in reader.scan():
                    ids = np.frombuffer(value, "<u2").astype("<u4").tobytes()
                    rows.append((key_number(key), at, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    at += len(ids) // 4
                    held += len(ids) * with_ids + 64
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=False)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=False)], names)

    return files.mapInArrow(in_worker(run), schema)
