"""Language-model scores from a log-frequency Bloom filter of bigram counts.

A text's tokens are its words and one end. Words are counted exactly. Counts of bigrams (each token after the one before it,
the first after a start) are quantised to levels, 1 + floor(log2 count), and a bigram of level q is put into a Bloom filter
q times, once with each level up to q. Probing a bigram with level 1, 2 and so on until one isn't there gives its level; a false
positive can only raise it, less likely so with each level. Counts from levels are bounded by the exact counts of both
words, and smoothed with the words' own probabilities:

    p(w | v) = (count(v w) + MASS * p(w)) / (count(v) + MASS),  p(w) = (count(w) + 1) / (tokens + words + 1)

What is gathered grows with the corpus. Texts are read once and written as chunks: a dictionary of word hashes and the documents'
codes. Words and bigrams go to parts by their hash, in blobs of one chunk and part; a part counts exactly, and holds a bounded
number of them, as there are more parts for more tokens. Each part of the filter is built where its bigrams were counted. A filter of
up to BROADCAST_BYTES is broadcast to the workers; a larger one stays in parts, and each chunk's bigrams are sent to the parts and
their levels back. Both ways probe the same bits, so that scores don't depend on the way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import batches_of, chunk_number
from .common import ROLL, hashed_words, in_worker, mix, text_bytes, text_groups, whole_number, write_table

#: A-Z become a-z; space, tab, line feed, vertical tab, form feed and carriage return become a space.
TOKEN_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Hashes of what stands before the first and after the last word (fixed values).
START, END = np.uint64(0x5157A12C0FFEE001), np.uint64(0x1E4D0F7EC7ED0B03)
#: Bits of the filter for each level of each bigram, and probes a level: 3 false positives in a thousand.
BITS, PROBES = 12, 8
#: Bytes of text after which a chunk, one row, is full.
CHUNK_BYTES = 16 << 20
#: Greatest level.
LEVELS = 40
#: Weight of the words' own probabilities, in occurrences of the word before.
MASS = 100.0
#: Words of chunks and bigrams of texts that a part gets on average, at most.
PART = 1 << 20
#: Bytes of a filter that is broadcast.
BROADCAST_BYTES = 128 << 20

CHUNKS = "chunk long, words binary, train binary, codes binary, ids binary, sizes binary, held binary, n_words long, n_tokens long, n_train long, n_docs long"
COUNTED = "chunk long, part int, counts binary, n long"
FILTER = "part int, bits binary, n_grams long"
SCORED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Stands for a null identifier.
NO_ID = np.iinfo(np.int64).max


def held_out(key: F.Column, of: int = 7, remainder: int = 2) -> F.Column:
    """Whether the crc32 of an identifier's text leaves the remainder; a null identifier is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of == remainder, F.lit(False))


def chunked(docs: DataFrame, key: str, size: int = CHUNK_BYTES) -> DataFrame:
    """docs as chunks, one row each: sorted hashes of its distinct words with their counts in training texts, and the documents'
    codes, identifiers, numbers of words and held-out marks."""
    rows = text_bytes(docs.select(whole_number(docs, key).alias("id"), held_out(F.col(key)).alias("held"), "text"))

    def chunk(number: int, ids: list, held: list, hashes: list, sizes: list) -> pa.RecordBatch:
        ids, held, h, sizes = np.concatenate(ids), np.concatenate(held), np.concatenate(hashes), np.concatenate(sizes)
        words, codes = np.unique(h, return_inverse=True)
        train = np.bincount(codes[~np.repeat(held, sizes)], minlength=len(words))
        row = {
            "chunk": number, "words": words.tobytes(), "train": train.astype(np.uint32).tobytes(), "codes": codes.astype(np.int32).tobytes(), "ids": ids.tobytes(),
            "sizes": sizes.astype(np.int64).tobytes(), "held": held.tobytes(), "n_words": len(words), "n_tokens": len(h) + len(ids), "n_train": int(train.sum() + (~held).sum()), "n_docs": int((~held).sum()),
        }
        return pa.RecordBatch.from_pylist([row], schema=arrow_of(CHUNKS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, hashes, sizes, filled, number = [], [], [], [], 0, 0
        for batch in batches:
            texts = batch.column(2).to_pylist()
            one_id = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            mark = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in text_groups(texts):
                h, n = hashed_words(texts[a:b], TOKEN_BYTES)
                ids.append(one_id[a:b])
                held.append(mark[a:b])
                hashes.append(h)
                sizes.append(n)
                filled += sum(len(t or b"") for t in texts[a:b])
                if filled >= size:
                    yield chunk(chunk_number(number), ids, held, hashes, sizes)
                    ids, held, hashes, sizes, filled, number = [], [], [], [], 0, number + 1
        if ids:
            yield chunk(chunk_number(number), ids, held, hashes, sizes)

    return rows.mapInArrow(in_worker(run, "ngrams.chunked"), CHUNKS)


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_of(schema: str) -> pa.Schema:
    """The Arrow schema of a schema text of plain types; workers can't ask Spark for it."""
    return pa.schema([(name, KINDS[kind]) for name, kind in map(str.split, schema.split(", "))])


@dataclass(frozen=True)
class Chunk:
    """A row of chunked."""

    words: np.ndarray
    train: np.ndarray
    codes: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        kinds = {"words": np.uint64, "train": np.uint32, "codes": np.int32, "ids": np.int64, "sizes": np.int64, "held": bool}
        return cls(*(np.frombuffer(row[name], kind) for name, kind in kinds.items()))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all tokens, words and then the end (its code is the number of words), and the token's document."""
        ends = np.cumsum(self.sizes + 1) - 1
        codes = np.full(len(self.codes) + len(self.sizes), len(self.words), np.int64)
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        codes[inside] = self.codes
        return codes, np.repeat(np.arange(len(self.sizes)), self.sizes + 1)

    def before(self, codes: np.ndarray) -> np.ndarray:
        """For each token the code before it; the start's is the number of words and one."""
        first = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        out = np.empty_like(codes)
        out[1:] = codes[:-1]
        out[first] = len(self.words) + 1
        return out

    def slices(self, most: int = 1 << 19) -> Iterator[Chunk]:
        """The chunk's documents in runs of about `most` tokens; a longer document is alone."""
        ends = np.cumsum(self.sizes + 1)
        cuts = np.r_[0, np.flatnonzero(np.diff(ends // most)) + 1, len(ends)].tolist()
        at = np.r_[0, np.cumsum(self.sizes)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield Chunk(self.words, self.train, self.codes[at[a] : at[b]], self.ids[a:b], self.sizes[a:b], self.held[a:b])

    def distinct(self, part_bits: int) -> np.ndarray:
        """Sorted keys of the chunk's bigrams."""
        return np.unique(np.concatenate([np.unique(s.grams(part_bits)) for s in self.slices()]))

    def grams(self, part_bits: int) -> np.ndarray:
        """Keys of each token's bigram: its part in the high bits, 32 bits of its hash in the low ones."""
        codes, _ = self.tokens()
        words = np.r_[self.words, END, START]
        return mix(words[self.before(codes)] * ROLL + words[codes]) >> np.uint64(32 - part_bits)


def blobs(keys: np.ndarray, low_bits: int, **arrays: np.ndarray) -> Iterator[tuple[int, dict[str, bytes]]]:
    """Runs of sorted keys of one part (the bits from low_bits on) with those of other arrays."""
    part = (keys >> np.uint64(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(len(keys), np.int64)
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(part[a]), {name: x[a:b].tobytes() for name, x in arrays.items()}


def by_part(df: DataFrame) -> DataFrame:
    return df.repartition("part").sortWithinPartitions("part", "chunk")


def parts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part of a stream in order of part."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["part"] != row["part"]:
                yield rows[0]["part"], rows
                rows = []
            rows.append(row)
    if rows:
        yield rows[0]["part"], rows


def part_bits(n: int, most: int = PART) -> int:
    """Bits that tell so many parts that each gets `most` of n at most, on average."""
    return max(0, (max(n, 1) - 1) // most).bit_length()


def word_counts(chunks: DataFrame, bits: int) -> DataFrame:
    """Counts in all training texts of each chunk's words, in blobs by part that follow the order of the chunk's words; a row with
    null chunk for each part has the number of its words that training texts hold."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, train = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["train"], np.uint32)
                out = [{"part": p, "chunk": row["chunk"], **b} for p, b in blobs(words, 64 - bits, words=words, train=train)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow_of("part int, chunk long, words binary, train binary"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in parts_of(batches):
            words = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
            train = np.concatenate([np.frombuffer(r["train"], np.uint32) for r in rows]).astype(np.int64)
            distinct, inverse = np.unique(words, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, inverse, train)
            counts, at = total[inverse], 0
            out = [{"chunk": None, "part": part, "n": int((total > 0).sum())}]
            for r in rows:
                n = len(r["words"]) // 8
                out.append({"chunk": r["chunk"], "part": part, "counts": counts[at : at + n].tobytes()})
                at += n
            yield pa.RecordBatch.from_pylist(out, schema=arrow_of(COUNTED))

    sent = chunks.select("chunk", "words", "train").mapInArrow(in_worker(send, "ngrams.send"), "part int, chunk long, words binary, train binary")
    return by_part(sent).mapInArrow(in_worker(count, "ngrams.count"), COUNTED)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log2(counts) + 1e-12).astype(np.int64), LEVELS)


def level_counts() -> np.ndarray:
    """The count that a level stands for: the middle of its range; 0 for level 0."""
    q = np.arange(LEVELS + 1, dtype=float)
    return np.where(q > 0, (2.0 ** (q - 1) + 2.0**q - 1) / 2, 0.0)


def places(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    """The bits of keys at a level, probe by probe, in a filter of `size` bits."""
    h = mix(keys * ROLL + np.uint64(level))
    step = mix(h) | np.uint64(1)
    for _ in range(PROBES):
        yield h % np.uint64(size)
        h = h + step


def filled(keys: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bytes of a filter that holds distinct keys with their levels."""
    size = max(64, int(q.sum()) * BITS + 63 & ~63)
    bits = np.zeros(size, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in places(keys[q >= level], level, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def probed(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The level of each key: the number of levels from 1 on at which all its bits are set."""
    q = np.zeros(len(keys), np.uint8)
    here, size = np.arange(len(keys)), len(bits) * 8
    for level in range(1, LEVELS + 1):
        rest, left = keys[here], here
        h = mix(rest * ROLL + np.uint64(level))
        step = mix(h) | np.uint64(1)
        for _ in range(PROBES):
            at = h % np.uint64(size)
            hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, h, step = left[hit], h[hit] + step[hit], step[hit]
        if not len(left):
            break
        q[left] = level
        here = left
    return q


def gram_filter(chunks: DataFrame, bits: int) -> DataFrame:
    """The filter's parts, each built from the exact counts of its bigrams in training texts."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                keys = np.concatenate([s.grams(bits)[~np.repeat(s.held, s.sizes + 1)] for s in chunk.slices()])
                keys, counts = np.unique(keys, return_counts=True)
                out = [{"part": p, "chunk": row["chunk"], **b} for p, b in blobs(keys, 32, low=keys.astype(np.uint32), counts=counts.astype(np.uint32))]
                yield pa.RecordBatch.from_pylist(out, schema=arrow_of("part int, chunk long, low binary, counts binary"))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in parts_of(batches):
            low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
            counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(np.int64)
            distinct, inverse = np.unique(low, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, inverse, counts)
            keys = distinct.astype(np.uint64) | np.uint64(part << 32)
            yield pa.RecordBatch.from_pylist([{"part": part, "bits": filled(keys, levels(total)).tobytes(), "n_grams": len(keys)}], schema=arrow_of(FILTER))

    schema = "part int, chunk long, low binary, counts binary"
    columns = ["words", "train", "codes", "ids", "sizes", "held"]
    sent = chunks.select("chunk", *columns).mapInArrow(in_worker(send, "ngrams.send_grams"), schema)
    return by_part(sent).mapInArrow(in_worker(build, "ngrams.build"), FILTER)


def routed(chunks: DataFrame, parts: DataFrame, bits: int) -> DataFrame:
    """Levels of each chunk's distinct bigrams, in blobs by part that follow the order of their keys: each part of the filter is read by the
    task that gets the part's bigrams."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = Chunk.of(row).distinct(bits)
                out = [{"part": p, "chunk": row["chunk"], **b} for p, b in blobs(keys, 32, low=keys.astype(np.uint32))]
                yield pa.RecordBatch.from_pylist(out, schema=arrow_of("part int, chunk long, low binary"))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, held = row["part"], None
                if row["chunk"] is None:
                    held = np.frombuffer(row["bits"], np.uint8)
                    continue
                keys = np.frombuffer(row["low"], np.uint32).astype(np.uint64) | np.uint64(part << 32)
                q = probed(keys, held) if held is not None else np.zeros(len(keys), np.uint8)
                yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "part": part, "counts": q.tobytes()}], schema=arrow_of(COUNTED))

    sent = chunks.select("chunk", "words", "train", "codes", "ids", "sizes", "held").mapInArrow(in_worker(send, "ngrams.send_probes"), "part int, chunk long, low binary")
    both = sent.unionByName(parts.select("part", "bits"), allowMissingColumns=True)  # a part's filter has no chunk and comes first
    return by_part(both).mapInArrow(in_worker(probe, "ngrams.probe"), COUNTED)


class Filter:
    """All parts of a filter, as broadcast."""

    def __init__(self, rows: Iterable) -> None:
        self.parts = {r["part"]: np.frombuffer(bytes(r["bits"]), np.uint8) for r in rows}

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of sorted keys."""
        out, part = np.zeros(len(keys), np.uint8), (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if (bits := self.parts.get(int(part[a]))) is not None:
                out[a:b] = probed(keys[a:b], bits)
        return out


@dataclass(frozen=True)
class Totals:
    """Training tokens, their distinct ones, and training documents."""

    tokens: int
    words: int
    documents: int


def scores(chunk: Chunk, counts: np.ndarray, keys: np.ndarray, q: np.ndarray, totals: Totals, bits: int) -> pa.RecordBatch:
    """Scores of a chunk's documents, from its words' counts and the levels of its distinct bigrams (sorted keys)."""
    codes, document = chunk.tokens()
    n = len(chunk.sizes)
    full = np.r_[counts, totals.documents, totals.documents].astype(float)  # words, end, start
    own = (full[codes] + 1) / (totals.tokens + totals.words + 1)
    context = full[chunk.before(codes)]
    gram = level_counts()[q[np.searchsorted(keys, chunk.grams(bits))]]
    gram = np.minimum(np.minimum(gram, context), full[codes])
    sums = lambda x: np.bincount(document, x, n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(chunk.ids), pa.array(chunk.held), pa.array(chunk.sizes + 1), pa.array(sums(full[codes] > 0).astype(np.int64)),
            pa.array(sums(np.log10(own))), pa.array(sums(np.log10((gram + MASS * own) / (context + MASS)))),
        ],
        schema=arrow_of(SCORED),
    )


def score_texts(docs: DataFrame, key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each text's log10 probability under the model of the texts that aren't held out. Columns: key, held_out, n_tokens, n_known
    (tokens that training texts hold), train_tokens, base_score (words alone, one added to each count) and score.

    Null and empty texts have one token, the end. Texts of any length are read whole. Rows that repeat an identifier are texts of
    their own; a null identifier is never held out. Where nothing is left to train on, counts are 0. An empty table gives no
    rows. Columns beside the identifier and the text are not read, whatever their names. Probabilities add up to 1 but for the
    rounding of counts to levels and the filter's false positives."""
    spark = docs.sparkSession
    with batches_of(spark, 2048):
        chunks = write_table(chunked(docs, key), "ngrams-chunks", batch=2048)
    total = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens", "n_train", "n_docs"))).first()
    n_words, n_tokens, n_train, n_docs = map(int, total)
    bits = part_bits(n_tokens)
    if bits > 31:
        raise ValueError("more than 2**31 parts")
    with batches_of(spark, 1):
        parts = write_table(gram_filter(chunks, bits), "ngrams-filter", batch=1)
        counted = write_table(word_counts(chunks, part_bits(n_words)), "ngrams-words", batch=64)
    known = counted.where("chunk is null").agg(F.sum("n")).first()[0]
    totals = Totals(n_train, int(known or 0) + (n_docs > 0), n_docs)
    size = int(parts.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0])
    shared = None
    stream = counted.where("chunk is not null").withColumn("kind", F.lit(0))
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(Filter(parts.select("part", "bits").toLocalIterator()))
    else:
        with batches_of(spark, 1):
            sent = write_table(routed(chunks, parts, bits), "ngrams-levels", batch=64)
        stream = stream.unionByName(sent.withColumn("kind", F.lit(1)))
    stream = stream.unionByName(chunks.select("chunk", "words", "train", "codes", "ids", "sizes", "held").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    stream = stream.repartition("chunk").sortWithinPartitions("chunk", "kind", "part")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list] = ([], [])
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] < 2:
                    found[row["kind"]].append(np.frombuffer(row["counts"], np.int64 if row["kind"] == 0 else np.uint8))
                    continue
                chunk, counts = Chunk.of(row), np.concatenate([np.empty(0, np.int64), *found[0]])
                sent = None if shared else (chunk.distinct(bits), np.concatenate(found[1]))
                found = ([], [])
                for some in chunk.slices():
                    if shared:
                        keys = np.unique(some.grams(bits))
                        yield scores(some, counts, keys, shared.value.levels(keys), totals, bits)
                    else:
                        yield scores(some, counts, *sent, totals, bits)

    with batches_of(spark, 64):
        scored = write_table(stream.mapInArrow(in_worker(run, "ngrams.score"), SCORED), "ngrams-scores", batch=64)
    name = F.when(F.col("id") != int(NO_ID), F.col("id")).alias(key)
    return scored.select(name, "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
