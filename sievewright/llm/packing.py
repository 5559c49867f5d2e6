"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' ids. A round serves one window: each source gets its share of WINDOW_TOKENS as
a quantum; what a quantum leaves over, a fraction of an id, is the source's deficit and is carried to its next round.
When a queue runs dry, the sources that are left share its quantum by their targets. The served ids, round by round and
source by source, are one stream that is cut every SEQUENCE ids, so that only the last sequence needs padding.

The ids that source i has got after w rounds are a closed form, floor(w times its quantum), so that deficits carry over
windows and partitions without a sequential pass: a document's place follows from the ids of its source before it, which
is a prefix sum over partitions, and from the sources' totals.

Edge cases: a null text is empty and has the end id alone; a null source is a queue of its own; repeated rows are packed
one by one; sources that the targets don't name get no share until the named ones have run dry; the empty table gives no
pieces. The one table held on the driver has a row for each source.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_worker, small_batches, whole_number, write_table
from .token_ids import encoder

SEQUENCE = 2048
WINDOW_TOKENS = 64 * SEQUENCE
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, ids binary"


@dataclass(frozen=True)
class Phase:
    """Rounds from `first` on, until `last`: source i had base[i] ids before, and gets quantum[i] / den ids a round."""

    first: int
    last: int
    base: list[int]
    quantum: list[int]
    den: int


class Schedule:
    """The rounds for sources with the given totals and target shares."""

    def __init__(self, totals: list[int], targets: list[int], window: int = WINDOW_TOKENS) -> None:
        self.totals = totals
        self.phases: list[Phase] = []
        base, w = [0] * len(totals), 0
        while left := [i for i, t in enumerate(totals) if base[i] < t]:
            active = [i for i in left if targets[i] > 0] or left
            share = [0] * len(totals)
            for i in active:
                share[i] = max(1, targets[i])
            den = sum(share)
            quantum = [s * window for s in share]
            rounds = min(-(-(totals[i] - base[i]) * den // quantum[i]) for i in active)
            self.phases.append(Phase(w, w + rounds, base, quantum, den))
            w += rounds
            base = [min(t, b + rounds * q // den) for t, b, q in zip(totals, base, quantum, strict=True)]
        self.rounds = w

    def phase(self, w: int) -> Phase:
        return next(p for p in self.phases if w < p.last) if w < self.rounds else self.phases[-1]

    def served(self, w: int) -> list[int]:
        """Ids of each source before round w."""
        p = self.phase(w)
        n = min(w, p.last) - p.first
        return [min(t, b + n * q // p.den) for t, b, q in zip(self.totals, p.base, p.quantum, strict=True)]

    def round_of(self, i: int, at: int) -> int:
        """The round that serves id `at` of source i."""
        for p in self.phases:
            n = p.last - p.first
            if p.quantum[i] and at < min(self.totals[i], p.base[i] + n * p.quantum[i] // p.den):
                # the last round before which at most `at` ids were served
                return p.first + ((at - p.base[i] + 1) * p.den - 1) // p.quantum[i]
        raise ValueError("beyond the source's ids")

    def pieces(self, i: int, at: int, length: int, held: dict) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, place in the stream, round) of the parts that rounds cut ids at..at + length of source i into."""
        done = 0
        w = self.round_of(i, at)
        while done < length:
            if w not in held:
                if len(held) > 64:
                    held.clear()
                before, after = self.served(w), self.served(w + 1)
                place, total = [], sum(before)
                for a, b in zip(before, after, strict=True):
                    place.append(total - a)
                    total += b - a
                held[w] = after, place
            after, place = held[w]
            n = min(length - done, after[i] - at - done)
            if n > 0:
                yield done, n, place[i] + at + done, w
                done += n
            w += 1


def tokenize(docs: DataFrame, vocabulary_path: str, end_id: int, key: str, text: str, source: str) -> DataFrame:
    """part, doc_id, source, n, before (ids of the same source earlier in the part) and ids; written to the shared folder,
    so that every later step sees one order of the documents."""
    small_batches(docs.sparkSession)
    rows = docs.select(whole_number(docs, key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary_path)
        part = TaskContext.get().partitionId()
        sums: dict[str | None, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, at = enc.encode(batch.column(2))
            raw, n, before = flat.astype("<u2").tobytes(), (np.diff(at) + 1).tolist(), []
            for s, k in zip(batch.column(1).to_pylist(), n, strict=True):
                before.append(sums.get(s, 0))
                sums[s] = before[-1] + k
            end = np.array([end_id], "<u2").tobytes()
            ids = [raw[2 * a : 2 * b] + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int64()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "doc_id", "source", "n", "before", "ids"],
            )

    return write_table(rows.mapInArrow(in_worker(run), "part long, doc_id long, source string, n long, before long, ids binary"), "packing")


def pack(
    docs: DataFrame,
    vocabulary_path: str,
    end_id: int = 1,
    targets: Mapping[str | None, int] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW_TOKENS,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """One row a piece: doc_id, start (the document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit numbers), doc_tokens, sequence_id, offset, window (the round) and on demand the ids as such numbers.
    targets: weights of the sources; none: the sources' own shares, so that all queues run dry together."""
    spark = docs.sparkSession
    rows = tokenize(docs, vocabulary_path, end_id, key, text, source)
    by_part = rows.groupBy("source", "part").agg(F.sum("n").alias("ids"))
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("earlier", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    by_part = write_table(by_part.select("source", "part", "ids", "earlier"), "packing-sums")
    totals = by_part.groupBy("source").agg(F.sum("ids").alias("ids")).collect()
    totals = sorted(((r["source"], r["ids"]) for r in totals), key=lambda x: (x[0] is not None, x[0] or ""))
    names = {s: i for i, (s, _) in enumerate(totals)}
    sizes = [n for _, n in totals]
    held = spark.sparkContext.broadcast((names, Schedule(sizes, sizes if targets is None else [targets.get(s, 0) for s in names], window)))
    schema = PIECES if with_ids else PIECES.removesuffix(", ids binary")
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, schedule = held.value
        rounds: dict = {}
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for doc, src, n, at, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                for start, size, place, w in schedule.pieces(index[src], at, n, rounds):
                    while size:
                        seq, offset = divmod(place, sequence)
                        take = min(size, sequence - offset)
                        part = ids[4 * start : 4 * (start + take)]
                        for c, v in zip(out, (doc, start, take, zlib.crc32(part), n, seq, offset, w, part), strict=False):
                            c.append(v)
                        start, place, size = start + take, place + take, size - take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(columns, out, strict=True)], columns)

    sums = by_part.select(F.col("source").alias("s"), F.col("part").alias("p"), "earlier")
    joined = rows.join(sums, rows["source"].eqNullSafe(sums["s"]) & (rows["part"] == sums["p"]))
    placed = joined.select("doc_id", "source", "n", (F.col("before") + F.col("earlier")).alias("at"), "ids")
    return placed.mapInArrow(in_worker(run), schema)
