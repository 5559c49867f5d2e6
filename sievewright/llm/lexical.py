"""Ranked lexical search: WAND over document shards.

The documents are read once: each task writes its documents as shards, small indexes that hold for every term of the
queries the documents with their counts. Corpus figures (documents, terms, documents a term) are sums over the shards.
Then each task takes its shards one after the other with one heap an item: a term's greatest impact in the shard bounds
what it can add, documents whose terms' greatest impacts together reach the least score of the heap are pivots, and only
pivots are scored. The tasks' heaps are merged by a window that keeps each task's best rows before it shuffles.

Pivots are chosen for a stretch of documents at a time, as arrays: lists whose greatest impacts together can't reach the
heap's least score aren't read for it, but only probed at the pivots. Scores are whole numbers, so that no order of sums
matters; a document with the heap's least score is kept until the identifiers decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_words, in_worker, small_batches, text_bytes, text_groups, whole_number, write_table

#: Results an item.
K = 50
#: Postings and documents of a shard, at most by one batch more.
POSTINGS, DOCUMENTS = 1_000_000, 65_536
#: Documents for which pivots are chosen at once.
STRETCH = 4096
#: Term references of a block of items; each block is broadcast and takes a pass over the documents.
BLOCK_TERMS = 1 << 20
#: Stands for a null identifier, the last one of equal scores.
NO_ID = np.iinfo(np.int64).max

SHARDS = "ids binary, lengths binary, ends binary, rows binary, counts binary, terms array<int>, holders array<int>, n_documents long, n_terms long"


@dataclass(frozen=True)
class Block:
    """Items of a block: the sorted hashes of their distinct terms, and for each item the places of its terms there."""

    items: list
    terms: np.ndarray
    wanted: list[np.ndarray]


def blocks(items: DataFrame, key: str, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """Items with their distinct terms, in blocks of about `most` term references; texts of one identifier count as one."""
    names: list = []
    hashes: list[np.ndarray] = []

    def block() -> Block:
        terms = np.unique(np.concatenate(hashes))
        return Block(list(names), terms, [np.searchsorted(terms, h) for h in hashes])

    rows = text_bytes(items.select(key, "text")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col("text").cast("string"))), " ").cast("binary").alias("text"))
    for row in rows.orderBy(key).toLocalIterator():
        h, _ = hashed_words([bytes(row["text"] or b"")])
        names.append(row[key])
        hashes.append(np.unique(h))
        if sum(map(len, hashes)) >= most:
            yield block()
            names.clear()
            hashes.clear()
    if names:
        yield block()


class Shard:
    """Postings of a run of documents, gathered batch by batch."""

    def __init__(self, n_terms: int) -> None:
        self.n_terms = n_terms
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.documents = self.size = 0

    def add(self, ids: np.ndarray, texts: list[bytes | None], terms: np.ndarray) -> None:
        h, lengths = hashed_words(texts)
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        known = terms[at] == h
        row = np.repeat(np.arange(len(texts)), lengths)[known]
        pairs, counts = np.unique(at[known] * len(texts) + row, return_counts=True)
        self.postings.append((pairs // len(texts), pairs % len(texts) + self.documents, counts))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.documents += len(texts)
        self.size += len(pairs)

    def row(self) -> dict:
        """The shard: documents by identifier, postings by term and document."""
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        term, row, count = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        row = place[row]
        by = np.lexsort((row, term))
        term, row, count = term[by], row[by], count[by]
        held, holders = np.unique(term, return_counts=True)
        ends = np.cumsum(holders)
        return {
            "ids": ids[order].tobytes(), "lengths": lengths[order].astype(np.int64).tobytes(), "ends": ends.astype(np.int64).tobytes(),
            "rows": row.astype(np.uint32).tobytes(), "counts": count.astype(np.uint32).tobytes(), "terms": held, "holders": holders,
            "n_documents": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
        }


def shards(docs: DataFrame, terms: np.ndarray, key: str) -> DataFrame:
    """Index shards of all documents over the given terms (sorted hashes, broadcast)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(SHARDS))
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = text_bytes(docs.select(whole_number(docs, key).alias("id"), "text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        shard = Shard(len(wanted))
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                shard.add(ids[a:b], texts[a:b], wanted)
                if shard.size >= POSTINGS or shard.documents >= DOCUMENTS:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema=arrow)
                    shard = Shard(len(wanted))
        if shard.documents:
            yield pa.RecordBatch.from_pylist([shard.row()], schema=arrow)

    return rows.mapInArrow(in_worker(run, "lexical.shards"), SHARDS)


def weights(holders: np.ndarray, n_documents: int) -> np.ndarray:
    """A term's weight by the documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)


def impacts(counts: np.ndarray, lengths: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds, by its count in a document and the document's length."""
    m = 50 + (50 * lengths * n_documents) // max(n_terms, 1)
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


class Heap:
    """The k best (score, identifier) so far: higher scores first, then lesser identifiers."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """The score from which on a document may enter."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else 1

    def push(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


def wand(ids: np.ndarray, lists: list[tuple[int, np.ndarray, np.ndarray]], heap: Heap, stretch: int = STRETCH) -> int:
    """Push a shard's best documents to the heap. lists: for each of the item's terms its greatest impact, documents (ascending
    places in ids) and impacts there. Gives the number of documents scored."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: -x[0])
    most = np.array([x[0] for x in lists], np.int64)
    rest = np.r_[np.cumsum(most[::-1])[::-1], 0]  # rest[i]: what the lists from i on can add
    scored = 0
    for low in range(0, len(ids), stretch):
        high = min(len(ids), low + stretch)
        least = heap.least()
        read = int((rest[:-1] >= least).sum())  # a document that is in later lists only can't enter
        if not read:
            break
        edges = [np.searchsorted(docs, (low, high)) for _, docs, _ in lists]
        bound = np.zeros(high - low, np.int64)
        for (top, docs, _), (a, b) in zip(lists[:read], edges[:read], strict=True):
            bound[docs[a:b] - low] += top
        pivots = np.flatnonzero((bound > 0) & (bound + rest[read] >= least)) + low
        scored += len(pivots)
        score = np.zeros(len(pivots), np.int64)
        for i, ((_, docs, values), (a, b)) in enumerate(zip(lists, edges, strict=True)):
            if not len(pivots):
                break
            if a < b:
                at = np.minimum(np.searchsorted(docs[a:b], pivots), b - a - 1) + a
                score += np.where(docs[at] == pivots, values[at], 0)
            able = score + rest[i + 1] >= least
            if not able.all():
                pivots, score = pivots[able], score[able]
        if len(pivots):
            heap.push(score, ids[pivots])
    return scored


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", item_key: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k documents of highest score above 0 for each item, equal scores by ascending identifier. Columns: item_key, rank
    (from 1), key, score.

    Null and empty texts have no terms: such documents aren't counted, such items have no rows. A document without an identifier
    comes last among equal scores, with a null in its rows. Rows that repeat an identifier are documents of their own; the texts of
    one item's rows count as one text. Texts of any length are read whole. Without documents or items there are no rows. Columns
    beside the identifier and the text are not read, whatever their names."""
    spark = docs.sparkSession
    schema = f"item int, id long, score long"
    found = None
    for block in blocks(items, item_key, block_terms):
        if not len(block.terms):
            continue
        index = write_table(shards(docs, block.terms, key), "lexical")
        totals = index.agg(F.sum("n_documents"), F.sum("n_terms")).first()
        n_documents, n_terms = int(totals[0] or 0), int(totals[1] or 0)
        holders = np.zeros(len(block.terms), np.int64)
        held = index.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).groupBy("x.terms").agg(F.sum("x.holders").alias("n"))
        for row in held.toLocalIterator():  # a row a term of the block
            holders[row["terms"]] = row["n"]
        shared = spark.sparkContext.broadcast((weights(holders, n_documents), block.wanted, n_documents, n_terms))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weight, wanted, n_documents, n_terms = shared.value
            heaps = [Heap(k) for _ in wanted]
            for batch in batches:
                for shard in batch.to_pylist():
                    ids, lengths = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["lengths"], np.int64)
                    ends, rows = np.frombuffer(shard["ends"], np.int64), np.frombuffer(shard["rows"], np.uint32).astype(np.int64)
                    terms, counts = np.array(shard["terms"], np.int64), np.frombuffer(shard["counts"], np.uint32).astype(np.int64)
                    if not len(terms):
                        continue
                    starts = np.r_[0, ends[:-1]]
                    values = impacts(counts, lengths[rows], n_documents, n_terms) * np.repeat(weight[terms], ends - starts)
                    tops = np.maximum.reduceat(values, starts)
                    for heap, mine in zip(heaps, wanted, strict=True):
                        at = np.searchsorted(terms, mine)
                        here = at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == mine)]
                        wand(ids, [(int(tops[i]), rows[starts[i] : ends[i]], values[starts[i] : ends[i]]) for i in here.tolist()], heap)
            for i, heap in enumerate(heaps):
                n = len(heap.ids)
                if n:
                    item = pa.array(np.full(n, i, np.int32))
                    yield pa.RecordBatch.from_arrays([item, pa.array(heap.ids), pa.array(heap.scores)], names=["item", "id", "score"])

        small_batches(spark, 1)
        heaps = write_table(index.select("ids", "lengths", "ends", "rows", "counts", "terms").mapInArrow(in_worker(run, "lexical.search"), schema), "lexical-heaps", batch=1)
        best = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, name {dict(items.dtypes)[item_key]}")
        part = best.join(F.broadcast(names), "item").select(F.col("name").alias(item_key), "rank", F.when(F.col("id") != int(NO_ID), F.col("id")).alias(key), "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{item_key} {dict(items.dtypes)[item_key]}, rank int, {key} long, score long")
    return found
