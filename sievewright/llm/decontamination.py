"""Benchmark decontamination by winnowing.

Items and documents keep the least k-gram hash of every run of w consecutive k-grams. With k + w - 1 = 10 every shared span
of ten words has a fingerprint in common at the same place. Documents are joined with the items' fingerprints, and each
hit is extended to all windows of ten words around it that an item has, compared word by word. Items of fewer than ten
words are one window as a whole and are looked up by a hash of their own length.

The benchmark is read in blocks of at most BLOCK_WORDS words, one after the other: the driver makes one block, broadcasts it
and lets go of it, so memory is bounded whatever the benchmark's size, and each further block is one more pass over the
documents.

Edge cases: a null or empty text has no words and is clean; items without words have no window; items with one identifier
count as one, and a null identifier as an empty one; repeated documents are judged one by one; columns of docs that have the
name of a result give way to it; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hashed_words, map_rows, minimizers, split_at, text_bytes, text_groups, without, words, write_table

WINDOW, K = 10, 5
W = WINDOW - K + 1
BLOCK_WORDS = 4_000_000


class Windows:
    """Distinct windows of n words: sorted hashes, the words of one place each, and the items that hold them."""

    def __init__(self, n: int, hashes: np.ndarray, places: np.ndarray, items: np.ndarray, words: np.ndarray) -> None:
        self.n = n
        pairs = np.unique(np.stack([hashes, items.astype(np.uint64)], 1), axis=0) if len(hashes) else np.empty((0, 2), np.uint64)
        self.items = pairs[:, 1].astype(np.int64)
        self.keys, self.begin = np.unique(pairs[:, 0], return_index=True)
        self.end = np.append(self.begin[1:], len(pairs))
        _, first = np.unique(hashes, return_index=True)
        self.words = words[places[first][:, None] + np.arange(n)] if len(hashes) else np.empty((0, n), np.uint64)

    def find(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of `starts` at which a window stands, and the items that hold one of them. Equal hashes are compared by word."""
        if not len(starts) or not len(self.keys):
            return starts[:0], self.items[:0]
        mine = h[starts[:, None] + np.arange(self.n)]
        at = np.searchsorted(self.keys, joined_hash(mine))
        at[at == len(self.keys)] = 0
        good = (self.words[at] == mine).all(1)
        found = np.unique(at[good])
        size = self.end[found] - self.begin[found]
        places = np.repeat(self.begin[found] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return starts[good], np.unique(self.items[places])


def joined_hash(rows: np.ndarray) -> np.ndarray:
    """gram_hashes() of each row as a whole."""
    return gram_hashes(np.ascontiguousarray(rows).reshape(-1), rows.shape[1])[:: rows.shape[1]] if len(rows) else np.empty(0, np.uint64)


class Block:
    """Fingerprints and windows of some items."""

    def __init__(self, items: list[tuple[str, np.ndarray]]) -> None:
        self.ids = [i for i, _ in items]
        sizes = np.array([len(h) for _, h in items], np.int64)
        starts = np.cumsum(sizes) - sizes
        words = np.concatenate([np.empty(0, np.uint64), *(h for _, h in items)])
        keys = [np.empty(0, np.uint64)]
        of: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for i, (_, h) in enumerate(items):
            n = min(WINDOW, len(h))
            if n:
                g = gram_hashes(h, n)
                of.setdefault(n, []).append((g, starts[i] + np.arange(len(g)), i))
            if n == WINDOW:
                k = gram_hashes(h, K)
                keys.append(k[minimizers(k, W)])
        self.windows = {
            n: Windows(n, np.concatenate([g for g, _, _ in v]), np.concatenate([p for _, p, _ in v]), np.repeat([i for *_, i in v], [len(g) for g, _, _ in v]), words)
            for n, v in sorted(of.items())
        }
        self.keys = np.unique(np.concatenate(keys))
        self.seen = np.zeros(1 << 16, bool)  # by the top bits of a hash
        self.seen[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray) -> np.ndarray:
        """Starts of windows around the fingerprints that the text has in common with items; a shared window has one in it."""
        g = gram_hashes(h, K)
        at = minimizers(g, W)
        at = at[self.seen[(g[at] >> np.uint64(48)).astype(np.int64)]]
        low = np.searchsorted(self.keys, g[at])
        low[low == len(self.keys)] = 0
        at = at[self.keys[low] == g[at]]
        starts = np.unique((at[:, None] - np.arange(W)).ravel())
        return starts[(starts >= 0) & (starts <= len(h) - WINDOW)]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Whether each word is inside a window, and the items with windows here. The time is linear in the text: each hit is
        extended to the windows around it, whatever number of places the items have it at."""
        hit, items = np.zeros(len(h) + 1, np.int64), set()
        for n, table in self.windows.items():
            if len(h) >= n:
                found, held = table.find(h, self.candidates(h) if n == WINDOW else np.arange(len(h) - n + 1))
                np.add.at(hit, found, 1)
                np.subtract.at(hit, found + n, 1)
                items.update(self.ids[i] for i in held.tolist())
        return np.cumsum(hit)[:-1] > 0, items


def blocks(benchmark: DataFrame, key: str, text: str, size: int) -> Iterator[Block]:
    """The items in blocks of at most `size` words, or WINDOW ones; a longer item is cut into parts that share all but one word
    of a window, so that each of its windows is in one of them."""
    rows = text_bytes(benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")))
    size = max(size, WINDOW)
    now, n = [], 0
    for r in rows.where("text is not null").toLocalIterator(prefetchPartitions=False):
        whole, _ = hashed_words([bytes(r["text"])])
        step = size - WINDOW + 1
        for s in range(0, max(1, len(whole) - WINDOW + 1), step):
            h = whole[s : s + size]
            if now and n + len(h) > size:
                yield Block(now)
                now, n = [], 0
            now.append((r["id"], h))
            n += len(h)
    if now:
        yield Block(now)


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """docs (all its columns, but those that have a result's name) with n_words, runs (an array of [start, end) word positions,
    merged) and items (ids of the items with windows that occur, sorted as strings)."""
    spark = docs.sparkSession
    docs = without(docs, *({"n_words", "runs", "items"} - {text.lower()}))
    names = [c for c in docs.columns if c != text]
    out = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(text).alias("text"), F.col(text).cast("binary").alias("raw"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("runs"), F.lit(None).cast("array<string>").alias("items"),
    )
    schema = ", ".join(f"{c} {k}" for c, k in out.dtypes)
    held = None
    for block in blocks(benchmark, item, item_text, block_words):
        if held is not None:
            out = write_table(out, "decontamination")
            held.unpersist()
        held = spark.sparkContext.broadcast(block)
        del block  # the next one is made with this one gone from the driver
        out = with_hits(out, held, schema)
    if held is None:
        out = with_hits(out, spark.sparkContext.broadcast(Block([])), schema)
    return out.select(
        *(F.col("text").alias(text) if c == text else F.col(f"c{names.index(c)}").alias(c) for c in docs.columns), "n_words", "runs", "items"
    )


def with_hits(docs: DataFrame, held, schema: str) -> DataFrame:
    """docs with the hits of a broadcast block added to its runs and items."""

    def make():
        block: Block = held.value

        def step(batch: dict[str, list]) -> dict[str, list]:
            each = []
            for i, j in text_groups(batch["raw"]):
                each += split_at(*hashed_words(batch["raw"][i:j]))
            counts, all_runs, all_items = [], [], []
            for h, runs, items in zip(each, batch["runs"], batch["items"], strict=True):
                hit, found = block.hits(h)
                counts.append(len(h))
                merged = merge_runs([(r["start"], r["end"]) for r in runs or ()] + runs_of(hit))
                all_runs.append([{"start": s, "end": e} for s, e in merged])
                all_items.append(sorted(found.union(items or ())))
            return {**batch, "n_words": counts, "runs": all_runs, "items": all_items}

        return step

    return map_rows(docs, make, schema)


def n_hit(runs: F.Column) -> F.Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def brute_force(text: str | None, items: dict[str, str]) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items of one document, by comparing every window: for tests."""
    ws = words(text.encode()) if text else []
    hit, found = set(), []
    for i, t in items.items():
        it = words(t.encode()) if t else []
        size = min(WINDOW, len(it))
        windows = {tuple(it[j : j + size]) for j in range(len(it) - size + 1)} if size else set()
        at = [p for p in range(len(ws) - size + 1) if tuple(ws[p : p + size]) in windows]
        if at:
            found.append(i)
        hit.update(x for p in at for x in range(p, p + size))
    return len(ws), len(hit), sorted(found)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
