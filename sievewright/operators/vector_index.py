"""An inverted file of product-quantised vectors, and exact search over whole stores.

The quantiser is fitted on a bounded sample: a k-means of cells, and for each stretch of a vector's coordinates a k-means of what is
left after its cell's centre is taken away. Every vector is indexed: its cell and a byte a stretch. The index has a row for each
block of vectors of a cell, clustered by cell, so that a frequent cell is many rows. A search reads the blocks of each query's
nearest cells, estimates distances from the bytes by a table a query and cell, keeps the best candidates a query in each task, and
ranks the merged candidates by their exact distances.

How many cells are read and how many candidates are ranked again is measured on the sample, so that the wanted recall is
reached on data of any shape; vectors without any clusters need many cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import batches, written
from .retrieval import squared_l2

#: Vectors that the quantiser is fitted on at most (those with the least hashes of their identifiers), and rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Cells at most, and stretches of a vector at most.
CELLS, STRETCHES = 1024, 16
#: Sampled queries that the numbers of cells and candidates are measured with.
TRIALS = 200
#: Vectors of a block of the index at most, and queries of a block, which is broadcast.
BLOCK, QUERIES = 4096, 10_000
#: Queries whose distances to a block are held at once.
AT_ONCE = 256

#: Pairs of a query and a vector that a task estimates, or ranks exactly, about, and tasks of a search at most.
PAIRS, EXACT_PAIRS, TASKS = 50_000_000, 100_000_000, 20_000
#: No candidate.
NONE = np.uint64(2**64 - 1)

ENTRY = "cell int, ids binary, labels binary, codes binary, n int"


@dataclass(frozen=True)
class Quantiser:
    """Centres of cells, centres of each stretch's rest, cells to read and candidates to rank again."""

    cells: np.ndarray
    books: np.ndarray
    probes: int
    candidates: int
    #: The sample's cells, codes and labels: stored vectors, by which a search is bounded before it reads the index.
    sample: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def bounds(self, q: np.ndarray, near: np.ndarray, labels: np.ndarray | None) -> np.ndarray:
        """For each query an estimate that its best candidates don't exceed: that of the last of so many among the sample's vectors in
        its cells (and of its label); infinite where the sample has fewer."""
        out = np.full(len(q), np.inf, np.float32)
        if self.sample is None or len(self.sample[0]) < self.candidates:
            return out
        of, codes, marks = self.sample
        inside = {c: np.flatnonzero(of == c) for c in np.unique(of).tolist()}
        for at in range(0, len(q), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            d = np.full((len(q[some]), len(of)), np.inf, np.float32)
            for c, rows in inside.items():
                who = np.flatnonzero((near[some] == c).any(1))
                if len(who):
                    d[np.ix_(who, rows)] = self.estimates(q[some][who], c, codes[rows])
            if labels is not None:
                d[marks[None] != labels[some][:, None]] = np.inf
            out[some] = np.partition(d, self.candidates - 1, axis=1)[:, self.candidates - 1] * 1.00001 + 1e-6
        return out

    def rest_codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """A byte for each vector and stretch."""
        rest = (x - self.cells[cell]).reshape(len(x), len(self.books), -1)
        return np.stack([nearest(rest[:, m], book) for m, book in enumerate(self.books)], 1).astype(np.uint8)

    def table(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of queries' rests in a cell to all centres of all stretches."""
        rest = (q - self.cells[cell]).reshape(len(q), len(self.books), -1)
        return np.stack([squares(rest[:, m], book) for m, book in enumerate(self.books)], 1)

    def estimates(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries (rows) to the vectors of a block (columns)."""
        table = self.table(q, cell)
        out = np.zeros((len(q), len(codes)), np.float32)
        for m in range(len(self.books)):
            out += table[:, m, codes[:, m]]
        return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(squares(x[at : at + 4096], centres), 1)
    return out


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        count = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, of, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres).astype(np.float32)
    return centres


def fit(store: DataFrame, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, k: int = 10, seed: int = 7, label: str | None = None) -> Quantiser | None:
    """A quantiser of a sample of at most SAMPLE vectors; none for a store without vectors. Cells grow with the root of the store."""
    rows = store.where(F.col(vector).isNotNull())
    n = rows.count()
    mark = F.coalesce(F.col(label).cast("int"), F.lit(-1)) if label else F.lit(-1)
    sample = rows.select(key, vector, mark.alias("mark")).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).collect()
    if not sample:
        return None
    x, marks = np.array([r[vector] for r in sample], np.float32), np.array([r["mark"] for r in sample], np.int32)
    cells = k_means(x, min(CELLS, max(1, math.isqrt(n)), len(x)), seed)
    of = nearest(x, cells)
    m = next(m for m in range(min(STRETCHES, x.shape[1]), 0, -1) if x.shape[1] % m == 0)
    rest = (x - cells[of]).reshape(len(x), m, -1)
    books = np.stack([k_means(rest[:, i], 256, seed + 1 + i) for i in range(m)])
    fitted = Quantiser(cells, books, len(cells), len(x))
    return replace(measured(fitted, x, of, recall, k, n), sample=(of, fitted.rest_codes(x, of), marks))


def measured(q: Quantiser, x: np.ndarray, of: np.ndarray, recall: float, k: int, n: int) -> Quantiser:
    """Cells to read and candidates to rank again, so that TRIALS vectors of the sample find the share `recall` of their k
    nearest others. What is lost to cells and to candidates is held to half of the rest each. Candidates are doubled for each
    tenfold of the sample in the store, whose neighbours are closer to each other."""
    trials = np.arange(min(TRIALS, len(x)))
    codes = q.rest_codes(x, of)
    rank_of_cell = np.argsort(np.argsort(squares(x[trials], q.cells), 1), 1)
    estimate = np.empty((len(trials), len(x)), np.float32)
    for c in np.unique(of).tolist():
        inside = np.flatnonzero(of == c)
        estimate[:, inside] = q.estimates(x[trials], c, codes[inside])
    estimate[trials, trials] = np.inf
    cells_needed, places = [], []
    for t in trials.tolist():
        d = squares(x[t : t + 1], x)[0]
        d[t] = np.inf
        true = np.argsort(d)[: min(k, len(x) - 1)]
        place = np.empty(len(x), np.int64)
        place[np.argsort(estimate[t], kind="stable")] = np.arange(len(x))
        cells_needed += rank_of_cell[t][of[true]].tolist()
        places += place[true].tolist()
    if not places:
        return q
    part = 1 - (1 - recall) / 2
    probes = 1 + int(np.quantile(cells_needed, part, method="higher"))
    candidates = 1 + int(np.quantile(places, part, method="higher"))
    grown = candidates * 2 ** max(0.0, math.log10(max(n, 1) / len(x)))
    return Quantiser(q.cells, q.books, probes, max(2 * k, math.ceil(grown)))


def index(store: DataFrame, quantiser: Quantiser, key: str = "vec_id", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """Every vector of the store in blocks of its cell. Each task packs what it reads; only blocks are shuffled, by cell and first
    identifier, so that a frequent cell is spread over tasks. Rows without a vector or identifier are not indexed."""
    shared = store.sparkSession.sparkContext.broadcast(quantiser)
    rows = store.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long"), (F.coalesce(F.col(label).cast("int"), F.lit(-1)) if label else F.lit(-1)).alias("label"), F.col(vector).cast("array<float>"))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            ids, labels, cell, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, cell))
            cuts = np.flatnonzero(np.diff(cell[order])) + 1
            for run_ in np.split(order, cuts):
                for at in range(0, len(run_), BLOCK):
                    some = run_[at : at + BLOCK]
                    row = [[int(cell[some[0]])], [ids[some].tobytes()], [labels[some].tobytes()], [codes[some].tobytes()], [len(some)]]
                    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["cell", "ids", "labels", "codes", "n"])

        for batch in parts:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten(), np.float32).reshape(batch.num_rows, -1)
            cell = nearest(x, q.cells)
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), cell, q.rest_codes(x, cell)))
            if sum(len(h[0]) for h in held) >= BLOCK * len(q.cells):
                yield from blocks()
                held = []
        if held:
            yield from blocks()

    with batches(store.sparkSession, 4096):
        packed = rows.mapInArrow(run, ENTRY)
        return written(packed.repartitionByRange("cell", F.xxhash64("ids")).sortWithinPartitions("cell"), "vector-index")


def candidates(blocks: DataFrame, quantiser: Quantiser, ids: np.ndarray, q: np.ndarray, labels: np.ndarray | None) -> DataFrame:
    """query_id, id: the best candidates of each query, by estimates over the blocks of its cells. The queries are a block of at
    most QUERIES and are broadcast; labels: only vectors of the query's label count."""
    near = np.argsort(squares(q, quantiser.cells), 1, kind="stable")[:, : quantiser.probes]
    asked = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}
    bounds = sample_bounds(blocks.sparkSession, quantiser, q, near, labels)
    shared = blocks.sparkSession.sparkContext.broadcast((replace(quantiser, sample=None), ids, q, labels, asked, bounds))
    keep = quantiser.candidates

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, ids, q, labels, asked, bounds = shared.value
        bounds = bounds.copy()
        best = np.full((len(ids), keep), NONE)  # estimates before the low bits of identifiers: ties don't depend on the order of blocks
        names = np.zeros((len(ids), keep), np.int64)
        for cell, stored, label, codes in cell_runs(parts):
            who = asked.get(cell, np.empty(0, np.int64))
            for mine, inside in together(len(who), labels[who] if labels is not None else None, label):
                names_, codes_ = stored[inside], codes[inside]
                low = (names_ & 0xFFFFFFFF).astype(np.uint64)
                for at in range(0, len(mine), AT_ONCE):
                    some = who[mine[at : at + AT_ONCE]]
                    d = np.maximum(quantiser.estimates(q[some], cell, codes_), np.float32(0))
                    rows, columns = np.nonzero(d <= bounds[some][:, None])
                    cuts = np.searchsorted(rows, np.arange(len(some) + 1))
                    for j in np.flatnonzero(np.diff(cuts)).tolist():
                        i, at_ = some[j], columns[cuts[j] : cuts[j + 1]]
                        key = np.concatenate([best[i], (d[j, at_].view(np.uint32).astype(np.uint64) << np.uint64(32)) | low[at_]])
                        top = np.argpartition(key, keep - 1)[:keep]
                        best[i], names[i] = key[top], np.concatenate([names[i], names_[at_]])[top]
                        last = best[i].max()
                        if last != NONE:  # ties of the last estimate still count, by identifier
                            bounds[i] = min(bounds[i], np.uint32(last >> np.uint64(32)).view(np.float32))
        who, place = np.nonzero(best != NONE)
        estimate = (best[who, place] >> np.uint64(32)).astype(np.uint32).view(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(names[who, place]), pa.array(estimate)], names=["query_id", "id", "estimate"])

    wanted = blocks.where(F.col("cell").isin([int(c) for c in asked])) if len(asked) < len(quantiser.cells) else blocks
    # an index is small for what a search computes over it, so that tasks are counted by pairs of a query and a vector
    pairs = (blocks.agg(F.sum("n")).first()[0] or 0) * len(ids) * quantiser.probes // len(quantiser.cells)
    tasks = min(TASKS, max(blocks.sparkSession.sparkContext.defaultParallelism, 1 + pairs // PAIRS))
    # tables are as large as some hundred vectors' estimates: a cell's blocks come to one task, in parts only if its vectors are many
    part = F.pmod(F.xxhash64("ids"), F.ceil(F.sum("n").over(Window.partitionBy("cell")) / F.lit(BLOCK)))
    wanted = wanted.withColumn("part", part).repartition(tasks, "cell", "part").sortWithinPartitions("cell").drop("part")
    with batches(blocks.sparkSession, 64):
        found = written(wanted.mapInArrow(run, "query_id long, id long, estimate float"), "vector-candidates")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("estimate", "id"))
    return found.withColumn("place", place).where(F.col("place") <= keep).select("query_id", "id")


def sample_bounds(spark: SparkSession, quantiser: Quantiser, q: np.ndarray, near: np.ndarray, labels: np.ndarray | None) -> np.ndarray:
    """Quantiser.bounds of all queries, AT_ONCE of them after the other in tasks."""
    n = -(-len(q) // AT_ONCE)
    shared = spark.sparkContext.broadcast((quantiser, q, near.astype(np.int32), labels))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, q, near, labels = shared.value
        for batch in parts:
            for i in batch.column(0).to_pylist():
                some = slice(i * AT_ONCE, (i + 1) * AT_ONCE)
                bound = quantiser.bounds(q[some], near[some], None if labels is None else labels[some])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([bound.tobytes()], pa.binary())], names=["id", "bound"])

    with batches(spark, 64):
        rows = spark.range(0, n, 1, min(n, TASKS)).mapInArrow(run, "id long, bound binary").collect()
    return np.concatenate([np.frombuffer(r["bound"], np.float32) for r in sorted(rows, key=lambda r: r["id"])])


def cell_runs(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """cell, identifiers, labels and codes of blocks sorted by cell, those of a cell together until they have BLOCK vectors."""
    held: list[dict] = []

    def joined() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        ids, labels, codes = (np.frombuffer(b"".join(r[c] for r in held), t) for c, t in (("ids", np.int64), ("labels", np.int32), ("codes", np.uint8)))
        return held[0]["cell"], ids, labels, codes.reshape(len(ids), -1)

    for batch in parts:
        for row in batch.to_pylist():
            if held and (row["cell"] != held[0]["cell"] or sum(r["n"] for r in held) >= BLOCK):
                yield joined()
                held = []
            held.append(row)
    if held:
        yield joined()


def first(dist: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (distance, name)."""
    edge = np.partition(dist, k - 1)[k - 1]
    near = np.flatnonzero(dist <= edge)
    return near[np.lexsort((name[near], dist[near]))[:k]]


def together(n: int, labels: np.ndarray | None, mark: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | slice]]:
    """Queries, and the stored vectors that count for them: all, or where queries have labels those of one label after the other."""
    if labels is None:
        yield np.arange(n), slice(None)
    for c in np.intersect1d(labels, mark) if labels is not None else ():
        yield np.flatnonzero(labels == c), np.flatnonzero(mark == c)


def closer(best: list[tuple[np.ndarray, np.ndarray]], who: np.ndarray, q: np.ndarray, x: np.ndarray, sizes: np.ndarray, stored: np.ndarray, k: int) -> None:
    """Take up in `best` what the queries `who` find among the vectors x. Distances by a product of matrices bound what can be among the k nearest;
    distances that count are sums of squared differences."""
    near = (q[who] ** 2).sum(1)[:, None] + sizes[None] - 2 * q[who] @ x.T
    bound = np.array([best[i][0].max() if len(best[i][0]) >= k else np.inf for i in who])
    if len(stored) > k:
        new = np.isinf(bound)
        bound[new] = np.partition(near[new], k - 1, axis=1)[:, k - 1]
    bound += 1e-9 * (1 + (q[who] ** 2).sum(1) + sizes.max())
    rows, columns = np.nonzero(~(near > bound[:, None]))  # what can't be compared is kept
    cuts = np.searchsorted(rows, np.arange(len(who) + 1))
    for j in np.flatnonzero(np.diff(cuts)).tolist():
        at = columns[cuts[j] : cuts[j + 1]]
        i = who[j]
        dist, name = np.r_[best[i][0], ((x[at] - q[i]) ** 2).sum(1)], np.r_[best[i][1], stored[at]]
        if len(dist) > k:
            top = first(dist, name, k)
            dist, name = dist[top], name[top]
        best[i] = dist, name


def query_blocks(queries: DataFrame, key: str, vector: str, label: str | None, most: int = QUERIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Identifiers, vectors and labels of the queries, in blocks that are small enough to be broadcast."""
    rows: list = []
    columns = [key, vector] + ([label] if label else [])

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        marks = np.array([-1 if r[label] is None else r[label] for r in rows], np.int32) if label else None
        return np.array([r[key] for r in rows], np.int64), np.array([r[vector] for r in rows], np.float32), marks

    for row in queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(*columns).toLocalIterator():
        rows.append(row)
        if len(rows) == most:
            yield block()
            rows = []
    if rows:
        yield block()


def search(store: DataFrame, blocks: DataFrame, quantiser: Quantiser, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str | None = None, most: int = QUERIES) -> DataFrame:
    """query_id, key, distance and rank (from 1) of the k nearest vectors of each query among its candidates, ties by
    identifier; label: a column whose value a result shares with its query. A query that is in the store finds itself."""
    parts = []
    for ids, q, labels in query_blocks(queries, key, vector, label, most):
        pairs = candidates(blocks, quantiser, ids, q, labels)
        near = pairs.join(store.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), "id")
        near = near.join(queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("q")), "query_id")
        parts.append(near.select("query_id", F.col("id").alias(key), squared_l2(F.col("v"), F.col("q")).alias("distance")))
    return ranked(queries, parts, k, key)


def ranked(queries: DataFrame, parts: list[DataFrame], k: int, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id", *by).orderBy("distance", key))
    if not parts:
        return queries.sparkSession.createDataFrame([], ", ".join(["query_id long", *(f"{c} int" for c in by), f"{key} long, distance double, rank int"]))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.withColumn("rank", place).where(F.col("rank") <= k)


def exact_search(store: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str | None = None, most: int = QUERIES, with_label: bool = False) -> DataFrame:
    """query_id, key, distance and rank of the k nearest vectors of each query in the whole store. Queries are broadcast in blocks
    of at most `most`, and each task keeps its own k nearest a query, so that a store of any size is read once a block and no
    label or vector that many rows share comes to one task. with_label: also the label, in which queries are then ranked."""
    rows = store.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("long"), (F.coalesce(F.col(label).cast("int"), F.lit(-1)) if label else F.lit(-1)).alias("label"), F.col(vector).cast("array<float>"))
    parts, n = [], rows.count()
    for ids, q, labels in query_blocks(queries, key, vector, label, most):
        # splits of a file may hold no row, so that a store is spread by pairs of a query and a vector however it is stored
        tasks = min(TASKS, max(store.sparkSession.sparkContext.defaultParallelism, 1 + n * len(ids) // EXACT_PAIRS))
        spread = rows.repartition(tasks)
        shared = store.sparkSession.sparkContext.broadcast((ids, q, labels))

        def run(batched: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, labels = shared.value
            q = q.astype(np.float64)
            best = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
            for batch in batched:
                if not batch.num_rows:
                    continue
                stored, mark = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                x = np.asarray(batch.column(2).flatten(), np.float32).reshape(batch.num_rows, -1).astype(np.float64)
                sizes = (x**2).sum(1)
                for who, some in together(len(ids), labels, mark):
                    for at in range(0, len(who), AT_ONCE):
                        closer(best, who[at : at + AT_ONCE], q, x[some], sizes[some], stored[some], k)
            for i, (dist, name) in enumerate(best):
                if len(dist):
                    own = np.full(len(dist), labels[i] if labels is not None else -1, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dist), ids[i])), pa.array(own), pa.array(name), pa.array(dist)], names=["query_id", "own", key, "distance"])

        with batches(store.sparkSession, 8192):
            found = written(spread.mapInArrow(run, f"query_id long, own int, {key} long, distance double"), "vector-nearest")
            parts.append(found.withColumnRenamed("own", label) if with_label else found.drop("own"))
    return ranked(queries, parts, k, key, (label,) if with_label else ())


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """n_queries and recall: the share of exact results that were found, over all queries."""
    hits = exact.join(found.select("query_id", key).withColumn("hit", F.lit(1)), ["query_id", key], "left")
    return hits.agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
