"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's shingles are its runs of five words, weighted by how often they occur. Every shingle is a Poisson process whose
rate is its weight; its arrivals fall on registers at random, and a register keeps the shingle of its first arrival. A
shingle's process ends as soon as its next arrival is later than all registers' first ones. Two texts agree on a register
with the probability Jaccard similarity of their weighted shingles.

Texts with equal words are one class from the start, so that copies cost nothing more. Of the distinct texts, those that
agree on a band share a bucket. First each text is verified against the partner it meets in most buckets, within a few
places of a bucket's order; links are closed to components. Then every bucket that still holds several components is
settled exactly: all its pairs of different components are compared, in blocks of bounded size, through the shingles they
have in common. No pair of a bucket goes unexamined but those that are already connected, and only links that join
components leave a task.

Edge cases: a text of fewer than five words, a null or an empty one is linked only to texts with equal words, texts without
any word only to equal ones; a null identifier has a null class; rows with one identifier are one document; the empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBERS_PER_BATCH, gram_hashes, hashed_words, in_worker, map_rows, mix, small_batches, split_at, text_bytes, text_groups, whole_number, word_digest, write_table
from .components import components

SHINGLE = 5
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Members of a mixed bucket that are compared with as many others in one task.
BLOCK = 256
#: Identifiers that may be broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    return np.unique(gram_hashes(hashed_words([text])[0], SHINGLE), return_counts=True)


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each weighted set, none of them empty."""
    size = np.array([len(s) for s, _ in sets], np.int64)
    item = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), size)
    first = np.full(len(sets) * registers, np.inf)
    held = np.zeros(len(sets) * registers, np.uint64)
    state, time = item.copy(), np.zeros(len(item))
    while len(item):
        with np.errstate(over="ignore"):
            state = mix(state + np.uint64(0xA0761D6478BD642F))
            at = owner * registers + (mix(state ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(registers)).astype(np.int64)
        time = time - np.log(uniform(state)) / weight
        early = np.flatnonzero(time < first[at])
        np.minimum.at(first, at[early], time[early])
        won = early[first[at[early]] == time[early]]
        held[at[won]] = item[won]
        some = np.unique(owner)
        latest = np.zeros(len(sets))
        latest[some] = first.reshape(-1, registers)[some].max(1)
        live = np.flatnonzero(time < latest[owner])
        item, weight, owner, state, time = item[live], weight[live], owner[live], state[live], time[live]
    return held.reshape(-1, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row, different between bands."""
    out = np.empty((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(signature), b + 1, np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * ROWS + j])
            out[:, b] = key
    return out.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The sum over common items of 1 / sum over items j of max(a_j / a_i, b_j / b_i)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = a[1].astype(np.float64), b[1].astype(np.float64)
    ca, cb = wa[ia], wb[ib]
    rest_a, rest_b = wa.sum() - ca.sum(), wb.sum() - cb.sum()
    total, ratio = 0.0, ca / cb
    for r in np.unique(ratio):
        total += ca[ratio == r].sum() / (np.maximum(ca, r * cb).sum() + rest_a + r * rest_b)
    return float(total)


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest of the words, and band keys (none for fewer than five words); written to the shared folder."""
    df = text_bytes(docs.where(F.col(key).isNotNull()).select(whole_number(docs, key).alias("key"), F.col(text).alias("text")))

    def make():
        def step(batch: dict[str, list]) -> dict[str, list]:
            digests: list[bytes] = []
            bands: list[list[int]] = [[] for _ in batch["text"]]
            for i, j in text_groups(batch["text"]):
                h, counts = hashed_words(batch["text"][i:j])
                sets, at = [], []
                for k, own in enumerate(split_at(h, counts), i):
                    digests.append(word_digest(own, batch["text"][k]))
                    if len(own) >= SHINGLE:
                        at.append(k)
                        sets.append(np.unique(gram_hashes(own, SHINGLE), return_counts=True))
                for k, keys in zip(at, band_keys(signatures(sets)).tolist() if sets else [], strict=True):
                    bands[k] = keys
            return {"key": batch["key"], "digest": digests, "bands": bands}

        return step

    return write_table(map_rows(df, make, "key long, digest binary, bands array<long>"), "probminhash")


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is among ids (column key, distinct), or with left_anti isn't: by broadcast up to a checked number of
    ids, else by shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, "key", how)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough."""
    a = texts.select(F.col("key").alias("u"), F.col("text").alias("a"))
    b = texts.select(F.col("key").alias("v"), F.col("text").alias("b"))

    def make():
        def step(batch: dict[str, list]) -> dict[str, list]:
            rows = zip(batch["u"], batch["v"], batch["a"], batch["b"], strict=True)
            good = [(u, v) for u, v, x, y in rows if probability_jaccard(shingles(x), shingles(y)) >= threshold]
            return {"u": [u for u, _ in good], "v": [v for _, v in good]}

        return step

    return map_rows(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), make, "u long, v long").distinct()


def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, key, p0 (the first key of the bucket here), p1 and p2 (the one and two keys before) of sorted rows (bucket, key).
    A bucket of one key is left out, but for the first and the last bucket here, which may go on in another task."""
    b, k = np.empty(0, np.int64), np.empty(0, np.int64)
    seen, first_bucket, opened, opener = 0, None, None, 0  # rows that were given out, and the open bucket with its first key

    def rows(upto: int, end: bool) -> pa.RecordBatch:
        same1 = np.r_[False, b[1:] == b[:-1]]
        same2 = np.r_[[False] * min(2, len(b)), b[2:] == b[:-2]] & same1
        begin = np.maximum.accumulate(np.where(~same1, np.arange(len(b)), 0))
        p0 = np.where((begin == 0) & (b == opened), opener, k[begin]) if opened is not None else k[begin]
        edge = (b == first_bucket) | (b == b[-1] if end else False)
        use = np.flatnonzero((same1 | np.r_[same1[1:], False] | edge) & (np.arange(len(b)) >= seen) & (np.arange(len(b)) < upto))
        previous = lambda n, ok: pa.array(k[np.maximum(use - n, 0)], pa.int64(), mask=~ok[use])
        columns = [pa.array(b[use]), pa.array(k[use]), pa.array(p0[use]), previous(1, same1), previous(2, same2)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "p0", "p1", "p2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        b, k = (np.concatenate([x, np.asarray(c)]) for x, c in zip((b, k), batch.columns, strict=True))
        first_bucket = int(b[0]) if first_bucket is None else first_bucket
        # the last row waits for the next one
        yield rows(len(b) - 1, False)
        start = int(np.searchsorted(b, b[-1]))
        if start or opened != int(b[-1]):
            opened, opener = int(b[-1]), int(k[start])
        kept = max(0, len(b) - 3)
        b, k, seen = b[kept:], k[kept:], len(b) - 1 - kept
    if len(b):
        yield rows(len(b), True)


def groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of rows whose first n_keys columns agree, from sorted batches."""
    now: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and row[:n_keys] != now[-1][:n_keys]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def settle(members: list[tuple[int, int, int, bytes]], across: bool, threshold: float) -> list[tuple[int, int]]:
    """Links that join different components among members (id, component, block, text); if across, only between blocks."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    if len({m[1] for m in members}) < 2:
        return []
    sets = [shingles(t) for _, _, _, t in members]
    size = np.array([len(s) for s, _ in sets])
    item = np.concatenate([s for s, _ in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    out = []
    for i, (s, weight) in enumerate(sets):
        low, high = np.searchsorted(item, s, "left"), np.searchsorted(item, s, "right")
        width = high - low
        at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        # the similarity is the chance that a coupling of both weight distributions agrees, so at most the share in common
        common = np.bincount(owner[at], np.repeat(weight / weight.sum(), width), minlength=len(sets))
        near = np.flatnonzero(common >= threshold - 1e-9)
        for j in near[near > i].tolist():
            if across and members[i][2] == members[j][2]:
                continue
            a, b = root(members[i][1]), root(members[j][1])
            if a != b and probability_jaccard(sets[i], sets[j]) >= threshold:
                parent[max(a, b)] = min(a, b)
                out.append((members[i][0], members[j][0]))
    return out


def mixed_links(buckets: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between components within buckets that hold several."""
    known = buckets.select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("component", F.coalesce("component", "key"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    mixed = write_table(mixed.where("lo < hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    rows = known.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("key", "bucket"), "blocks").cast("int"))
    # a block meets every block of its bucket, itself included
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "component", "block")
    rows = rows.join(texts, "key").select("bucket", "i", "j", "key", "component", "block", "text")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for group in groups(batches, 3):
            across = group[0][1] != group[0][2]
            for a, b in settle([g[3:] for g in group], across, threshold):
                u.append(a)
                v.append(b)
            if len(u) > 4096:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.mapInArrow(in_worker(run), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: key, class_id (the least identifier of its class) and copy_of (the least identifier
    with equal words). The representative of a class is the row whose key is class_id."""
    small_batches(docs.sparkSession)
    described = describe(docs, key, text)
    firsts = described.groupBy("digest").agg(F.min("key").alias("copy_of"), F.max("key").alias("last")).where("copy_of < last")
    # both sides of the join are plain tables, so that adaptive execution can split a text with many copies
    firsts = write_table(firsts.select("digest", "copy_of"), "copied")
    copies = described.select("key", "digest").join(firsts, "digest", "left").select("key", F.coalesce("copy_of", "key").alias("copy_of"))
    copies = write_table(copies.distinct(), "copies")
    # several texts may share an identifier: it is one document, and its texts' groups are one
    own = copies.groupBy("key").agg(F.min("copy_of").alias("copy_of"), F.max("copy_of").alias("other"))
    distinct = described.join(copies.where("key = copy_of").select("key").distinct(), "key", "left_semi")

    follow = F.concat(F.slice("bands", 2, BANDS), F.slice("bands", 1, 1))
    banded = distinct.where(F.size("bands") > 0).select("key", F.explode(F.arrays_zip(F.col("bands"), follow.alias("after"))).alias("z"))
    banded = banded.select("key", F.col("z.bands").alias("bucket"), F.col("z.after").alias("after"))
    # by range, so that a bucket of many texts is spread over several tasks
    banded = banded.repartitionByRange("bucket", "after", "key").sortWithinPartitions("bucket", "after", "key")
    buckets = write_table(banded.select("bucket", "key").mapInArrow(in_worker(neighbours), "bucket long, key long, p0 long, p1 long, p2 long"), "buckets", batch=NUMBERS_PER_BATCH)
    involved = buckets.select("key").distinct()
    texts = text_bytes(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))).where("key is not null")
    texts = write_table(only(texts, involved), "texts")

    met = buckets.select("key", F.explode(F.array_distinct(F.array_compact(F.array("p0", "p1", "p2")))).alias("p")).where("p <> key")
    met = met.groupBy(F.least("key", "p").alias("u"), F.greatest("key", "p").alias("v")).count()
    both = met.unionByName(met.select(F.col("v").alias("u"), F.col("u").alias("v"), "count"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("v"))
    pairs = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    links = write_table(verified(pairs, texts, threshold), "links")
    labels = components(links)
    more = write_table(mixed_links(buckets, labels, texts, threshold), "links")
    bridges = own.where("copy_of < other").select(F.col("copy_of").alias("u"), F.col("other").alias("v"))
    labels = components(links.unionByName(more).unionByName(bridges))

    classes = own.join(labels, F.col("copy_of") == F.col("node"), "left")
    classes = classes.select("key", F.coalesce("component", "copy_of").alias("class_id"), "copy_of")
    out = docs.select(F.col(key).cast("long").alias("key")).join(classes, "key", "left")
    return out.select(F.col("key").alias(key), "class_id", "copy_of")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """docs without the rows that another document of their class stands for; rows without an identifier stay, and rows with
    one identifier stay or go together."""
    found = near_duplicates(docs.select(key, text), key, text, threshold)
    gone = found.where((F.col("class_id") != F.col(key))).select(F.col(key).alias("key")).distinct()
    gone = write_table(gone, "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[key] == gone["key"], "left_anti")
