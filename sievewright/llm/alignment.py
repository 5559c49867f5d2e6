"""Alignment of two tokenizers' tokens of a text by relations of Spark: exploded tokens, cumulative lengths, a join on ends.

Both vocabularies end a token before a single space or line feed between other characters: the byte-level one splits text there
before its merges, and no piece of the other one spans such a place (units_of states the rule, the tests hold it against whole
texts). A text is so a row of units, and a unit that recurs, in whatever document, has the same tokens and groups each time.
Units are aligned once each for the whole corpus, by tokens exploded with their places, cumulative lengths over a window,
an equi-join on unit and end (the cuts), running counts of cuts as groups, and the links inside a group. Documents then put
their units' groups one after the other, chunk by chunk (see chunks).

Left whole, a text without such places is one unit; nothing depends on units being short.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import batches_of, by_chunk, coded, gathered, runs, settings
from .common import REMEMBERED, in_worker, one_thread, whole_number, write_table
from .token_ids import byte_letters

#: Where a unit ends: before a space or line feed between two characters that are neither white space, control or format
#: characters, unassigned nor the mark that stands for a space in pieces.
UNIT_EDGE = r"(?<=[^\s\p{Z}\p{C}\x{2581}])(?=[ \n][^\s\p{Z}\p{C}\x{2581}])"
SPACE = "▁"
#: A pair of ids is a number of 31 bits: ids of the second vocabulary take the low bits.
LOW_BITS = 15
#: A token is a number, its id before its length in bytes in the low bits.
LENGTH_BITS = 12
#: Id pairs that are broadcast with their counts at most (24 bytes each); beyond, a shuffle join takes over.
BROADCAST_PAIRS = 1 << 20
#: Numbers the rows of a written alignment, as identifiers may repeat.
ROW = "_row"
#: Units of the documents that are put together at once; a longer document is alone.
UNITS_AT_ONCE = 200_000

#: Bytes of rows that are packed at once.
PACK_BYTES = 32 << 20

PACKED = "chunk long, size long, codes binary, text binary, n long"
PACKED_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
UNITS = "unit string, a array<int>, b array<int>"
ROLLED = "row long, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>"


class Tokens:
    """Ids and token bytes of units under a tokenizers file (a) and a sentencepiece model (b)."""

    def __init__(self, a: str, b: str) -> None:
        one_thread()
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = {c: n for n, c in byte_letters().items()}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i)) if all(c in letters for c in self.a.id_to_token(i)) else b"" for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) > 1 << (31 - LOW_BITS) or len(self.b_bytes) > 1 << LOW_BITS:
            raise ValueError("pairs of ids of more than 31 bits")
        if max(map(len, self.a_bytes + self.b_bytes)) >> LENGTH_BITS:
            raise ValueError(f"tokens of more than {LENGTH_BITS} bits of length")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units, each of which begins with a space or a line feed; the second tokenizer adds the space itself, and one before
        a line feed that goes again."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u.removeprefix(" ") for u in units], num_threads=1)
        return a, [ids if u[:1] == " " else ids[1:] for u, ids in zip(units, b, strict=True)]


@lru_cache(maxsize=1)
def tokens(a: str, b: str) -> Tokens:
    return Tokens(a, b)


REMEMBERED.append(tokens.cache_clear)


def units_of(text: F.Column) -> F.Column:
    """The units of a space and the text; none of null or empty text."""
    return F.when(F.length(text) > 0, F.split(F.concat(F.lit(" "), text), UNIT_EDGE)).otherwise(F.array().cast("array<string>"))


def encoded(units: DataFrame, a: str, b: str) -> DataFrame:
    """Tokens of distinct units, ids with byte lengths; those whose tokens' bytes differ from the unit have no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokens(a, b)
        for batch in batches:
            units = batch.column(0).to_pylist()
            kept = [
                (u, x, y)
                for u, x, y in zip(units, *both.encode(units), strict=True)
                if b"".join([both.a_bytes[i] for i in x]) == (raw := u.encode()) == b"".join([both.b_bytes[i] for i in y]) and raw
            ]
            sides = [pa.array([[(i << LENGTH_BITS) + len(size[i]) for i in k[side]] for k in kept], pa.list_(pa.int32())) for side, size in ((1, both.a_bytes), (2, both.b_bytes))]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), *sides], names=["unit", "a", "b"])

    return units.select("unit").mapInArrow(in_worker(run, "alignment.encoded"), UNITS)


def aligned(units: DataFrame) -> DataFrame:
    """unit, n_a, n_b, groups (array of group number, ids of a, ids of b) of units with their tokens.

    Plan with spark.sql.requireAllClusterKeysForCoPartition off: all steps then keep the partitioning by unit, and no exploded
    row is shuffled."""
    whole = Window.partitionBy("unit")

    dealt = units.repartition("unit").sortWithinPartitions("unit")

    def side(name: str) -> DataFrame:
        tokens = dealt.select("unit", F.posexplode(name).alias("place", "token"))
        end = F.sum(F.col("token").bitwiseAND((1 << LENGTH_BITS) - 1)).over(whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        return tokens.select("unit", end.alias("end"), F.shiftright("token", LENGTH_BITS).alias(name))

    def grouped(name: str, other: str) -> DataFrame:
        cuts = side(other).select("unit", "end", F.lit(1).alias("cut"))
        before = F.sum("cut").over(whole.orderBy("end").rowsBetween(Window.unboundedPreceding, -1))
        rows = side(name).join(cuts, ["unit", "end"], "left").withColumn("group", F.coalesce(before, F.lit(0)))
        return rows.groupBy("unit", "group").agg(ids(name))

    def ids(name: str) -> F.Column:
        return F.transform(F.sort_array(F.collect_list(F.struct("end", name))), lambda x: x[name]).alias(name)

    groups = grouped("a", "b").join(grouped("b", "a"), ["unit", "group"])
    return groups.groupBy("unit").agg(
        F.sum(F.size("a")).alias("n_a"), F.sum(F.size("b")).alias("n_b"), F.sort_array(F.collect_list(F.struct("group", "a", "b"))).alias("groups")
    )


def told(units: DataFrame) -> DataFrame:
    """Aligned units with their groups as text."""
    text = F.transform("groups", lambda g: F.concat(F.array_join(g["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(g["b"].cast("array<string>"), ",")))
    return units.select("unit", F.array_join(text, ";").alias("groups"))


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows chunk, code, groups as one row for many of a chunk: their codes, and their groups, null as empty, one to a line."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for chunk, parts in held.items():
            one = pa.Table.from_batches(parts)
            text = "\n".join(pc.fill_null(one["groups"], "").to_pylist()).encode()
            codes = np.asarray(one["code"]).astype(np.int32).tobytes()
            row = [[chunk], [len(text)], [pa.compress(codes, "zstd", asbytes=True)], [pa.compress(text, "zstd", asbytes=True)], [one.num_rows]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, PACKED_TYPES, strict=True)], names=["chunk", "size", "codes", "text", "n"])

    for batch in batches:
        chunk = np.asarray(batch.column(0))
        order = np.argsort(chunk, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(chunk[order])) + 1, len(order)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                held.setdefault(int(chunk[order[a]]), []).append(batch.take(pa.array(order[a:b])))
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield from rows()
            held, size = {}, 0
    yield from rows()


def numbers(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a text of digits and separators that ends in a separator, and the place of the separator after each."""
    raw = np.frombuffer(text, np.uint8)
    digit = (raw >= 48) & (raw < 58)
    ends = np.flatnonzero(digit[:-1] & ~digit[1:]) + 1
    starts = np.flatnonzero(np.r_[True, ~digit[:-1]] & digit)
    value, size = np.zeros(len(ends), np.int64), ends - starts
    for i in range(int(size.max(initial=0))):
        here = i < size
        value[here] = value[here] * 10 + raw[starts[here] + i] - 48
    return value, ends


def figures(lines: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n units' groups, one unit to a line: ids of a, ids of b and groups (a row each), and the links of each unit, one unit after the
    other, with how many each has. An empty line has none."""
    ids, ends = numbers(lines)
    raw = np.frombuffer(lines, np.uint8)
    after, unit = raw[ends], np.searchsorted(np.flatnonzero(raw == 10), ends)
    if not len(ids):
        return np.zeros((3, n), np.int64), np.empty(0, np.int32), np.zeros(n, np.int64)
    last = np.flatnonzero((after == 59) | (after == 10))  # the last id of each group, before ; or a line's end
    turn = np.flatnonzero(after == 124)  # the last id of a in each group, before |
    begins = np.r_[0, last[:-1] + 1]
    n_a, n_b, owner = turn - begins + 1, last - turn, unit[begins]
    totals = np.stack([np.bincount(owner, w, n).astype(np.int64) for w in (n_a, n_b, np.ones(len(last), np.int64))])
    left = gathered(begins, n_a)  # each id of a meets all of b in its group
    group = np.repeat(np.arange(len(last)), n_a)
    links = (np.repeat(ids[left], n_b[group]) << LOW_BITS) + ids[gathered(turn[group] + 1, n_b[group])]
    return totals, links.astype(np.int32), np.bincount(owner, n_a * n_b, n).astype(np.int64)


class Dictionary:
    """A chunk's units: their groups as text and their links, by code; units without groups are bad."""

    def __init__(self, parts: list[dict]) -> None:
        codes, texts, totals, links, sizes = [np.empty(0, np.int32)], [pa.array([], pa.large_string())], [np.zeros((3, 0), np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        while parts:
            p = parts.pop()
            lines = pa.decompress(p["text"], p["size"], "zstd", asbytes=True) if p["size"] else b""
            codes.append(np.frombuffer(pa.decompress(p["codes"], p["n"] * 4, "zstd", asbytes=True), np.int32))
            texts.append(pc.split_pattern(pa.array([lines.decode()], pa.large_string()), "\n").flatten())
            for held, new in zip((totals, links, sizes), figures(lines + b"\n", p["n"]), strict=True):
                held.append(new)
        order = np.argsort(np.concatenate(codes), kind="stable")
        sizes = np.concatenate(sizes)
        self.groups = pa.concat_arrays(texts).take(pa.array(order))
        self.bad = np.asarray(pc.equal(pc.binary_length(self.groups), 0))
        self.figures = np.concatenate(totals, 1)[:, order]
        self.links = np.concatenate(links)[gathered((np.cumsum(sizes) - sizes)[order], sizes[order])]
        self.sizes = sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def documents(self, rows: pa.Array, codes: list[bytes], sizes: np.ndarray) -> pa.RecordBatch:
        """What documents are made of, from their codes."""
        flat = np.frombuffer(b"".join(codes), np.int32)
        document = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.zeros(len(sizes), bool)
        bad[document[self.bad[flat]]] = True
        good = ~bad[document]
        flat, document = flat[good], document[good]
        sizes = np.where(bad, 0, sizes)
        totals = [np.bincount(document, f[flat], len(sizes)).astype(np.int64) for f in self.figures]
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), self.groups.take(pa.array(flat)))
        text = pc.binary_join(lists, pa.scalar(";", pa.large_string())).cast(pa.string())
        here, times = np.unique(document * len(self.sizes) + flat, return_counts=True)  # a document's distinct units
        unit = here % max(len(self.sizes), 1)
        n = self.sizes[unit]
        key = (np.repeat(here // max(len(self.sizes), 1), n) << 31) + self.links[gathered(self.starts[unit], n)]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], np.repeat(times, n)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        times = np.add.reduceat(weight, first) if len(first) else weight
        at = np.searchsorted(key[first] >> 31, np.arange(len(sizes) + 1)).astype(np.int32)
        pairs, times = (key[first] & ((1 << 31) - 1)).astype(np.int32), times.astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [rows, *(pa.array(t) for t in totals), text, pa.ListArray.from_arrays(pa.array(at), pa.array(pairs)), pa.ListArray.from_arrays(pa.array(at), pa.array(times))],
            names=["row", "n_a", "n_b", "n_groups", "groups", "pairs", "times"],
        )


def put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a stream of chunks (see by_chunk)."""
    parts: list[dict] = []
    dictionary = None
    for new, documents, rows in runs(batches):
        if new:
            parts, dictionary = [], None
        if not documents:
            parts += rows.select(["codes", "text", "size", "n"]).to_pylist()
            continue
        if dictionary is None:
            dictionary, parts = Dictionary(parts), []
        sizes = np.asarray(rows.column("size"))
        held = np.cumsum(sizes) // UNITS_AT_ONCE
        cuts = np.r_[0, np.flatnonzero(held[1:] != held[:-1]) + 1, rows.num_rows].tolist()
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            codes = [pa.decompress(c, 4 * n, "zstd", asbytes=True) if n else b"" for c, n in zip(rows.column("codes")[at:end].to_pylist(), sizes[at:end].tolist(), strict=True)]
            yield dictionary.documents(rows.column("row").slice(at, end - at), codes, sizes[at:end])


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """Each document's groups and links under the tokenizers file a and the sentencepiece model b. Columns: key, n_a, n_b, n_groups,
    groups (text `a1,a2|b1;a3|b2,b3`), pairs (distinct linked ids, see pair_ids) and times (how often each is linked).

    The tokens are those of a space and the text under a, of the text under b, which adds the space; strings of special tokens are
    plain text. Null and empty texts, and texts whose tokens' bytes under either aren't those of a space and the text, have no tokens:
    zeros, empty text and arrays. Long texts are whole, in one row. Rows that repeat an identifier, or have none, keep a row each. An
    empty table gives no rows. Columns beside the identifier and the text are not read, whatever their names. The result
    reads tables of the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(whole_number(docs, key).alias("row"), units_of(F.col("text")).alias("units"))
    with batches_of(spark, 512):
        chunks = write_table(coded(rows), "alignment-chunks", batch=512)
    dictionary = chunks.where("code is not null").select("chunk", "code", "unit")
    with batches_of(spark, 8192):
        distinct = write_table(encoded(dictionary.select("unit").distinct(), a, b), "alignment-units", batch=8192)
    known = told(aligned(distinct))
    found = dictionary.join(known, "unit", "left").select("chunk", "code", "groups").mapInArrow(in_worker(packed, "alignment.packed"), PACKED)
    stream = by_chunk(found.withColumn("code", F.lit(0)), chunks.where("code is null").select("chunk", "code", "row", "size", "codes"))
    rolled = stream.select("chunk", "code", "row", "size", "n", "codes", "text").mapInArrow(in_worker(put_together, "alignment.put_together"), ROLLED)
    return rolled.withColumnRenamed("row", key)


def pair_ids(pair: F.Column) -> tuple[F.Column, F.Column]:
    """The ids of a pair number."""
    return F.shiftright(pair, LOW_BITS), pair.bitwiseAND((1 << LOW_BITS) - 1)


def write_aligned(df: DataFrame) -> DataFrame:
    """Write what align gave, in the plan that keeps its partitioning by unit, with a number for each row (ROW)."""
    df = df.withColumn(ROW, F.monotonically_increasing_id())
    with settings(df.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}), batches_of(df.sparkSession, 4096):
        return write_table(df, "alignment", batch=4096)


def counted(table: DataFrame) -> DataFrame:
    """pair, held (documents that hold it linked) and best (whether that is the greatest of its id of a) over a written alignment."""
    held = table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held"))
    a, _ = pair_ids(F.col("pair"))
    return held.withColumn("best", F.col("held") == F.max("held").over(Window.partitionBy(a)))


def weighed(table: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """A written alignment with n_links, n_best (links whose pair's count is the greatest of its id of a) and count_sum (over links)
    in place of pairs and times."""
    pairs = write_table(counted(table), "alignment-pairs")
    few = pairs.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    kept = [c for c in table.columns if c not in ("pairs", "times", ROW)]
    links = table.select(ROW, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(ROW, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(F.broadcast(pairs) if few else pairs, "pair").groupBy(ROW).agg(
        F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return table.join(sums, ROW, "left").select(*kept, zero("n_links"), zero("n_best"), zero("count_sum"))
