"""Lexical search, language-model scores and token alignment against brute force, and with odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievewright.llm import alignment, lexical, ngrams
from sievewright.llm import queries as Q
from sievewright.llm.common import words

from .test_llm_operators import ODD, empty, odd_documents, text

FEW = [f"t{i}" for i in range(60)]


def brute_search(docs, items, k):
    """Rows (item, rank, doc, score) by the formula, document by document."""
    counts = [(i, collections.Counter(words(t.encode() if t is not None else None))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, size = len(counts), sum(sum(c.values()) for _, c in counts)
    held = collections.Counter(w for _, c in counts for w in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t.encode() if t is not None else None))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // size
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms if c[w])
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("postings, stretch, block", [(10**6, 4096, 10**6), (300, 16, 40)])
def test_search_equals_brute_force(spark, monkeypatch, postings, stretch, block):
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical.wand, "__defaults__", (stretch,))
    r = random.Random(5)
    docs = [(i, text(r.randint(0, 90), i, FEW[: r.randint(5, 60)])) for i in range(300)]
    docs += [(1000 + i, docs[i % 40][1]) for i in range(120)]  # equal scores
    items = [(i, text(r.randint(1, 12), 500 + i, FEW)) for i in range(12)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), 7, block_terms=block)
    assert sorted(map(tuple, got.collect())) == brute_search(docs, items, 7)


def test_search_odd_rows(spark):
    items = spark.createDataFrame([(1, "one"), (1, "two"), (2, None), (3, ""), (4, "absent"), (None, "two one")], "item_id long, text string")
    docs = odd_documents(spark, [(None, "Two", "en", "a", 1, "x")]).withColumn("score", F.col("n_chars"))
    got = lexical.search(docs, items).collect()
    assert sorted((r.item_id or 0, r["rank"], r.doc_id) for r in got) == [(0, 1, 7), (0, 2, None), (1, 1, 7), (1, 2, None)]
    repeated = lexical.search(docs, spark.createDataFrame([(9, text(80, 2))], "item_id long, text string")).collect()
    assert [r.doc_id for r in sorted(repeated, key=lambda r: r["rank"]) if r.doc_id != 4][:3] == [1, 5, 5]
    assert lexical.search(empty(spark), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


def test_wand_scores_pivots_only():
    r = np.random.default_rng(1)
    rare, common = np.sort(r.choice(20_000, 60, replace=False)), np.arange(20_000)
    lists = [(900, rare, np.full(60, 900)), (10, common, np.full(20_000, 10))]
    heap = lexical.Heap(50)
    scored = lexical.wand(np.arange(20_000), lists, heap, 256)
    assert set(heap.ids) <= set(rare) and set(heap.scores) == {910} and scored < 18_000


# --- alignment --------------------------------------------------------------------------------------------------------

A, B = public_tokenizers.path(Q.BYTE_VOCABULARY), public_tokenizers.path(Q.PIECE_MODEL)


def brute_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of whole texts, by walking through both tokens' ends."""
    both = alignment.Tokens(A, B)
    rows = []
    for t in texts:
        groups = []
        if t:
            a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
            raw = (" " + t).encode()
            if b"".join(both.a_bytes[i] for i in a) == raw == b"".join(both.b_bytes[i] for i in b):
                ends = lambda ids, size: np.cumsum([len(size[i]) for i in ids]).tolist()
                ea, eb = ends(a, both.a_bytes), ends(b, both.b_bytes)
                low = (0, 0)
                for cut in sorted(set(ea) & set(eb)):
                    high = (ea.index(cut) + 1, eb.index(cut) + 1)
                    groups.append((a[low[0] : high[0]], b[low[1] : high[1]]))
                    low = high
        rows.append(groups)
    held = collections.Counter(p for g in rows for p in {(x, y) for a, b in g for x in a for y in b})
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups in rows:
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == best[p[0]] for p in links),
            sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return out


def aligned_rows(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = alignment.align(docs, A, B)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("d")
    rows = alignment.weighed(alignment.write_aligned(found.select("doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "times")), **options).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.d) for r in rows]


@pytest.mark.parametrize("pairs", [1 << 20, 0])
def test_alignment_equals_brute_force_on_whole_texts(spark, pairs):
    r = random.Random(3)
    letters = "aeiouxyzß éÉ日本🙂ü'’1234.,;-_/<>|\n\t\r  ▁\x01 \x0b​  "
    texts = [*ODD, "a\nb\n\nc", "\n", " \n x", "x▁y z", "<s> </s> <unk> <0x0A>", "𝒳 𝒴 🙂 🙂🙂 é", "a\r\nb", "🙂 a 🙂\nb"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(150)]
    texts += [text(r.randint(1, 60), i) for i in range(30)] + ["the of the of and"] * 5 + [text(3000, 9)]
    assert aligned_rows(spark, texts, broadcast_pairs=pairs) == brute_alignment(texts)


def test_alignment_of_odd_rows(spark):
    docs = odd_documents(spark, [(None, "one two", "en", "a", 1, "x")]).withColumnRenamed("key", "Groups").withColumn("pairs", F.col("n_chars"))
    rows = alignment.weighed(alignment.write_aligned(alignment.align(docs, A, B))).collect()
    assert len(rows) == 9 and sum(r.doc_id is None for r in rows) == 1
    assert {r.doc_id for r in rows if not r.n_groups} == {2, 3}
    assert alignment.weighed(alignment.write_aligned(alignment.align(empty(spark), A, B))).collect() == []


# --- language model ---------------------------------------------------------------------------------------------------


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def token_list(t):
    return [*(t or "").encode().translate(ngrams.TOKEN_BYTES).split(b" "), None] if t else [None]


def brute_scores(docs):
    """(id, held, n, known, N, base, score) with exact bigram counts in place of the filter's."""
    lists = [(i, [w for w in token_list(t) if w != b""]) for i, t in docs]
    train = [ws for i, ws in lists if not held(i)]
    counts = collections.Counter(w for ws in train for w in ws)
    grams = collections.Counter(p for ws in train for p in zip(["<"] + ws[:-1], ws, strict=True))
    n, v = sum(counts.values()), len(counts)
    counts["<"] = len(train)
    middle = ngrams.level_counts()
    out = []
    for i, ws in lists:
        own = [(counts[w] + 1) / (n + v + 1) for w in ws]
        score = 0.0
        for before, w, p in zip(["<"] + ws[:-1], ws, own, strict=True):
            c = grams[(before, w)]
            c = min(middle[int(math.log2(c)) + 1] if c else 0, counts[before], counts[w])
            score += math.log10((c + ngrams.MASS * p) / (counts[before] + ngrams.MASS))
        out.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(map(math.log10, own)), score))
    return out


def lm_docs():
    r = random.Random(8)
    docs = [(i, text(r.randint(0, 80), i, FEW[: r.randint(3, 60)])) for i in range(200)]
    return docs + [(300, None), (301, ""), (302, " \t\n"), (303, "Ünï Ünï T1. \x0b t1. \x1c x"), (303, "t1 t2"), (None, "t1 t2 t3"), (304, text(4000, 3))]


@pytest.mark.parametrize("broadcast, part", [(1 << 27, 1 << 20), (0, 500)])
def test_scores_equal_exact_counts_but_for_false_positives(spark, monkeypatch, broadcast, part):
    monkeypatch.setattr(ngrams.part_bits, "__defaults__", (part,))
    docs = lm_docs()
    got = ngrams.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), broadcast_bytes=broadcast).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[2])
    got, want = sorted(map(tuple, got), key=order), sorted(brute_scores(docs), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    off = np.array([g[6] - w[6] for g, w in zip(got, want, strict=True)])
    assert (off > -1e-6).all() and off.sum() < 0.01 * -sum(w[6] for w in want)
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])


def test_both_ways_to_probe_give_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(ngrams.part_bits, "__defaults__", (500,))
    docs = spark.createDataFrame(lm_docs(), "doc_id long, text string")
    one, other = (sorted(map(repr, ngrams.score_texts(docs.repartition(p), broadcast_bytes=b).collect())) for p, b in ((2, 1 << 27), (5, 0)))
    strip = lambda rows: [r[: r.rindex("base_score")] for r in rows]
    assert strip(one) == strip(other)
    numbers = lambda rows: [float(r[r.rindex("=") + 1 : -1]) for r in rows]
    assert np.allclose(numbers(one), numbers(other))


def test_filter_never_forgets_and_seldom_invents():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 40, 20_000).astype(np.uint64))
    q = r.integers(1, 6, len(keys))
    bits = ngrams.filled(keys, q)
    found = ngrams.probed(keys, bits)
    assert (found >= q).all() and (found > q).mean() < 0.01
    assert (ngrams.probed(r.integers(1 << 40, 1 << 41, 50_000).astype(np.uint64), bits) > 0).mean() < 0.006


def test_scores_of_odd_rows(spark):
    docs = odd_documents(spark).withColumn("Score", F.col("n_chars")).withColumnRenamed("key", "held_out")
    rows = ngrams.score_texts(docs).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 5, 6, 7] and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert ngrams.score_texts(empty(spark)).collect() == []
    lone = next(i for i in range(100) if held(i))
    (row,) = ngrams.score_texts(spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).collect()
    assert (row.n_known, row.train_tokens, row.base_score, row.score) == (0, 0, 0.0, 0.0)
