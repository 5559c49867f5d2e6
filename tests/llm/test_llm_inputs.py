"""Inputs that broke operators or would make them slow: neighbours in a batch, long runs, repeats, clashing names, bounds."""

import itertools
import os
import random
import re
import time
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.llm import common, decontamination, flac, holders, kin, learning, packing, passages, probminhash, quality, secret_scan, toxicity, urlfilter
from sievewright.llm import queries as Q

from .test_llm_operators import empty, insult, labelled, odd_documents, payload, text

# --- workers --------------------------------------------------------------------------------------------------------------


def test_workers_remember_for_one_operator_only(monkeypatch):
    gone = []
    monkeypatch.setattr(common, "REMEMBERED", [lambda: gone.append(1)])
    monkeypatch.setattr(common, "_OWNER", [])
    one, other = (common.in_worker(lambda batches: iter(batches), name) for name in ("one", "other"))
    assert list(one([1, 2])) == [1, 2] and list(one([])) == [] and len(gone) == 1
    assert list(other([3])) == [3] and len(gone) == 2
    assert list(one([4])) == [4] and len(gone) == 3


# --- words ------------------------------------------------------------------------------------------------------------


def test_hashed_words_are_those_of_words():
    texts = ["a b", None, "", "  x", "É é ab1!c", "!!", "z", "a" * 5000]
    raw = [None if t is None else t.encode() for t in texts]
    h, counts = common.hashed_words(raw)
    lists = [common.words(t) for t in raw]
    assert counts.tolist() == list(map(len, lists))
    by_word = {}
    assert all(by_word.setdefault(w, x) == x for w, x in zip([w for ws in lists for w in ws], h.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)
    assert [len(x) for x in common.split_at(h, counts)] == counts.tolist()
    assert list(common.text_groups([b"x" * n for n in (5, 5, 20, 1)], 10)) == [(0, 2), (2, 3), (3, 4)]


def test_clusters_without_a_shared_folder_are_refused(monkeypatch):
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_identifiers_that_are_no_whole_numbers_are_refused(spark):
    df = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    for run in (probminhash.near_duplicates, passages.repeated_passages):
        with pytest.raises(TypeError, match="whole numbers"):
            run(df)


def test_further_columns_with_clashing_names_do_no_harm(spark):
    names = ("key", "raw", "score", "n_words", "runs", "items", "spans", "u", "v", "p", "digest", "bucket", "near", "media", "ids", "doc")
    plain = odd_documents(spark).drop("key").dropDuplicates(["doc_id"])
    wide = plain
    for n in names:
        wide = wide.selectExpr("*", f"'clash' AS {n}")
    path = public_tokenizers.path(Q.BYTE_VOCABULARY)
    model = toxicity.train(labelled(60, insult), epochs=1)
    runs = {
        "near": lambda d: probminhash.near_duplicates(d), "kept": lambda d: probminhash.representatives(d).select("doc_id", "text"),
        "passages": lambda d: passages.repeated_passages(d), "flac": lambda d: flac.digests(flac.store_texts(d)),
        "packed": lambda d: packing.pack(d, path).select("doc_id", "doc_tokens"), "score": lambda d: toxicity.with_scores(d, model).select("doc_id", "score"),
        "hits": lambda d: decontamination.contamination(d, spark.createDataFrame([("i", text(80, 2))], "item_id string, text string")).select("doc_id", "n_words", "runs", "items"),
        "secrets": lambda d: secret_scan.scan_secrets(d, public_tokenizers.path(Q.BYTE_RANKS), public_tokenizers.PATTERN),
    }
    for name, run in runs.items():
        a, b = run(plain), run(wide)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name


# --- op1 and op3 ------------------------------------------------------------------------------------------------------


def test_scores_do_not_depend_on_the_batch():
    r = random.Random(4)
    texts = [t for _, t, _ in labelled(40, insult)] + [b"", b"x", b"y" * 59, b"y" * 60, b"z" * 300, "é".encode() * 200]
    for model in (quality.train([(i, t, 1 - y) for i, t, y in labelled(60, insult)], epochs=1), toxicity.train(labelled(60, insult), epochs=1)):
        run = model.scorer()
        alone = [run([t])[0] for t in texts]
        for _ in range(20):
            some = [r.randrange(len(texts)) for _ in range(r.randrange(1, 30))]
            assert run([texts[i] for i in some]).tolist() == [alone[i] for i in some]


def test_quality_network_equals_brute_force():
    model = quality.train([(i, t, 1 - y) for i, t, y in labelled(60, insult)], epochs=1)
    p, texts = model.params, [b"", b"a", b"some words here", text(70, 5).encode(), text(300, 6).encode()]
    fast = model.logits(texts, model.taps())
    for t, z in zip(texts, fast, strict=True):
        size = -(-(len(t) + quality.PAD) // quality.SEGMENT) * quality.SEGMENT
        raw = bytes(quality.PAD) + t + bytes(size - len(t))
        x = np.array([p["e"][b] if b else np.zeros(quality.DIM) for b in raw])
        y = np.array([sum(x[i + j] @ p["w"][j] for j in range(quality.WIDTH)) for i in range(size)])
        chunk, stride = quality.CHUNK * quality.SEGMENT, quality.STRIDE * quality.SEGMENT
        begins = [0, *range(stride, size - chunk + stride, stride)] if size > chunk else [0]
        hidden = [np.maximum(np.maximum(y[b : b + chunk].max(0) + p["b"], 0) @ p["h"] + p["hb"], 0) for b in begins]
        assert np.isclose(np.r_[np.max(hidden, axis=0), np.mean(hidden, axis=0)] @ p["v"] + p["c"], z, atol=1e-3)


def test_samples_are_bounded_and_take_the_first_text_of_an_identifier(spark):
    rows = [(i, f"{c} {'x' * 90}") for i in range(50) for c in "ba"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    everything = lambda k: k.isNotNull()
    got = learning.labelled_sample(docs, labels, "quality", everything)
    assert got == [(i, f"a {'x' * 90}".encode(), i % 2) for i in range(50)]
    assert len(learning.labelled_sample(docs, labels, "quality", everything, rows=10)) == 10
    few = learning.labelled_sample(docs, labels, "quality", everything, size=1000)
    assert len(few) == 10 and set(few) < set(got)


# --- op4 --------------------------------------------------------------------------------------------------------------


def test_digests_come_from_blocks_of_any_size(spark):
    stored = flac.store_texts(odd_documents(spark))
    one, many = (sorted(map(tuple, flac.digests(stored, samples=n).drop("n_blocks").collect())) for n in (1 << 20, 192))
    assert one == many
    blocks = {r.doc_id: r.n_blocks for r in flac.digests(stored, samples=192).collect()}
    assert blocks[3] == 1 and blocks[4] == len(payload(text(5000, 1).encode())) // 192


# --- op5 --------------------------------------------------------------------------------------------------------------


def test_fixed_patterns_equal_a_plain_run_on_random_texts():
    r = random.Random(8)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API", "_", "key", "AKIA", "akia", "Q" * 12, "abcdef0123", "ABC123", '"', "'", " ", "  ", ":", "=", "\n", "é", "ſ", "K", "x-y/z.+"]
    kinds = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    }
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        want = sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(kinds.values()) for m in p.finditer(t) if good(m))
        assert secret_scan.base_spans(t) == want, t


def test_secrets_take_linear_time():
    enc = secret_scan.vocabulary(public_tokenizers.path(Q.BYTE_RANKS), public_tokenizers.PATTERN)
    r = random.Random(1)
    for t in ("a" * 10000 + "12345", "Abcd" * 2500 + "12345", "A" * 10000 + "bb1", "".join(r.choice("abcABC012") for _ in range(10000)), "token=abcdefgh1 " * 600):
        began = time.process_time()
        secret_scan.random_spans(t, secret_scan.base_spans(t), enc, 2.0)
        assert time.process_time() - began < 0.1


# --- op6 --------------------------------------------------------------------------------------------------------------


def test_contamination_with_null_items_repeated_words_and_long_items(spark):
    items = [(None, text(12, 1)), (None, text(12, 2)), ("b", text(12, 1)), ("run", "of " * 25), ("long", text(90, 3)), ("nothing", None)]
    docs = [(1, text(12, 1) + " x"), (2, "of " * 200), (3, text(90, 3)), (4, "clean words"), (5, text(12, 2))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (4_000_000, 20):
        got = {r.doc_id: (sum(x.end - x.start for x in r.runs), r["items"]) for r in decontamination.contamination(df, bench, block_words=size).collect()}
        assert got == {1: (12, ["", "b"]), 2: (200, ["run"]), 3: (90, ["long"]), 4: (0, []), 5: (12, [""])}
    block = decontamination.Block([("x", common.hashed_words([b"a " * 30000])[0])])
    began = time.process_time()
    hit, found = block.hits(common.hashed_words([b"a " * 100000])[0])
    assert hit.all() and found == {"x"} and time.process_time() - began < 2


# --- op8 --------------------------------------------------------------------------------------------------------------


def batches_of(r, rows, names):
    at = 0
    while at < len(rows):
        n = r.randrange(1, 8)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[at : at + n]], t) for i, t in enumerate(names.values())], list(names))
        at += n


def test_every_place_of_a_shared_hash_is_met_whatever_the_batches():
    r = random.Random(2)
    names = {"h": pa.int64(), "doc": pa.int64(), "p": pa.int32()}
    for _ in range(200):
        rows = sorted({(r.randrange(r.choice([2, 5, 30])), r.randrange(6), r.randrange(8)) for _ in range(r.randrange(60))})
        h, doc, p = (np.array([x[i] for x in rows], np.int64) for i in range(3))
        whole = list(zip(*(c.tolist() for c in holders.meet(h, doc, p)), strict=True))
        assert sorted(tuple(x.values()) for b in holders.stream(batches_of(r, rows, names), True) for x in b.to_pylist()) == sorted(whole)
        for at, d, place in rows:
            if len({y for x, y, _ in rows if x == at}) > 1:
                assert any(u != v and (d, place) in ((u, a), (v, b)) for u, v, a, b, _ in whole)


def test_hot_hashes_are_thinned_and_still_met():
    h, doc, p = (np.array(x, np.int64) for x in zip(*[(8, d, 3) for d in range(40)] + [(16, 5, 7), (16, 6, 9)], strict=True))
    on, near = holders.thin(h, doc, p)
    assert sorted(zip(h[on].tolist(), doc[on].tolist(), strict=True)) == [(8, 0), (16, 5), (16, 6)]
    assert {u for u, v in zip(near[0].tolist(), near[1].tolist(), strict=True) if u == v} == set(range(40))


def longest_common(a, b):
    best, row = 0, {}
    at = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    for w in a:
        row = {j: row.get(j - 1, 0) + 1 for j in at.get(w, ())}
        best = max(best, *row.values(), 0) if row else best
    return best


def test_documents_with_a_common_span_of_40_words_are_named_as_by_brute_force(spark):
    """Random documents that hold parts of passages, so that holders of a part stand between those of the whole."""
    r, docs = random.Random(12), {}
    lines = [[f"p{k}x{i}" for i in range(70)] for k in range(12)]
    for d in range(120):
        ws = []
        for _ in range(r.randrange(1, 4)):
            line, n = r.choice(lines), r.choice([20, 30, 38, 40, 45, 70])
            a = r.randrange(70 - n + 1)
            ws += [f"o{d}x{r.randrange(10**6)}" for _ in range(r.randrange(5, 30))] + line[a : a + n]
        docs[d] = ws
    want = {d for d in docs if any(e != d and docs[e] != docs[d] and longest_common(docs[d], docs[e]) >= 40 for e in docs)}
    rows = passages.repeated_passages(spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs.items()], "doc_id long, text string")).collect()
    got = {x.doc_id for x in rows}
    assert want <= got and len(want) > 60
    for x in rows:  # what is reported is there
        a, b = docs[x.doc_id][x.start : x.end], docs[x.other_doc_id][x.other_start : x.other_end]
        assert min(len(a), len(b)) >= 40 and len(set(a) & set(b)) >= 0.7 * max(len(a), len(b))


def test_fuzzy_passages_of_partial_holders_meet(spark):
    """A passage of 56 words that two documents hold with every tenth word replaced, while others hold its first or last 30 words."""
    r, docs, pairs = random.Random(13), {}, []
    for k in range(40):
        ws = [f"p{k}x{i}" for i in range(56)]
        other = [f"n{k}x{i}" if i % 10 == k % 10 else w for i, w in enumerate(ws)]
        ids = r.sample(range(1000 * k, 1000 * k + 900), 6)
        for d, part in zip(ids, (ws, other, ws[:30], ws[-30:], other[:30], other[-30:]), strict=True):
            docs[d] = " ".join([text(30, 7 * d, [f"a{d}x{i}" for i in range(99)]), *part, text(30, 7 * d + 1, [f"b{d}x{i}" for i in range(99)])])
        pairs.append({ids[0], ids[1]})
    rows = passages.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    found = {frozenset((x.doc_id, x.other_doc_id)) for x in rows}
    assert sum(frozenset(p) in found for p in pairs) >= 0.9 * len(pairs)


def test_fuzzy_passages_meet_though_others_stand_between_them_at_every_seed(spark):
    """Two documents hold a passage with every tenth word replaced; before and between them stand holders of 12 words each."""
    docs, pairs = {}, set()
    for k in range(12):
        ws = [f"p{k}x{i}" for i in range(60)]
        other = [f"n{k}x{i}" if i % 10 == 5 else w for i, w in enumerate(ws)]
        parts = [x[a : a + 12] for x in (ws, other) for a in range(0, 49, 6)]
        at = 1000 * k
        held = {at + 1 + i: x for i, x in enumerate(parts)} | {at + 101 + i: x for i, x in enumerate(parts)} | {at + 100: ws, at + 200: other}
        for d, x in held.items():
            docs[d] = " ".join([*(f"a{d}y{i}" for i in range(30)), *x, *(f"b{d}y{i}" for i in range(30))])
        pairs.add((at + 100, at + 200))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for n in (1, 5):
        rows = passages.repeated_passages(df.repartition(n, "doc_id")).collect()
        assert {(x.doc_id, x.other_doc_id) for x in rows if x.doc_id < x.other_doc_id} == pairs
        assert all(x.start == 30 and x.end == 90 for x in rows)


def test_pairs_without_room_for_a_passage_are_not_compared_and_dead_tables_go(spark, monkeypatch):
    """Documents hold 20 to 37 times one word, and nothing else that others have: no passage is there, and only words that are equal by chance of a byte make pairs."""
    pairs, write = [], kin.write_table

    def counted(df, name, **more):
        out = write(df, name, **more)
        if name == "kin":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(kin, "write_table", counted)
    docs = [(d, " ".join([*(f"a{d}y{i}" for i in range(50)), *["same"] * (20 + d % 18), *(f"b{d}y{i}" for i in range(50))])) for d in range(90)]
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert rows == [] and pairs[0] < len(docs)
    left = {x[:-33] for x in set(os.listdir(folder)) - before}
    assert not left & {"seeds", "seed-meets", "spans", "span-meets", "chained", "chains", "passage-texts", "open-places", "kin-texts"}


def test_no_pair_of_places_inside_a_passage_is_left_out():
    """Passages of 40 to 100 words with replaced, lost and added words, with few or many words in common around them."""
    r, n = random.Random(31), 0
    for k in range(400):
        few, rate = [f"w{i}" for i in range(r.choice((8, 60, 2000)))], r.choice((0.02, 0.1, 0.2, 0.27))
        ws = [r.choice(few) for _ in range(r.randint(40, 100))]
        other = [x for i, w in enumerate(ws) for x in (r.choice(([], [f"n{k}x{i}"], [f"n{k}x{i}"], [w, f"n{k}x{i}"])) if r.random() < rate else [w])]
        texts = [" ".join([*(f"{c}{i}" for i in range(r.randint(0, 200))), *x, *(f"{c}x{i}" for i in range(r.randint(0, 200)))]).encode() for c, x in (("a", ws), ("b", other))]
        words = [common.hashed_words([t])[0] for t in texts]
        seeds = [passages.Seeds().of(0, t) for t in texts]
        codes = [(h >> np.uint64(56)).astype(np.uint8).tobytes() for h in words]
        for chain in passages.all_chains(*seeds):
            segments = [tuple(chain[i : i + 3]) for i in range(0, len(chain), 3)]
            if passages.passages_of(*words, [chain], passages.MIN_WORDS, passages.IDENTITY):
                for p, q, _ in segments:
                    cuts = [([c[max(0, x - kin.SIDE) : x][::-1] for c, x in zip(codes, (p, q))]), ([c[x : x + kin.SIDE] for c, x in zip(codes, (p, q))])]
                    sides, one = tuple(kin.Sides(*kin.word_rows(c)) for c in cuts), np.zeros(1, np.int64)
                    assert kin.going_on(sides, one, one + 1)[1].all()
                    same, two = np.zeros(2, np.int64), np.arange(2)
                    assert any(len(kin.sharing(same, same > 0, same > 0, two, two, two, s.codes, s.size)) for s in sides)
                    n += 1
    assert n > 300


def test_words_in_another_order_leave_no_room_for_a_passage(spark, monkeypatch):
    """Documents hold 24 times one word and 16 times another, apart or in turn: enough words in common, but never in one order."""
    pairs, write = [], kin.write_table

    def counted(df, name, **more):
        out = write(df, name, **more)
        if name == "kin":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(kin, "write_table", counted)
    docs = [(d, " ".join([*(f"a{d}y{i}" for i in range(50)), *["same"] * 24, *[f"own{d}"] * (20 + d % 7), *["other"] * 16, *(f"b{d}y{i}" for i in range(50))])) for d in range(60)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert rows == [] and pairs[0] < 10 * len(docs)


def test_words_in_order_equal_recursion_and_keep_passages():
    r = random.Random(32)
    for k in range(60):
        n, few = r.randint(0, kin.SIDE), r.choice((3, 9, 200))
        a, b = (bytes(r.randrange(few) for _ in range(m)) for m in (n, r.randint(0, kin.SIDE)))
        side = kin.Sides(*kin.word_rows([a, b]))
        got = side.ordered(np.array([0]), np.array([1]))[0]
        row = [0] * (len(b) + 1)
        for i, w in enumerate(a):
            row = list(itertools.accumulate(zip(row, row[1:], b, strict=False), lambda best, x, w=w: max(best, x[1], x[0] + (w == x[2])), initial=0))
            assert got[i + 1] == row[-1]
    found = 0
    for k in range(200):
        ws = [f"w{r.randrange(60)}" for _ in range(r.randint(40, 100))]
        other = [x for i, w in enumerate(ws) for x in (r.choice(([], [f"n{k}x{i}"], [w, f"n{k}x{i}"])) if r.random() < 0.2 else [w])]
        texts = [" ".join([*(f"{c}{i}" for i in range(r.randint(0, 200))), *x, *(f"{c}x{i}" for i in range(r.randint(0, 200)))]).encode() for c, x in (("a", ws), ("b", other))]
        words = [common.hashed_words([t])[0] for t in texts]
        codes = [(h >> np.uint64(56)).astype(np.uint8).tobytes() for h in words]
        for chain in passages.all_chains(*(passages.Seeds().of(0, t) for t in texts)):
            if passages.passages_of(*words, [chain], passages.MIN_WORDS, passages.IDENTITY):
                for p, q in zip(chain[::3], chain[1::3], strict=True):
                    cuts = [([c[max(0, x - kin.SIDE) : x][::-1] for c, x in zip(codes, (p, q))]), ([c[x : x + kin.SIDE] for c, x in zip(codes, (p, q))])]
                    sides, one = tuple(kin.Sides(*kin.word_rows(c)) for c in cuts), np.zeros(1, np.int64)
                    size, good = kin.going_on(sides, one, one + 1)
                    assert good.all() and kin.in_order(sides, one, one + 1, size).all()
                    found += 1
    assert found > 150

# --- op9 --------------------------------------------------------------------------------------------------------------


def test_neighbours_of_buckets_whatever_the_batches():
    r = random.Random(3)
    for _ in range(200):
        b = sorted(r.randrange(1, r.choice([3, 8, 40])) for _ in range(r.randrange(40)))
        k = [r.randrange(1000) for _ in b]
        want = []
        for i, (x, key) in enumerate(zip(b, k, strict=True)):
            s = b.index(x)
            if b.count(x) > 1 or x in (b[0], b[-1]):
                want.append((x, key, k[s], k[i - 1] if i - 1 >= s else None, k[i - 2] if i - 2 >= s else None))
        batches = batches_of(r, list(zip(b, k, strict=True)), {"bucket": pa.int64(), "key": pa.int64()})
        assert [tuple(x.values()) for y in probminhash.neighbours(batches) for x in y.to_pylist()] == want


# --- op10 -------------------------------------------------------------------------------------------------------------


def test_long_urls_take_bounded_memory():
    automaton = urlfilter.Automaton(["**/ads/**", "**.exe"])
    strings = [b"/ads/" + b"x" * 3000, *[b"/y.exe", b"", b"/ads/"] * 40]
    whole = automaton.match(strings)
    assert (automaton.match(strings, room=100) == whole).all() and whole[0].tolist() == [True, False] and whole[1].tolist() == [False, True]


def test_masking_and_packing_leave_clashing_columns_alone(spark):
    names = ["spans", "start", "length", "kind", "key", "Window", "sequence_id"]
    docs = odd_documents(spark).drop("key")
    docs = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    masked = secret_scan.redact(docs, public_tokenizers.path(Q.BYTE_RANKS), public_tokenizers.PATTERN)
    assert masked.columns == docs.columns and masked.count() == 8
    assert {tuple(r[n] for n in names) for r in masked.collect()} == {tuple(range(len(names)))}
    pieces = packing.pack(docs, public_tokenizers.path(Q.BYTE_VOCABULARY))
    plain = packing.pack(docs.drop(*names), public_tokenizers.path(Q.BYTE_VOCABULARY))
    assert sorted(map(str, pieces.collect())) == sorted(map(str, plain.collect()))
    assert secret_scan.redact(empty(spark), public_tokenizers.path(Q.BYTE_RANKS), public_tokenizers.PATTERN).collect() == []
