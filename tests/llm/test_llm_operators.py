"""Every operator against a brute-force version, an exact round trip or held-out accuracy, and with odd inputs."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sievewright.llm import common, decontamination, flac, packing, passages, probminhash, quality, secret_scan, sstable, toxicity, urlfilter
from sievewright.llm import queries as Q
from sievewright.llm.common import words
from sievewright.llm.components import components
from sievewright.llm.token_ids import Encoder

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(400)]
ODD = [
    "", " ", "a  b", " lead", "trail ", "a\n b", "İstanbul ΣΑΣ e\u0301 x", "don't we'll 'S it's", "tab\tx \ty", "a \nb", "\u00a0x y",
    "x\x1cy z", "<|endoftext|> hi", "日本語 テスト 123", "1234 56.78-9", "ﬁ ﬂ ① ½ ²", "a\u2003b \u3000c", "µm ß ẞ ÿ Ÿ", "\x01a b \x01c",
    "a. ..b .", "'s 't don 's", None,
]


def text(n, seed, vocabulary=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(n))


def odd_documents(spark, extra=()):
    """Nulls, empty, long and repeated texts, repeated identifiers, and clashing extra columns."""
    long = text(5000, 1)
    rows = [
        (1, text(80, 2), "en", "a", 5, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "x"), (4, long, "en", "b", 9, "x"),
        (5, text(80, 2), "fr", "b", 5, "x"), (5, text(80, 2), "fr", "b", 5, "x"), (6, "!!! ???", "de", "c", 7, "x"), (7, "one two", "de", "c", 7, "x"), *extra,
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")


def empty(spark):
    return odd_documents(spark).limit(0)


# --- tokens -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", [Q.BYTE_VOCABULARY, Q.WORD_VOCABULARY])
def test_ids_equal_those_of_the_library(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [*ODD, *(text(40, i) + ", End. " + text(3, i) for i in range(20))]
    for _ in range(2):  # from memory the second time
        flat, at = Encoder(path).encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


# --- op1 and op3 ------------------------------------------------------------------------------------------------------


def labelled(n, bad, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = int(r.random() < 0.3)
        ws = text(60, 1000 + i).split()
        out.append((i, bad(ws, r) if y else " ".join(ws), y))
    return [(i, t.encode(), y) for i, t, y in out]


def insult(ws, r):
    ws[r.randrange(len(ws))] = r.choice(["foulone", "foultwo", "foulthree"])
    return " ".join(ws)


def test_toxicity_finds_held_out_documents():
    rows = labelled(600, insult)
    model = toxicity.train(rows[:400], epochs=4)
    z = model.scorer()([t for _, t, _ in rows[400:]])
    y = np.array([y for _, _, y in rows[400:]])
    assert ((z >= 0.5) == y).mean() > 0.95 and ((z >= 0) & (z <= 1)).all()


def test_toxicity_uses_text_alone_and_takes_odd_rows(spark):
    model = toxicity.train(labelled(200, insult), epochs=2)
    got = toxicity.score_toxicity(odd_documents(spark), model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 5)}) == 1
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.fit(odd_documents(spark), labels).prior is not None  # one class only


def test_toxicity_pooling_equals_brute_force():
    model = toxicity.train(labelled(120, insult), epochs=1)
    p, ws = model.params, [words(text(9, i).encode()) for i in range(3)] + [[], [b"a"]]
    fast = model.logits(ws, model.tables())
    ids, starts = toxicity.indexed(ws)
    for d, s in enumerate(starts):
        e = starts[d + 1] if d + 1 < len(starts) else ids.shape[1]
        x = np.hstack([toxicity.rows_of(p[t], row[s:e]) for t, row in zip(toxicity.TABLES, ids, strict=True)])
        h = []
        for w in toxicity.WIDTHS:
            y = [sum(x[i + j] @ p[f"w{w}"][j] for j in range(w)) + p[f"b{w}"] for i in range(len(x) - w + 1)]
            h.append(np.maximum(np.max(y, axis=0), 0))
        assert np.isclose(np.hstack(h) @ p["v"] + p["c"], fast[d], atol=1e-3)


def test_quality_finds_held_out_documents():
    rows = [(i, t, 1 - y) for i, t, y in labelled(300, lambda ws, r: " ".join(w + r.choice(["$$$", "###"]) for w in ws))]
    model = quality.train(rows[:220], epochs=4)
    z = model.scorer()([t for _, t, _ in rows[220:]])
    assert ((z >= 0.5) == np.array([y for _, _, y in rows[220:]])).mean() > 0.9


def test_quality_chunks_cover_every_byte():
    for n in (0, 1, 59, 60, 61, 252, 255, 256, 257, 5000):
        data, begin, end, first = quality.layout([b"x" * n, b"y"])
        mine = [(b, e) for b, e in zip(begin[: first[1]], end[: first[1]], strict=True)]
        assert mine[0][0] == 0 and all(b <= e0 for (_, e0), (b, _) in itertools.pairwise(mine))
        pad = quality.PAD
        assert mine[-1][1] * quality.SEGMENT >= pad + n and data[: pad + n].tobytes() == bytes(pad) + b"x" * n
        # zeros before and behind the next text
        at = mine[-1][1] * quality.SEGMENT
        assert data[at : at + pad + 1].tobytes() == bytes(pad) + b"y" and not data[-pad:].any()


def test_quality_takes_odd_rows(spark):
    model = quality.train([(i, t, 1 - y) for i, t, y in labelled(60, insult)], epochs=1)
    got = quality.score_quality(odd_documents(spark), model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty(spark), model).count() == 0


# --- op2 --------------------------------------------------------------------------------------------------------------


def check_packing(docs, rows, sequence=2048):
    path = public_tokenizers.path(Q.BYTE_VOCABULARY)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == sequence or s == len(by_sequence) - 1 and at <= sequence


def test_packing_keeps_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(docs.collect(), Q.op2_packing(spark, SF).collect())


def test_packing_odd_rows_and_targets(spark):
    path = public_tokenizers.path(Q.BYTE_VOCABULARY)
    docs = odd_documents(spark).dropDuplicates(["doc_id"])
    for targets in (None, {"a": 3, "b": 1}, {"a": 1}):
        rows = packing.pack(docs, path, targets=targets, sequence=64, window=256).collect()
        check_packing(docs.collect(), rows, 64)
    assert packing.pack(empty(spark), path).count() == 0


def test_schedule_is_a_round_robin_with_deficits():
    """The closed form against serving the queues round by round."""
    for totals, targets in (([1000, 300, 77], [1000, 300, 77]), ([500, 500, 500], [5, 3, 0]), ([10, 2000], [1, 1])):
        s = packing.Schedule(totals, targets, 100)
        assert s.served(0) == [0] * len(totals) and s.served(s.rounds) == totals
        for w in range(s.rounds):
            now, after = s.served(w), s.served(w + 1)
            assert all(a <= b for a, b in zip(now, after, strict=True))
            p = s.phase(w)
            if w + 1 < p.last:  # a whole window in proportion, fractions carried
                for i, t in enumerate(totals):
                    assert abs((after[i] - now[i]) - min(t, p.quantum[i] / p.den)) <= 1
        for i, t in enumerate(totals):
            for at in range(0, t, 7):
                w = s.round_of(i, at)
                assert s.served(w)[i] <= at < s.served(w + 1)[i]


# --- op4 --------------------------------------------------------------------------------------------------------------


def payload(t: bytes) -> bytes:
    return t + b" " * (max(1, -(-len(t) // 192)) * 192 - len(t))


def test_flac_round_trip_of_all_kinds():
    r = random.Random(3)
    raws = [
        b"", b"a" * 400, bytes(r.randrange(256) for _ in range(5000)), b"\xff\xf8\x10\x02" * 300, text(3000, 4).encode(),
        bytes(int(128 + 100 * np.sin(i / 30)) for i in range(9000)), bytes((i * i // 50) % 256 for i in range(30000)), bytes(range(192)) * 4,
    ]
    raws = [payload(x) for x in raws]
    streams = flac.encode(raws)
    kinds = np.zeros(4, int)
    for raw, stream, (info, x, k) in zip(raws, streams, flac.decode(streams), strict=True):
        assert (x.reshape(-1) + 128).astype(np.uint8).tobytes() == raw
        slow = [v + 128 for f in flac.decode_slowly(stream, info) for v in f[0]]
        assert bytes(slow) == raw
        assert flac.read_at(stream, len(raw) - 16, 16) == raw[-16:] and flac.read_at(stream, 100, 50) == raw[100:150]
        assert stream == flac.encode([raw])[0]  # whatever batch it is in
        kinds += k
    assert (kinds > 0).all()


def test_flac_damage_is_noticed():
    (stream,) = flac.encode([payload(text(300, 5).encode())])
    for at in (len(stream) // 2, len(stream) - 1, 30):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def stereo_stream(left, right):
    """A 16-bit stream with left/side decorrelation and verbatim subframes, written bit by bit."""
    bits = []
    put = lambda v, n: bits.extend((v >> (n - 1 - i)) & 1 for i in range(n))
    for v, n in ((0x7FFC, 15), (0, 1), (7, 4), (0, 4), (8, 4), (4, 3), (0, 1), (0, 8), (len(left) - 1, 16)):
        put(v, n)
    raw = np.packbits(bits)
    put(int(flac.crc_rows(raw[None], np.array([len(raw)]), flac.CRC8, 8)[0]), 8)
    put(2, 8)
    for v in left:
        put(v & 0xFFFF, 16)
    put(2, 8)
    for a, b in zip(left, right, strict=True):
        put((a - b) & 0x1FFFF, 17)
    bits.extend([0] * (-len(bits) % 8))
    raw = np.packbits(bits)
    body = raw.tobytes() + int(flac.crc_rows(raw[None], np.array([len(raw)]), flac.CRC16, 16)[0]).to_bytes(2, "big")
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | len(left)).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body


def test_flac_reads_stereo_and_writes_seekable_blocks(spark):
    r = random.Random(6)
    left, right = ([r.randrange(-30000, 30000) for _ in range(300)] for _ in "lr")
    df = spark.createDataFrame([(1, stereo_stream(left, right)), (2, None)], "doc_id long, media binary")
    rows = sorted(flac.pcm_blocks(df, samples=128).collect(), key=lambda r: r.block)
    assert [(r.sample_offset, r.n_samples, r.channels, r.bits) for r in rows] == [(0, 128, 2, 16), (128, 128, 2, 16), (256, 44, 2, 16)]
    got = np.frombuffer(b"".join(bytes(r.pcm) for r in rows), "<i2").reshape(-1, 2)
    assert got[:, 0].tolist() == left and got[:, 1].tolist() == right


def test_flac_query_gives_the_texts_digests(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: r for r in flac.digests(flac.store_texts(docs)).collect()}
    for d in docs.collect():
        raw = (d.text or "").encode()
        r, whole = got[d.doc_id], payload(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(whole))
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest() and r.tail_crc32 == zlib.crc32(whole[-16:])
    assert got[1].media_sha256 == got[5].media_sha256 and got[1].feature == got[5].feature
    assert flac.digests(flac.store_texts(empty(spark))).count() == 0


# --- op5 --------------------------------------------------------------------------------------------------------------

KEY = "xK9-vQz2LmP7wR4tYb8NcJ5h"


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secret_scan.scan_secrets(df, public_tokenizers.path(Q.BYTE_RANKS), public_tokenizers.PATTERN).collect()
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found}


def test_secret_patterns(spark):
    akia = "AKIA" + "Q" * 12
    texts = [
        "é password = 'abcdefgh1' x", "PassWord: short", f"x {akia} y", "AKIA123 no", "0" * 31 + " " + "0123456789abcdef" * 2, None, "",
        'api_key="abcd.efg-hij" apikey: zzzzzzzz', "ſecret=abcdefgh1", f"key {KEY} end", "digest " + "AB12" * 10,
        "123e4567-e89b-12d3-a456-426614174000", "some_long_identifier_name_2024", "password:token=abcdefgh",
    ]
    got = scan(spark, texts)
    assert got[0] == [("assign", 2, 23)]
    assert got[1] == [] and got[3] == [] and got[5] == [] and got[6] == [] and got[8] == []
    assert got[2] == [("access", 2, 18)] and got[4] == [("hex", 32, 64)]
    assert [k for k, _, _ in got[7]] == ["assign", "assign"]
    assert got[9] == [("random", 4, 4 + len(KEY))]
    assert got[10] == [] and got[11] == [] and got[12] == []
    assert got[13] == [("assign", 0, 23)]


def test_keys_of_one_case_and_of_letters_only_are_found(spark):
    r = random.Random(5)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [low + digits, up + digits, up + "234567", low, up, low + up]
    keys = ["".join(r.choice(a) for _ in range(n)) for a in alphabets for n in (24, 32, 40) for _ in range(20)]
    keys += ["3ax6xnjp29jd6fds4gc373sgvjxteol0", "x7f9q2m4k8z1p3w6r5t0"]
    names = ["some_long_identifier_name_2024", "getUserAccountByIdentifier", "file_2024_03_11_12_30_45", "path/to/some/file/name", "-" * 40, "2024-03-11-12-30-00-17"]
    got = scan(spark, [f"a {x} b" for x in keys + names])
    missed = [k for i, k in enumerate(keys) if got[i] != [("random", 2, 2 + len(k))]]
    assert len(missed) <= len(keys) // 50 and not set(keys[-2:]) & set(missed)
    assert all(got[len(keys) + i] == [] for i in range(len(names)))


def test_secrets_are_masked_and_clean_texts_left_alone(spark):
    df = odd_documents(spark, [(9, f"a password=abcdefgh1 b {KEY} c", "en", "a", 1, "x")])
    path = public_tokenizers.path(Q.BYTE_RANKS)
    out = secret_scan.redact(df, path, public_tokenizers.PATTERN)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(9) == "a [SECRET] b [SECRET] c"
    assert got == {r.doc_id: r.text for r in df.collect() if r.doc_id != 9}


# --- op6 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_words", [4_000_000, 60])
def test_contamination_equals_brute_force(spark, block_words):
    r = random.Random(7)
    few = WORDS[:6]  # words so frequent that windows meet by chance
    items = {f"i{k}": text(r.choice([1, 4, 9, 10, 11, 25]), 50 + k, few if k % 3 == 0 else WORDS) for k in range(12)}
    items |= {"empty": "", "copy": items["i1"], "marks": "?!"}
    docs = {}
    for d in range(60):
        ws = text(r.randrange(0, 80), 500 + d, few if d % 4 == 0 else WORDS).split()
        for k in r.sample(sorted(items), 2):
            part = items[k].split()
            a = r.randrange(len(part) + 1)
            ws[len(ws) // 2 : len(ws) // 2] = part[a : a + r.choice([5, 10, 30])] if d % 2 else part
        docs[d] = " ".join(ws).upper() if d % 5 == 0 else ", ".join(ws)
    df = spark.createDataFrame([*docs.items(), (98, None), (99, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), ("none", None)], "item_id string, text string")
    got = decontamination.contamination(df, bench, block_words=block_words)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "items"]
    rows = {r.doc_id: (r.n_words, sum(x.end - x.start for x in r.runs), r["items"]) for r in got.collect()}
    assert any(v[1] for v in rows.values())
    for d, t in [*docs.items(), (98, None), (99, "")]:
        assert rows[d] == decontamination.brute_force(t, items), d


def test_contamination_odd_inputs(spark):
    bench = spark.createDataFrame([("a", text(80, 2))], "item_id string, text string")
    rows = decontamination.contamination(odd_documents(spark), bench).collect()
    assert {r.doc_id for r in rows if r["items"]} == {1, 5} and len(rows) == 8
    assert all(not r["items"] for r in decontamination.contamination(odd_documents(spark), bench.limit(0)).collect())
    assert decontamination.contamination(empty(spark), bench).count() == 0


# --- op7 --------------------------------------------------------------------------------------------------------------


def test_shards_round_trip_and_lookup(spark):
    path = public_tokenizers.path(Q.WORD_VOCABULARY)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    docs = odd_documents(spark, [(-3, "below zero", "en", "a", 1, "x"), (None, "no key", "en", "a", 1, "x")])
    manifest = sstable.write_shards(docs, path)
    rows = sstable.read_shards(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, -3, 1, 2, 3, 4, 5, 5, 6, 7]
    texts, at = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in rows:
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r.n_tokens
    found = {}
    for shard in manifest.collect():
        reader = sstable.open_shard(shard.path)
        for k in (-3, 1, 5, 8, None):
            found.setdefault(k, []).extend(reader.get(sstable.key_bytes(k)))
    assert [len(found[k]) for k in (-3, 1, 5, 8, None)] == [1, 1, 2, 0, 1]
    assert sstable.read_shards(sstable.write_shards(empty(spark), path)).count() == 0


def test_shard_blocks_index_and_damage(tmp_path):
    with open(tmp_path / "x", "wb") as f:
        w = sstable.Writer(f)
        for i in range(20000):
            w.add(sstable.key_bytes(i * 3), bytes([i % 251] * 10))
        with pytest.raises(ValueError):
            w.add(sstable.key_bytes(0), b"")
        w.close()
    data = (tmp_path / "x").read_bytes()
    reader = sstable.Reader(lambda at, n: data[at : at + n], len(data))
    assert len(reader.blocks) > 3 and reader.n == 20000
    assert reader.get(sstable.key_bytes(3 * 777)) == [bytes([777 % 251] * 10)] and reader.get(sstable.key_bytes(4)) == []
    assert sum(reader.may_hold(sstable.key_bytes(i * 3 + 1)) for i in range(5000)) < 250
    bad = bytearray(data)
    bad[100] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(lambda at, n: bytes(bad[at : at + n]), len(bad)).scan())


# --- op8 --------------------------------------------------------------------------------------------------------------


def brute_chain(matches):
    """The best chain score by comparing all segments, under the same costs, for matches that are segments of their own."""
    ms = sorted(set(matches))
    best = {}
    for p, q in ms:
        value = passages.K
        for (a, b), v in best.items():
            gp, gq = p - a - passages.K, q - b - passages.K
            if gp >= 0 and gq >= 0 and max(gp, gq) <= passages.MAX_GAP:
                value = max(value, v + passages.K - passages.GAP_COST * (gp + gq) - passages.SKEW_COST * abs(gp - gq))
        best[p, q] = value
    return max(best.values())


def test_chains_follow_both_texts():
    matches = [(i * 20, i * 20 + (i % 3)) for i in range(8)] + [(30, 500), (90, 3)]
    best = passages.chains(matches)[0]
    assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in itertools.pairwise(best))
    assert len(best) == 8 and brute_chain(matches) > 30


def test_chains_take_the_best_predecessor_in_reach():
    r = random.Random(3)
    for _ in range(300):
        # places of their own and diagonals far apart, so that each match is a segment
        matches = [(i * 7 + r.randrange(2), r.randrange(300)) for i in range(30)]
        if len({q - p for p, q in matches}) == len(matches):
            best = passages.chains(matches)[0]
            value = sum(n for _, _, n in best)
            for (a, b, n), (p, q, _) in itertools.pairwise(best):
                value -= passages.GAP_COST * (p - a - n + q - b - n) + passages.SKEW_COST * abs(p - a - q + b)
            assert abs(value - brute_chain(matches)) < 1e-9


def test_a_far_passage_hides_no_near_one(spark):
    first, second = text(60, 41), text(50, 42)
    halves = second.split()
    docs = [" ".join([text(30, 50 + d, [f"a{d}x{i}" for i in range(99)]), first, text(100, 60 + d, [f"b{d}x{i}" for i in range(99)])]) for d in range(2)]
    docs[0] += " " + second
    docs[1] += " " + " ".join([*halves[:25], "added", *halves[25:]])
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == {(0, 30, 90), (0, 190, 240), (1, 30, 90), (1, 190, 241)}


def planted(n_clean=20, holders=12, size=70):
    passage = text(size, 900).split()
    docs, spans = {}, {}
    for d in range(n_clean):
        docs[d] = text(200, 2000 + d, [f"c{d}x{i}" for i in range(150)])
    for k in range(holders):
        d = 100 + k
        ws = text(120, 3000 + k, [f"h{d}x{i}" for i in range(150)]).split()
        p = list(passage)
        if k % 3 == 1:
            p[25] = f"other{k}"
        if k % 3 == 2:
            del p[40]
        at = 10 * k % 100
        docs[d] = " ".join(ws[:at] + p + ws[at:])
        spans[d] = (at, at + len(p))
    return docs, spans


def test_passages_are_found_and_clean_documents_left_alone(spark):
    docs, spans = planted()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == set(spans)
    for r in rows:
        s, e = spans[r.doc_id]
        assert abs(r.start - s) <= 2 and abs(r.end - e) <= 2, r
    assert {r.exact for r in rows} == {True, False}


def test_runs_of_one_word_are_passages(spark):
    texts = [text(30, 10 * d, [f"r{d}x{i}" for i in range(99)]) + " of" * (60 + d) + " " + text(30, 10 * d + 1, [f"s{d}x{i}" for i in range(99)]) for d in range(3)]
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2} and all(r.start >= 30 and r.end - r.start >= 40 for r in rows)


def test_passages_with_replaced_words_are_found(spark):
    r, docs = random.Random(9), {}
    for k in range(30):
        own = [text(60, 4000 + 4 * k + j, [f"k{k}j{j}x{i}" for i in range(99)]) for j in range(4)]
        ws, every = [f"p{k}x{i}" for i in range(60)], (6, 8, 10)[k % 3]
        first = r.randrange(every)
        other = [f"n{k}x{i}" if i % every == first else w for i, w in enumerate(ws)]
        docs[2 * k], docs[2 * k + 1] = " ".join([own[0], *ws, own[1]]), " ".join([own[2], *other, own[3]])
    rows = passages.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    # a share of .83 to .9 of the words is equal
    for every, least in ((0, 9), (1, 10), (2, 10)):
        found = {x.doc_id // 2 for x in rows if x.doc_id // 2 % 3 == every}
        assert len(found) >= least, (every, found)


def test_spans_of_frequent_parts_are_found(spark):
    own = iter([text(30, 5000 + d, [f"f{d}x{i}" for i in range(99)]) for d in range(40)])
    docs = {}
    for k in range(3):
        lines = [" ".join(f"l{k}{j}x{i}" for i in range(26)) for j in "ab"]
        for d, parts in enumerate([[lines[0]], [lines[1]], lines, lines, [lines[0]], [lines[1]]]):
            docs[10 * d + k] = " ".join([next(own), *parts, next(own)])
    rows = passages.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_doc_id, r.start, r.end) for r in rows} == {(20 + x + k, 30 - x + k, 30, 82) for k in range(3) for x in (0, 10)}


def test_passages_are_found_at_every_place_of_a_document(spark):
    own = [text(30, 70 + d, [f"o{d}x{i}" for i in range(99)]) for d in range(5)]
    passage, other = text(50, 78), text(50, 78).split()
    other[20] = "other"
    docs = [" ".join([own[0], passage, own[1], passage, own[2], *other]), " ".join([own[3], passage, own[4]])]
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end) for r in rows} == {(0, 30, 80), (0, 110, 160), (0, 190, 240), (1, 30, 80)}


def test_passages_of_copies_and_odd_rows(spark):
    docs = odd_documents(spark)
    rows = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_doc_id, r.start, r.end) for r in rows} == {(5, 1, 0, 80)}
    assert passages.repeated_passages(empty(spark)).count() == 0


# --- op9 --------------------------------------------------------------------------------------------------------------


def brute_classes(docs, threshold=0.8):
    sets = {d: probminhash.shingles((t or "").encode()) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(docs), 2):
        wa, wb = (words((docs[x] or "").encode()) for x in (a, b))
        same = wa == wb if wa or wb else (docs[a] or "") == (docs[b] or "")
        if same or len(sets[a][0]) and probminhash.probability_jaccard(sets[a], sets[b]) >= threshold:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in docs}


def family(seed, n, words_n, edits):
    r = random.Random(seed)
    base = text(words_n, seed).split()
    for _ in range(n):
        ws = list(base)
        for _ in range(r.randrange(edits + 1)):
            ws[r.randrange(len(ws))] = f"e{r.randrange(10**6)}"
        yield " ".join(ws)


def test_classes_equal_brute_force(spark):
    texts = [t for s in range(12) for t in family(s, 14, 60 + 20 * s, 4 + s // 2)]
    texts += ["", "", None, "one two", "One, TWO", "!!!", "???", "!!!", texts[0].upper()]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()}
    assert got == brute_classes(docs)


def test_large_mixed_buckets_are_settled(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", 8)
    docs = dict(enumerate(family(5, 60, 100, 3)))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()}
    assert got == brute_classes(docs)


def test_near_duplicates_odd_rows(spark):
    docs = odd_documents(spark, [(None, text(80, 2), "en", "a", 1, "x")])
    rows = probminhash.near_duplicates(docs).collect()
    assert len(rows) == 9
    assert {(r.doc_id, r.class_id) for r in rows} == {(1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (6, 6), (7, 7), (None, None)}
    kept = probminhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 6, 7]
    assert probminhash.near_duplicates(empty(spark)).count() == 0


def test_registers_estimate_the_probability_jaccard():
    r = np.random.default_rng(1)
    items = r.integers(1, 1 << 62, 300).astype(np.uint64)
    a = (np.sort(items[:200]), np.ones(200, np.int64))
    b = (np.sort(items[60:260]), r.integers(1, 4, 200))
    z = probminhash.signatures([a, b, a], 4000)
    assert (z[0] == z[2]).all()
    assert abs((z[0] == z[1]).mean() - probminhash.probability_jaccard(a, b)) < 0.03
    slow = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in wa | wb) for wa, wb in [(dict(zip(*a)), dict(zip(*b)))] for i in wa.keys() & wb)
    assert np.isclose(slow, probminhash.probability_jaccard(a, b))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(50, 50), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_intermediate_tables_can_be_dropped(spark):
    held = common.write_table(spark.range(5), "five")
    path = held.inputFiles()[0].removeprefix("file://")
    assert held.count() == 5 and os.path.exists(path)
    common.drop_written(spark)
    assert not os.path.exists(path)


# --- op10 -------------------------------------------------------------------------------------------------------------


def glob_match(tokens, s):
    """By recursion."""
    if not tokens:
        return not s
    t, rest = tokens[0], tokens[1:]
    if t >= 0:
        return bool(s) and s[0] == t and glob_match(rest, s[1:])
    return glob_match(rest, s) or bool(s) and (t == -2 or s[0] != 47) and glob_match(tokens, s[1:])


def test_automaton_equals_recursion():
    globs = ["*.com/**", "**/ads/**", "a*b", "**", "", "*", "**.exe", "x" * 70 + "*", "*.a.b/c*/d"]
    strings = ["", ".com/", ".x.com/a/b", ".x/y.com/", "ab", "a/b", "axxb", "/ads/", "q/ads/z.exe", "x" * 70, "x" * 71 + "/", ".a.b/c1/d", ".z.a.b/c/d"]
    got = urlfilter.Automaton(globs).match([s.encode() for s in strings])
    for i, s in enumerate(strings):
        for j, g in enumerate(globs):
            assert got[i, j] == glob_match(urlfilter.parse_glob(g), s.encode()), (s, g)


def test_url_verdicts(spark):
    urls = {
        "https://X.Example.com/en/1?q": ("x.example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/x": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://a.net/fr/": ("a.net", "/fr/", "net/fr/", "block"),
        "http://evil.org/x.com/en/": ("evil.org", "/x.com/en/", None, "allow"),
        "http://a.org/ads/1": ("a.org", "/ads/1", None, "block"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://é.com/ü": ("é.com", "/ü", "com/", "allow"), "x://a.net#/es/": ("a.net", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(df, Q.URL_RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert urlfilter.judge_urls(df.limit(0), Q.URL_RULES).count() == 0
