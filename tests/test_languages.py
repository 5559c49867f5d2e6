"""Language posteriors against a plain computation, and the English test's rules."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from sievewright.operators import languages as L

TEXTS = [("en", "the cat and the dog sat there"), ("en", "that other thing is here"), ("de", "der Hund und die Katze"), ("de", "über den Wald, schön!"), (None, "xx"), ("unknown", "yy")]


def grams(t):
    return [f" {w} "[i : i + 3] for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for i in range(len(w))]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_posteriors_equal_a_plain_computation(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_GRAMS", broadcast)
    model = L.learn(spark.createDataFrame(TEXTS, "lang string, text string"))
    assert model.languages == ("de", "en")
    counts = {lang: collections.Counter(g for t in TEXTS if t[0] == lang for g in grams(t[1])) for lang in ("de", "en")}
    v = len(set(counts["de"]) | set(counts["en"]))
    asked = [(1, "the hound"), (2, "die Hunde über"), (3, None), (4, ""), (5, "123 !"), (6, "a"), (6, "cat")]
    got = {r.k: (r.language, r.p) for r in L.posteriors(spark.createDataFrame(asked, "k long, text string"), ["k"], model).collect()}
    for k in range(1, 7):
        mine = [g for i, t in asked if i == k for g in grams(t)]
        s = {lang: sum(math.log((c[g] + 1) / (c.total() + v)) for g in mine) for lang, c in counts.items()}
        p = {lang: math.exp(x) / sum(map(math.exp, s.values())) for lang, x in s.items()}
        assert got[k][0] == min(p, key=lambda lang: (-p[lang], lang)) and all(abs(got[k][1][lang] - p[lang]) < 1e-9 for lang in p)
    none = L.learn(spark.createDataFrame([(None, "a")], "lang string, text string"))
    assert L.posteriors(spark.createDataFrame([(1, "a")], "k long, text string"), ["k"], none).first().language is None


@pytest.mark.parametrize("held", [1 << 17, 2])
def test_texts_are_exploded_to_words_and_only_rare_ones_to_trigrams(spark, monkeypatch, held):
    monkeypatch.setattr(L, "BROADCAST_WORDS", held)
    model = L.learn(spark.createDataFrame(TEXTS, "lang string, text string"))
    known = {w for lang, t in TEXTS if lang in ("de", "en") for w in re.findall(r"[^\W\d_]+", t.lower())}
    assert 0 < model.words.count() <= held and (held < len(known) or model.words.count() == len(known))
    sums = {r["word"]: r for r in model.words.collect()}
    table = {r["gram"]: r for r in model.table.collect()}
    for w, r in sums.items():
        assert all(abs(r[f"w{i}"] - sum(table[g][f"l{i}"] for g in grams(w))) < 1e-9 for i in range(2))
    asked = spark.createDataFrame([(1, "The cat, the xyz; über!"), (2, None)], "k long, text string")
    found = L.posteriors(asked, ["k"], model)
    got = {r.k: r.p for r in found.collect()}
    s = [sum(table[g][f"l{i}"] if g in table else model.unseen[i] for g in grams("The cat, the xyz; über!")) for i in range(2)]
    assert abs(got[1]["en"] - 1 / (1 + math.exp(s[0] - s[1]))) < 1e-9 and got[2] == {"de": 0.5, "en": 0.5}


def test_english_rules(spark):
    rows = [
        ("one two", 0.86, 0.0, "en", True), ("one two", 0.84, 0.0, "en", False), ("one two", 0.86, 0.0, None, True), ("one two", 0.89, 0.1, "de", False),
        ("one two", 0.91, 0.09, "de", True), ("one two", 0.9, 0.75, "de", False), ("1", 0.0, 1.0, "de", True), ("a", 0.0, 1.0, "de", True), (None, 0.0, 1.0, "de", True), ("éé", 0.0, 1.0, "de", True),
    ]
    df = spark.createDataFrame(rows, "t string, en double, other double, doc string, want boolean")
    p = F.create_map(F.lit("en"), "en", F.lit("de"), "other")
    assert all(r.got == r.want for r in df.withColumn("got", L.is_english(F.col("t"), p, F.col("doc"))).collect())
