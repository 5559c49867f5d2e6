"""Pairs of similar word sets against brute force, and what they shuffle."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import retrieval as R
from sievewright.plans import search

LEAST = 0.8


def families(seed):
    """Sets of 0 to 60 words, some frequent, with near copies of all."""
    r = random.Random(seed)
    rows = []
    for _ in range(60):
        base = [f"w{int(r.paretovariate(0.4)) % 400}" for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 20, 60]))]
        for _ in range(r.randint(1, 5)):
            rows.append((len(rows), r.choice(["a", "a", "b", None]), sorted({w if r.random() > 0.06 else f"n{r.randint(0, 999)}" for w in base})))
    return rows


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("seed", "counted"), [(1, 1 << 19), (2, 20), (3, 0)])
def test_similar_sets_equal_brute_force(spark, monkeypatch, seed, counted):
    monkeypatch.setattr(R, "COUNTED", counted)
    rows = families(seed)
    df = spark.createDataFrame(rows, "i long, g string, ws array<string>").repartition(3)
    got = {(x.ka, x.kb): round(x.similarity, 6) for x in R.similar_within(df, "i", "ws", LEAST, "g").collect()}
    want = {(i, j): round(jaccard(set(a), set(b)), 6) for (i, g, a), (j, h, b) in itertools.combinations(rows, 2) if g == h and g and a and b and jaccard(set(a), set(b)) >= LEAST}
    assert got == want and len(want) > 25


def test_first_items_are_few_and_rarest(spark):
    rows = [(i, "a", sorted({f"c{j}" for j in range(50)} | {f"r{i}-{j}" for j in range(50)})) for i in range(8)]
    df = spark.createDataFrame(rows, "k long, g string, ws array<string>").select("k", "g", F.transform("ws", lambda w: F.xxhash64(w)).alias("ws"))
    few = R.first_items(df, R.frequent(df, "ws"), LEAST).collect()
    assert len(few) == 8 * (100 - math.ceil(LEAST * 100) + R.MET)
    assert len({x.w for x in few}) == len(few)  # none of the words that all have


def test_pairs_link_all_documents_that_resemble_another(spark, tmp_path):
    texts = ["one two three four five six seven eight nine ten"] * 4 + ["one two three four five six seven eight nine eleven twelve"] * 3
    texts += ["one two three four five six seven eight nine ten zwei"] * 2 + ["quite another text"] * 2 + ["", "", None, "alone here"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(90, texts[0], None), (91, texts[0], None), (92, texts[0], "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_a, x.doc_b): x.similarity for x in search.near_dup_pairs(spark, str(tmp_path)).collect()}
    copies = {(0, 1): 1.0, (0, 2): 1.0, (0, 3): 1.0, (4, 5): 1.0, (4, 6): 1.0, (7, 8): 1.0, (9, 10): 1.0}
    assert got == copies | {(0, 7): round(10 / 11, 6)}
    members = {x.doc_id: (x.representative, x.n_links) for x in search.near_dup_members(spark, str(tmp_path)).collect()}
    assert len(members) == len(rows) and members[3] == (0, 1) and members[8] == (7, 1) and members[6] == (4, 0) and members[91] == (90, 0)
