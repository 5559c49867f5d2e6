"""Translation in pieces with a deterministic translator."""

import random

from pyspark.sql import functions as F

from sievewright.operators.sections import merge_overlaps, pack_sentences
from sievewright.sources import translating as X

SIZES = (12, 16, 4, 2)


def upper(texts, language):
    """Upper case; refuses a batch that holds the word bad, and that piece."""
    if any("bad" in t for t in texts):
        raise ValueError("bad piece")
    return [f"{t.upper()} " for t in texts]


def make():
    return upper


def test_batches_are_of_one_language_sorted_and_bounded():
    r = random.Random(1)
    pieces = [(r.choice("ab"), r.randint(1, 60)) for _ in range(300)] + [("a", 500)]
    batches = list(X.model_batches(pieces, 200))
    assert sorted(i for b in batches for i in b) == list(range(301))
    for b in batches:
        assert len({pieces[i][0] for i in b}) == 1 and (len(b) == 1 or max(pieces[i][1] for i in b) * len(b) <= 200)
    assert len(batches) < 80 and list(X.model_batches([], 10)) == []


def test_a_bad_piece_keeps_its_text_and_spares_the_others():
    texts, errors = X.translated(upper, ["one", "bad two", "three"], ["fr"] * 3, [1, 2, 1], 100)
    assert texts == ["ONE", "bad two", "THREE"] and errors == [None, "ValueError: bad piece", None]
    texts, errors = X.translated(lambda t, _: t[:1], ["a", "b"], ["fr"] * 2, [1, 1], 100)
    assert texts == ["a", "b"] and errors == [None, None]


def test_texts_are_cut_translated_and_merged(spark):
    r = random.Random(2)
    words = [f"mot{i}" for i in range(50)]
    long = " ".join(" ".join(r.choice(words) for _ in range(8)).capitalize() + "." for _ in range(30))
    rows = [(1, long, "fr"), (1, "Court.", "fr"), (2, "Plain text.", "en"), (3, "Texto.", "es"), (4, None, "fr"), (5, " ", "fr"), (6, "Sans langue.", None), (7, "C'est bad ici. " + long, "fr")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "row long, id long, t string, lang string").repartition(3)
    got = {x.row: x for x in X.translate_pieces(df, ["row", "id"], "t", "lang", ["fr", "de"], make, SIZES, budget=60).collect()}
    cut = pack_sentences(df, "t", *SIZES).where("row = 0").select(F.size("pieces").alias("n"), merge_overlaps(F.transform("pieces", lambda p: F.upper(p))).alias("m")).first()
    assert got[0].n_pieces == cut.n > 5 and got[0].translated == cut.m and got[0].errors == []
    assert got[1].translated == "COURT." and (got[2].decision, got[2].translated) == ("no_translation_needed_english", "Plain text.")
    assert got[3].decision == "no_model_available" and got[4].translated is None and got[5].translated == " " and got[6].n_pieces == 0
    assert set(got[7].errors) == {"ValueError: bad piece"} and "bad ici" in got[7].translated and "MOT" in got[7].translated and len(got) == 8
