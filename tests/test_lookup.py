"""The file cascade against a plain search, and years by trigger line."""

import random

from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import lookup as U

END = U.SUFFIX


def plain(request, files):
    source, kind, indication = (x or "" for x in request)
    stem = source + (f"_{kind}" if kind else "")
    word = indication.split()
    names = sorted(f for f in set(files) if f and f.endswith(END))
    if word and stem + "_" + word[0].lower() + END in names:
        return stem + "_" + word[0].lower() + END, 1
    if stem + END in names:
        return stem + END, 2
    found = [f for f in names if source in f and kind in f]
    return (found[0], 3) if found else (None, None)


def test_cascade_equals_a_plain_search(spark):
    r = random.Random(6)
    parts = ["hta", "hta_submission", "guideline", "g", "", "ta", "zzz", "retrieval"]
    kinds = [None, "", "population", "po", "n", "outcomes_long"]
    marks = [None, "", "  ", "NSCLC stage 4", "hcc", " x"]
    files = [f"{s}{'_' if k else ''}{k or ''}{m}{END}" for s in parts[:4] for k in kinds[1:] for m in ("", "_nsclc", "_hcc") if r.random() < 0.4] + ["other.json", None, "dup" + END, "dup" + END]
    requests = [(i, r.choice(parts + [None]), r.choice(kinds), r.choice(marks)) for i in range(200)]
    df = spark.createDataFrame(requests, "id long, source_type string, retrieval_type string, indication string")
    got = {x.id: (x["name"], x.rule) for x in U.resolve(df, spark.createDataFrame([(f,) for f in files], "name string"), "id").collect()}
    assert got == {i: plain(q, files) for i, *q in requests} and {x[1] for x in got.values()} == {1, 2, 3, None}
    assert all(x["name"] is None for x in U.resolve(df, spark.createDataFrame([], "name string"), "id").collect())


def test_years_by_trigger_then_page(spark):
    pages = [("In 1999\nSubmission date: 03.2021\nPublished 2022", "2021"), ("In 1999\nSubmitted on Monday\nx", "1999"), ("a 2040 b 1950", "2040"), ("x 12021 y", "unknown_year"), ("", "unknown_year"), (None, "unknown_year"), ("Rapport\r\n2015 rapport 2016", "2015")]
    df = spark.createDataFrame(pages, "p string, want string").withColumn("got", T.submission_year(F.col("p")))
    assert all(r.got == r.want for r in df.collect())
