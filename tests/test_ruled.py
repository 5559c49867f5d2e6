"""Tables from ruled lines, against a plain computation."""

import random

from pyspark.sql import functions as F

from sievewright.operators import documents as D
from sievewright.operators import ruled as R

LINES = "page long, x0 double, y0 double, x1 double, y1 double"
WORDS = "page long, x double, y double, text string"


def test_a_grid_becomes_a_table_and_goes_through_the_passes(spark):
    lines = [(1, x, 0.0, x, 90.0) for x in (0.0, 50.0, 52.0, 100.0)] + [(1, 0.0, y, 100.0, y) for y in (0.0, 30.0, 32.0, 60.0, 90.0)]
    lines += [(1, 10.0, 5.0, 10.0, 20.0), (1, 70.0, 0.0, 78.0, 90.0), (1, None, 0.0, 5.0, 90.0), (2, 0.0, 0.0, 0.0, 90.0)]  # short, thick, null, alone
    words = [(1, 10.0, 10.0, "Drug"), (1, 60.0, 10.0, "dose"), (1, 70.0, 10.0, "mg"), (1, 10.0, 45.0, "A"), (1, 60.0, 45.0, "10"), (1, 99.0, 89.0, "20"), (1, 100.0, 10.0, "out"), (3, 1.0, 1.0, "x")]
    df = spark.createDataFrame(lines, LINES)
    rules = {(r.kind, r.at, r.low, r.high) for r in R.rules(df, ["page"]).where("page = 1").collect()}
    assert rules == {("v", x, 0.0, 90.0) for x in (0.0, 50.0, 100.0)} | {("h", y, 0.0, 100.0) for y in (0.0, 30.0, 60.0, 90.0)}
    grid = R.cells(R.crossings(R.rules(df, ["page"]), ["page"]), ["page"])
    filled = R.filled(grid, spark.createDataFrame(words, WORDS), ["page"])
    (table,) = R.tables(filled, ["page"]).collect()
    assert table.page == 1 and table.t == [["Drug", "dose mg"], ["A", "10"], ["", "20"]]
    found = D.detect_tables(R.tables(filled, ["page"]).withColumn("doc", F.lit(1)).withColumn("ruled", F.lit(1.0)), "doc", "page").collect()
    assert len(found) <= 1
    assert R.tables(R.filled(grid.limit(0), spark.createDataFrame([], WORDS), ["page"]), ["page"]).collect() == []


def test_crossings_of_a_crowded_page_equal_all_pairs(spark):
    r = random.Random(4)
    lines = [(1, x := r.uniform(0, 900), y := r.uniform(0, 900), x, y + r.uniform(20, 300)) for _ in range(150)]
    lines += [(1, x := r.uniform(0, 900), y := r.uniform(0, 900), x + r.uniform(30, 300), y) for _ in range(150)]
    rules = R.rules(spark.createDataFrame(lines, LINES), ["page"])
    rows = rules.collect()
    want = {(v.at, h.at) for v in rows if v.kind == "v" for h in rows if h.kind == "h" and h.low - 2 <= v.at <= h.high + 2 and v.low - 2 <= h.at <= v.high + 2}
    met = R.crossings(rules, ["page"])
    assert {(m.x, m.y) for m in met.collect()} == want and met.count() == len(want)


def test_lines_are_shuffled_once_and_met_without_copies_of_the_work(spark):
    lines, words = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 90.0)], LINES), spark.createDataFrame([(1, 1.0, 1.0, "x")], WORDS)
    grid = R.cells(R.crossings(R.rules(lines, ["page"]), ["page"]), ["page"])
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count(grid) == 1
    assert count(R.tables(R.filled(grid, words, ["page"]), ["page"])) <= 6


def test_cells_that_share_a_corner_are_all_there(spark):
    at = [(0, 0), (2, 0), (2, 1), (0, 1), (1, 0), (1, 1), (0, 2), (2, 2), (5, 5)]
    met = spark.createDataFrame([(1, float(x), float(y)) for x, y in at], "page long, x double, y double")
    by_x, by_y = {x: sorted(b for a, b in at if a == x) for x, _ in at}, {y: sorted(a for a, b in at if b == y) for _, y in at}
    after = lambda vs, v: next((w for w in vs if w > v), None)
    want = {(x, y, after(by_y[y], x), after(by_x[x], y)) for x, y in at if (after(by_y[y], x), after(by_x[x], y)) in at}
    assert {(r.x0, r.y0, r.x1, r.y1) for r in R.cells(met, ["page"]).collect()} == want
