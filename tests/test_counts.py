"""Counters of cleaning, and counts over nested maps."""

import duckdb
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import evidence as E
from sievewright.plans import catalog


def test_fixes_are_counted_as_cleaning_makes_them(spark):
    rows = [
        ("no, no, no, no and very very very very", False, (0, 0, 2, 0, 0)), ("a b c a b c a b c!!!!!", False, (0, 0, 1, 1, 0)), ("$$$$$ ##### x  y", False, (0, 2, 0, 0, 1)),
        ("Low 3: x\nRow 1: Row 1: y\nRow 4!!! z\nRow 5: ", True, (4, 0, 0, 0, 0)), ("Low 3: x", False, (0, 0, 0, 0, 0)), (None, True, (0, 0, 0, 0, 0)), ("", False, (0, 0, 0, 0, 0)),
    ]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "t string, is_table boolean").withColumn("x", T.fix_counts(F.col("t"), F.col("is_table")))
    got = {(r.t, r.is_table): tuple(r.x)[:4] for r in df.collect()}
    assert got == {(t, b): want[:4] for t, b, want in rows}
    assert {r.t: r.x.whitespace for r in df.collect()}["$$$$$ ##### x  y"] == 1


def test_counts_over_nested_maps(spark):
    kind = "m map<string,map<string,array<string>>>"
    rows = [({"a": {"x": ["1", "2"], "y": []}, "b": {"z": ["3", None]}},), ({"a": None, "b": {"x": None}},), ({},), (None,)]
    assert [r.n for r in spark.createDataFrame(rows, kind).select(E.nested_count(F.col("m")).alias("n")).collect()] == [4, 0, 0, 0]


def test_fix_totals_count_faults_between_repeated_words_as_sql_does(spark, tmp_path):
    texts = ["menu\nmenu\nmenu\nmenu", "ja ja ja  ja\tja", "a b c\na b c\na b c", "plain", "x de de. y", None]
    rows = [(2 * i + odd, t, f"s{i}") for i, t in enumerate(texts) for odd in (0, 1) if t is not None]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["fix_totals"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.ORACLES["fix_totals"]).fetchall())
