"""Work that is done once a row, table or page."""

from pyspark.sql import functions as F

from sievewright.functions import tables as B
from sievewright.operators import evidence as E
from sievewright.operators import sections as S


def test_pairs_of_a_row_are_built_once(spark):
    t = [["Name ::", " Dose\t", "", "Arm:"], [" a  b ", "1 mg", "x\n", ""], ["", "", "", ""], [None, "2", "", ""], ["p", "", "", "q"]]
    df = spark.createDataFrame([(t,), ([["Name"], []],), ([],)], "t array<array<string>>").select(B.narrative(F.col("t"), F.lit("T")).alias("x"))
    told = [r.x for r in df.collect()]
    assert told[0].split("\n")[2:] == [
        "Table contains the following columns: Name ::, Dose, Column_3, Arm:", "Row 1: Name : a b, Dose: 1 mg, and Column_3: x", "Row 2: Dose: 2", "Row 3: Name : p and Arm: q",
    ]
    assert told[2] == ""
    assert df._jdf.queryExecution().analyzed().toString().count("zip_with(") == 1


def test_heading_scores_sort_lines_once(spark):
    rows = [(p, f"line {i}", 10.0 * i, 10.0 * i + 8, 10.0 + i % 3, 0.1) for p in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "page int, text string, top double, bottom double, size double, bold_share double")
    scored = E.heading_scores(df, ["page"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Window [") == 2
    assert scored.columns == [*df.columns, "heading_score", "is_heading"] and scored.count() == 15


def test_pieces_are_cut_to_words_once(spark):
    df = spark.createDataFrame([(["a b c d", "c d e", "f", "f f"],), ([],)], "p array<string>").select(S.merge_overlaps(F.col("p")).alias("x"))
    assert [r.x for r in df.collect()] == ["a b c d e f f", ""]
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 2
