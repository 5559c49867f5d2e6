"""Quantiles, correlations by element, many measures and recommendations."""

import math
import random

from pyspark.sql import functions as F

from sievewright.operators import agreement as A
from sievewright.operators import statistics as S


def test_quantiles_of_f_and_log_gamma(spark):
    pairs = [(1, 1), (2, 3), (4, 10), (19, 38), (99, 198), (149, 596), (3, 2000)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    rows = df.select("a", "b", A.f_quantile(0.975, F.col("a"), F.col("b")).alias("h"), A.f_quantile(0.025, F.col("a"), F.col("b")).alias("l"), A.log_gamma(F.col("b") / 2).alias("g")).collect()
    for r in rows:
        assert math.isclose(r.h, S.f_quantile(0.975, r.a, r.b), rel_tol=1e-6) and math.isclose(r.l, S.f_quantile(0.025, r.a, r.b), rel_tol=1e-6)
        assert math.isclose(r.g, math.lgamma(r.b / 2), abs_tol=1e-9)
    table = {(4.0, 10.0): 4.468, (2.0, 3.0): 16.044, (1.0, 1.0): 647.789}  # printed tables of F, upper 2.5 %
    assert all(abs(r.h - table[(r.a, r.b)]) < 5e-4 for r in rows if (r.a, r.b) in table)


def test_correlations_by_element(spark):
    r = random.Random(2)
    rows = [(e, i, j, i * (e == "P") + r.random() * (1 + (e == "C"))) for e in "PCO" for i in range(12) for j in range(4)]
    rows = [x for x in rows if x[:3] != ("O", 3, 2)] + [("E", 1, 1, 1.0), ("Q", 1, 1, 2.0), ("Q", 1, 2, 2.0), ("Q", 2, 1, 5.0), ("Q", 2, 2, 5.0), (None, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "e string, i long, j long, v double")
    got = {x.element: x for x in A.element_correlations(df, "e", "i", "j", "v").collect()}
    for e in "PC":
        parts = S.icc_parts(df.where(F.col("e") == e), "i", "j", "v").first().asDict()
        low, high = S.icc_interval(parts)
        assert math.isclose(got[e].icc, S.icc_agreement(df.where(F.col("e") == e), "i", "j", "v").first().icc_agreement_single, abs_tol=1e-9)
        assert math.isclose(got[e].ci_low, low, abs_tol=1e-6) and math.isclose(got[e].ci_high, high, abs_tol=1e-6)
    assert got["O"].icc == got["O"].ci_high == 0 and got["O"].k is None and got["E"].grade == "Poor"
    assert got["Q"].icc == got["Q"].ci_low == got["Q"].ci_high == 1 and set(got) == {"P", "C", "O", "E", "Q"}
    two = A.element_correlations(df.where("e in ('P', 'C')"), "e", "i", "j", "v").where("element = 'Total'").first()
    assert two.n == 24 and 0 < two.icc < 1 and two.ci_low <= two.icc <= two.ci_high
    assert A.element_correlations(df.limit(0), "e", "i", "j", "v").where("element <> 'Total'").collect() == []


def test_measures_over_groups(spark):
    df = spark.createDataFrame([("a", "x", 1.0, None), ("a", "y", 3.0, 2.0), (None, "y", 5.0, None)], "g string, h string, m double, t double")
    rows = A.measure_statistics(df, ["m", "t"], [(), ("g",), ("g", "h")], ["t"]).collect()
    found = {(r.group, r.g, r.h, r.measure): (r["mean"], r["std"], r.total, r["count"]) for r in rows}
    assert found[("", None, None, "m")] == (3.0, math.sqrt(8 / 3), None, 3) and found[("", None, None, "t")] == (2.0, 0.0, 2.0, 1)
    assert found[("g", "a", None, "m")][0] == 2.0 and found[("g", None, None, "m")][0] == 5.0 and ("g", None, None, "t") not in found


def test_recommendation_rules(spark):
    rows = [(0.9, 0.9, 0.9, 0.1, 0.1, 0.1), (0.5, 0.75, 0.7, 0.2, 0.3, 0.3), (0.6, 0.69, 0.75, 0.15, 0.2, 0.2)]
    df = spark.createDataFrame(rows, "k double, a double, h double, m double, ao double, ho double")
    got = [r.r for r in df.select(A.recommendations(*(F.col(c) for c in df.columns)).alias("r")).collect()]
    assert got[0] == ["satisfactory", "monitor"] and got[2] == ["ai_recall_low"]
    assert got[1][:3] == ["investigate_disagreement", "calibrate_criteria", "ai_recall_moderate"] and got[1][-1] == "improve_recall" and len(got[1]) == 10
    grades = spark.createDataFrame([(0.81,), (0.7,), (0.5,), (0.3,), (0.1,), (-0.1,)], "k double").select(S.interpret_kappa(F.col("k")).alias("g"))
    assert [r.g for r in grades.collect()] == ["Almost Perfect", "Substantial", "Moderate", "Fair", "Slight", "Poor"]
