"""Similar strings and their groups against all pairs."""

import random

import pytest

from sievewright.operators import synonyms as Y


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def family(seed):
    r = random.Random(seed)
    out = ["", "a", "b", "ab", "é", "éa"]
    for _ in range(25):
        s = "".join(r.choice("abcé") for _ in range(r.randint(1, 12)))
        out.append(s)
        for _ in range(3):
            i = r.randint(0, len(s))
            out.append(s[:i] + r.choice(["", "x", "b"]) + s[i + r.randint(0, 1) :])
    return out


@pytest.mark.parametrize("k", [1, 2])
def test_pairs_equal_all_pairs(spark, k):
    names = family(k)
    df = spark.createDataFrame([(s,) for s in names + names[:10] + [None]], "name string")
    got = sorted(map(tuple, Y.similar_strings(df, "name", k).collect()))
    distinct = sorted(set(names))
    assert got == sorted((a, b, d) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (d := distance(a, b)) <= k)


def test_components_and_groups(spark):
    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z0"), ("z0", "z2"), ("q", "q")]
    got = {r.node: r.least for r in Y.components(spark.createDataFrame(path, "a string, b string")).collect()}
    assert got == {f"n{i:03}": "n000" for i in range(61)} | {z: "z0" for z in ("z0", "z1", "z2")}
    rows = ["survival"] * 3 + ["survivals"] * 2 + ["survivalss"] + ["toxicity"] + [None]
    groups = {r.name: (r.canonical, r.n) for r in Y.synonym_groups(spark.createDataFrame([(x,) for x in rows], "name string"), "name").collect()}
    assert groups == {"survival": ("survival", 3), "survivals": ("survival", 2), "survivalss": ("survival", 1), "toxicity": ("toxicity", 1)}
    assert Y.synonym_groups(spark.createDataFrame([], "name string"), "name").collect() == []
