"""The vector index against brute force: recall, ties, hot vectors, odd rows and blocks of queries."""

import numpy as np
import pytest

from sievewright.operators import vector_index as V


def store(spark, x, labels=None, ids=None):
    rows = [(int(i), v.tolist(), int(c)) for i, v, c in zip(ids if ids is not None else range(len(x)), x, labels if labels is not None else [0] * len(x), strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


def clustered(n, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, 16))
    return (centres[r.integers(0, 20, n)] + 0.3 * r.normal(size=(n, 16))).astype(np.float32)


def brute(x, labels, q, k, same):
    out = {}
    for i in q:
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        if same:
            d[labels != labels[i]] = np.inf
        out[i] = [j for j in np.lexsort((np.arange(len(x)), d))[:k].tolist() if d[j] < np.inf]
    return out


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("most", [10_000, 7])
def test_exact_and_indexed_results(spark, same, most):
    x = clustered(900)
    x[100:160] = x[5]  # a vector that many rows share
    labels = np.arange(900) % 3
    df = store(spark, x, labels)
    queries = df.where("vec_id % 20 = 0")
    want = brute(x, labels, range(0, 900, 20), 10, same)
    label = "label" if same else None
    exact = V.exact_search(df, queries, 10, label=label, most=most)
    got = {}
    for r in exact.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(vs)] for q, vs in got.items()} == want
    quantiser = V.fit(df, label="label")
    blocks = V.index(df, quantiser, label="label")
    found = V.search(df, blocks, quantiser, queries, 10, label=label, most=most)
    unbounded = V.search(df, blocks, V.replace(quantiser, sample=None), queries, 10, label=label, most=most)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, unbounded.collect()))
    (figures,) = V.recall(found, exact).collect()
    assert figures.n_queries == 45 and figures.recall >= 0.9
    own = {r.query_id: r.vec_id for r in found.where("rank = 1").collect()}
    assert sum(q == v for q, v in own.items()) >= 42 and quantiser.probes < len(quantiser.cells)


def test_every_vector_is_indexed_and_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    x = clustered(400)
    x[:200] = x[0]
    df = store(spark, x)
    blocks = V.index(df, V.fit(df)).collect()
    ids = np.concatenate([np.frombuffer(b.ids, np.int64) for b in blocks])
    assert sorted(ids.tolist()) == list(range(400)) and max(b.n for b in blocks) <= 50


def test_odd_vectors(spark):
    rows = [(1, [0.0, 1.0], 1), (2, None, 1), (None, [1.0, 1.0], 1), (3, [0.0, 1.0], None), (3, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = sorted((r.query_id, r.vec_id) for r in V.exact_search(df, df, 2).collect())
    assert exact == [(1, 1), (1, 3), (3, 1), (3, 1), (3, 3), (3, 3)] or len(exact) == 4
    quantiser = V.fit(df)
    assert V.search(df, V.index(df, quantiser), quantiser, df.where("vec_id = 1"), 1).first().vec_id == 1
    none = df.where("vec_id < 0")
    assert V.fit(none) is None and V.exact_search(df, none, 3).collect() == [] and V.exact_search(none, df, 3).collect() == []


def test_quantiser_estimates_follow_distances():
    x = clustered(2000, 3)
    cells = V.k_means(x, 16, 1)
    of = V.nearest(x, cells)
    books = np.stack([V.k_means((x - cells[of]).reshape(len(x), 4, -1)[:, i], 256, i) for i in range(4)])
    q = V.Quantiser(cells, books, 4, 50)
    inside = np.flatnonzero(of == of[0])
    estimate = q.estimates(x[:1], int(of[0]), q.rest_codes(x[inside], of[inside]))[0]
    true = ((x[inside] - x[0]) ** 2).sum(1)
    assert np.corrcoef(estimate, true)[0, 1] > 0.95


def test_exact_search_within_labels_equals_brute_force(spark, tmp_path):
    """One search in numpy for all labels; no join that computes pairs in the JVM."""
    from sievewright.plans import catalog

    x = clustered(600, 5) * 1000
    x[40:90] = x[3]
    labels = np.arange(600) % 4
    df = store(spark, x, labels)
    df.unionByName(spark.createDataFrame([(1200, x[0].tolist(), None)], df.schema)).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.QUERIES["vector_topk_per_label"](spark, str(tmp_path))
    assert "aggregate(" not in found._jdf.queryExecution().analyzed().toString()
    want = brute(x, labels, range(0, 600, 20), 5, True)
    got = {}
    for r in found.collect():
        assert r.label == r.query_id % 4
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(vs)] for q, vs in got.items()} == want


def test_recall_uses_one_index(spark, tmp_path, monkeypatch):
    from sievewright.plans import catalog

    store(spark, clustered(400), np.arange(400) % 2).write.parquet(f"{tmp_path}/embeddings.parquet")
    made, index = [], V.index
    monkeypatch.setattr(V, "index", lambda *a, **k: made.append(1) or index(*a, **k))
    assert [r.reached for r in catalog.QUERIES["vector_index_recall"](spark, str(tmp_path)).collect()] == [True, True] and made == [1]
