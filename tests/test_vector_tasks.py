"""Searches spread by pairs of a query and a vector, and a cell's blocks meet in one task."""

import numpy as np
import pyarrow as pa

from sievewright.operators import vector_index as V


def test_blocks_of_a_cell_share_their_tables_and_bounds_come_from_tasks(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    fitted = V.fit(df, label="label")
    blocks = V.index(df.repartition(40), fitted, label="label")
    assert blocks.count() > 2 * len(fitted.cells)
    batches = pa.Table.from_pylist([b.asDict() for b in sorted(blocks.collect(), key=lambda b: b["cell"])]).to_batches(max_chunksize=7)
    runs = list(V.cell_runs(batches))
    assert len({c for c, *_ in runs}) == len(runs) and sorted(i for _, ids, _, _ in runs for i in ids.tolist()) == list(range(600))
    q, labels = x[::2], np.arange(0, 600, 2, dtype=np.int32) % 3
    near = np.argsort(V.squares(q, fitted.cells), 1, kind="stable")[:, : fitted.probes]
    for mark in (None, labels):
        assert np.allclose(V.sample_bounds(spark, fitted, q, near, mark), fitted.bounds(q, near, mark))


def test_exact_search_of_one_file_is_spread(spark, monkeypatch):
    monkeypatch.setattr(V, "EXACT_PAIRS", 2000)
    parts, write = [], V.written

    def counted(df, name, **more):
        parts.append(df.rdd.getNumPartitions())
        return write(df, name, **more)

    monkeypatch.setattr(V, "written", counted)
    x = np.random.default_rng(4).normal(size=(400, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    got = {(r.query_id, r.vec_id) for r in V.exact_search(df, df.where("vec_id < 50"), 3).collect()}
    d = ((x[:50, None].astype(float) - x[None]) ** 2).sum(2)
    assert got == {(i, int(j)) for i in range(50) for j in np.argsort(d[i], kind="stable")[:3]}
    assert parts == [11]
