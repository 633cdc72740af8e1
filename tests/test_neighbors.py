"""Exact and approximate cosine neighbours against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.operators import neighbors

NAN, INF = float("nan"), float("inf")
ODD = [(5000, None), (5001, []), (5002, [1.0]), (5003, [NAN, 1.0, 0.0]), (5004, [INF, 0.0, 0.0]), (5005, [None, 1.0, 0.0]), (5006, [0.0, 0.0, 0.0])]


def plain(rows, asked, k):
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v is not None and len(v) == 3 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for q, v in (r for r in good if r[0] in asked):
        near = sorted((-round(float(v @ w), 9), i) for i, w in good if i != q)[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def clusters(n=300, copies=60, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 3))
    rows = [(i, (middles[i % 12] + 0.05 * rng.normal(size=3)).tolist()) for i in range(n)]
    return rows + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(copies)] + ODD


def got(df):
    return sorted((r[0], r["neighbor"], r["sim"], r["rank"]) for r in df.collect())


@pytest.fixture
def table(spark):
    return spark.createDataFrame(clusters(), "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("shard,block", [(1 << 17, 1 << 12), (37, 5)])
def test_exact_neighbours(spark, table, monkeypatch, shard, block):
    monkeypatch.setattr(neighbors, "EXACT_SHARD", shard)
    monkeypatch.setattr(neighbors, "BLOCK", block)
    found = got(neighbors.nearest(table.where("vec_id % 10 = 0"), table, 6))
    assert found == plain(clusters(), {i for i, _ in clusters() if i % 10 == 0}, 6)


def test_keys_may_be_texts(spark):
    rows = [(f"k{i}", [float(i), 1.0]) for i in range(8)]
    found = neighbors.nearest(spark.createDataFrame(rows[:1], "k string, v array<float>"), spark.createDataFrame(rows, "k string, v array<float>"), 2, "k", "v").collect()
    assert [(r["k"], r["neighbor"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [("k0", "k1", 1), ("k0", "k2", 2)]


@pytest.mark.parametrize("cells,shard,block", [(None, 1 << 13, 1 << 12), (9, 20, 7), (1, 50, 100), (500, 3, 3)])
def test_all_probes_are_exact(spark, table, tmp_path, monkeypatch, cells, shard, block):
    monkeypatch.setattr(neighbors, "SHARD", shard)
    monkeypatch.setattr(neighbors, "BLOCK", block)
    path = str(tmp_path / "ivf")
    neighbors.build(table, path, cells=cells)
    found = got(neighbors.search(spark, path, table.where("vec_id % 10 = 0"), 6, probes=10**6))
    assert found == plain(clusters(), {i for i, _ in clusters() if i % 10 == 0}, 6)


def test_few_probes_find_most(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(50, 16))
    rows = [(i, (middles[i % 50] + 0.2 * rng.normal(size=16)).tolist()) for i in range(5000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    path, asked = str(tmp_path / "ivf"), table.where("vec_id % 20 = 0")
    neighbors.build(table, path)
    probes = neighbors.measured(spark, path, asked, 10)
    assert probes <= 15
    found, best = neighbors.search(spark, path, asked, 10), neighbors.nearest(asked, table, 10)
    assert neighbors.recall(found, best) >= 0.9
    # only the probed cells of few queries are read
    plan = neighbors.search(spark, path, table.where("vec_id = 20"), 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan and "In(cell" in plan or "cell IN" in plan


def test_more_vectors_are_entered(spark, table, tmp_path):
    path = str(tmp_path / "ivf")
    neighbors.build(table.where("vec_id < 200"), path)
    neighbors.added(table.where("vec_id >= 200"), path)
    found = got(neighbors.search(spark, path, table.where("vec_id % 10 = 0"), 6, probes=10**6))
    assert found == plain(clusters(), {i for i, _ in clusters() if i % 10 == 0}, 6)


def test_no_vectors(spark, table, tmp_path):
    path, none = str(tmp_path / "ivf"), table.where("vec_id >= 5000")
    neighbors.build(none, path)
    assert neighbors.search(spark, path, table, 3).count() == 0
    assert neighbors.nearest(none, none, 3).count() == 0
    neighbors.build(table, path)
    assert neighbors.search(spark, path, none, 3).count() == 0 and neighbors.nearest(table.where(F.lit(False)), table, 3).count() == 0
