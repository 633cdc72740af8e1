"""Multi-index, whitening and resampling against plain forms."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexarium.llm import multi_index, queries, resampling, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, id string, x string, vector int, CELL int"


def table_of(spark, rows, parts=3):
    """Vectors with columns that operators use inside."""
    return spark.createDataFrame([(i, v, 0, "a", "b", 1, 2) for i, v in rows], VECTORS).repartition(parts)


ODD = [(None, [1.0, 2.0, 3.0, 4.0]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [NAN, 0.0, 0.0, 1.0]), (904, [INF, 0.0, 0.0, 1.0]), (905, [1.0, None, 0.0, 0.0]), (906, [0.0, 0.0, 0.0, 0.0]), (907, [0.0, -0.0, 0.0, 0.0])]


# ---- multi-index


def distance(a, b):
    """Squares summed in order; Python's own sum would correct for rounding."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def plain_nearest(rows, k=10, every=100):
    """``query_id, rank, vec_id, score`` by comparing all pairs of given rows."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out, queries_ = [], {}
    for i, v in good:
        if i % every == 0:
            queries_[i] = np.array(min(tuple(v), tuple(queries_.get(i, v))))
    for q, v in queries_.items():
        near = {(distance(v, w), i, tuple(w)) for i, w in good if i != q}
        out += [(q, r, i, s) for r, (s, i, _) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def clumps(seed=1, n=400):
    """Clusters, many copies of one vector, repeated rows and ids, ties, and rows that take no part."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0, 1, 5]) + rng.random() for _ in range(4)]) for i in range(n)]
    rows += [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(250)]
    rows += [(2000 + 100 * i, [float(i % 3), 1.0, 0.0, 0.0]) for i in range(9)]
    return rows + rows[:3] * 2 + [(7, [0.5, 0.5, 0.5, 0.5])] + ODD


@pytest.mark.parametrize("setting", [multi_index.Setting(), multi_index.Setting(shard=5, queries=2), multi_index.Setting(shard=50, centroids=3), multi_index.Setting(k=3, shard=7)])
def test_all_cells_give_all_neighbours(spark, setting):
    rows = clumps()
    table = table_of(spark, rows)
    index = multi_index.build(table, setting=setting)
    found = multi_index.search(index, table.where("vec_id % 100 = 0"), enough=10**9)
    assert sorted(map(tuple, found.collect())) == plain_nearest(rows, setting.k)
    assert [f.name for f in found.schema] == ["query_id", "rank", "vec_id", "score"]


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = queries.QUERIES["op11_multi_index"](spark, sf)
    rows = vectors.toPandas()
    x = np.stack(rows.embedding).astype(np.float64)
    best = [(int(rows.vec_id[q]), int(rows.vec_id[j])) for q in np.flatnonzero(rows.vec_id % 100 == 0) for j in sorted(set(range(len(x))) - {q}, key=lambda j: (np.sqrt(np.cumsum((x[q] - x[j]) ** 2)[-1]), rows.vec_id[j]))[:10]]
    assert got.count() == len(best)
    assert multi_index.recall(got, spark.createDataFrame(best, "query_id long, vec_id long")) >= 0.9
    at = {int(i): v for i, v in zip(rows.vec_id, x, strict=True)}
    for r in got.collect():
        assert r["score"] == distance(at[r["query_id"]].tolist(), at[r["vec_id"]].tolist())


def test_measured_recall_is_reached_by_few_entries_in_clusters(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 8)) * 20
    rows = [(i, (middles[i % 40] + rng.normal(size=8)).astype(float).tolist()) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = multi_index.build(table)
    asked = multi_index.usable(table.where("vec_id % 100 = 0"), "vec_id", "embedding", 8)
    enough, share = multi_index.measured(index, asked)
    assert share >= 0.95 and enough < 1000
    x = np.array([v for _, v in rows])
    best = [(q, int(j)) for q in range(0, 4000, 100) for j in np.argsort(np.where(np.arange(4000) == q, np.inf, ((x - x[q]) ** 2).sum(1)))[:10]]
    found = multi_index.search(index, table.where("vec_id % 100 = 0"))
    assert found.count() == 400 and multi_index.recall(found, spark.createDataFrame(best, "query_id long, vec_id long")) >= 0.9


@pytest.mark.parametrize("seed", range(5))
def test_traversal_is_the_order_of_sums(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, 7).astype(float), rng.integers(0, 6, 5).astype(float)
    counts = rng.integers(0, 4, (7, 5))
    got = list(multi_index.traversed(a, b, counts, 10**9))
    assert sorted((i, j) for _, i, j, _ in got) == [(i, j) for i in range(7) for j in range(5)]
    assert [s for s, *_ in got] == sorted((a[:, None] + b[None, :]).ravel().tolist())
    assert got[-1][3] == counts.sum()
    some = list(multi_index.traversed(a, b, counts, 9))
    assert some == got[: len(some)] and some[-1][3] >= 9 and (len(some) == 1 or some[-2][3] < 9)


@pytest.mark.parametrize("seed", range(6))
def test_shards_hold_every_cell(seed):
    rng = np.random.default_rng(seed)
    counts = rng.choice([0, 1, 3, 40], (6, 6))
    got = multi_index._shards(counts, 10, 2)
    load, flat = np.zeros(got.total), counts.ravel()
    for c in range(36):
        assert got.many[c] == max(1, -(-flat[c] // 10)) if flat[c] > 10 else got.many[c] == 1
        load[got.first[c] : got.first[c] + got.many[c]] += flat[c] / got.many[c]
        others = [d for d in range(36) if d != c and got.first[d] < got.first[c] + got.many[c] and got.first[d] + got.many[d] > got.first[c]]
        assert flat[c] <= 10 or not any(flat[d] for d in others)
    assert load.sum() == flat.sum() and load.max() <= 19


def test_few_or_no_vectors(spark):
    empty = multi_index.nearest(table_of(spark, []), table_of(spark, []))
    assert empty.count() == 0 and empty.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert multi_index.nearest(table_of(spark, ODD), table_of(spark, ODD)).count() == 0
    few = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (200, [1.0, 0.0, 0.0, 0.0])]
    got = multi_index.nearest(table_of(spark, few), table_of(spark, few).where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == plain_nearest(few)
    one = [(0, [1.0, 0.0, 0.0, 0.0])]
    assert multi_index.nearest(table_of(spark, one), table_of(spark, one)).count() == 0


def test_neighbours_of_huge_vectors(spark):
    rows = [(i, [1e200 * i, 1.0, 0.0, float(i)]) for i in range(1, 30)] + [(100, [3e200, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert multi_index.nearest(table, table.where("vec_id = 100")).count() == 10


# ---- whitening


def plain_whitening(rows, scale=256, k=4):
    x = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v)]
    once = sorted({tuple(v) for _, v in x})
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    m = np.array(once, float)
    v = (m - m.mean(0)).T @ (m - m.mean(0)) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, row in x:
        y = (np.array(row) - np.array(sums) / n) @ u / np.sqrt(e)
        out += [(i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)), y[c], e[c] / np.trace(v)) for c in range(k)]
    return out


def test_whitening_is_that_of_all_pairs_of_entries(spark):
    rows = [(i, v) for i, v in clumps(5) if i is not None]
    table = table_of(spark, rows)
    model = whitening.fit(table)
    got = sorted(map(tuple, whitening.whiten(table, model).collect()))
    want = sorted(plain_whitening(rows))
    assert len(got) == len(want) and model.identity_error < 1e-12
    signs = {}
    for a, b in zip(sorted(got, key=lambda r: (r[1], r[0], r[3])), sorted(want, key=lambda r: (r[1], r[0], r[3])), strict=True):
        assert a[:4] == b[:4] and a[5] == pytest.approx(b[5], rel=1e-12) and abs(a[4]) == pytest.approx(abs(b[4]), abs=1e-9)
        if abs(b[4]) > 1e-6:
            signs.setdefault(a[1], set()).add(a[4] * b[4] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_null_ids_and_other_columns_stay_out_of_the_way(spark):
    table = table_of(spark, clumps(6))
    got = whitening.whiten(table, whitening.fit(table))
    assert got.where("vec_id IS NULL").count() == 4 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("rows", [[], ODD[1:6], [(1, [1.0, 1.0, 1.0, 1.0])] * 3])
def test_nothing_to_whiten(spark, rows):
    table = table_of(spark, rows)
    got = whitening.whiten(table, whitening.fit(table))
    assert got.count() == 0 and got.columns[0] == "vec_id"


def test_fewer_directions_than_components(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0, float(i % 3)]) for i in range(30)]
    model = whitening.fit(table_of(spark, rows))
    assert len(model.eigenvalues) == 2 and model.identity_error < 1e-9
    assert sum(model.eigenvalues) == pytest.approx(model.trace, rel=1e-12)


def test_deviations_stay_exact_or_null(spark):
    n, sums = 3, [2**40, -5]
    x = np.array([[2**39, 1], [-(2**41), 0]])
    assert list(whitening.deviations(x, n, sums)) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    rows = [(1, [1e12, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [1e30, 0.0, 0.0, 0.0])]
    got = whitening.whiten(table_of(spark, rows), whitening.fit(table_of(spark, rows))).collect()
    assert {r["vec_id"] for r in got} == {1, 2} and all(r["deviation"] is None for r in got)


@pytest.mark.parametrize("size,kind", [(40, "spread"), (300, "spread"), (300, "slow"), (60, "low rank"), (50, "multiple"), (3, "spread")])
def test_lanczos_against_a_dense_solver(size, kind):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.normal(size=(size, size)))
    e = {"spread": 2.0 ** -np.arange(size), "slow": 1 + np.linspace(1, 0, size) ** 2, "low rank": np.where(np.arange(size) < 5, 5.0 - np.arange(size), 0), "multiple": np.where(np.arange(size) < 12, 3.0, 1.0)}[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    passes = []
    values, columns, residuals, n = whitening.lanczos(lambda b: passes.append(b.shape[1]) or a @ b, size, 4, whitening.Setting(basis=64))
    assert values == pytest.approx(e[: len(values)], rel=1e-12) and len(values) == min(4, size)
    assert np.abs(columns.T @ columns - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(a @ columns - columns * values, axis=0).max() < 1e-11 and n == len(passes)
    assert max(passes) <= 8


def test_breakdown_starts_again_outside_the_basis():
    """A block of which one column is left, then none: the others are random and orthogonal to all."""
    rng = np.random.default_rng(0)
    basis = np.eye(10)[:, :4]
    block = np.column_stack([np.eye(10)[:, 0], np.eye(10)[:, 5], np.zeros(10)])
    new = whitening._orthogonal(block, basis, rng, 6, 1e-12)
    assert new.shape == (10, 3) and np.abs(np.column_stack([basis, new]).T @ np.column_stack([basis, new]) - np.eye(7)).max() < 1e-12


# ---- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resampling(docs, target, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    count = lambda texts: [sum(b == i for t in texts for b in map(bucket, features(t, s.longest)[1])) for i in range(s.buckets)]
    source, aim = count([t for _, t in docs]), count(target)
    gain = [math.floor(1000 * math.log((t + 1) * (sum(source) + s.buckets) / ((c + 1) * (sum(aim) + s.buckets)))) for c, t in zip(source, aim, strict=True)]
    out = []
    for i, t in docs:
        words, found = features(t, s.longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{s.seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= s.least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = {id(r): n for n, r in enumerate(able[: s.percent * len(able) // 100], 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


def texts(seed, n, most=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "ÀB", "x1y", "日本", "don"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(most))) + rng.choice(["", "!", "--A_B", "\x00Z", "\n\nYes's"]) for _ in range(n)]


@pytest.mark.parametrize("s", [resampling.Setting(buckets=50), resampling.Setting(longest=3, buckets=20, percent=37, least_words=5), resampling.Setting(buckets=7, percent=100, least_words=0, range_rows=9), resampling.Setting(buckets=7, percent=1)])
def test_draw_is_the_plain_one(spark, monkeypatch, s):
    monkeypatch.setattr(resampling, "BLOCK", 4)
    docs = list(enumerate(texts(1, 300))) + [(400, None), (401, ""), (402, " -- "), (None, "word " * 25), (-5, "word " * 25)]
    target = texts(2, 20) + [None, ""]
    table = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, score int, RANK int, place string").repartition(7)
    got = resampling.resampled(table, spark.createDataFrame([(t,) for t in target], "text string"), s)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(docs, target, s)


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = [(i % 3, "some words of a text") for i in range(90)] + [(None, "some words of a text")] * 30
    s = resampling.Setting(least_words=1, percent=50, buckets=10)
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([("words",)], "text string"), s)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(docs, ["words"], s)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "too short")]])
def test_nothing_to_draw(spark, rows):
    got = resampling.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"))
    assert [tuple(r)[4] for r in got.collect()] == [None] * len(rows)


def test_other_kinds_of_ids(spark):
    docs = [(f"d{i}", t) for i, t in enumerate(texts(4, 60, 90))]
    s = resampling.Setting(buckets=30)
    got = resampling.resampled(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("w1 w2",)], "text string"), s).toPandas()
    able = got[got.n_features >= 20].sort_values(["score", "doc_id"], ascending=[False, True])
    n = len(able) // 10
    assert able["rank"].head(n).tolist() == list(range(1, n + 1)) and able["rank"].tail(len(able) - n).isna().all()


@pytest.mark.parametrize("seed", range(8))
def test_tournament_merges_blocks_and_stops(seed):
    rng = random.Random(seed)
    runs = [sorted((-rng.randrange(40), True, rng.randrange(5), p * 1000 + i) for i in range(rng.randrange(30))) for p in range(rng.randrange(1, 9))]
    blocks = []
    for run in runs:
        while run:
            n = rng.randrange(1, 6)
            part, run = run[:n], run[n:]
            blocks.append({"scores": [-k[0] for k in part], "ids": [k[2] for k in part], "places": [k[3] for k in part], "features": [0] * len(part), "weights": [0] * len(part)})
    every = sorted(k for b in blocks for k, *_ in resampling._rows(b))
    blocks.sort(key=resampling._key)
    most = rng.randrange(len(every) + 3)
    opened = []
    stream = (opened.append(b) or b for b in blocks)
    assert [r[0] for r in resampling.merged(stream, most)] == every[:most]
    if 0 < most <= len(every):  # one block ahead of those that the draw needs
        assert len(opened) <= sum(resampling._key(b) <= every[most - 1] for b in blocks) + 1


def test_gains_follow_the_stated_formula():
    source, target = np.array([0, 5, 100]), np.array([3, 0, 7])
    want = [math.floor(1000 * math.log((t + 1) * (105 + 3) / ((s + 1) * (10 + 3)))) for s, t in zip(source, target, strict=True)]
    assert resampling.gains(source, target).tolist() == want


def test_resampling_query_on_the_small_table(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    target = pd.read_parquet(f"{small}/benchmark.parquet").text
    got = queries.QUERIES["op13_resampling"](spark, small)
    s = resampling.Setting()
    flat = lambda texts: np.bincount([zlib.crc32(f.encode()) % s.buckets for t in texts for f in features(t, 1)[1]], minlength=s.buckets)
    gain = resampling.gains(flat(docs.text), flat(target))
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        found = features(t, 1)[1]
        assert (rows[i]["n_features"], rows[i]["weight"]) == (len(found), sum(int(gain[zlib.crc32(f.encode()) % s.buckets]) for f in found))
        assert rows[i]["score"] == rows[i]["weight"] + resampling.noise(str(i), "2024")
    able = sorted((r for r in rows.values() if r["n_features"] >= 20), key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in able] == [*range(1, len(able) // 10 + 1), *[None] * (len(able) - len(able) // 10)]
    assert got.where(F.col("rank").isNotNull() & (F.col("n_features") < 20)).count() == 0
