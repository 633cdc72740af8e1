"""The segment index against plain counts, through updates and merges; stored indexes; the facade's search."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.facade import Library
from lexarium.operators import index, search, segments
from lexarium.sources import files
from lexarium.storage import release

WORDS = [f"w{i}" for i in range(40)] + ["über", "日本", "rare"]


def corpus(seed, n, start=0, longest=40):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(start + i, " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 1, 3, rng.randrange(longest)])))) for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, text string").repartition(parts)




def tokens():
    return F.filter(F.split("text", " "), lambda t: t != "")


def plain_search(docs, queries, k):
    """BM25 by counting; ``docs`` and ``queries`` are pairs of a key and a text."""
    split = [(i, Counter(t.split()) if t else Counter()) for i, t in docs]
    mean = max(1.0, sum(sum(c.values()) for _, c in split) / len(split)) if split else 1.0
    df = Counter(t for _, c in split for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in split:
            n = sum(c.values())
            s = sum(times * math.log((len(split) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / mean)) for t, times in Counter(text.split()).items() if t in c)
            if s > 0:
                scored.append((-round(s, 9), i is not None, i))
        out += [(q, r, i, round(-s, 6)) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


ASKED = [(1, "w0 w1 rare"), (2, "w30"), (3, "w0 w0 w2 w5 w9 日本"), (4, "missing"), (5, "w39 über w38")]


def found(spark, path, k=7):
    asked = spark.createDataFrame([(q, t) for q, text in ASKED for t in text.split()], "query_id int, token string")
    return sorted((r["query_id"], r["rank"], r["doc"], round(r["score"], 6)) for r in segments.search(spark, path, asked, k).collect())


@pytest.fixture
def small_shards(monkeypatch):
    """Shards of few documents; workers take the size along."""
    monkeypatch.setattr(segments, "SHARD_DOCS", 60)


def sizes_below(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if not f.startswith(".")}


def test_search_is_the_plain_one(spark, tmp_path, small_shards):
    docs = corpus(1, 500) + [(None, "w0 w1"), (600, None), (601, ""), (3, "w0 rare rare"), (3, "w2")]
    path = str(tmp_path / "i")
    state = segments.create(frame(spark, docs), "id", tokens(), path)
    assert (state.total, len(state.segments)) == (len(docs), 1) and state.segments[0]["shards"] >= 8
    assert found(spark, path) == plain_search(docs, ASKED, 7)
    counts = Counter(t for _, text in docs for t in set((text or "").split()))
    assert {r["token"]: r["df"] for r in segments.term_stats(spark, path).collect()} == counts
    tf = Counter((i, t, c) for i, text in docs for t, c in Counter((text or "").split()).items())
    assert Counter(map(tuple, segments.term_frequencies(spark, path).collect())) == tf


def test_updates_write_their_segment_only_and_merges_change_no_score(spark, tmp_path, small_shards):
    docs, path = dict(corpus(2, 300)), str(tmp_path / "i")
    segments.create(frame(spark, list(docs.items())), "id", tokens(), path)
    before = sizes_below(path)
    docs[17] = "w0 rare w39"
    state = segments.updated(spark, path, frame(spark, [(17, docs[17])], 1), tokens())
    after = sizes_below(path)
    assert {f: t for f, t in after.items() if f in before and not f.endswith("current")} == {f: t for f, t in before.items() if not f.endswith("current")}
    assert state.segments[-1]["docs"] == 1 and state.total == 300 and sum(os.path.getsize(f) for f in after.keys() - before.keys()) < 40_000
    assert found(spark, path) == plain_search(list(docs.items()), ASKED, 7)
    for step in range(3):
        more = corpus(10 + step, 40, 290 + 20 * step)
        gone = list(docs)[step * 30 : step * 30 + 25]
        docs = {i: t for i, t in docs.items() if i not in gone} | dict(more)
        segments.updated(spark, path, frame(spark, more), tokens(), spark.createDataFrame([(i,) for i in gone if i not in dict(more)], "id long"))
        assert found(spark, path) == plain_search(list(docs.items()), ASKED, 7)
    state = segments.manifest(spark, path)
    assert len(state.segments) == 5 and state.total == len(docs)
    for groups in ([[s["id"] for s in state.segments[1:4]]], None, [[]]):
        if groups == [[]]:
            groups = [[s["id"] for s in segments.manifest(spark, path).segments]]
        state = segments.merged(spark, path, groups)
        assert found(spark, path) == plain_search(list(docs.items()), ASKED, 7)
    assert len(state.segments) == 1 and not state.deletes and state.segments[0]["docs"] == len(docs)
    fresh = str(tmp_path / "fresh")
    segments.create(frame(spark, list(docs.items())), "id", tokens(), fresh)
    rows = lambda p: sorted((r["token"], r["df"], r["total"]) for r in segments.term_stats(spark, p).collect())
    assert rows(path) == rows(fresh)
    assert segments.vacuumed(spark, path) > 0 and found(spark, path) == plain_search(list(docs.items()), ASKED, 7)


def test_merged_shards_end_at_their_tokens(spark, tmp_path, monkeypatch):
    """A shard of long documents is no longer after a merge than one that is built; what was deleted doesn't count for it."""
    monkeypatch.setattr(segments, "SHARD_TOKENS", 500)
    rng, path = random.Random(7), str(tmp_path / "i")
    docs = {i: " ".join(rng.choices(WORDS, k=rng.choice([60, 90, 120]))) for i in range(24)}
    segments.create(frame(spark, list(docs.items()), 8), "id", tokens(), path)
    segments.updated(spark, path, None, gone=spark.createDataFrame([(i,) for i in docs if i % 3 == 0], "id long"))
    docs = {i: t for i, t in docs.items() if i % 3}
    state = segments.merged(spark, path, [[s["id"] for s in segments.manifest(spark, path).segments]])
    sizes = [r["n"] for r in segments.documents(spark, path, state).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()]
    assert len(sizes) >= 3 and sum(sizes) == sum(len(t.split()) for t in docs.values()) and max(sizes) <= 500
    # each took what it could
    assert all(a + b > 500 for a, b in zip(sizes[:-1], sizes[1:], strict=True))
    assert found(spark, path) == plain_search(list(docs.items()), ASKED, 7)


def test_nothing_to_do_and_nothing_left(spark, tmp_path):
    path = str(tmp_path / "i")
    state = segments.create(frame(spark, corpus(3, 5)), "id", tokens(), path)
    assert segments.updated(spark, path, None, gone=spark.createDataFrame([(99,)], "id long")) == state and segments.merged(spark, path) == state
    state = segments.updated(spark, path, None, gone=spark.createDataFrame([(i,) for i in range(5)], "id long"))
    assert state.total == 0 and found(spark, path) == []
    assert segments.merged(spark, path).segments == [] and found(spark, path) == []
    empty = str(tmp_path / "e")
    segments.create(frame(spark, []), "id", tokens(), empty)
    assert found(spark, empty) == []
    segments.updated(spark, empty, frame(spark, [(1, "w0 rare")]), tokens())
    assert found(spark, empty) == plain_search([(1, "w0 rare")], ASKED, 7)


def test_the_second_writer_of_a_version_fails(spark, tmp_path):
    path = str(tmp_path / "i")
    state = segments.create(frame(spark, corpus(4, 5)), "id", tokens(), path)
    files.put_text(spark, f"{path}/v{state.version + 1}", "{}")
    with pytest.raises(Exception, match="exist"):
        segments.updated(spark, path, frame(spark, [(1, "x")]), tokens())
    assert segments.manifest(spark, path) == state


def test_size_classes(spark):
    seg = lambda *sizes: segments.Manifest(0, "id", "bigint", [{"id": f"s{i}", "docs": n, "tokens": n, "shards": 1} for i, n in enumerate(sizes)])
    assert segments.due(seg(1, 1, 1), 3) == [["s0", "s1", "s2"]] and segments.due(seg(1, 1, 9, 10), 3) == []
    assert segments.due(seg(9, 11, 26, 1), 3) == [["s0", "s1", "s2"]]
    lost = seg(100, 1)
    lost.deletes = [{"id": "d", "by": {"s0": {"docs": 60, "tokens": 60}}}]
    assert segments.due(lost, 3) == [["s0"]]


def test_blocks_are_passed_over(spark, tmp_path):
    """Many short documents with the common word once, few that are full of it: most blocks can't reach the k-th score."""
    rng = random.Random(0)
    docs = [(i, "w0 " + " ".join(rng.choices(WORDS[1:], k=60))) for i in range(4000)] + [(9000 + i, "w0 w0 w0 w30") for i in range(40)]
    path = str(tmp_path / "i")
    segments.create(frame(spark, docs, 1), "id", tokens(), path)
    assert found(spark, path) == plain_search(docs, ASKED, 7)
    asked = spark.createDataFrame([(1, "w0"), (1, "w30")], "query_id int, token string")
    work = segments.opened(spark, path, asked, 3).first()
    assert 0 < work["opened"] < work["blocks"] / 2


@pytest.mark.parametrize("seed", range(20))
def test_best_of_a_shard_is_exhaustive(seed, monkeypatch):
    monkeypatch.setattr(segments, "WINDOW", 8)
    monkeypatch.setattr(segments, "STEP", 2)
    rng = np.random.default_rng(seed)
    size, mean, k = 200, 30.0, int(rng.integers(1, 12))
    n = rng.integers(1, 60, size)
    lists, weights, total = [], [], np.zeros(size)
    for _ in range(int(rng.integers(1, 6))):
        ords = np.sort(rng.choice(size, int(rng.integers(1, size)), replace=False))
        tf = rng.integers(1, 5, len(ords))
        batch = next(segments._lists(0, segments.pa.array(["t"], segments.pa.large_string()), np.zeros(len(ords), np.int64), ords, tf, n)).to_pydict()
        part = lambda c: np.array(batch[c][0])  # noqa: E731, B023
        maxima = np.maximum.reduceat(segments.part(part("front_tfs"), part("front_ns"), mean), part("front_starts"))
        one = segments._List(part("ords"), part("tfs"), part("ns"), part("windows"), part("starts"), maxima)
        each = segments.part(tf, n[ords], mean)
        assert [each[a:b].max() for a, b in zip(one.starts, one.ends, strict=True)] == maxima.tolist()
        lists.append(one)
        weights.append(float(rng.choice([0.1, 1.0, 5.0])))
        total[ords] += weights[-1] * each
    dead = rng.random(size) < 0.2
    ords, scores, opened, blocks = segments.best(lists, weights, k, mean, dead)
    live = [i for i in range(size) if total[i] > 0 and not dead[i]]
    want = sorted(live, key=lambda i: (-round(total[i], 9), i))[:k]
    assert ords.tolist() == want and scores == pytest.approx(total[want]) and opened <= blocks


# ---- stored indexes


def test_other_tables_have_other_indexes(spark, tmp_path):
    cut = lambda df: index.stored(df, "id", "text", tokens())
    path = str(tmp_path / "docs")
    frame(spark, corpus(5, 30)).write.parquet(path)
    docs = spark.read.parquet(path)
    some = docs.where("id < 10")
    a, b = cut(some), cut(docs)
    assert a != b and segments.manifest(spark, a).total == 10 and segments.manifest(spark, b).total == 30
    assert cut(spark.read.parquet(path)) == b and cut(spark.read.parquet(path).where("id < 10")) == a and cut(docs.where("id < 11")) != a
    for table in (frame(spark, [(1, "apple banana")]), docs.unionByName(frame(spark, [(99, "w0")])), spark.range(3).select("id", F.lit("x").alias("text"))):
        with pytest.raises(ValueError, match="no files"):
            cut(table)
    release(spark)
    again = cut(docs)
    assert again != b and segments.manifest(spark, again).total == 30


def test_facade_indexes_its_pages_once(spark, tmp_path, monkeypatch):
    made = []
    create = segments.create
    monkeypatch.setattr(segments, "create", lambda *a, **k: made.append(1) or create(*a, **k))
    one = Library(spark, spark.createDataFrame([("a", "apple banana"), ("b", "cherry")], "path string, content string"))
    two = Library(spark, spark.createDataFrame([("c", "cherry apple")], "path string, content string"))
    paths = lambda lib, q: [r["path"] for r in lib.search_docs(q).collect()]
    assert paths(one, "apple") == ["a"] and paths(two, "apple") == ["c"] and paths(one, "cherry") == ["b"] and paths(one, "zzz") == []
    assert len(made) == 2
    assert search.bm25 and [r["title"] for r in one.search_docs("apple").collect()] is not None


def test_a_shard_is_counted_and_listed_by_parts(monkeypatch):
    """No step of building holds more than its part of a batch's tokens or of a shard's postings, and parts are what the whole is."""
    pa, rng = segments.pa, random.Random(4)
    texts = [rng.choices(WORDS, k=rng.choice([0, 3, 20, 90])) for _ in range(50)]
    batch = pa.record_batch({"doc": pa.array(range(50)), "tokens": pa.array(texts, pa.list_(pa.string()))})
    monkeypatch.setattr(segments, "FOLD_TOKENS", 100)
    monkeypatch.setattr(segments, "LISTED", 40)
    folds = list(segments._folds(batch.slice(5)))
    assert len(folds) > 10 and all(f.sizes.sum() <= 100 or len(f.sizes) == 1 for f in folds)
    assert all(f.docs.get_total_buffer_size() < batch.get_total_buffer_size() / 5 for f in folds)
    counted = {(d, f.vocabulary[int(c)].as_py()): int(tf) for f in folds for c, r, tf in zip(f.code, f.row, f.tf, strict=True) for d in [f.docs[int(r)].as_py()]}
    assert counted == {(i, t): n for i, words in enumerate(texts) if i >= 5 for t, n in Counter(words).items()}
    token = np.sort(np.array([rng.randrange(30) for _ in range(400)], np.int32))
    ords, tf, n = np.concatenate([np.arange(c) * 9 for c in np.bincount(token)]), np.ones(400, np.int32), np.arange(1000)
    names = pa.array([f"t{i:02}" for i in range(30)], pa.large_string())
    parts = list(segments._lists(3, names, token, ords, tf, n))
    assert len(parts) > 8 and all(sum(p.column(2).to_pylist()) <= 40 or p.num_rows == 1 for p in parts)
    monkeypatch.setattr(segments, "LISTED", 1 << 18)
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(segments._lists(3, names, token, ords, tf, n)).to_pylist()
