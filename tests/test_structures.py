"""Batches, edit scripts, keyword automata, table functions and strict events against plain forms."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexarium.operators import catalog, chunking, evaluation, records, redaction, sessions, sync
from lexarium.sources import landed

# ---- batches


def fold(groups, max_files, max_bytes):
    out, number, files, size = [], 1, 0, 0
    for f, b in groups:
        if files and (files + f > max_files or size + b > max_bytes):
            number, files, size = number + 1, 0, 0
        files, size = files + f, size + b
        out.append(number)
    return out


@pytest.mark.parametrize(("seed", "block"), [(0, 1 << 16), (1, 7), (2, 1), (3, 25), (4, 4)])
def test_batches_are_those_of_the_fold(spark, monkeypatch, seed, block):
    monkeypatch.setattr(sync, "BLOCK", block)
    rng = random.Random(seed)
    groups = [(rng.randrange(1, 5), rng.choice([0, 1, 3, 9, 10])) for _ in range(rng.randrange(60, 150))]
    groups = [(f, min(b, 10)) for f, b in groups]
    rows = [(g, b if i == 0 else 0) for g, (f, b) in enumerate(groups, 1) for i in range(f)]
    plan = spark.createDataFrame([(i, g, b) for i, (g, b) in enumerate(rows, 1)], "seq int, group_no long, payload_bytes long").repartition(5)
    got = {r["group_no"]: r["batch_no"] for r in sync.planned_batches(plan, 6, 12).collect()}
    assert [got[g] for g in range(1, len(groups) + 1)] == fold(groups, 6, 12)
    assert sync.planned_batches(plan, 6, 12).count() == len(rows)


def test_no_groups_make_no_batches(spark):
    assert sync.planned_batches(spark.createDataFrame([], "seq int, group_no long, payload_bytes long"), 3, 3).count() == 0


# ---- edit scripts


def common(x, y):
    """Length of the longest common part, row by row."""
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdz "), max_size=30), st.lists(st.sampled_from("abcdy "), max_size=30))
def test_edits_are_the_fewest(x, y):
    kept = common(x, y)
    assert sync.edit_counts(x, y) == (len(y) - kept, len(x) - kept)


def test_moved_and_repeated_lines(spark):
    left = spark.createDataFrame([("p", "a\nb\nc\nd\n\n\ne"), ("q", "x\nx\nx"), ("same", "1"), ("only", "1")], "path string, content string")
    right = spark.createDataFrame([("p", "c\nd\n\ne\na\nb"), ("q", "x\ny\nx\nx\nx"), ("same", "1")], "path string, content string")
    assert sorted(map(tuple, sync.line_diff(left, right).collect())) == [("p", 2, 3), ("q", 2, 0)]


# ---- keywords


def test_ten_thousand_keywords(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"].lower() for r in docs.collect() if r["text"] is not None}
    rng, all_texts = random.Random(0), list(texts.values())
    words = set()
    while len(words) < 10_000:
        t = rng.choice(all_texts)
        a = rng.randrange(max(1, len(t) - 3))
        words.add((t[a : a + rng.randrange(2, 14)] if rng.random() < 0.9 else f"none{len(words)}") or "x")
    table = spark.createDataFrame([(w.upper() if i % 3 == 0 and w.upper().lower() == w else w,) for i, w in enumerate(words)] + [("",), (None,)], "keyword string")
    want = {(i, w) for i, t in texts.items() for w in words if w in t}
    got = sessions.keyword_hits(docs, "doc_id", "text", table).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    monkeypatch.setattr(sessions, "AUTOMATON", 3000)
    assert sessions.keyword_hits(docs, "doc_id", "text", table).count() == len(want)
    assert sessions.keyword_hits(docs, "doc_id", "text", table.limit(0)).count() == 0


# ---- table function


def test_pieces_in_sql(spark):
    chunking.registered(spark)
    body = "One sentence here. Another one there! " * 9
    spark.createDataFrame([(1, body, "k"), (2, None, "k"), (3, "short", None), (1, body, "again")], "id int, Body string, kind string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, kind, part, piece FROM pieces(TABLE(texts), 'body', 100, 20) ORDER BY id, kind, part").collect()
    want = chunking.split_with_overlap(body, 100, 20)
    assert [r["piece"] for r in got if r["kind"] == "k"] == want and [r["part"] for r in got if r["kind"] == "again"] == list(range(len(want)))
    assert [tuple(r) for r in got if r["id"] == 3] == [(3, None, 0, "short")] and not [r for r in got if r["id"] == 2]
    parted = spark.sql("SELECT count(*) AS n FROM pieces(TABLE(texts) PARTITION BY (id), 'body', 100, 20)").first()["n"]
    assert parted == len(got)
    for bad in ("'nothing', 100, 20", "'body', 20, 20"):
        with pytest.raises(Exception, match="no column|overlap"):
            spark.sql(f"SELECT * FROM pieces(TABLE(texts), {bad})").collect()


def test_repeated_paths_are_pages_of_their_own(spark):
    pages = spark.createDataFrame([("p", "## A\nx"), ("p", "## A\nx"), ("q", None)], "path string, content string")
    assert [r["path"] for r in chunking.chunks(pages, "path", "content").collect()] == ["p", "p"]


# ---- strict events

PIECES = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', '"\\u0061"', "1", "-0.5e3", "01", "NaN", "Infinity", "1e999", "null", "true", " ", "x", '"', "\n"]


def plain_strict(line):
    try:
        value = redaction.strict_json(line)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and "1e999" not in line


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_strictness_is_that_of_a_whole_parse(line):
    assert landed.strict_object(line) == plain_strict(line)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=3), JSON, max_size=4), st.booleans())
def test_good_objects_are_strict(value, ascii_only):
    line = json.dumps(value, ensure_ascii=ascii_only, indent=1)
    assert landed.strict_object(line) and not landed.strict_object(line + "x") and not landed.strict_object(line[:-1]) and not landed.strict_object(f"[{line}]")


@pytest.mark.parametrize("most", [10, 100_000])
def test_the_verdict_is_the_same_on_both_sides_of_the_bound(spark, most):
    big = "y" * 600
    lines = [f'{{"type": "a", "n": 1, "t": "{big}"}}', f'{{"type": "a", "type": "b", "t": "{big}"}}', f'{{"type": "a", "n": NaN, "t": "{big}"}}', f'{{"o": {{"k": 1, "\\u006b": 2}}, "t": "{big}"}}', f'{{"type": "c", "t": "{big}"}} x', f'["{big}"]', None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    e = landed.projected_event(F.col("line"), "type string, n int", most)
    got = {r["i"]: r for r in rows.select("i", e.alias("e")).select("i", "e.large", F.col("e.fields").isNotNull().alias("good"), F.col("e.whole").isNotNull().alias("whole"), "e.fields.type").collect()}
    assert [i for i, r in got.items() if r["good"]] == [0] and got[0]["type"] == "a"
    assert [i for i, r in got.items() if r["whole"]] == ([] if most == 10 else [0])


# ---- both sides in one aggregate


def test_null_and_repeated_keys_are_compared(spark):
    old = spark.createDataFrame([(None, "a"), ("k", "1"), ("k", "1"), ("m", "1"), ("n", None), ("gone", "x")], "key string, d string")
    new = spark.createDataFrame([(None, "a"), ("k", "1"), ("m", "1"), ("m", "2"), ("n", None), ("new", "x")], "key string, d string")
    assert {r["key"]: r["state"] for r in sync.index_diff(new, old, "key", "d").collect()} == {None: "unchanged", "k": "unchanged", "m": "changed", "n": "unchanged", "gone": "deleted", "new": "new"}
    assert sync.index_diff(new, old, "key", "d").count() == 6
    got = {r["key"]: (r["change"], r["changed_fields"]) for r in catalog.compared(old, new, ["key"], ["d"]).collect()}
    assert got == {None: ("same", []), "k": ("same", []), "m": ("same", []), "n": ("same", []), "gone": ("removed", []), "new": ("added", [])}
    seen = spark.createDataFrame([(None, True), ("a", True), ("b", False), ("c", True), ("c", True), ("x", True), ("d", None)], "key string, ok boolean")
    wanted = spark.createDataFrame([(None,), ("a",), ("a",), ("b",), ("c",), ("z",), ("d",)], "key string")
    assert {r["key"]: (r["n"], r["status"]) for r in evaluation.completeness(seen, wanted, ["key"], "ok").collect()} == {None: (1, "complete"), "a": (1, "complete"), "b": (1, "invalid"), "c": (2, "duplicate"), "x": (1, "unexpected"), "z": (0, "missing"), "d": (1, "invalid")}


def test_hashed_embeddings_count_tokens(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "i int, t array<string>")
    got = {r["i"]: r["v"] for r in rows.select("i", records.hashed_embedding(F.col("t")).alias("v")).collect()}
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([("a",), ("b",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    want = [0.0] * 64
    for w in ("a", "b", "a"):
        want[hashes[w] % 64] += 1.0 if (hashes[w] >> 33) % 2 == 0 else -1.0
    length = sum(x * x for x in want) ** 0.5
    assert got[1] == pytest.approx([x / length for x in want]) and got[2] == [0.0] * 64 == got[3]
