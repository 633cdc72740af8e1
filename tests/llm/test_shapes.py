"""Packing, mixing, near copies, fingerprints, extraction, revisits, pipeline: against brute force and exact rules."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexarium.llm import components, fingerprint, html_extract, jaccard_join, mixing, packing, queries, warc_revisit
from lexarium.llm import textbatch as tb
from lexarium.llm.durable import written

from . import brute
from .test_filters import ODD, ODD_ROWS

TABLES = "documents pages labels benchmark".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, duck, small, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), duck.sql(queries.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert key(got) == key(want)


# ---- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 12))
def test_bins_take_the_best_fit(lengths, most):
    bins, open_bins, number = packing.Bins(20, most), {}, 0
    for n in lengths:
        got, offset = bins.put(n)
        fits = [f for f in open_bins.values() if f >= n]
        free = min(fits) if fits else 20
        assert offset == 20 - free
        if fits:
            assert open_bins.pop(got) == free
        else:
            assert got == number
            number += 1
        if free > n:
            open_bins[got] = free - n
            if len(open_bins) > most:
                least = min(open_bins.values())
                # which of equals closes is the class's choice: take its word for what is left
                left = {x for held in bins.free for x in held}
                (closed,) = set(open_bins) - left
                assert open_bins.pop(closed) == least
        assert bins.n == len(open_bins)


TEXTS = st.lists(st.text(max_size=80) | st.lists(st.sampled_from(["a", "Bc", "é", " ", " ", "\n", ",", ".", "'s", "1", "!", "\t", "_", "<|endoftext|>", "\u00a0", "日", "  ", "\u2028", "the", "²"]), max_size=14).map("".join), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_ids_are_the_tokenizers(texts):
    encoder = packing.encoder(packing.tokenizer_path())
    assert [x.tolist() for x in encoder.encode(texts)] == encoder.defined(texts)


def test_every_compared_character():
    """Each alone, doubled, and between letters, digits, spaces and marks; by the fast library and by the definition."""
    encoder = packing.encoder(packing.tokenizer_path())
    list(encoder.encode(["agree"]))
    assert encoder.fast
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    texts = [t for c in chars for t in (c, c + c, f"a{c}b", f"1{c}2", f" {c} ", f"!{c}?", f"{c} {c}a", f"a\n{c}\n\n{c}", f"a  {c}'s", f"{c}\xa0{c}")]
    assert not any(encoder.other(t) for t in texts)
    assert [encoder.fast.encode_ordinary(t) for t in texts] == encoder.defined(texts)


def test_other_vocabularies_and_disagreement():
    encoder = packing.Encoder(packing.tokenizer_path())
    encoder.fast = type("Wrong", (), {"encode_ordinary": staticmethod(lambda t: [1])})()
    assert [x.tolist() for x in encoder.encode(["some text"])] == encoder.defined(["some text"])
    assert packing.Encoder._ranks("/nowhere.tiktoken") is None


def check_packing(rows: pd.DataFrame, docs: list[tuple], width: int = 1024) -> None:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(int)
    for name, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % width + 1, len(ids) + 1, width)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[name, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = defaultdict(int)
    for r in rows.itertuples():
        got[None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want
    for _, s in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        ends = (s.offset + s.length).tolist()
        assert s.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= width


def test_packing_query(spark, small):
    rows = queries.op1_best_fit_packing(spark, small).toPandas()
    docs = pd.read_parquet(f"{small}/documents.parquet")
    check_packing(rows, list(zip(docs.doc_id, docs.text, strict=True)))
    assert rows.sequence_id.nunique() <= 1.03 * -(-rows.length.sum() // 1024)
    again = queries.op1_best_fit_packing(spark, small).toPandas()
    key = ["doc_id", "piece", "sequence_id", "offset"]
    assert sorted(rows[key].values.tolist()) == sorted(again[key].values.tolist())


def test_packing_odd_rows_over_several_tasks(spark, odd):
    rows = packing.pack(odd, setting=packing.Packing(pieces_per_task=2)).toPandas()
    check_packing(rows, [(r[0], r[1]) for r in ODD_ROWS])
    assert packing.pack(odd.where("false")).collect() == []


# ---- mixing


def brute_targets(sizes: list[int], weights=(5, 2, 1), most=3) -> list[float]:
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    capped, total = set(), sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        level = left / sum(w[i] for i in free) if free else 0
        over = [i for i in free if w[i] * level > most * sizes[i]]
        if not over:
            return [most * sizes[i] if i in capped else w[i] * level for i in range(len(sizes))]
        capped |= set(over)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 7, 0, 3], [0, 0], [5], [1, 1, 1, 1, 1000]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", f"{i:02}", n) for i, n in enumerate(sizes)], "skey string, source string, source_size long")
    got = {r["skey"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(brute_targets(sizes))


def test_mix_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (None, "a", 4), (2, None, 7), (3, "b", 0), (4, "c", 100)], "doc_id long, source string, size long")
    got = mixing.mix(rows).collect()
    assert len(got) == 6
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(taken - target) <= 0.5 for taken, target in by.values())
    assert mixing.mix(rows.where("false")).collect() == []
    near = mixing.mix(rows, cut="document").collect()
    assert all(r["taken"] % r["size"] == 0 for r in near if r["size"])


@pytest.mark.parametrize("most", [0, 1000])
def test_mixed_rows_are_what_the_mix_takes(spark, small, most, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(sized, cut="document").collect() if r["taken"]}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert got == want


# ---- near copies


def copies(seed=3, n=60):
    """Groups of near copies around a few texts, exact copies, and a passage that all share."""
    rnd = random.Random(seed)
    voc = [f"w{i}" for i in range(300)]
    passage = [rnd.choice(voc) for _ in range(20)]
    bases = [[rnd.choice(voc) for _ in range(60)] + passage for _ in range(4)]
    out = {}
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            words[rnd.randrange(len(words))] = rnd.choice(voc)
        out[i] = " ".join(words)
    return out | {n: "", n + 1: "one", n + 2: "one", n + 3: "One two", n + 4: None}


@pytest.mark.parametrize("change", [{}, {"small": 2, "pivots": 2}, {"small": 1, "pivots": 1, "star_rounds": 1, "members": 3}, {"common": 1}, {"frequent": 1}, {"bitmap_bits": 1 << 15, "cells": 4}])
def test_links_equal_brute_force(spark, change):
    texts = copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    setting = jaccard_join.Setting(n=4, least=85, **change)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(docs, setting).collect()}
    want = brute.jaccard_components(texts, 4, 85)
    assert got == {i: (len(brute.shingles(t, 4)), want[i]) for i, t in texts.items()}
    assert len(set(want.values())) < len(texts) - 10


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30).map(" ".join), min_size=1, max_size=6), st.integers(1, 6))
def test_shingle_sets(texts, n):
    s = jaccard_join.shingle_sets(tb.texts_of(pa.array(texts)), n)
    assert s.size.tolist() == [len(brute.shingles(t, n)) for t in texts]
    same = {}
    for t, c in zip(texts, s.cls.tolist(), strict=True):
        key = frozenset(brute.shingles(t, n))
        if key:
            assert same.setdefault(key, c) == c
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize(("local", "degree"), [(0, 1 << 16), (0, 3), (10**6, 3)])
def test_components(spark, local, degree, monkeypatch):
    monkeypatch.setattr(components, "HOT_DEGREE", degree)
    rnd = random.Random(2)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)] + [(200, 201 + i) for i in range(40)]
    edges = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["comp"] for r in components.components(edges, local=local).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = brute.components(sorted(nodes), [(a, b) for a, b in links if a != b])
    assert got == want
    assert components.components(edges.where("false"), local=local).collect() == []


def test_keep_one_of_each_group(spark, odd):
    texts = copies()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, cls string")
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == set(brute.jaccard_components(texts, 5, 80).values())
    rows = jaccard_join.keep_one(odd)
    # rows without words are nobody's near copy: both of the empty rows with id 2 stay
    assert rows.columns == odd.columns and rows.count() == len(ODD_ROWS)
    assert jaccard_join.linked(odd).count() == len(ODD_ROWS) and jaccard_join.linked(odd.where("false")).collect() == []


def test_keep_one_tells_rows_by_group_not_by_id(spark):
    a, b, *other = ([f"{x}{i}" for i in range(40)] for x in "abcdef")
    near = [*a[:-1], "z"]
    rows = [(3, a, "x"), (7, near, "a"), (7, b, "b"), (None, a, "x"), *[(None, t, "x") for t in other], (None, other[0], "y"), (None, None, "x"), (None, [], "x")]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t), s) for i, t, s in rows], "doc_id long, text string, source string")
    got = jaccard_join.keep_one(docs).collect()
    want = [(3, " ".join(a), "x"), (7, " ".join(b), "b"), *[(None, " ".join(t), "x") for t in other], (None, None, "x"), (None, "", "x")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# ---- fingerprints


def test_fingerprints_equal_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 20)
    rows = queries.op8_fingerprints(spark, small).toPandas().set_index("doc_id").sort_index()
    docs = pd.read_parquet(f"{small}/documents.parquet").sort_values("doc_id")
    texts = [t or "" for t in docs.text]
    sigs = [fingerprint.signature(fingerprint._hashes(fingerprint.phrases(t))) for t in texts]
    for i, (name, t) in enumerate(zip(docs.doc_id, texts, strict=True)):
        follow = (i + 1) % len(texts)
        edited = t[: len(t) - len(t) // 4] + texts[follow][: len(t) // 4]
        sig = fingerprint.signature(fingerprint._hashes(fingerprint.phrases(edited)))
        r = rows.loc[name]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.text_of(sigs[i]), fingerprint.text_of(sig))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(sigs[i], sig), fingerprint.likeness(sigs[i], sigs[follow]))
    assert rows.near_edited.mean() > 0.5 > 0.3 > rows.near_next.mean()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab ", max_size=60), st.text(alphabet="ab ", max_size=20))
def test_shared_parsing_changes_nothing(text, tail):
    keep = len(text) - len(text) // 4
    own, edited = fingerprint.both(text, keep, tail)
    sig = lambda t: fingerprint.signature(fingerprint._hashes(fingerprint.phrases(t)))
    assert (own == sig(text)).all() and (edited == sig(text[:keep] + tail)).all()
    found = fingerprint.phrases(text)
    assert len(set(found)) == len(found) and text.startswith("".join(found))


def test_likeness_estimates_jaccard():
    rnd = random.Random(1)
    a = "".join(rnd.choice("abcdef ") for _ in range(20_000))
    b = a[:10_000] + "".join(rnd.choice("ghijkl ") for _ in range(10_000))
    x, y = set(fingerprint.phrases(a)), set(fingerprint.phrases(b))
    near = fingerprint.likeness(*(fingerprint.signature(fingerprint._hashes(sorted(s))) for s in (x, y)))
    assert abs(near - len(x & y) / len(x | y)) < 0.15
    assert fingerprint.likeness(np.zeros(0), np.zeros(0)) == 1.0


def test_fingerprint_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 2)
    rows = fingerprint.fingerprint(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    ordered = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in ODD_ROWS))
    last, first = ordered[-1][2], ordered[0][2]
    edited = last[: len(last) - len(last) // 4] + first[: len(last) // 4]
    assert hashlib.sha256(edited.encode()).hexdigest() in {r["edited_sha256"] for r in rows}
    assert fingerprint.fingerprint(odd.where("false")).collect() == []
    one = fingerprint.fingerprint(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0


# ---- extraction


def test_articles_are_extracted_whole(spark, small):
    import html
    import re

    pages = pd.read_parquet(f"{small}/pages.parquet").set_index("page_id").html
    for r in queries.op2_html_extraction(spark, small).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


LONG = "It was the best of the times and it was in the age of the wise that we had all of this before us and with them"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><nav><a href=/>Home</a></nav><header><h1>Site</h1></header><div id=main-content><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><aside><p>{LONG}</p></aside><footer>F</footer>", ["Title", LONG, "Short.", LONG]),
        (f"<article><h1>T &amp; U</h1><p>{LONG}<p>{LONG}</article><section class='comments'><article class=comment><p>{LONG}</article></section>", ["T & U", LONG, LONG]),
        (f"<main><div class='cookie-notice'>{LONG}</div><p>{LONG}</p><form><p>{LONG}</p></form><ol><li class=comment><div><p>{LONG}</p></div></li></ol></main>", [LONG]),
        (f"<article><p>{LONG}<script>if (a < b) '</p>'</script><style>p{{}}</style> end<!-- <p>no --></p></article>", [LONG + " end"]),
        (f"<div class=post><p>{LONG}</p><p><a href=x>{LONG}</a></p></div>", [LONG]),
        (f"<div role=navigation><p>{LONG}</p></div><p hidden>{LONG}</p><div class='with-sidebar'><p>{LONG}</p></div>", [LONG]),
        ("<p>only  short\n text</p>", ["only short text"]),
        ("<nav><a href=x>all</a> <a href=y>links</a></nav>", []),
        (None, []),
        ("", []),
        ("a < b and <unclosed", ["a < b and"]),
        ("<p title=\"a>b\">x&#233;&nbsp;y&bogus;</p>", ["xé y&bogus;"]),
    ],
)
def test_block_rules(page, want):
    assert html_extract.main_text(page) == "\n".join(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<nav>", "</nav>", "<article>", "</article>", "<", ">", "\"", "text ", "&amp;", "<!--", "-->", "<script>", "</script>", "<br>", "<li>"]), max_size=25).map("".join))
def test_any_markup_ends(page):
    html_extract.main_text(page)


def test_extraction_columns(spark):
    rows = spark.createDataFrame([(1, None, "old", "x"), (1, "<p>a</p>", "old", "y")], "page_id long, html string, text string, url string")
    got = html_extract.extract(rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and {(r["url"], r["text"], r["n_chars"]) for r in got.collect()} == {("x", "", 0), ("y", "a", 1)}
    assert html_extract.extract(rows.where("false")).collect() == []


# ---- revisits


def brute_revisits(records):
    full = [r for r in records if r["kind"] == "response" and r["url"] is not None and r["ts"] is not None]
    out = {}
    for v in (r for r in records if r["kind"] == "revisit"):
        earlier = [r for r in full if v["url"] is not None and v["ts"] is not None and r["key"] == v["key"] and r["ts"] < v["ts"]]
        best = max(earlier, key=lambda r: (r["ts"], r["id"]), default=None)
        mine = v["headers"] or {}
        if best is None:
            out[v["id"]] = ("no_response", None, mine)
            continue
        theirs = best["headers"] or {}
        tags, dates = [h.get("etag", "").removeprefix("W/") for h in (mine, theirs)], [h.get("last-modified") for h in (mine, theirs)]
        if all(tags):
            outcome = "resolved" if tags[0] == tags[1] else "mismatch"
        elif all(dates):
            outcome = "resolved" if dates[0] == dates[1] else "mismatch"
        else:
            outcome = "no_validator"
        merged = {**theirs, **{k: x for k, x in mine.items() if k in warc_revisit.PERMITTED}} if outcome == "resolved" else mine
        out[v["id"]] = (outcome, best["id"], merged)
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_revisits_equal_brute_force(spark, ranges):
    rnd = random.Random(ranges)
    variants = ["http://www.A.example:80/p/", "https://a.example/p#x", "a.example/p?utm_source=z", "https://b.example/?b=2&a=1", "http://b.example?a=1&b=2", None]
    keys = ["a", "a", "a", "b", "b", None]
    records = []
    for i in range(300):
        k = 0 if rnd.random() < 0.4 else rnd.randrange(6)
        headers = {"etag": rnd.choice(["1", "W/1", "2"]), "last-modified": rnd.choice("xy"), "date": str(i), "content-length": str(i)}
        headers = None if rnd.random() < 0.1 else {h: x for h, x in headers.items() if rnd.random() < 0.7}
        records.append({"id": i, "url": variants[k], "key": keys[k], "ts": None if rnd.random() < 0.05 else rnd.randrange(60), "kind": rnd.choice(["response", "revisit", "revisit", "request"]), "headers": headers})
    df = spark.createDataFrame([(r["id"], r["url"], r["ts"], r["kind"], r["headers"], "c") for r in records], "record_id long, url string, ts long, kind string, headers map<string,string>, outcome string")
    got = {r["record_id"]: (r["outcome"], r["response_id"], dict(r["headers"])) for r in warc_revisit.resolve(df, ranges).collect()}
    assert got == brute_revisits(records)
    assert warc_revisit.resolve(df.where("false"), ranges).collect() == []


def test_warc_round_trip(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    records = [
        warc_revisit.write_record({"WARC-Type": "response", "WARC-Record-ID": "<1>", "WARC-Date": "2024-01-01T00:00:00+00:00", "WARC-Target-URI": "http://a.example/"}, http),
        warc_revisit.write_record({"WARC-Type": "revisit", "WARC-Record-ID": "<2>", "WARC-Date": "2024-01-02T00:00:00+00:00", "WARC-Target-URI": "https://a.example"}, b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\nExpires: soon\r\n\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records))[:-3])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc_revisit.read_warc(spark, str(tmp_path / "a.warc"))
    assert {(r["kind"], r["status"]) for r in rows.collect()} == {("response", 200), ("revisit", 304)}
    (r,) = warc_revisit.resolve(rows).collect()
    assert (r["outcome"], r["response_id"], r["headers"]["expires"], r["headers"]["content-type"]) == ("resolved", "<1>", "soon", "text/html")
    assert warc_revisit.read_warc(spark, str(tmp_path)).where("kind = 'response'").count() == 2


def test_a_large_response_is_still_the_one_that_a_revisit_means(spark, tmp_path):
    head = "HTTP/1.1 200 OK\r\nETag: \"{}\"\r\nContent-Type: text/html\r\n\r\n"
    made = lambda i, day, kind, block: warc_revisit.write_record({"WARC-Type": kind, "WARC-Record-ID": f"<{i}>", "WARC-Date": f"2024-01-0{day}T00:00:00Z", "WARC-Target-URI": "http://a.example/"}, block)
    records = [
        made(1, 1, "response", head.format("old").encode() + b"x"),
        made(2, 2, "response", head.format("new").encode() + b"y" * 200_000),
        made(3, 3, "revisit", b"HTTP/1.1 304 Not Modified\r\nETag: \"new\"\r\n\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    rows = warc_revisit.read_warc(spark, str(tmp_path / "a.warc"), 1000)
    large = rows.where("record_id = '<2>'").first()
    assert (large["status"], large["headers"]["etag"], large["payload"], large["truncated"]) == (200, '"new"', None, None)
    (r,) = warc_revisit.resolve(rows).collect()
    assert (r["outcome"], r["response_id"]) == ("resolved", "<2>")
    assert warc_revisit.read_warc(spark, str(tmp_path / "a.warc")).where("length(payload) = 200000").count() == 1


# ---- pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "best-fit packing":
            assert docs.columns == columns
            docs = written(docs, "test")
        seen.append(docs.toPandas())
    raw, good, known, unique, mix, packed = seen
    assert set(good.doc_id) == {r["doc_id"] for r in queries.op9_quality_rules(spark, small).where("kept").collect()}
    assert len(known) >= 0.98 * len(good) and set(known.doc_id) <= set(good.doc_id)
    comps = brute.jaccard_components(dict(zip(known.doc_id, known.text, strict=True)), 5, 80)
    assert sorted(unique.doc_id) == sorted(set(comps.values()))
    check_packing(packed, list(zip(mix.doc_id, mix.text, strict=True)))
    whole = corpus_pipeline.run(spark, small).toPandas()
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(whole[key].values.tolist()) == sorted(packed[key].values.tolist())


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), "").collect() == []
        stage(spark, odd, "").collect()


def test_written_tables_can_be_released(spark):
    from lexarium.llm import durable

    durable.release(spark)
    df = durable.written(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and durable.release(spark) == 1 and durable.release(spark) == 0


@pytest.mark.parametrize(("name", "columns"), [("op5_license_scan", "doc_id:bigint,text:string"), ("op9_quality_rules", "doc_id:bigint,text:string"), ("op2_html_extraction", "page_id:bigint,url:string,html:string")])
def test_scans_read_what_is_used(spark, small, name, columns):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert f"ReadSchema: struct<{columns}>" in plan and "Exchange" not in plan
