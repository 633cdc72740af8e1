"""Contracts of the training-data operators on rows made to break them."""

from __future__ import annotations

import hashlib
import io
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexarium.llm import fingerprint, html_extract, jaccard_join, mixing, packing, quality_rules, warc_revisit
from lexarium.llm import textbatch as tb

from . import brute
from .test_shapes import LONG, check_packing, copies

# ---- packing


def test_ids_of_added_tokens_and_long_runs():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a" * 9000 + " b", "<|endoftext", "plain", " " * 5000, "é<|endoftext|>é"]
    got = [x.tolist() for x in packing.encoder(packing.tokenizer_path()).encode(texts)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[0] and got[1] == [50256]


@pytest.mark.parametrize("change", ["coalesce", "repartition", "union"])
def test_sequences_stay_apart_however_the_result_is_dealt(spark, change):
    docs = spark.createDataFrame([(i, "some words of a text " * (i % 7 * 20 + 1)) for i in range(60)], "doc_id long, text string").repartition(5)
    packed = packing.pack(docs, setting=packing.Packing(pieces_per_task=8))
    if change == "union":
        packed = packed.where("doc_id % 2 = 0").unionByName(packed.where("doc_id % 2 = 1")).coalesce(2)
    else:
        packed = packed.coalesce(1) if change == "coalesce" else packed.repartition(3, "doc_id")
    check_packing(packed.toPandas(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_a_share_is_a_task(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string").repartition(4)
    packed = packing.pack(docs, setting=packing.Packing(pieces_per_task=10))
    found = packed.select(F.spark_partition_id().alias("task"), F.expr("sequence_id div 2 % 20").alias("share")).distinct().collect()
    assert len(found) == len({r["task"] for r in found}) == len({r["share"] for r in found}) == 20


def test_equal_rows_without_ids_are_dealt_out(spark):
    rows = [(None, "the same text")] * 40 + [(i, "the same text") for i in range(10)] + [(None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, setting=packing.Packing(pieces_per_task=8)).toPandas()
    check_packing(packed, rows)
    assert packed[packed.doc_id.isna() & (packed.length > 1)].sequence_id.nunique() > 1


def test_very_long_texts_are_cut_into_pieces():
    long = "word and the " * 400_000 + "<|endoftext|>"
    ids = next(iter(packing.encoder(packing.tokenizer_path()).encode([long])))
    plain = next(iter(packing.encoder(packing.tokenizer_path()).encode([long.removesuffix("<|endoftext|>")])))
    assert len(ids) > 1_000_000 and (ids[-1], len(ids)) == (50256, len(plain) + 1) and (ids[:-1] == plain).all()


# ---- near copies


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    """Sets under a name that others share go by their second one, and shared names are noticed."""
    texts = copies(5, 40)
    whole = jaccard_join.shingle_sets(tb.texts_of(pa.array(list(texts.values()), pa.string())), 4)
    assert len({*zip(whole.cls.tolist(), whole.alt.tolist(), strict=True)}) == len(set(whole.cls.tolist()))
    clash = np.sort(whole.cls[whole.size > 0][:2])
    again = jaccard_join.shingle_sets(tb.texts_of(pa.array(list(texts.values()), pa.string())), 4, clash)
    named = np.isin(whole.cls, clash)
    assert (again.cls[named] == whole.alt[named]).all() and (again.cls[~named] == whole.cls[~named]).all()

    # the first pass gives a third of all names as one: the classes must show that it has several second names
    real, name = jaccard_join._first_pass, int(whole.cls[whole.size > 0][0])
    monkeypatch.setattr(jaccard_join, "_first_pass", lambda docs, setting: real(docs, setting).withColumn("cls", F.when(F.col("cls") % 3 == 0, F.lit(name)).otherwise(F.col("cls"))))
    monkeypatch.setattr(jaccard_join, "MOST_CLASHES", 0)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    with pytest.raises(RuntimeError, match="clash"):
        jaccard_join.linked(docs, jaccard_join.Setting(n=4, least=85))


def test_keep_one_by_row_against_brute_force(spark):
    """Repeated and null ids of unlike texts, rows without words, columns of awkward names."""
    rnd = random.Random(4)
    texts = [t for t in copies(7, 30).values()] + ["", None, " ", "lone words", "other text here"]
    rows = [(rnd.choice([None, 1, 2, 3, 50]), t, rnd.choice("xy"), rnd.choice("pq")) for t in texts for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, Number string")
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs, jaccard_join.Setting(n=5, least=80)).collect())
    comps = brute.jaccard_components({i: r[1] for i, r in enumerate(rows)}, 5, 80)
    want = Counter()
    for comp in set(comps.values()):
        group = [rows[i] for i in comps if comps[i] == comp]
        best = min(group, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest() if r[1] is not None else "-"))
        want[best[0], best[1]] += 1
    assert got == want


def test_hot_copies_and_components_get_their_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MANY_COPIES", 3)
    texts = copies(9, 50)
    texts |= {100 + i: texts[3] for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(docs, jaccard_join.Setting(n=4, least=85)).collect()}
    assert got == brute.jaccard_components(texts, 4, 85)


# ---- mixing


def test_mixed_passes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", i, "k", f"x{i}") for i in range(5)], "doc_id long, text string, source string, _key long, skey string, Time string")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {(r["_key"], r["skey"], r["Time"]) for r in got.collect()} == {(i, "k", f"x{i}") for i in range(5)}


@pytest.mark.parametrize("copies", [1, 3, 1 << 16])
def test_mix_of_rows_without_ids(spark, monkeypatch, copies):
    monkeypatch.setattr(mixing, "COPIES", copies)
    rnd = random.Random(1)
    rows = [(rnd.choice([None, None, 7, i]), rnd.choice("ab"), rnd.choice([1, 2, 5])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(rows)
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        total, target = sum(r["size"] for r in mine), mine[0]["target"]
        # the mix in order of keys, row by row
        order = sorted(mine, key=lambda r: (hashlib.md5(str("null" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest(), r["doc_id"] or 0, r["size"]))
        epochs, left = int(target // total), int(target + 0.5)
        want, left = Counter(), left - epochs * total
        for r in order:
            more = max(0, min(r["size"], left))
            left -= r["size"]
            want[r["doc_id"], r["size"], epochs * r["size"] + more] += 1
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mine) == want


# ---- fingerprints


def test_successors_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 6)
    rnd = random.Random(2)
    rows = [(rnd.choice([None, None, 5, 5, 7, i]), rnd.choice(["", "same text here", f"text {rnd.randrange(20)} " * rnd.randrange(1, 9)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.fingerprint(docs).collect()
    import xxhash

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh3_64_intdigest(r[1])))
    want = Counter()
    for i, (name, text) in enumerate(order):
        follow = order[(i + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 4] + follow[: len(text) // 4]
        want[name, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert len(fingerprint._starts(docs)) > 5
    # a range is a task, so no task has more than one range's rows; equal rows stay together
    tasks = fingerprint.fingerprint(docs).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == len(fingerprint._starts(docs))


def plain_fingerprint(text, hashes=128):
    """Phrases by a dictionary walk, and the smallest hashes, with nothing of the module but its hash."""
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return sorted({int(h) for h in fingerprint._hashes(sorted(seen))})[:hashes]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc d", max_size=200), st.text(alphabet="abc d", max_size=200))
def test_fingerprints_equal_a_plain_walk(a, b):
    x, y = plain_fingerprint(a), plain_fingerprint(b)
    assert fingerprint.signature(fingerprint._hashes(fingerprint.phrases(a))).tolist() == x
    union = sorted({*x, *y})[:128]
    near = len({*x} & {*y} & {*union}) / len(union) if union else 1.0
    assert fingerprint.likeness(np.array(x, np.uint32), np.array(y, np.uint32)) == near


# ---- quality rules


@pytest.mark.parametrize("length", [40, 47, 48, 49, 64, 127, 300, 2000])
def test_repeats_of_any_length_are_told(length):
    """A passage that stands after three other words, and again after others."""
    rng = random.Random(length)
    passage = [f"p{rng.randrange(900)}" for _ in range(length)]
    texts = [" ".join(["x", "y", "z", *passage, f"u{i}", "v", *passage, "w"]) for i in range(3)] + [" ".join(passage), "one two", "a " * length]
    rows = quality_rules.measure(tb.texts_of(pa.array(texts))).to_pylist()
    assert [r["longest_repeat"] for r in rows[:3]] == [length] * 3 and rows[5]["longest_repeat"] == length - 1
    w = tb.words(tb.texts_of(pa.array(texts[:1])))
    got = quality_rules.longest_repeats(w.row, w.code)
    assert got[3] == length and got[3 + length + 2] == length and got[:3].tolist() == [0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b"]), max_size=120).map(" ".join), min_size=1, max_size=3))
def test_suffixes_are_in_order(texts):
    w = tb.words(tb.texts_of(pa.array(texts)))
    suffix = lambda p: (w.row[p], w.code[p : np.searchsorted(w.row, w.row[p], side="right")].tolist())
    got = quality_rules.suffix_array(w.row, w.code).tolist()
    assert got == sorted(range(len(w.code)), key=suffix)
    assert [quality_rules.longest_repeats(w.row, w.code)[w.row == i].tolist() for i in range(len(texts))] == [brute.repeats(t) for t in texts]


def test_long_repetitive_texts_take_bounded_memory():
    import subprocess
    import sys

    code = """
import resource, pyarrow as pa
from lexarium.llm import quality_rules, textbatch as tb
row = quality_rules.measure(tb.texts_of(pa.array(["word " * 4_000_000]))).to_pylist()[0]
assert row["n_repeat_words"] == 4_000_000 and row["longest_repeat"] == 3_999_999 and not row["kept"]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=200)
    assert int(got.stdout) < 1000


# ---- extraction

SALE = "SALE buy cheap pills now limited offer discount percent click order today free shipping worldwide best price deal"
WORDS = "one two three"
SHAPES = [
    (f"<article class='comment-on-the-news'><p>{LONG}</p></article>", [LONG]),
    (f"<article class='comment-body depth-2'><p>{LONG}</p></article><article><p>{LONG} too</p></article>", [f"{LONG} too"]),
    (f"<article><div class='ad-hoc-analysis'><p>{LONG}</p></div></article>", [LONG]),
    (f"<section id='login-tutorial'><p>{LONG}</p></section>", [LONG]),
    (f"<section class='menu-engineering'><p>{LONG}</p></section>", [LONG]),
    (f"<div class='notice-board'><p>{LONG}</p></div>", [LONG]),
    (f"<div class='notices-of-1848'><p>{LONG}</p></div>", [LONG]),
    (f"<article><p>{LONG}</p><div class='ad-slot-left'><p>{LONG} too</p></div><div id='mainMenu2'><p>{LONG}</p></div></article>", [LONG]),
    (f"<article><p>{LONG}</p><form><p>Your mail</p><p>Sign up now</p></form></article>", [LONG]),
    (f"<article class='post-12 category-social tag-comments'><p>{LONG}</p></article>", [LONG]),
    (f"<article><p title='a hidden gem'>{LONG}</p></article>", [LONG]),
    (f"<article><p data-id='ad-1'>{LONG}</p></article>", [LONG]),
    (f"<article><p>Some <a href='/x?id=comments'>anchor words</a> and {LONG}</p><p>{LONG} too</p></article>", [f"Some anchor words and {LONG}", f"{LONG} too"]),
    (f"<article><p>Some <a class='share'>anchor words</a> and {LONG}</p><p>{LONG} too</p></article>", [f"Some anchor words and {LONG}", f"{LONG} too"]),
    (f"<article><h2 class='share-prices'>Prices</h2><p>{LONG}</p></article>", ["Prices", LONG]),
    (f"<div><p>{LONG}</p><p>{SALE}</p><p>{LONG}</p></div>", [LONG, LONG]),
    (f"<div><p>{LONG}</p></div><div><p>{SALE}</p></div>", [LONG]),
    (f"<div class=x1><p>{LONG}</p><p>Short end.</p></div><div><a href=a>one link</a> <a href=b>two link</a></div>", [LONG, "Short end."]),
    (f"<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div><h1>Title</h1><p>{LONG}</p></div>", ["Title", LONG]),
    (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p><p>Short.</p></section></article>", [LONG, "Discussion", LONG, "Short."]),
    (f"<article><p>{LONG}</p><div class=share>Share this</div><p>{LONG}</p></article>", [LONG, LONG]),
    (f"<article><p>{LONG}</p><div class='related'><a href=a>{LONG}</a></div></article>", [LONG]),
    (f"<article><p>{LONG}</p><div class=legal><p>{LONG}</p></div></article>", [LONG, LONG]),
    (f"<div class=legal><p>{LONG}</p></div>", [LONG]),
    (f"<div class=copyright>All rights reserved</div><div><p>{LONG}</p></div>", [LONG]),
    (f"<article><p>{LONG}</p><ul><li>{WORDS}</li><li>four five</li></ul><p>{LONG}</p></article>", [LONG, WORDS, "four five", LONG]),
    (f"<div><p>{LONG}</p><ul><li>{WORDS}<li>four five</ul><p>{LONG}</p></div>", [LONG, WORDS, "four five", LONG]),
    (f"<article><p>{LONG}</p><pre>x = 1; y = 2; z = 3; for i in range(10): print(i, x, y, z) # some code line that runs on</pre></article>", [LONG, "x = 1; y = 2; z = 3; for i in range(10): print(i, x, y, z) # some code line that runs on"]),
    (f"<article><p>{LONG}<p>{LONG}<div class=advertisement>Buy</div></article>", [LONG, LONG]),
    (f"<article><p>{LONG}</p></article><div>{LONG}</div>", [LONG]),
    (f"<main><p>{LONG}</p><article class=comment><p>{LONG}</p></article></main>", [LONG]),
    (f"<main><p>{LONG}</p><div id=comments><p>{LONG}</p></div></main>", [LONG]),
    (f"<div class='no-sidebar with-nav'><p>{LONG}</p></div>", [LONG]),
    (f"<p>{LONG} <a href=x>link without an end<p>{LONG}", [f"{LONG} link without an end", LONG]),
    (f"<a href=x><div><p>{LONG}</p></div></a><p>{LONG} here</p>", [f"{LONG} here"]),
    (f"<article><p>{LONG}<span hidden>not seen</span> end</p><p style='display:none'>{LONG}</p></article>", [f"{LONG} end"]),
    (f"<p>{LONG} <button>Click</button> here <svg><text>no</text></svg></p>", [f"{LONG} here"]),
    (f"<article><h1>Only a title</h1></article>", ["Only a title"]),
    (f"<article>{'<p>abc def ghi jkl mno pqr stu vwx yz abc def ghi jkl mno pqr stu vwx yz abc def ghi jkl mno pqr</p>' * 2}</article>", ["abc def ghi jkl mno pqr stu vwx yz abc def ghi jkl mno pqr stu vwx yz abc def ghi jkl mno pqr"] * 2),
    (f"<table><tr><td>{LONG}</td><td>{WORDS}</td></tr></table>", [LONG, WORDS]),
    (f"<nav>{LONG}</nav><header>{LONG}</header><div role=banner>{LONG}</div><p>{LONG}</p><footer>{LONG}</footer><form><p>{LONG}</p></form>", [LONG]),
    (f"<article><header><h1>T</h1></header><p>{LONG}</p><footer>by me</footer></article>", ["T", LONG]),
    (f"<DIV CLASS='Sidebar'>{LONG}</DIV><DIV><P>{LONG}</P></DIV>", [LONG]),
    (f"<p CLASS=MainText>{LONG}</p><p aria-hidden=TRUE>{LONG}</p><p hidden=until-found>{LONG}</p>", [LONG, LONG]),
    (f"<div><h2>Before</h2><p>{LONG}</p><h2>After</h2><p><a href=a>{LONG}</a></p></div>", ["Before", LONG]),
]


@pytest.mark.parametrize(("page", "want"), SHAPES)
def test_shapes_of_pages(page, want):
    assert html_extract.main_text(page).split("\n") == want


def slow_labels(blocks, rules):
    """Both passes, block by block, with nothing carried along."""
    words = lambda t: ["".join(c for c in w if c.isalnum() or c in "'’").strip("'’").lower() for w in "".join(c if c.isalnum() or c in "'’" else " " for c in t).split()]
    share = lambda t: sum(w in html_extract.STOP_WORDS for w in words(t)) / max(1, len([w for w in words(t) if w]))
    own = sorted(share(b.text) for b in blocks if not b.other and not b.sparse and len(b.text) >= rules.long_chars and b.link_chars < rules.doubt_links * len(b.text))
    half = rules.page_part * (own[len(own) // 2] if own else 1)
    label = {}
    for i, b in enumerate(blocks):
        linky = b.link_chars >= (rules.doubt_links if b.doubt else rules.link_share) * len(b.text)
        if b.other or linky:
            label[i] = "bad"
        elif len(b.text) >= rules.long_chars:
            if share(b.text) >= min(rules.stop_share, half):
                label[i] = "good"
            elif b.doubt or (share(b.text) < min(rules.stop_least, half) and not b.sparse and not b.article):
                label[i] = "bad"
    out = dict(label)
    articles = any(b.article and label.get(i) == "good" for i, b in enumerate(blocks))
    for i, b in enumerate(blocks):
        if articles and not b.article:
            out[i] = "bad"
        if i in out:
            continue
        if b.doubt:
            pools = [[j for j in label if blocks[j].doubt == b.doubt]]
        else:
            pools = [[j for j in label if blocks[j].parent == b.parent], [j for j in label if blocks[j].article == b.article and not (blocks[j].article and (blocks[j].other or blocks[j].doubt))]]
        pool = next((p for p in pools if p), [])
        left, right = max((j for j in pool if j < i), default=None), min((j for j in pool if j > i), default=None)
        if "good" not in label.values():
            out[i] = "bad" if b.doubt else "good"
        elif left is None and right is None:
            out[i] = "good" if b.article and not b.doubt else "bad"
        elif left is None or right is None:
            out[i] = label[left if right is None else right]
        elif label[left] == label[right]:
            out[i] = label[left]
        elif i - left != right - i:
            out[i] = label[left if i - left < right - i else right]
        else:
            out[i] = label[right] if b.heading else "bad"
    return [out[i] for i in range(len(blocks))]


PARTS = ["<div>", "</div>", "<div class=related>", "<div class=ad>", "<article>", "</article>", "<ul>", "</ul>", "<li>x y</li>", f"<p>{LONG}</p>", f"<p>{SALE}</p>", "<p>short</p>", "<h2>head</h2>", f"<p><a href=a>{LONG}</a></p>", "<nav>", "</nav>", "<section>", "</section>", "<pre>code</pre>"]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=22).map("".join))
def test_passes_equal_slow_ones(page):
    rules = html_extract.Rules()
    blocks = html_extract.blocks_of(page)
    want = [b.text for b, label in zip(blocks, slow_labels(blocks, rules), strict=True) if label == "good"]
    assert html_extract.main_text(page) == "\n".join(want)


def test_passes_decide():
    """Without the passes, keeping all that isn't declared something else, most shapes come out otherwise."""
    kept = lambda page: [b.text for b in html_extract.blocks_of(page) if not b.other]
    plain = [(p, w) for p, w in SHAPES if "<article" not in p and "<main" not in p]
    assert sum(kept(p) != w for p, w in plain) >= 6


def test_very_long_pages_end_in_time():
    import time

    began = time.perf_counter()
    text = html_extract.main_text("<div>" * 50_000 + f"<p>{LONG}</p>" * 20_000 + "</span></section>" * 50_000 + "<p>" + "word and the " * 500_000)
    assert text.count(LONG) == 20_000 and time.perf_counter() - began < 30


# ---- revisits


def test_states_profiles_and_references(spark):
    rows = [
        (1, "http://a.example/", 10, "response", 200, None, None, None, {"etag": "1"}),
        (2, "http://a.example/", 20, "response", 404, None, None, None, {"etag": "2"}),
        (3, "http://a.example/", 22, "response", 206, None, None, None, {"etag": "2"}),
        (4, "http://a.example/", 24, "response", 200, "length", None, None, {"etag": "2"}),
        (5, "http://a.example/", 30, "revisit", 304, None, "http://netpreserve.org/warc/1.1/revisit/server-not-modified", None, {"etag": "1"}),
        (6, "http://a.example/", 30, "revisit", 200, None, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", None, {"etag": "1"}),
        (7, "http://a.example/", 40, "response", 200, None, None, None, {"etag": "3"}),
        (8, "http://a.example/", 50, "revisit", 304, None, None, 10, {"etag": "1"}),
        (9, "http://a.example/", 50, "revisit", 304, None, None, None, {"etag": "1"}),
        (10, "http://a.example/", 50, "revisit", 200, None, "", None, {}),
        (11, None, 50, "revisit", 304, None, None, None, {}),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, truncated string, profile string, refers_to_ts long, headers map<string,string>")
    for ranges in (1, 5):
        got = {r["record_id"]: (r["outcome"], r["response_id"], r["ts"]) for r in warc_revisit.resolve(df, ranges).collect()}
        assert got == {5: ("resolved", 1, 30), 6: ("other_profile", None, 30), 8: ("resolved", 1, 50), 9: ("mismatch", 7, 50), 10: ("other_profile", None, 50), 11: ("no_response", None, 50)}


def test_warc_files_stream(monkeypatch):
    import gzip

    monkeypatch.setattr(warc_revisit._Plain.__init__, "__defaults__", (64,))
    bodies = [b"x" * n for n in (0, 1, 63, 64, 65, 500, 5000)]
    records = [warc_revisit.write_record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, b) for i, b in enumerate(bodies)]
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        got = [(h["warc-record-id"], b if whole else None) for h, b, whole in warc_revisit.records_of(io.BytesIO(data), 1000)]
        assert got == [(f"<{i}>", b if len(b) <= 1000 else None) for i, b in enumerate(bodies)]
        cut = [h["warc-record-id"] for h, *_ in warc_revisit.records_of(io.BytesIO(data[:-20]), 1000)]
        assert cut in ([f"<{i}>" for i in range(6)], [f"<{i}>" for i in range(len(cut))])
    assert list(warc_revisit.records_of(io.BytesIO(b""))) == [] and list(warc_revisit.records_of(io.BytesIO(b"no record"))) == []


def test_warc_dates():
    assert warc_revisit.micros("1970-01-01T00:00:01.5Z") == 1_500_000 == warc_revisit.micros("1970-01-01T00:00:01.500000")
    assert warc_revisit.micros("1970-01-01T01:00:00+01:00") == 0 and warc_revisit.micros("soon") is None and warc_revisit.micros(None) is None
