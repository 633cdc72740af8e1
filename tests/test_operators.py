"""Rules of single operators, on rows written by hand."""

from __future__ import annotations

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexarium.facade import Library, backoff, retry_after
from lexarium.functions import text
from lexarium.operators import chunking, evaluation, graph, markdown, redaction, search, sync


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a b cd", ["cd"]), ("fine-tuning is great", ["fine-tuning", "great"]), ("<b>bold</b> move", ["bold", "move"]), ("x ```code here``` after", ["after"]), ("", []), ("snake_case the", ["snake_case"])],
)
def test_tokens(spark, raw, want):
    assert one(spark, text.tokens(F.col("t")), t=raw) == want


def pages(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def test_title_beats_body_and_rare_terms_weigh_more(spark):
    docs = pages(spark, a='---\ntitle: "Fine Tuning Guide"\n---\nOther words entirely here', b='---\ntitle: "Other"\n---\nFine tuning is covered here, in words', c="# Common\nwords words")
    lib = Library(spark, docs)
    assert [r["path"] for r in lib.search_docs("fine tuning").collect()] == ["a", "b"]
    assert lib.search_docs("").collect() == []
    df = search.term_stats(search.postings(docs, "path", text.page_tokens(F.col("content"))))
    idf = {r["token"]: r["i"] for r in df.select("token", search.idf(F.lit(3), F.col("df")).alias("i")).collect()}
    assert idf["covered"] > idf["words"]


def test_limit_and_repeated_query_tokens(spark):
    docs = pages(spark, **{f"d{i:02}": "keyword content" for i in range(20)})
    lib = Library(spark, docs)
    found = lib.search_docs("keyword", 5).collect()
    assert [r["path"] for r in found] == [f"d{i:02}" for i in range(5)]
    assert math.isclose(lib.search_docs("keyword keyword", 1).first()["score"], 2 * found[0]["score"], abs_tol=2e-4)


def test_backend_falls_back(spark):
    docs = pages(spark, a="# Agents\nagents run")

    def broken(query, limit):
        raise RuntimeError("down")

    assert Library(spark, docs, backend=broken).search_docs("agents").count() == 1


def test_library_lookup_and_sections(spark):
    docs = pages(spark, **{"agents/overview": "# Agents\nx", "index": "y"})
    lib = Library(spark, docs, [{"group": "Start", "pages": ["index", {"group": "Agents", "pages": ["agents/overview"]}]}])
    assert lib.get_doc("/overview.mdx").first()["path"] == "agents/overview"
    assert [(r["path"], r["title"]) for r in lib.get_section("agents").collect()] == [("agents/overview", "Agents")]
    assert {r["value"]: r["n"] for r in lib.list_sections().collect()} == {"Start": 2, "Agents": 1}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\nX", max_size=400), st.integers(12, 60), st.integers(0, 8))
def test_chunks_are_bounded_and_lose_nothing(body, most, overlap):
    pieces = chunking.split_with_overlap(body, most, overlap)
    assert all(len(p) <= most for p in pieces)
    if overlap == 0 and len(body) > most:
        assert "".join("".join(pieces).split()) == "".join(body.split())


def test_oversize_sentence_and_empty_text():
    pieces = chunking.split_with_overlap("Intro sentence. " + "X" * 500, 100, 10)
    assert max(map(len, pieces)) <= 100
    assert "".join(pieces).count("X") == 500
    assert chunking.split_with_overlap("", 100, 10) == [""]


def test_chunk_rows(spark):
    docs = pages(spark, p='---\ntitle: "T"\n---\n## One\nbody one\n## Two\nbody two\n')
    rows = chunking.chunks(docs, "path", "content").orderBy("heading").collect()
    assert [(r["heading"], r["content"]) for r in rows] == [("One", "T > One\n\n## One\nbody one"), ("Two", "T > Two\n\n## Two\nbody two")]
    assert all(len(r["content_hash"]) == 64 for r in rows)


def test_batches_are_filled_in_order(spark):
    plan = spark.createDataFrame([(1, "i1", "a", 4), (2, "i2", "b", 6), (3, "i3", "c", 1), (4, "i4", "d", 9)], "seq int, id string, path string, payload_bytes long")
    got = sync.planned_batches(plan, 2, 10)
    assert [r["batch_no"] for r in got.orderBy("seq").collect()] == [1, 1, 2, 2]
    assert sync.assigned_once(plan, got).count() == 0
    with pytest.raises(Exception, match="above 2 and 5"):
        sync.planned_batches(plan, 2, 5).collect()


def test_paths_that_cover_each_other_stay_together(spark):
    plan = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (3, "a/b", 1), (4, "y", 1)], "seq int, path string, payload_bytes long")
    got = {r["path"]: r["batch_no"] for r in sync.planned_batches(plan, 3, 100).collect()}
    assert got == {"a": 1, "x": 1, "a/b": 1, "y": 2}


def test_sync_plan_order_and_payload(spark):
    inv = lambda rows: spark.createDataFrame(rows, "path string, bytes long, sha256 string")
    source, target = inv([("new", 4, "a"), ("mod", 3, "b"), ("same", 2, "c")]), inv([("mod", 4, "z"), ("same", 2, "c"), ("gone", 7, "d"), ("keep/x", 9, "e")])
    plan = sync.tree_plan(source, target, [("directory", "keep")]).orderBy(sync.decision_order(F.col("decision")), "path").collect()
    assert [(r["decision"], r["path"], r["payload_bytes"]) for r in plan] == [("add", "new", 4), ("modify", "mod", 7), ("remove", "gone", 7), ("preserve", "keep/x", 0)]


@pytest.mark.parametrize(("passed", "total", "want"), [(849, 1000, "fail"), (85, 100, "pass"), (0, 0, "fail")])
def test_gate_is_inclusive(spark, passed, total, want):
    rows = spark.range(total).select((F.col("id") < passed).alias("ok"))
    assert evaluation.gate(rows, "ok", 0.85).first()["decision"] == want


def test_scoreboard_bands_and_rankings(spark):
    rows = spark.createDataFrame([("m1", "a", 0.933), ("m1", "b", 0.949), ("m2", "a", 0.882), ("m2", "b", 0.868)], "model string, server string, mean double")
    got = evaluation.rankings_agree(rows, "model", "mean", "server").first()
    assert (got["n_groups"], got["n_orders"], got["agree"]) == (2, 2, False)


def test_long_chains_are_followed_to_their_end(spark):
    n = 25
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(n)]
    ring = [(f"r{i:02}", f"r{(i + 1) % n:02}") for i in range(n)] + [("into", "r03")]
    got = {r["source"]: r["final"] for r in graph.resolved_aliases(spark.createDataFrame(chain + ring, "source string, destination string")).collect()}
    assert got == {s: f"c{n:02}" for s, _ in chain} | {s: None for s, _ in ring}
    edges = spark.createDataFrame(chain[:14], "source string, target string")
    assert {(r["root"], r["node"], r["depth"]) for r in graph.closure(edges).collect()} == {(f"c{i:02}", f"c{j:02}", j - i) for i in range(14) for j in range(i + 1, 15)}


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")], "source string, target string")
    assert {(r["root"], r["node"], r["depth"]) for r in graph.closure(edges).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("c", "b", 2)}


PAGE = """---
title: "T"
titleSuffix: S
---
# T

> [!NOTE]
> careful <x> {y}

| a | b |
|---|
| 1 | 2 |

```python
x = {1} <!-- keep --> | a |
```

# [One](#tab/1)
first
# [Two](#tab/2)
second
---
after <br> end

::: zone pivot="py"
p
::: zone-end

::: zone pivot="js"
j
::: zone-end
"""


def test_page_conversion():
    made = markdown.page(PAGE, markdown.standard_steps({"py": "Python"}))
    assert made.startswith('---\ntitle: "T"\nsidebarTitle: "T"\n---\n')
    for part in ("<Note>", "careful &lt;x> \\{y\\}", "| --- | --- |", "x = {1} <!-- keep --> | a |", '<Tab title="Two">', "<br />", '<ZonePivot group="js__py"', '"title": "Python"', '<ZoneContent group="js__py" value="js"'):
        assert part in made, part
    assert made.count("<ZonePivot") == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["text\n", "```\n", "```py\n", "~~~\n", "{/* c */}", "{/*", "*/}", "| a | b |\n", "|---|\n", "`x`", "\n"]), max_size=12).map("".join))
def test_splitting_joins_back_and_tables_settle(raw):
    assert "".join(markdown.split_protected(raw)) == raw
    fixed = markdown.in_prose(markdown.tables)(raw)
    assert markdown.in_prose(markdown.tables)(fixed) == fixed


@pytest.mark.parametrize(
    ("raw", "gone"),
    [("ghp_abcDEF123", "ghp_abc"), ("api_key: 'zzz'", "zzz"), ("Authorization: Bearer abc\n folded", "folded"), ("eyJhbGciOi.eyJzdWIiOi.SflKxwRJSM", "eyJ"), ("C:\\secret\\x", "secret"), ("a=1&sig=abcd", "abcd")],
)
def test_redaction(raw, gone):
    assert gone not in redaction.redacted(raw)[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("authorization = Basic dXNlcjpwYXNz more", "Authorization=[REDACTED]"),
        ('log {"authorization": "Basic abc", "x": 1}', "log Authorization=[REDACTED]"),
        ("x %61uthorization%3A Basic abc\nnext", "[REDACTED]\nnext"),
        ("%61uthorization%3A\n folded secret\nnext", "[REDACTED]\nnext"),
        ("a=%2Fhome%2Fme%2Fsecret.txt.", "<PATH>."),
        ("%2541%2542 stays", "%2541%2542 stays"),
        ("a\x001\x00b", "a\x001\x00b"),
        ("https://me:pw@h.example/x?id_token=1&a=2#code=3", "https://[REDACTED]@h.example/x?id_token=[REDACTED]&a=2#code=[REDACTED]"),
        ("[d](/docs/a) and /docs/b but '/home/x y/z' and ~/f", "[d](/docs/a) and /docs/b but '<PATH>' and <PATH>"),
        ("%" + "25" * 30 + "41", "[REDACTED]"),
    ],
)
def test_answers_keep_links_and_nothing_secret(raw, want):
    assert redaction.linked(raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('password="a ghp_abcDEF123 b", then', "password=[REDACTED], then"),
        ("token=https://h.example/x?y=1 end", "token=[REDACTED] end"),
        ("see https://h.example/a?sig=x)y and token=z.", "see https://h.example/a?sig=[REDACTED])y and token=[REDACTED]."),
        ("https://h.example/p/ghp_abcDEF123/q#/r?code=1&b=2", "https://h.example/p/[REDACTED]/q#/r?code=[REDACTED]&b=2"),
        ("https://h.example/a%20b?q=%74oken%3Dabc", "https://h.example/a b?q=[REDACTED]"),
        ("https://h.example/a?b=c#d.", "https://h.example/a?b=c#d."),
        ("//host/share/f and \\\\host\\s\\g", "<PATH> and <PATH>"),
    ],
)
def test_spans_that_overlap_hide_all_they_cover(raw, want):
    assert redaction.linked(raw) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ghp_S3CRETabc ", "password=S3CRET ", "https://u:S3CRET@h.example/x?token=S3CRET ", "Authorization: S3CRET\n", "%74oken%3DS3CRET ", "plain words, ", "'/home/S3CRET/x' ", "(", '"', "\n\t", "Bearer S3CRET ", "pat=S3CRET. "]), max_size=8).map("".join))
def test_no_mix_of_secrets_shows_one(raw):
    for shown in (redaction.linked(raw), redaction.redacted(raw)[0]):
        assert "S3CRET" not in shown
    assert redaction.linked(redaction.linked(raw)) == redaction.linked(raw) or "%" in raw


def test_spans_are_put_in_one_pass():
    span = redaction.Span
    assert redaction.shown("0123456789", [span(2, 4, "A"), span(3, 6, "B"), span(6, 7, "C"), span(8, 8, "+")]) == "01AC7+89"
    assert redaction.shown("0123456789", [span(0, 10, "all"), span(1, 2, "x"), span(0, 3, "y")]) == "all"


def test_diagnostics_hide_assignments_and_paths():
    assert redaction.redacted("authorization = Basic dXNlcjpwYXNz more")[0] == "Authorization=[REDACTED]"
    assert redaction.redacted("at /srv/x, D:\\a\\b; in /work", places=(("/work", "<ROOT>"),))[0] == "at <PATH>, <PATH>; in <ROOT>"


def test_visible_text_shapes():
    page = "<head><title>T</title></head><svg><text>s</text></svg><!-- c --><article>A &amp; B<style>x{}</style></article> out <main>M<article>N</article></main><template>t</template>"
    assert redaction.visible_text(page) == "A & B M N"
    assert redaction.visible_text("<p>1 &lt; 2</p><script>never ends") == "1 < 2"


def test_redaction_bounds_and_nesting():
    assert redaction.redacted("y " * 9000, 100) == ("y " * 50 + "...[truncated]", True)
    got = redaction.nested({"password": "x", "input": [1], "deep": {"a": {"b": {"c": 1}}}, "list": list(range(30)), "n": float("nan")})
    assert got["password"] == "[REDACTED]" and got["input"] == "[OMITTED]" and len(got["list"]) == 21 and got["n"] is None
    assert got["deep"]["a"]["b"] == "[truncated-depth]" or got["deep"]["a"]["b"]["c"] == "[truncated-depth]"


def test_visible_text():
    assert redaction.visible_text("<p>all</p><main>only <b>this</b><script>no</script></main>") == "only this"
    assert redaction.visible_text("<p>all</p><style>x</style>") == "all"


def test_retry_helpers():
    assert retry_after("3") == 3
    assert retry_after("Thu, 01 Jan 1970 00:00:10 GMT", now=4) == 6
    assert retry_after("soon") is None and retry_after(None) is None
    assert [backoff(i) for i in (1, 2, 3)] == [1, 2, 4]
    assert backoff(9, most=30) == 30 and backoff(1, told=7) == 7


def test_hash_embeddings_are_unit_vectors(spark):
    from lexarium.operators import records

    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (["a", "b", "a"],)], "t array<string>")
    rows = [r["e"] for r in df.select(records.hashed_embedding(F.col("t"), 16).alias("e")).collect()]
    assert rows[0] == rows[2] and len(rows[0]) == 16 and math.isclose(sum(x * x for x in rows[0]), 1)
    assert rows[1] == [0.0] * 16


def test_plans_prune_columns_and_limit_groups_early(spark, small):
    from lexarium import registry

    plan = registry.QUERIES["bm25_topk"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*kind", plan) and "EqualTo(token" in plan and "WindowGroupLimit" in plan and "documents" not in plan
    plan = registry.QUERIES["bm25_unindexed"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    plan = registry.QUERIES["content_hash"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "source:string" not in plan


def test_a_page_is_split_once_however_many_lines_it_has(spark):
    """A long page of one section, and one of many: seconds, not hours; sections as a plain walk over the lines cuts them."""
    import re
    import time

    from lexarium.functions import text
    from lexarium.operators import chunking

    lines = [f"## head {i}" if i % 50 == 0 else ("####\tdeep" if i % 77 == 0 else "##") if i % 7 == 0 else f"line {i} of it" for i in range(40_000)]
    pages = [(1, "\n".join(lines)), (2, "\r\n".join(["no heading"] * 40_000)), (3, "##\nx\x0b## y   ##### z\n#### \n"), (4, None), (5, "")]
    began = time.perf_counter()
    got = {(r["k"], r["section"]): (r["heading"], r["body"]) for r in chunking.sections(spark.createDataFrame(pages, "k int, t string"), "k", "t").collect()}
    assert time.perf_counter() - began < 60
    want = {}
    for key, page in pages:
        parts: list[list[str]] = []
        for line in re.split(text.LINE_BREAK, page) if page is not None else ():
            if not parts or re.match(r"#{2,4}[ \t]", line):
                parts.append([])
            parts[-1].append(line)
        bodies = [(re.sub(r"^#{2,4}[ \t]+", "", p[0]).strip() if re.match(r"#{2,4}[ \t]", p[0]) else "", "\n".join(p).strip(" \t\n\x0b\f\r")) for p in parts]
        want |= {(key, i): (h or "Introduction", b) for i, (h, b) in enumerate(x for x in bodies if x[1])}
    assert got == want


def test_walks_end_soon_and_lone_ways_meet_nothing_known(spark, monkeypatch):
    """Random graphs with cycles, lone ways and branches against a plain walk; rounds go with the depth of walks, not with their number."""
    import random

    from lexarium.operators import graph

    cuts = []
    monkeypatch.setattr(graph, "_cut", lambda df, cut=graph._cut: cuts.append(1) or cut(df))
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(f"a{i}", f"a{i // 2}") for i in range(2, 60)] + [(f"c{i}", f"c{i + 1}") for i in range(21)]
        edges += [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("a1", "b0"), ("c21", "b3")][: 7 - seed]
        edges += [(f"b{rng.randrange(12)}", f"b{rng.randrange(12)}") for _ in range(14)]
        out = {}
        for a, b in edges:
            out.setdefault(a, set()).add(b)
        want = set()
        for root in out:
            seen, now, depth = {root}, {root}, 0
            while now:
                depth += 1
                now = {b for a in now for b in out.get(a, ())} - seen
                seen |= now
                want |= {(root, node, depth) for node in now}
        got = [tuple(r) for r in graph.closure(spark.createDataFrame(edges, "source string, target string")).select("root", "node", "depth").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        at = {a: min(b) for a, b in out.items()}
        final = {}
        for a in at:
            node, seen = a, set()
            while node in at and node not in seen:
                seen.add(node)
                node = at[node]
            final[a] = None if node in at else node
        assert {r["source"]: r["final"] for r in graph.resolved_aliases(spark.createDataFrame(edges, "source string, destination string")).collect()} == final
    cuts.clear()
    many = spark.range(20_000).selectExpr("concat('r', id) AS source", "concat('t', id % 7) AS destination")
    found = graph.resolved_aliases(many.unionByName(spark.createDataFrame([("p", "q"), ("q", "p")], "source string, destination string")))
    assert len(cuts) <= 4 and found.where("final IS NULL").count() == 2
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_assignments_are_found_as_by_their_shape():
    """Only places before a sign are tried: the same matches as those of the whole shape, and none of its work on words without a secret's name."""
    import random
    import time

    from lexarium.operators import redaction

    rng = random.Random(3)
    bits = ["token", "api_key", "Api-Key", "client_secret", "sig", "signature", "authorization", "=", ":", "=", " ", "\n", "'", '"', "x", "_", "-", "9", "a" * 100, "b" * 129, "é", "ſecret", "abc", "}", ",", "."]
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert [m.span() for m in redaction.assignments(text)] == [m.span() for m in redaction.ASSIGNMENT.finditer(text)]
    prose = ("some_longer_words_" * 7 + " and-more of them: ") * 5_000
    began = time.perf_counter()
    assert redaction.secrets(prose) == []
    assert time.perf_counter() - began < 3
