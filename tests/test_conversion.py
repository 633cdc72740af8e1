"""Page conversion, landed sources, campaigns and reports."""

from __future__ import annotations

import json
import os

import pytest

from lexarium import campaign, reports
from lexarium.facade import Library
from lexarium.operators import evaluation, index, markdown, search
from lexarium.sources import files, landed

# ---- conversion


def test_includes_are_resolved_where_they_stand(spark):
    pages = spark.createDataFrame([("docs/a/p.md", "x [!INCLUDE [one](../../inc/one.md)] [!INCLUDE [no](gone.md)]."), ("q.md", "plain")], "path string, content string")
    includes = spark.createDataFrame([("inc/one.md", "---\ntitle: t\n---\nONE [!INCLUDE [two](sub/two.md)]"), ("inc/sub/two.md", "TWO [!INCLUDE [loop](two.md)]")], "path string, content string")
    got = {r["path"]: r["content"] for r in markdown.inlined(pages, includes).collect()}
    assert got["q.md"] == "plain" and got["docs/a/p.md"].startswith("x ONE TWO TWO") and got["docs/a/p.md"].endswith(" .")


def test_samples_keep_their_indent(spark):
    pages = spark.createDataFrame([("p", '- item\n  :::code language="python" source="~/s/a.py" id="x":::\n:::code language="js" source="~/s/none.js":::')], "path string, content string")
    samples = spark.createDataFrame([("s/a.py", "x = 1\n\ny = $2\n")], "path string, content string")
    (row,) = markdown.with_samples(pages, samples).collect()
    assert row["content"] == "- item\n  ```python\n  x = 1\n\n  y = $2\n  ```\n```js\n// Source: none.js (not available)\n```"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("[a](b.md#x)", "[a](/out/b#x)"), ("[a](c.md?q=1)", "[a](c)"), ("![a](b.md)", "![a](b.md)"), ("[a](https://x.example/y?z=1)", "[a](https://x.example/y?z=1)"), ("[a](#)", "a"),
        ("[a](#part)", "[a](#part)"), ("[a](/site/x)", "[a](https://s.example/site/x)"), ("[a](../../other/z/w.md#k)", "[a](https://s.example/en/other/z/w#k)"), ("[a](..\\f\\g.md)", "[a](../f/g)"), ("[a](file.png)", "[a](file.png)"),
    ],
)
def test_links(raw, want):
    site = markdown.Site("https://s.example", ("/site/",), ("other",), "/en")
    assert markdown.links({"b.md": "out/b"}, site)(raw) == want


def test_link_targets_come_by_join(spark):
    pages = spark.createDataFrame([("docs/a.md", "[x](b.md#h) [y](../c.md) ![i](b.md) [z](d.md)")], "path string, content string")
    routes = spark.createDataFrame([("docs/b.md", "s/b"), ("c.md", "s/c")], "source_path string, output_path string")
    assert markdown.link_outputs(pages, routes).first()["outputs"] == {"b.md": "s/b", "../c.md": "s/c"}
    made = markdown.converted(pages, "path", "content", routes=routes, includes=spark.createDataFrame([], "path string, content string")).first()["page"]
    assert "[x](/s/b#h) [y](/s/c)" in made and "[z](d)" in made


CODE_TABS = "# [One](#tab/1)\n```python\na = 1\n```\n# [Two](#tab/2)\n```js\nb = 2\n```\n---\nafter"


def test_code_only_tabs_are_code_groups():
    got = markdown.code_groups(markdown.tabs(CODE_TABS))
    assert got == "<CodeGroup>\n```python One\na = 1\n```\n\n```js Two\nb = 2\n```\n</CodeGroup>\nafter"
    mixed = markdown.tabs(CODE_TABS.replace("a = 1\n```", "a = 1\n```\nand a sentence that is longer than that"))
    assert markdown.code_groups(mixed) == mixed
    titled = markdown.code_groups(markdown.tabs(CODE_TABS.replace("```python", "```python own.py")))
    assert "```python own.py\n" in titled


def test_components_leave_list_items():
    raw = "1. step\n   <Note>\n   inside\n   </Note>\n   more\n2. next\n   <Tip>one line</Tip>\ntext\n  <Note>\n  stays\n  </Note>"
    assert markdown.list_components(raw) == "1. step\n\n<Note>\ninside\n</Note>\n\n   more\n2. next\n\n<Tip>one line</Tip>\n\ntext\n  <Note>\n  stays\n  </Note>"
    assert markdown.list_components("- a\n  <Frame>\n  open") == "- a\n\n<Frame>\nopen"


def test_zones_have_values_and_their_import():
    raw = "::: zone pivot=\"b\"\nB\n::: zone-end\n\n::: zone pivot=\"a\"\nA\n::: zone-end"
    got = markdown.zone_import(markdown.zones({"a": "Ay"})(raw))
    assert got.startswith('import { ZoneContent, ZonePivot } from "/snippets/zone-pivot.jsx"\n\n<ZonePivot group="a__b"')
    assert 'values={["b", "a"]}' in got and '"title": "Ay"' in got and got.count("import ") == 1
    assert markdown.zone_import("no zones") == "no zones" and markdown.group_name(["x y", "!"]) == "x-y" or markdown.group_name(["!"]) == "default"


def test_block_kinds():
    step = markdown.quoted_blocks
    assert step('> [!div class="nextstepaction"]\n> [Go](x.md)\n') == '<Card title="Go" icon="arrow-right" href="x.md" />'
    assert step('> [!div class="checklist"]\n> * a\n> - b\n') == "- a\n- b"
    assert '<Tab title="T">' in step('> [!div class="op_single_selector"]\n> - [T](t.md)\n')
    assert markdown.columns(":::row:::\n:::column span=\"\":::\nL\n:::column-end:::\n:::column:::\nR\n:::column-end:::\n:::row-end:::\n") == "<Columns cols={2}>\n<Card>\n\nL\n\n</Card>\n<Card>\n\nR\n\n</Card>\n</Columns>\n"
    assert markdown.code_references("[!code-csharp[Main](~/s/Program.cs?highlight=2)]") == "```csharp\n// See: Program.cs\n```"


def test_question_lists():
    text = "### YamlMime:FAQ\nmetadata:\n  title: T \"q\"\n  description: about\nsections:\n- name: S\n  questions:\n  - question: Why?\n    answer: |\n      Because.\n- questions: []\n"
    assert markdown.faq_page(text) == '---\ntitle: "T \\"q\\""\ndescription: "about"\n---\n\n## S\n\n### Why?\n\nBecause.\n'
    assert markdown.faq_page("") is None and markdown.faq_page("a: [") is None


# ---- landed sources


def test_tables_of_contents_follow_sub_tables(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "toc.yml").write_text("items:\n- name: Start\n  href: index.md\n- name: Agents\n  href: sub/toc.yml\n- name: Gone\n  href: none/toc.yml\n- name: Header\n")
    (tmp_path / "docs" / "sub" / "toc.yml").write_text("items:\n- name: A\n  href: a.md?x=1\n  items:\n  - name: B\n    href: ../b.md#y\n  - name: S\n    href: /site/z\n- name: W\n  href: https://w.example\n")
    toc = landed.read_toc_tree(spark, str(tmp_path), "docs/toc.yml")
    assert [(r["name"], r["section"], r["hierarchy"]) for r in toc.orderBy("seq").collect()] == [("Start", "Start", ["Start"]), ("A", "Agents", ["Agents", "A"]), ("B", "Agents", ["Agents", "A", "B"]), ("S", "Agents", ["Agents", "A", "S"]), ("W", "Agents", ["Agents", "W"])]
    rows = landed.manifest_of(toc, own=("/own/",), other=("/site/",), site="https://s.example", slugs={"Agents": "agents"}).orderBy("seq").collect()
    assert [(r["category"], r["source_path"], r["output_path"]) for r in rows] == [("page", "docs/index.md", "start/index"), ("page", "docs/sub/a.md", "agents/a"), ("page", "docs/b.md", "agents/b"), ("other-repository", "/site/z", None), ("external", "https://w.example", None)]
    assert rows[3]["url"] == "https://s.example/site/z"


def test_pivot_titles_and_fallback_files(spark, tmp_path):
    assert landed.pivot_titles("### YamlMime:Groups\ngroups:\n- pivots:\n  - {id: py, title: Python }\n  - {id: py, title: Other}\n  - {id: x}\n") == {"py": "Python"}
    assert landed.pivot_titles(None)["python"] == "Python" and landed.pivot_titles("bad: [", {"a": "A"}) == {"a": "A"}
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "a.md").write_text("first")
    (tmp_path / "two" / "a.md").write_text("second")
    (tmp_path / "two" / "b.md").write_text("only")
    wanted = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",)], "path string")
    got = {r["path"]: (r["content"], r["root"]) for r in landed.files_with_fallback(spark, wanted, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()}
    assert got == {"a.md": ("first", str(tmp_path / "one")), "b.md": ("only", str(tmp_path / "two")), "c.md": (None, None)}


def test_navigation_pulls_and_issues(spark, tmp_path):
    config = {"navigation": {"tabs": [{"tab": "T", "groups": [{"group": "G", "pages": ["p"]}]}]}, "redirects": [{"source": "/a", "destination": "/b"}]}
    (tmp_path / "docs.json").write_text(json.dumps(config))
    nav, redirects = landed.read_navigation(spark, [str(tmp_path / "none.json"), str(tmp_path / "docs.json")])
    assert [r["value"] for r in nav.orderBy("node_id").collect()] == ["T", "G", "p"] and redirects.collect()[0]["destination"] == "b"
    assert landed.read_navigation(spark, ["/nowhere.json"])[0].collect() == []
    pull = {"number": 1, "title": "t", "url": "u", "state": "OPEN", "createdAt": "c", "mergedAt": None}
    (tmp_path / "l1.json").write_text(json.dumps([pull | {"labels": [{"name": "x"}]}]))
    (tmp_path / "l2.json").write_text(json.dumps([pull | {"labels": [{"name": "y"}]}, {"number": 2, "labels": []}]))
    got = landed.read_pulls(spark, [str(tmp_path / "l1.json"), str(tmp_path / "l2.json")]).orderBy("number").collect()
    assert [(r["number"], r["label_names"]) for r in got] == [(1, ["x", "y"]), (2, [])]
    (tmp_path / "issues.json").write_text('[{"number": 3, "body": "b"}]')
    assert landed.read_issues(spark, str(tmp_path / "issues.json")).first()["body"] == "b"
    for bad in ("{}", "no", '[{"number": "3"}]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError, match="holds no"):
            landed.read_issues(spark, str(tmp_path / "bad.json"))


def test_large_events_are_projected(spark):
    rows = spark.createDataFrame([('{"type": "a", "data": {"big": "x", "n": 1}}',), ('{"type": "b", "data": {"big": "' + "y" * 600 + '", "n": 2}}',), ("nope",)], "line string")
    from pyspark.sql import functions as F

    e = landed.projected_event(F.col("line"), "type string, data struct<n:int>", 500)
    got = rows.select(e.alias("e")).select("e.large", "e.fields.type", "e.fields.data.n", F.col("e.whole").isNotNull().alias("whole")).collect()
    assert [tuple(r) for r in got] == [(False, "a", 1, True), (True, "b", 2, False), (False, None, None, False)]


# ---- hooks


def test_embedding_and_rerank_hooks(spark):
    rows = spark.createDataFrame([(i, f"t{i}" * i) for i in range(7)] + [(9, None)], "id int, t string")
    got = {r["id"]: r["v"] for r in search.embedded(rows, "t", "v", lambda texts: [[len(t)] for t in texts], batch=2).collect()}
    assert got == {i: [2.0 * i] for i in range(7)} | {9: [0.0]}
    with pytest.raises(Exception, match="vectors for"):
        search.embedded(rows, "t", "v", lambda texts: []).collect()
    found = spark.createDataFrame([(1, 1, "a", "q"), (1, 2, "ccc", "q"), (1, 3, "bb", "q")], "query_id int, rank int, text string, q string")
    best = search.reranked(found, "q", "text", lambda qs, ts: [len(t) for t in ts], 2).orderBy("rank").collect()
    assert [(r["rank"], r["text"]) for r in best] == [(1, "ccc"), (2, "bb")]


def test_chunk_table_is_brought_up_to_date(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunk = lambda rows: spark.createDataFrame([(k, "p", "t", "d", "h", c, str(hash(c))) for k, c in rows], "chunk_id string, path string, title string, description string, heading string, content string, content_hash string")
    embed = lambda texts: [[float(len(t))] for t in texts]
    assert index.synced(spark, path, chunk([("a", "x"), ("b", "y")]), embed)["new"] == 2
    again = chunk([("a", "x"), ("b", "yy"), ("c", "z")])
    assert index.synced(spark, path, again, embed, dry_run=True) == {"new": 1, "changed": 1, "unchanged": 1, "deleted": 0}
    index.synced(spark, path, again, embed)
    now = files.current(spark, path)
    assert {r["chunk_id"]: r["embedding"] for r in index.chunks_of(spark, path).collect()} == {"a": [1.0], "b": [2.0], "c": [1.0]}
    assert index.synced(spark, path, again, embed)["unchanged"] == 3 and files.current(spark, path) == now
    assert index.synced(spark, path, chunk([("a", "x")]), embed, recreate=True)["new"] == 1


def test_hybrid_search_over_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    embed = lambda texts: [[float(t.count("a")), float(t.count("z")), 0.1] for t in texts]
    assert index.create(spark, path) and not index.create(spark, path)
    rows = [("c1", "p1", "Deploy", "quota limits here"), ("c2", "p1", "Deploy", "a a a a"), ("c3", "p2", "Other", "z z z z zebra"), ("c4", "p3", "Throttle", "throttle everything")]
    chunks = spark.createDataFrame([(c, p, t, "d", "h", x, x) for c, p, t, x in rows], "chunk_id string, path string, title string, description string, heading string, content string, content_hash string")
    index.synced(spark, path, chunks, embed)
    asked = spark.createDataFrame([("q1", "rate limit"), ("q2", "zebra zz"), ("q3", "the of")], "query_id string, q string")
    lexical = [(r["query_id"], r["rank"], r["path"], r["chunk_id"]) for r in index.hybrid(spark, path, asked, 5).orderBy("query_id", "rank").collect()]
    assert [x[:3] for x in lexical] == [("q1", 1, "p3"), ("q1", 2, "p1"), ("q2", 1, "p2")] and lexical[1][3] == "c1"
    both = index.hybrid(spark, path, asked, 2, embed).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in both} == {"q1", "q2", "q3"} and max(r["rank"] for r in both) == 2
    assert next(r["path"] for r in both if r["query_id"] == "q2" and r["rank"] == 1) == "p2"


def test_resources_prompts_and_backends(spark, caplog):
    pages = spark.createDataFrame([("a/b/c", "# T\ntext")], "path string, content string")

    class Other:
        def search(self, query, limit):
            raise RuntimeError("down")

        def get_content(self, path):
            return f"from elsewhere: {path}"

    lib = Library(spark, pages, [{"group": "G", "pages": ["a/b/c"]}], backend=Other())
    assert lib.search_docs("text").count() == 1 and "search backend failed" in caplog.text
    assert lib.content_of("x") == "from elsewhere: x" and Library(spark, pages).content_of("c") == "# T\ntext" and Library(spark, pages).content_of("no") is None
    assert lib.page_resource("a", "b", "c") == "# T\ntext" and lib.page_resource("b", "c") == "Document not found: b/c"
    assert json.loads(lib.navigation_resource())["navigation"]["groups"][0]["group"] == "G"
    ask = lib.prompt("compare", option_a="x", option_b="y", context="small teams")[1]["content"]
    assert "'x' with 'y'. Context: small teams" in ask and "4. " in ask
    assert "agents that uses search" in lib.prompt("build", kind="agents", tools="search")[1]["content"] and len(lib.prompt("explain")) == 2
    with pytest.raises(KeyError):
        lib.prompt("other")


# ---- campaigns


def folder(root, **contents):
    for name, text in contents.items():
        at = root / name.replace("__", "/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def operation(root_s, root_t, decision, path):
    return campaign.Operation(f"{decision}:{path}", decision, path, campaign.digest(str(root_s / path)), campaign.digest(str(root_t / path)))


def test_campaigns_stop_and_go_on(tmp_path):
    s, t, at = tmp_path / "s", tmp_path / "t", str(tmp_path / "check.json")
    folder(s, new="1", mod="2", swap__file="3")
    folder(t, mod="old", gone="x", swap="a file", keep="k")
    ops = [operation(s, t, d, p) for d, p in (("add", "new"), ("modify", "mod"), ("remove", "gone"), ("preserve", "keep"))]
    batches = [campaign.Batch(1, tuple(ops[:2])), campaign.Batch(2, (operation(s, t, "remove", "swap"), operation(s, t, "add", "swap/file"))), campaign.Batch(3, tuple(ops[2:3])), campaign.Batch(4, tuple(ops[3:]))]
    (t / "gone").write_text("changed meanwhile")
    backend = campaign.FolderBackend(str(s), str(t))
    assert not campaign.run(batches, backend, at)
    saved = json.loads(open(at).read())
    assert saved["summary"] == {"completed": 2, "failed": 1, "pending": 1} and "gone changed" in saved["batches"][2]["diagnostic"]
    assert (t / "gone").exists() and (t / "swap" / "file").read_text() == "3"
    (t / "gone").write_text("x")
    assert campaign.run(batches, backend, at)
    saved = json.loads(open(at).read())
    assert [b["result"] for b in saved["batches"]] == ["applied-before", "applied-before", "applied", "preserve-only"] and saved["status"] == "completed"
    assert sorted(os.listdir(t)) == ["keep", "mod", "new", "swap"] and (t / "mod").read_text() == "2"
    with pytest.raises(ValueError, match="outside"):
        backend.done(campaign.Batch(1, (campaign.Operation("x", "add", "../evil", None, None),)))


def test_batches_come_from_plans(spark):
    plan = spark.createDataFrame([(1, 1, "i1", "add", "a", "h", None), (2, 3, "i3", "remove", "c", None, "t"), (1, 2, "i2", "modify", "b", "h", "t")], "batch_no int, seq int, id string, decision string, path string, source_sha string, target_sha string")
    got = campaign.batches_of(plan)
    assert [(b.number, [o.id for o in b.operations]) for b in got] == [(1, ["i1", "i2"]), (2, ["i3"])] and got[0].id == campaign.batches_of(plan)[0].id != got[1].id


def test_retries_and_the_shared_gate():
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise TimeoutError("busy")
        return "done"

    gate = campaign.Throttle(most=5, clock=lambda: 0.0, sleep=slept.append)
    assert campaign.retried(flaky, lambda e: isinstance(e, TimeoutError), jitter=0, told=lambda e: 3.0 if len(calls) == 2 else None, throttle=None, sleep=slept.append) == "done"
    assert slept == [0.5, 3.0, 2.0]
    with pytest.raises(ValueError):
        campaign.retried(lambda: int("x"), lambda e: isinstance(e, TimeoutError))
    with pytest.raises(TimeoutError):
        calls.clear()
        campaign.retried(flaky, lambda e: True, attempts=2, sleep=lambda s: None)
    gate.pause(2)
    gate.pause(1)
    assert gate.until == 2
    gate.pause(99)
    assert gate.until == 5


# ---- reports


def test_availability_pages(spark):
    rows = spark.createDataFrame([("std", "eu", "b", "1"), ("std", "us", "A", "2"), ("std", "eu", "A", "2"), ("x", "eu", "A", "1")], "sku string, region string, model string, version string")
    made = reports.availability_markdown(rows, {"none": "None", "std": "Standard"})
    assert list(made) == ["std"] and made["std"].split("\n")[2] == "| **Region** | **A** (2) | **b** (1) |" and "| us | ✅ | - |" in made["std"]
    page = reports.availability_html(rows, {"std": "Standard <1>", "x": "X"}, "T & U", "now")
    assert page.count("<section") == 2 and "Standard &lt;1&gt;" in page and "T &amp; U" in page and page.count("<th>Region</th>") == 2


def test_reports_publish_only_whole_matrices(spark):
    observed = spark.createDataFrame([("a", "m", True), ("b", "m", True)], "server string, model string, valid boolean")
    wanted = spark.createDataFrame([("a", "m"), ("b", "m")], "server string, model string")
    means = spark.createDataFrame([("a", "m", 0.5), ("b", "m", 0.75), ("b", "n", None)], "server string, model string, mean double")
    whole = evaluation.completeness(observed, wanted, ["server", "model"], "valid")
    text = reports.evaluation_report({"run_id": "r"}, whole, means, {"By server": means.select("server")})
    assert "| 🥇 | b | 0.750 | n/a | 0.750 |" in text and "## By server" in text
    part = evaluation.completeness(observed.where("server = 'a'"), wanted, ["server", "model"], "valid")
    text = reports.evaluation_report({"run_id": "r"}, part, means, {})
    assert "publication blocked" in text and "| b / m | missing |" in text and "0.750" not in text
    assert "publication blocked" in reports.evaluation_report({}, whole, means, {}, ["no discovery"])


GOOD = {"status": "failed", "total_tests": 4, "passed_tests": 3, "pass_rate": 0.75, "threshold": 0.85, "failed_queries": [{"query": "<q>"}]}


def test_incidents_follow_from_results_alone(tmp_path):
    got = reports.incident(GOOD, [{"run": "r1", "rate": 0.5}, {"run": "r2", "rate": 0.6}], "r2", keep=2)
    assert got["action"] == "upsert" and [h["run"] for h in got["incident"]["history"]] == ["r2", "r1"] and "&lt;q&gt;" in got["incident"]["body"]
    passed = GOOD | {"status": "passed", "passed_tests": 4, "pass_rate": 1.0, "failed_queries": []}
    assert reports.incident(passed, [], "r")["action"] == "noop"
    for wrong in ({"pass_rate": 0.8}, {"status": "passed"}, {"failed_queries": []}, {"passed_tests": 9}, {"status": "odd"}):
        with pytest.raises(ValueError):
            reports.incident(GOOD | wrong, [], "r")
    reports.write_result(str(tmp_path / "r.json"), GOOD)
    assert json.loads((tmp_path / "r.json").read_text()) == GOOD


def test_watchdog_and_discovery(spark):
    raw, none = spark.createDataFrame([("b",), ("a",)], "name string"), spark.createDataFrame([], "problem string")
    assert reports.watchdog(raw, none, "name", 1) == {"status": "passed", "members": 2, "sample": ["a"], "problems": []}
    assert reports.watchdog(raw.limit(0), none, "name")["status"] == "failed"
    seen = spark.createDataFrame([("/mcp", 200, None), ("/x", None, "timeout")], "path string, status int, error string")

    def broken():
        raise OSError("no server")

    got = reports.discovery(seen, {"a": lambda: ["s", "f"], "b": broken}, {"endpoint": True, "project": False}, "https://h.example")
    assert got["servers"]["a"]["tools"] == ["f", "s"] and got["servers"]["b"]["status"] == "unavailable" and got["hybrid"]["status"] == "not_configured"
    assert got["hosted"]["endpoints"]["/x"]["status"] == "unreachable" and got["hosted"]["endpoints"]["/mcp"]["http_status"] == 200
    assert reports.discovery(seen, {}, {})["hosted"] == {"status": "skipped"}


# ---- writers


def test_pages_images_and_testbench_are_written(spark, tmp_path):
    pages = spark.createDataFrame([("a/b c", "# é"), ("d", None)], "path string, page string")
    assert files.write_pages(pages, str(tmp_path / "out")) == 2
    assert (tmp_path / "out" / "a" / "b c.mdx").read_text() == "# é" and (tmp_path / "out" / "d.mdx").read_text() == ""
    got = {r["path"]: (r["bytes"], r["sha256"][:6]) for r in files.inventory(spark, str(tmp_path / "out")).collect()}
    assert got["a/b c.mdx"][0] == 4 and set(got) == {"a/b c.mdx", "d.mdx"}
    with pytest.raises(Exception, match="leads outside"):
        files.write_pages(spark.createDataFrame([("../x", "y")], "path string, page string"), str(tmp_path / "out"))
    (tmp_path / "src" / "m").mkdir(parents=True)
    (tmp_path / "src" / "m" / "i.png").write_bytes(b"1")
    (tmp_path / "src" / "i.png").write_bytes(b"2")
    refs = spark.createDataFrame([("m/i.png",), ("i.png",), ("http://x/y.png",), ("gone.png",), ("../out/d.mdx",)], "reference string")
    assert files.copy_images(refs, str(tmp_path / "src"), str(tmp_path / "img")) == ["i.png"] and (tmp_path / "img" / "i.png").read_bytes() == b"2"
    cases = spark.createDataFrame([("q", "p"), ("q", "p"), ("a", "b")], "query string, expected string")
    assert files.write_testbench(cases, str(tmp_path / "bench.json")) == 2
    assert [c["query"] for c in json.loads((tmp_path / "bench.json").read_text())] == ["a", "q"]


def test_line_granular_json_and_spec_examples(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    files.write_line_granular(rows, {"total": 2, "at": "x"}, "models", str(tmp_path / "m.json"), ["id"])
    text = (tmp_path / "m.json").read_text()
    assert json.loads(text) == {"at": "x", "total": 2, "models": [{"id": "a", "n": 1}, {"id": "b", "n": 2}]} and text.count("\n") == 4
    files.write_line_granular(rows.limit(0), {}, "models", str(tmp_path / "e.json"), ["id"])
    assert json.loads((tmp_path / "e.json").read_text()) == {"models": []}
    spec = {"paths": {"/w": {"get": {"operationId": "l", "responses": {"200": {"content": {"application/json": {}}}, "404": {"content": {"application/json": {}}}}}, "post": {"operationId": "p", "responses": {"201": {"content": {"application/json": {"example": "own"}}}}}, "parameters": []}}}
    got = json.loads(files.enriched_spec(json.dumps(spec), {"l": {"x": 1}, "p": "given"}, {"l": [{"lang": "py"}]}))["paths"]["/w"]
    assert got["get"]["responses"]["200"]["content"]["application/json"] == {"example": {"x": 1}} and got["get"]["responses"]["404"]["content"]["application/json"] == {}
    assert got["post"]["responses"]["201"]["content"]["application/json"] == {"example": "own"} and got["get"]["x-codeSamples"] == [{"lang": "py"}]


def test_wide_batches_are_converted_by_slices():
    """Rows in order, no slice above its bytes but single rows, nothing lost; empty batches and nulls too."""
    import pyarrow as pa

    from lexarium.operators import batches

    texts = ["é" * n for n in (0, 3, 50, 400, 1, 1, 90)] + [None, "x" * 120, None]
    whole = pa.record_batch({"k": pa.array(range(10)), "t": pa.array(texts)})
    got = list(batches.sliced(iter([whole.slice(1), whole.slice(0, 0), whole.slice(0, 1)]), 1, 200))
    assert [k for b in got for k in b.column(0).to_pylist()] == [*range(1, 10), 0] and [t for b in got for t in b.column(1).to_pylist()] == [*texts[1:], ""]
    assert len(got) > 3 and all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 200 for b in got)
