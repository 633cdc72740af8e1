"""Readers, writers and streams over temporary folders."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lexarium.operators import sessions
from lexarium.sources import files
from lexarium.sources.listing import ListingSource
from lexarium.streaming import mentions


def test_page_tree_and_inventory(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.mdx").write_bytes(b"# X\n\xff")
    (tmp_path / "y.mdx").write_text("Y")
    (tmp_path / "z.txt").write_text("no page")
    got = {r["path"]: r["content"] for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"a b/x": "# X\n�", "y": "Y"}
    inv = {r["path"]: r["bytes"] for r in files.inventory(spark, str(tmp_path)).collect()}
    assert inv["z.txt"] == 7 and len(inv) == 3


def test_toc_is_flattened(spark):
    toc = [{"name": "A", "href": "a.md", "items": [{"name": "B", "items": [{"name": "C", "href": "c.md"}]}]}]
    rows = files.read_toc(spark, toc, "S").orderBy("seq").collect()
    assert [(r["name"], r["hierarchy"]) for r in rows] == [("A", ["S"]), ("C", ["S", "A", "B"])]


def test_assets(spark):
    pages = spark.createDataFrame([("p", '[!INCLUDE [x](inc/a.md)] ![i](img.png "t") :::image type="icon" source="b.svg":::')], "path string, content string")
    assert {(r["kind"], r["reference"]) for r in files.asset_references(pages, "path", "content").collect()} == {("include", "inc/a.md"), ("image", "img.png"), ("image", "b.svg")}


def test_catalog_shards_and_listing_pages(spark, tmp_path):
    (tmp_path / "core.json").write_text(json.dumps({"generatedAt": "x", "models": [{"id": "m", "publisher": "p", "regions": {"s": ["r"]}}]}))
    row = files.read_catalog(spark, [str(tmp_path / "core.json")]).first()
    assert (row["id"], row["regions"]) == ("m", {"s": ["r"]})
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"page": 1, "token": "t", "value": [{"name": "a"}]}))
    with pytest.raises(ValueError, match="continuation"):
        files.read_pages_of_listing(spark, str(pages), "name:string")
    (pages / "2.json").write_text(json.dumps({"page": 2, "token": None, "value": [{"name": "b"}]}))
    assert {r["name"] for r in files.read_pages_of_listing(spark, str(pages), "name:string").collect()} == {"a", "b"}


def fetch_two_pages(scope, token):
    """A listing of two pages for the data source."""
    return ([{"id": f"{scope}-{token or 0}"}], None if token else 1)


def endless(scope, token):
    return ([], 1)


def test_listing_source(spark):
    spark.dataSource.register(ListingSource)
    read = lambda fn: spark.read.format("listing").option("fetch", f"tests.test_sources:{fn}").option("scopes", "eu,us").option("most_pages", "5").load()
    assert sorted(r["member"] for r in read("fetch_two_pages").collect()) == ['{"id": "eu-0"}', '{"id": "eu-1"}', '{"id": "us-0"}', '{"id": "us-1"}']
    with pytest.raises(Exception, match="token is left"):
        read("endless").collect()


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "id int, v string")
    files.upsert_table(spark, path, df([(1, "a"), (2, "b")]), ["id"])
    last = files.upsert_table(spark, path, df([(2, "c"), (3, "d")]), ["id"])
    assert {(r["id"], r["v"]) for r in spark.read.parquet(last).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, v string")
    assert files.markdown_table(rows.orderBy("id"), ["id", "v"]) == "| id | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    files.write_shards(rows, F.when(F.col("id") == 1, "one").otherwise("rest"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).groupBy("shard").count().count() == 2
    assert files.manifest_text({"b": 1, "a": 2}) == '{\n  "a": 2,\n  "b": 1\n}\n'
    files.write_atomically(str(tmp_path / "x" / "f.json"), "{}")
    assert (tmp_path / "x" / "f.json").read_text() == "{}"


def test_operations(spark):
    spec = json.dumps({"paths": {"/w": {"get": {"summary": "List", "tags": ["T"]}, "post": {}, "parameters": []}, "/x": {"get": {"x-excluded": True}}}})
    rows = files.operations_of(spark.createDataFrame([(spec,)], "c string"), "c").collect()
    assert {(r["path"], r["method"], r["tag"], r["summary"]) for r in rows} == {("/w", "get", "T", "List"), ("/w", "post", "default", "POST /w")}


def test_mention_stream_once_per_period(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    rows = [("1", "2024-01-01 00:00:00", "an Agent post"), ("1", "2024-01-02 00:00:00", "agent again"), ("2", "2024-01-01 00:00:00", "nothing")]
    spark.createDataFrame(rows, "id string, ts string, text string").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "text").write.parquet(source)
    stream = spark.readStream.schema("id string, ts timestamp_ntz, text string").parquet(source)
    fresh = mentions.fresh_mentions(stream, ["agent"])
    mentions.run_once(fresh, str(tmp_path / "cp"), lambda df, n: out.extend(df.collect()))
    assert [(r["id"], r["keywords"]) for r in out] == [("1", ["agent"])]


def test_stream_counts_equal_batch_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(small)
    got: dict = {}
    mentions.run_once(mentions.windowed_counts(stream, "ts", "event_type", "7 days"), str(tmp_path / "cp"), lambda df, n: got.update({(r["start"], r["event_type"]): r["n"] for r in df.collect()}), "complete")
    want = mentions.windowed_counts(events, "ts", "event_type", "7 days")
    assert got == {(r["start"], r["event_type"]): r["n"] for r in want.collect()}


def test_period_restarts_with_a_dispatch(spark):
    days = [1, 5, 9, 12]
    rows = spark.createDataFrame([("a", f"2024-01-{d:02} 00:00:00") for d in days], "id string, t string").select("id", F.col("t").cast("timestamp").alias("ts"))
    kept = [r["ts"].day for r in sessions.dispatched_once(rows, 7).orderBy("ts").collect()]
    assert kept == [1, 9]


def test_feedback_loop(spark, tmp_path):
    folder = str(tmp_path / "fb")
    one = ("feedback", "2024-01-01", "u", "q", ["p"], "/docs/x.mdx", "s")
    rows = spark.createDataFrame([one, one, ("feedback", "t", "u", "", [], "e", "")], mentions.FEEDBACK)
    mentions.append_feedback(rows, folder)
    out = []
    mentions.run_once(mentions.testbench_cases(mentions.feedback_stream(spark, folder)), str(tmp_path / "cp"), lambda df, n: out.extend(df.collect()))
    assert [(r["query"], r["expected"]) for r in out] == [("q", "docs/x")]


def test_stored_index_answers_like_the_direct_search(spark, small, tmp_path):
    from lexarium.functions import text
    from lexarium.operators import index, search, segments

    docs = spark.read.parquet(f"{small}/documents.parquet")
    empty = spark.createDataFrame([(10_000, "the of", "en", "s", 6)], docs.schema)
    docs = docs.unionByName(empty)
    path = str(tmp_path / "index")
    segments.create(docs, "doc_id", text.tokens(F.col("text")), path)
    asked = search.query_tokens(spark.read.parquet(f"{small}/benchmark.parquet").where("item_id < 5"), "item_id", "text")
    rows = lambda df: [(r["query_id"], r["rank"], r["doc"], round(r["score"], 6)) for r in df.orderBy("query_id", "rank").collect()]
    got = index.search(spark, path, asked, 5)
    assert rows(got) == rows(search.bm25(asked, docs, "doc_id", text.tokens(F.col("text")), 5))


def test_an_index_is_written_once_for_each_state(spark, tmp_path):
    import shutil

    from lexarium.functions import text
    from lexarium.operators import index

    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id int, text string").write.parquet(path)
    at = lambda: index.stored(spark.read.parquet(path), "doc_id", "text", text.tokens(F.col("text")))
    first = at()
    assert at() == first and index.term_stats(spark, first).where("token = 'two'").first()["df"] == 2
    assert {(r["doc"], r["token"], r["tf"]) for r in index.term_frequencies(spark, first).collect()} == {(1, "one", 1), (1, "two", 1), (2, "two", 1), (2, "three", 1)}
    spark.createDataFrame([(3, "four")], "doc_id int, text string").write.mode("append").parquet(path)
    second = at()
    assert second != first
    shutil.rmtree(second.removeprefix("file:"))
    assert at() != second
