"""Queries of readers and stored tables: assets, catalogue shards, chunk tables, version blocks, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, index, markdown, redaction, sync
from ..registry import query
from ..session import table
from ..sources import files, landed
from ..storage import new_path
from .sync import PLAN, sequenced

def key_text():
    return F.col("p_partkey").cast("string")


@query(
    "asset_references",
    """SELECT 'p' || p_partkey AS path, unnest([{'kind': 'include', 'reference': '../inc/' || p_size || '.md'}, {'kind': 'image', 'reference': 'media/' || p_partkey || '.png'}, {'kind': 'image', 'reference': p_brand || '.svg'}], recursive := true) FROM part""",
)
def asset_references(spark, sf_dir):
    """References of a page for every part."""
    body = F.concat(F.lit("see ![shot](media/"), key_text(), F.lit('.png "t") and\n[!INCLUDE [i](../inc/'), F.col("p_size").cast("string"), F.lit('.md)]\n:::image type="icon" source="'), F.col("p_brand"), F.lit('.svg"::: ![shot](media/'), key_text(), F.lit(".png)"))
    return files.asset_references(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key_text()).alias("path"), body.alias("content")), "path", "content")


@query("catalog_shards", "SELECT 'm' || p_partkey AS id, p_name AS \"displayName\", p_brand AS publisher, p_size::VARCHAR AS \"latestVersion\", array_to_string(['std:eu', 'std:' || p_type], ',') AS regions FROM part")
def catalog_shards(spark, sf_dir):
    """Catalogue shards written from parts and read back."""
    regions = F.create_map(F.lit("std"), F.array(F.lit("eu"), F.col("p_type")))
    models = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), key_text()).alias("id"), F.col("p_name").alias("displayName"), F.col("p_brand").alias("publisher"), F.col("p_size").cast("string").alias("latestVersion"), regions.alias("regions"))
    path = new_path(spark, "shards")
    shard = models.groupBy(F.expr("cast(substring(id, 2) as bigint) div 100").alias("shard")).agg(F.lit("today").alias("generatedAt"), F.collect_list(F.struct("id", "displayName", "publisher", "latestVersion", "regions")).alias("models"))
    shard.write.partitionBy("shard").json(path)  # one object a file
    got = files.read_catalog(spark, [path])
    flat = F.flatten(F.transform(F.map_entries("regions"), lambda e: F.transform(e["value"], lambda r: F.concat(e["key"], F.lit(":"), r))))
    return got.select("id", "displayName", "publisher", "latestVersion", F.array_join(flat, ",").alias("regions"))


def chunk_versions(spark, sf_dir, later: str = "doc_id % 9 <> 0"):
    """A table before and after: the two sides of a sync."""
    docs = table(spark, sf_dir, "documents")
    chunk = lambda text: docs.select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.lit("p"), (F.col("doc_id") % 10).cast("string")).alias("path"), F.lit("t").alias("title"), F.lit("").alias("description"), F.lit("h").alias("heading"), text.alias("content"), F.sha2(F.encode(text, "UTF-8"), 256).alias("content_hash"))
    before = chunk(F.col("text")).where("doc_id % 7 <> 0").drop("doc_id")
    after = chunk(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).where(later).drop("doc_id")
    return before, after


def lengths(texts: list[str]) -> list[list[float]]:
    """A vector of a text: its length and its words."""
    return [[float(len(t)), float(len(t.split()))] for t in texts]


@query("chunk_metadata", "SELECT 'c' || doc_id AS chunk_id, 'p' || (doc_id % 10) AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents")
def chunk_metadata(spark, sf_dir):
    """Keys and hashes of a chunk table after two syncs, the second of all documents."""
    path = new_path(spark, "chunks")
    for version in chunk_versions(spark, sf_dir, "true"):
        index.synced(spark, path, version, lengths)
    return index.chunk_metadata(spark, path)


@query(
    "chunk_sync",
    """WITH b AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 0),
    s AS (SELECT CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.text = b.text THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id)
    SELECT state, COUNT(*)::BIGINT AS n FROM s GROUP BY state""",
)
def chunk_sync(spark, sf_dir):
    """What the second sync of a chunk table found."""
    path = new_path(spark, "chunks")
    before, after = chunk_versions(spark, sf_dir)
    index.synced(spark, path, before)
    return spark.createDataFrame(list(index.synced(spark, path, after).items()), "state string, n long")


@query(
    "chunk_vectors",
    "SELECT 'c' || doc_id AS chunk_id, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, '[^\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'))::DOUBLE AS words FROM documents",
)
def chunk_vectors(spark, sf_dir):
    """Every document embedded by a caller's function."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    from ..operators import search

    got = search.embedded(rows, "text", "v", lengths)
    return got.select("chunk_id", F.col("v")[0].cast("double").alias("chars"), F.col("v")[1].cast("double").alias("words"))


@query("version_blocks", "SELECT 'a ' || (CASE p_size % 3 WHEN 0 THEN '' ELSE 'kept ' || p_name || chr(10) END) || ' z' AS text, p_partkey FROM part")
def version_blocks(spark, sf_dir):
    """Version blocks in a page for every part: of the other version, of the kept one, and of both."""
    names = F.element_at(F.array(F.lit("classic"), F.lit("current"), F.lit("classic || current")), (F.col("p_size") % 3 + 1).cast("int"))
    body = F.concat(F.lit("a :::moniker range=\""), names, F.lit("\"\nkept "), F.col("p_name"), F.lit("\n:::moniker-end z"))
    return redaction.mapped(table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey", "body", "text", markdown.monikers("current", "classic"))


@query(
    "batch_pack",
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY list_position(['add', 'modify', 'remove', 'preserve'], decision), path) AS seq, payload_bytes AS b FROM {PLAN}),
    f(seq, batch_no, files, size) AS (SELECT seq, 1, 1, b FROM p WHERE seq = 1 UNION ALL
      SELECT p.seq, CASE WHEN f.files + 1 > 50 OR f.size + p.b > 400000 THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN f.files + 1 > 50 OR f.size + p.b > 400000 THEN 1 ELSE f.files + 1 END,
        CASE WHEN f.files + 1 > 50 OR f.size + p.b > 400000 THEN p.b ELSE f.size + p.b END FROM f JOIN p ON p.seq = f.seq + 1)
    SELECT batch_no::BIGINT AS batch_no, COUNT(*)::BIGINT AS files, SUM(p.b)::BIGINT AS bytes, MIN(p.seq)::INTEGER AS first, MAX(p.seq)::INTEGER AS last FROM f JOIN p USING (seq) GROUP BY batch_no""",
)
def batch_pack(spark, sf_dir):
    """Batches of the plan: at most 50 files and 400,000 bytes each."""
    return sync.planned_batches(sequenced(spark, sf_dir), 50, 400_000).groupBy("batch_no").agg(F.count("*").alias("files"), F.sum("payload_bytes").alias("bytes"), F.min("seq").alias("first"), F.max("seq").alias("last"))


ANSWERS = "SELECT p_partkey AS query_id, 1 AS rank, 'agents/' || p_size AS path, p_name AS title, 'about ' || p_type AS description, 'https://h.example/docs/agents/' || p_size || '?x=1' AS url FROM part"


@query("site_answers", ANSWERS)
def site_answers(spark, sf_dir):
    """Landed answers of a site search, one per part."""
    hit = F.struct(F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b>")).alias("title"), F.concat(F.lit("https://h.example/docs/agents/"), F.col("p_size").cast("string"), F.lit("?x=1")).alias("url"), F.concat(F.lit("about <i>"), F.col("p_type"), F.lit("</i>")).alias("description"))
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), F.to_json(F.struct(F.array(hit).alias("results"))).alias("body"))
    return landed.site_answers(raw, "q", "body", r"/docs/([^?#]+)")


@query("stream_answers", ANSWERS)
def stream_answers(spark, sf_dir):
    """Landed answers of a tool server, as event streams; every answer begins with a text that has no link."""
    url = F.concat(F.lit("https://h.example/docs/agents/"), F.col("p_size").cast("string"), F.lit("?x=1"))
    text = F.concat(F.lit("Title: "), F.col("p_name"), F.lit("\nLink: "), url, F.lit("\nContent: about <i>"), F.col("p_type"), F.lit("</i>"))
    data = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("no link").alias("text")), F.struct(text.alias("text"))).alias("content")).alias("result")))
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q"), F.concat(F.lit("event: message\ndata: "), data, F.lit("\n\n")).alias("body"))
    return landed.stream_answers(raw, "q", "body", r"/docs/([^?#]+)")


@query(
    "fetched_pages",
    "SELECT url AS route, page_id, CASE WHEN page_id % 11 <> 0 THEN 200 END AS status, page_id % 11 <> 0 AND octet_length(encode(html)) > 3000 AS oversize, CASE WHEN page_id % 11 <> 0 AND octet_length(encode(html)) <= 3000 THEN length(html) END::INTEGER AS chars FROM pages",
)
def fetched_pages(spark, sf_dir):
    """Fetched pages, some of which failed, and the lengths of those within the bound."""
    failed = F.col("page_id") % 11 == 0
    raw = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("route"), F.lit(200).alias("status"), F.when(~failed, F.col("html")).alias("body"), F.col("url").alias("final_url"), F.when(failed, "timeout").alias("error"))
    got = landed.fetched_pages(raw.withColumn("route", F.struct("route", "page_id")), 3000)
    return got.select("route.route", "route.page_id", "status", "oversize", F.when(~F.col("oversize"), F.length("body")).alias("chars"))


@query("page_inlining", "SELECT 'docs/p' || p_partkey AS path, 'x ' || (CASE p_size % 3 WHEN 0 THEN 'leaf' WHEN 1 THEN 'one leaf' ELSE '' END) || ' [' || p_name || '](/out/' || p_size || '#a)' AS page FROM part")
def page_inlining(spark, sf_dir):
    """Includes of two levels and links to other pages, for every part."""
    parts = table(spark, sf_dir, "part")
    name = F.element_at(F.array(F.lit("leaf"), F.lit("one"), F.lit("none")), (F.col("p_size") % 3 + 1).cast("int"))
    body = F.concat(F.lit("x [!INCLUDE [i](../inc/"), name, F.lit(".md)] ["), F.col("p_name"), F.lit("](../src/"), F.col("p_size").cast("string"), F.lit(".md#a)"))
    pages = parts.select(F.concat(F.lit("docs/p"), key_text()).alias("path"), body.alias("content"))
    includes = spark.createDataFrame([("inc/leaf.md", "---\ntitle: x\n---\nleaf"), ("inc/one.md", "one [!INCLUDE [l](leaf.md)]")], "path string, content string")
    routes = parts.select(F.concat(F.lit("src/"), F.col("p_size").cast("string"), F.lit(".md")).alias("source_path"), F.concat(F.lit("out/"), F.col("p_size").cast("string")).alias("output_path")).distinct()
    inlined = markdown.inlined(pages, includes)
    linked = inlined.join(markdown.link_outputs(inlined, routes), "path", "left")
    made = redaction.mapped(linked.select(F.struct("path").alias("k"), F.to_json(F.struct("content", "outputs")).alias("raw")), "k", "raw", "page", _rewritten)
    return made.select("k.path", "page")


def _rewritten(raw: str) -> str:
    import json

    row = json.loads(raw)
    return markdown.links(row.get("outputs") or {})(row["content"])


@query(
    "suffix_hits",
    """WITH f AS (SELECT l_orderkey AS case_id, l_linenumber AS rank, CASE l_partkey % 3 WHEN 0 THEN 'docs/p' || (l_partkey % 5) WHEN 1 THEN 'other/x/p' || (l_partkey % 5) ELSE 'docs/xp' || (l_partkey % 5) END AS path FROM lineitem),
    c AS (SELECT o_orderkey AS case_id, unnest(['docs/p' || (o_custkey % 5), 'p' || (o_custkey % 4)]) AS e FROM orders)
    SELECT o_orderkey AS case_id, MIN(rank) FILTER (WHERE path = e OR ends_with(path, '/' || regexp_extract(e, '[^/]*$')))::INTEGER AS first_rank FROM orders LEFT JOIN c ON c.case_id = o_orderkey LEFT JOIN f ON f.case_id = o_orderkey GROUP BY o_orderkey""",
)
def suffix_hits(spark, sf_dir):
    """Orders as cases, their lines as found paths."""
    n = (F.col("l_partkey") % 5).cast("string")
    path = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("docs/p"), n)).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("other/x/p"), n)).otherwise(F.concat(F.lit("docs/xp"), n))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), path.alias("path"))
    expected = F.array(F.concat(F.lit("docs/p"), (F.col("o_custkey") % 5).cast("string")), F.concat(F.lit("p"), (F.col("o_custkey") % 4).cast("string")))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), expected.alias("expected"))
    return evaluation.suffix_hits(found, cases)


@query("file_hashes", "SELECT 's' || (s_nationkey % 3) || '/n' || s_suppkey || '.txt' AS path, octet_length(encode(s_name))::BIGINT AS bytes, sha256(s_name) AS sha256 FROM supplier")
def file_hashes(spark, sf_dir):
    """Inventory of files on disk: one for every supplier."""
    root = new_path(spark, "files")
    path = F.concat(F.lit("s"), (F.col("s_nationkey") % 3).cast("string"), F.lit("/n"), F.col("s_suppkey").cast("string"))
    files.write_pages(table(spark, sf_dir, "supplier").select(path.alias("path"), F.col("s_name").alias("page")), root, ".txt")
    return files.inventory(spark, root)
