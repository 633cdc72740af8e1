"""Queries of trees, links and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..registry import query
from ..session import table
from .inline import Extended, Grown, Inline

NAV = [{"group": "Get started", "pages": ["index", "quickstart", {"group": "Agents", "pages": ["agents/overview", "agents/how-to/deploy"]}]}, {"group": "Models & data", "pages": ["models/catalog", {"group": "Empty", "pages": []}]}, "changelog"]
NAV_ROWS = Inline(
    {"node_id": "string", "kind": "string", "value": "string"},
    [("0000/", "group", "Get started"), ("0000/0000/", "page", "index"), ("0000/0001/", "page", "quickstart"), ("0000/0002/", "group", "Agents"), ("0000/0002/0000/", "page", "agents/overview"), ("0000/0002/0001/", "page", "agents/how-to/deploy"), ("0001/", "group", "Models & data"), ("0001/0000/", "page", "models/catalog"), ("0001/0001/", "group", "Empty"), ("0002/", "page", "changelog")],
)


@query("nav_nodes", f"SELECT * FROM {NAV_ROWS.sql}")
def nav_nodes(spark, sf_dir):
    return graph.flattened(spark, NAV).select("node_id", "kind", "value")


@query("nav_page_counts", f"SELECT g.node_id, g.value, COUNT(p.node_id)::BIGINT AS n FROM {NAV_ROWS.sql} g LEFT JOIN {NAV_ROWS.sql} p ON p.kind = 'page' AND starts_with(p.node_id, g.node_id) WHERE g.kind = 'group' GROUP BY ALL")
def nav_page_counts(spark, sf_dir):
    return graph.pages_below(graph.flattened(spark, NAV))


ASKED = Inline({"asked": "string"}, [("agents",), ("models",), ("start",), ("getting",), ("zzz",)])


@query("section_lookup", "SELECT * FROM (VALUES ('agents', 'Agents'), ('models', 'Models & data'), ('start', 'Get started'), ('getting', 'Get started')) AS t(asked, section)")
def section_lookup(spark, sf_dir):
    return graph.matched_sections(graph.flattened(spark, NAV), ASKED.df(spark))


WANTED = Inline({"asked": "string"}, [("/agents/overview.mdx",), ("overview",), ("deploy",), ("missing",), ("how-to/deploy",), ("index",)])


@query(
    "page_lookup",
    f"""WITH p AS (SELECT value AS path FROM {NAV_ROWS.sql} WHERE kind = 'page'), a AS (SELECT asked, regexp_replace(regexp_replace(asked, '^/+', ''), '\\.mdx$', '') AS stem FROM {WANTED.sql})
    SELECT asked, arg_min(path, CASE WHEN path = stem THEN '0' ELSE '1' || path END) AS path FROM a LEFT JOIN p ON path = stem OR ends_with(path, '/' || stem) GROUP BY asked""",
)
def page_lookup(spark, sf_dir):
    pages = graph.flattened(spark, NAV).where("kind = 'page'").select(F.col("value").alias("path"))
    return graph.lookup(pages, WANTED.df(spark))


TITLES = Inline({"path": "string", "title": "string"}, [("index", "Home"), ("agents/overview", "Agents"), ("changelog", None)])


@query("section_pages", f"SELECT n.node_id, n.value AS path, COALESCE(t.title, n.value) AS title FROM {NAV_ROWS.sql} n LEFT JOIN {TITLES.sql} t ON t.path = n.value WHERE n.kind = 'page'")
def section_pages(spark, sf_dir):
    pages = graph.flattened(spark, NAV).where("kind = 'page'").select("node_id", F.col("value").alias("path"))
    return pages.join(TITLES.df(spark), "path", "left").select("node_id", "path", F.coalesce("title", "path").alias("title"))


MANIFEST = Inline(
    {"seq": "int", "name": "string", "source": "string", "section": "string", "hierarchy": "array<string>", "kind": "string"},
    [(1, "A", "x/a.md", "One", ["One"], "page"), (2, "B", "x/b.md", "One", ["One", "Sub"], "page"), (3, "A again", "x/a.md", "Two", ["Two"], "page"), (4, "C", "y/c.yml", "Two", ["Two", "Sub"], "table"), (5, "A third", "x/a.md", "Three", ["Three"], "external"), (6, "B", "x/b2.md", "One", ["One", "Sub"], "page")],
)


@query("manifest_stats", f"SELECT kind, COUNT(*)::BIGINT AS n, COUNT(DISTINCT source)::BIGINT AS sources FROM {MANIFEST.sql} GROUP BY kind")
def manifest_stats(spark, sf_dir):
    return MANIFEST.df(spark).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("first_occurrence", f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM {MANIFEST.sql}) SELECT source, any_value(name) FILTER (WHERE k = 1) AS name, COALESCE(array_to_string(list_sort(list(DISTINCT section) FILTER (WHERE k > 1)), '|'), '') AS also FROM n GROUP BY source")
def first_occurrence(spark, sf_dir):
    return graph.first_seen(MANIFEST.df(spark), "source", "seq", "section").select("source", "name", F.array_join("also", "|").alias("also"))


@query("exact_dup_docs", "SELECT md5(text) AS key, MIN(doc_id) AS doc_id, COUNT(*)::BIGINT AS n FROM documents GROUP BY md5(text) HAVING COUNT(*) > 1")
def exact_dup_docs(spark, sf_dir):
    key = F.md5(F.col("text").cast("binary")).alias("key")
    return table(spark, sf_dir, "documents").groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1")


@query(
    "nav_tree",
    f"""WITH e AS (SELECT array_to_string(hierarchy[1:d - 1], ' > ') AS parent, 'group' AS kind, hierarchy[d] AS label, seq FROM (SELECT *, unnest(range(1, len(hierarchy) + 1)) AS d FROM {MANIFEST.sql}) UNION ALL SELECT array_to_string(hierarchy, ' > '), 'page', name, seq FROM {MANIFEST.sql}),
    o AS (SELECT parent, kind, label, MIN(seq) AS first FROM e GROUP BY ALL) SELECT parent, kind, label, first, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN kind = 'page' THEN 0 ELSE 1 END, first, label)::INTEGER AS ordinal FROM o""",
)
def nav_tree(spark, sf_dir):
    return graph.nav_tree(MANIFEST.df(spark), "hierarchy", "name", "seq")


@query("route_conflicts", f"SELECT name, arg_min(source, seq) AS source, COUNT(DISTINCT source) > 1 AS conflict, COUNT(*)::BIGINT AS n FROM {MANIFEST.sql} GROUP BY name")
def route_conflicts(spark, sf_dir):
    return graph.unique_routes(MANIFEST.df(spark), "name", "source", "seq")


def part_pages(spark, sf_dir):
    """A page of every part, with two internal links, one of them twice, and some that are none."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    link = F.concat(F.lit("[a](../x/q"), size, F.lit("?v=1)"))
    body = F.concat(link, F.lit(' and <a href="/docs/'), "p_brand", F.lit('.mdx#s">b</a> '), link, F.lit(" `[c](no)` ![i](i.png) [m](mailto:x@y)\n```\n[d](gone)\n```"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("parts/p"), n).alias("route"), body.alias("content"))


def part_routes(spark, sf_dir):
    """Routes of half the sizes that parts have."""
    return table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("x/q"), F.col("p_size").cast("string")).alias("route")).distinct()


PAGES = Grown(
    {"route": "string", "content": "string"},
    [
        ("agents/overview", "See [a](../models/catalog) and [b](/index#top), [c](how-to/deploy.mdx) `[code](x)` <a href=\"/missing\">m</a> [ext](https://e.example) [img](pic.png) [up](../../../x)"),
        ("models/catalog", "```\n[fenced](nope)\n```\n[gone](./old-page) [gone again](./old-page) <!-- [hidden](zz) --> [dir](/agents/)"),
        ("index", "[self](#a) [mail](mailto:x@y) [ok](agents/overview)"),
    ],
    part_pages,
    "SELECT NULL AS route, NULL AS content WHERE false",
)
ROUTES = Grown({"route": "string"}, [("agents/overview",), ("models/catalog",), ("index",), ("agents/how-to/deploy",)], part_routes, "SELECT DISTINCT 'x/q' || p_size AS route FROM part WHERE p_size % 2 = 0")
LINKS = """(SELECT * FROM (VALUES ('agents/overview', '../models/catalog', 'models/catalog'), ('agents/overview', '/index#top', 'index'), ('agents/overview', 'how-to/deploy.mdx', 'agents/how-to/deploy'), ('agents/overview', '/missing', 'missing'), ('agents/overview', '../../../x', ''), ('models/catalog', './old-page', 'models/old-page'), ('models/catalog', '/agents/', 'agents'), ('index', 'agents/overview', 'agents/overview')) AS t(route, link, target)
    UNION ALL SELECT 'parts/p' || p_partkey, unnest(['../x/q' || p_size || '?v=1', '/docs/' || p_brand || '.mdx#s']), unnest(['x/q' || p_size, 'docs/' || split_part(p_brand, '#', 1)]) FROM part)"""


@query("page_links", f"SELECT * FROM {LINKS}")
def page_links(spark, sf_dir):
    return graph.links_of(PAGES.df(spark, sf_dir), "route", "content")


@query("broken_links", f"SELECT route, link, target FROM {LINKS} WHERE target <> '' AND target NOT IN (SELECT route FROM {ROUTES.sql})")
def broken_links(spark, sf_dir):
    return graph.broken(graph.links_of(PAGES.df(spark, sf_dir), "route", "content"), ROUTES.df(spark, sf_dir))


KNOWN = Inline({"route": "string", "link": "string", "target": "string"}, [("models/catalog", "/agents/", "agents")])


@query("introduced_links", f"SELECT route, link, target FROM {LINKS} WHERE target <> '' AND target NOT IN (SELECT route FROM {ROUTES.sql}) AND (route, link, target) NOT IN (SELECT (route, link, target) FROM {KNOWN.sql})")
def introduced_links(spark, sf_dir):
    return graph.introduced(broken_links(spark, sf_dir), KNOWN.df(spark), ["route", "link", "target"])


HREF = r"""href="([^"]+)\""""


@query("page_hrefs", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS href FROM pages")
def page_hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), 1))).alias("href"))


@query("dangling_hrefs", "WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages), t AS (SELECT DISTINCT '/' || regexp_extract(html, '<h1>([^ <]+)', 1) AS href FROM pages) SELECT page_id, href FROM l WHERE href NOT IN (SELECT href FROM t)")
def dangling_hrefs(spark, sf_dir):
    """Links to what is no page's first heading word."""
    known = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), F.regexp_extract("html", "<h1>([^ <]+)", 1)).alias("href")).distinct()
    return page_hrefs(spark, sf_dir).join(known, "href", "left_anti").select("page_id", "href")


REDIRECTS = Extended(
    "part", "SELECT 'r' || p_partkey AS source, 'r' || CAST(FLOOR(p_partkey / 2) AS INT) AS destination FROM part WHERE p_partkey > 1",
    {"source": "string", "destination": "string"}, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), ("p", "a"), ("q", "x")])


@query(
    "alias_resolution",
    f"""WITH RECURSIVE r AS {REDIRECTS.sql}, w(source, cur, seen, cyc) AS (SELECT source, destination, [source], destination = source FROM r UNION ALL
      SELECT w.source, r.destination, list_append(w.seen, w.cur), list_contains(w.seen, r.destination) OR r.destination = w.cur FROM w JOIN r ON r.source = w.cur WHERE NOT w.cyc AND len(w.seen) < 20)
    SELECT source, CASE WHEN NOT bool_or(cyc) THEN arg_max(cur, len(seen)) END AS final FROM w GROUP BY source""",
)
def alias_resolution(spark, sf_dir):
    return graph.resolved_aliases(REDIRECTS.df(spark, sf_dir))


INCLUDES = Extended(
    "part", "SELECT 'd' || p_partkey AS source, 'd' || CAST(FLOOR(p_partkey / 2) AS INT) AS target FROM part WHERE p_partkey > 1",
    {"source": "string", "target": "string"}, [("doc1", "inc/a"), ("inc/a", "inc/b"), ("inc/b", "inc/a"), ("doc2", "inc/b"), ("doc2", "inc/c"), ("inc/c", "inc/d"), ("doc3", "doc3")])


@query("include_closure", f"WITH RECURSIVE e AS {INCLUDES.sql}, c(root, node) AS (SELECT source, target FROM e WHERE source <> target UNION SELECT c.root, e.target FROM c JOIN e ON e.source = c.node WHERE e.target <> c.root) SELECT root, node FROM c")
def include_closure(spark, sf_dir):
    return graph.closure(INCLUDES.df(spark, sf_dir)).select("root", "node")


@query(
    "even_samples",
    """WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part),
    w AS (SELECT b.p_brand, round_even(p * (b.n - 1) / 31.0, 0)::BIGINT AS i FROM (SELECT DISTINCT p_brand, n FROM n WHERE n > 32) b, range(32) AS r(p))
    SELECT p_brand, p_partkey FROM n WHERE n <= 32 UNION ALL SELECT DISTINCT n.p_brand, p_partkey FROM n JOIN w ON w.p_brand = n.p_brand AND w.i = n.i""",
)
def even_samples(spark, sf_dir):
    return graph.sampled_evenly(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 32)
