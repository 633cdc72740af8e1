"""Navigation trees, links, redirects, includes, manifests: trees and graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import link_target
from ..storage import written

LINK = r"""\[[^\]]*\]\(\s*(<[^>]*>|[^)\s]+)[^)]*\)|href=["']([^"']+)["']"""


def flattened(spark: SparkSession, items: list, parent: str = "") -> DataFrame:
    """A nested navigation config (groups ``{"group", "pages"}``, pages as texts) as ``node_id, parent_id, ordinal, kind, value``.

    A config is one small file that the driver has read; nodes are numbered depth first."""
    rows: list[tuple] = []

    def walk(nodes: list, above: str) -> None:
        for i, node in enumerate(nodes):
            own = f"{above}{i:04d}/"
            if isinstance(node, str):
                rows.append((own, above or None, i, "page", node))
            else:
                rows.append((own, above or None, i, "group", node["group"]))
                walk(node.get("pages", []), own)

    walk(items, parent)
    return spark.createDataFrame(rows, "node_id string, parent_id string, ordinal int, kind string, value string")


def pages_below(nav: DataFrame) -> DataFrame:
    """Number of pages under every group, however deep; a page's ancestors are prefixes of its number."""
    parts = F.split(F.regexp_replace("node_id", "/$", ""), "/")
    above = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    pages = nav.where("kind = 'page'").select(F.explode(above).alias("node_id"))
    counts = pages.groupBy("node_id").agg(F.count("*").alias("n"))
    return nav.where("kind = 'group'").join(counts, "node_id", "left").select("node_id", "value", F.coalesce("n", F.lit(0)).alias("n"))


def nav_tree(manifest: DataFrame, hierarchy: str, page: str, order: str) -> DataFrame:
    """Edges of a tree from hierarchy arrays: ``parent, label, kind, first``; groups and pages once each, by first appearance, pages before groups."""
    h = F.col(hierarchy)
    groups = manifest.select(F.explode(F.sequence(F.lit(1), F.size(h))).alias("d"), h.alias("h"), order).select(
        F.array_join(F.slice("h", 1, F.col("d") - 1), " > ").alias("parent"), F.element_at("h", F.col("d")).alias("label"), F.lit("group").alias("kind"), order
    )
    pages = manifest.select(F.array_join(h, " > ").alias("parent"), F.col(page).alias("label"), F.lit("page").alias("kind"), order)
    once = groups.unionByName(pages).groupBy("parent", "kind", "label").agg(F.min(order).alias("first"))
    place = Window.partitionBy("parent").orderBy(F.when(F.col("kind") == "page", 0).otherwise(1), "first", "label")
    return once.withColumn("ordinal", F.row_number().over(place))


def first_seen(rows: DataFrame, key: str, order: str, other: str) -> DataFrame:
    """The first row of each key, with the distinct ``other`` values of its later rows in ``also``."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    later = numbered.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("_n") > 1, F.col(other)))).alias("also"))
    return numbered.where("_n = 1").drop("_n").join(later, key)


def unique_routes(rows: DataFrame, route: str, source: str, order: str) -> DataFrame:
    """Each route once, with ``conflict`` where it has different sources."""
    first = F.min_by(source, order).alias(source)
    return rows.groupBy(route).agg(first, (F.countDistinct(source) > 1).alias("conflict"), F.count("*").alias("n"))


def links_of(pages: DataFrame, route: str, content: str) -> DataFrame:
    """``route, link, target`` of every distinct internal link outside code and comments."""
    clean = F.col(content)
    for pattern in (r"(?s)```.*?```", r"`[^`\n]*`", r"(?s)\{/\*.*?\*/\}", r"(?s)<!--.*?-->"):
        clean = F.regexp_replace(clean, pattern, "")
    marked, plain = F.regexp_extract_all(clean, F.lit(LINK), 1), F.regexp_extract_all(clean, F.lit(LINK), 2)
    found = F.array_distinct(F.zip_with(marked, plain, lambda a, b: F.when(a != "", a).otherwise(b)))
    rows = pages.select(route, F.explode(found).alias("link"))
    return rows.withColumn("target", link_target(F.col(route), F.col("link"))).where(F.col("target").isNotNull()).dropDuplicates([route, "link", "target"])


def broken(links: DataFrame, routes: DataFrame) -> DataFrame:
    """Links whose target is no route; the root is one."""
    return links.where("target <> ''").join(routes.select(F.col("route").alias("target")), "target", "left_anti")


def introduced(current: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Failures that weren't there before."""
    return current.join(before.select(*keys), keys, "left_anti")


def _cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, as a table in the shared folder."""
    return written(df, "graph")


def resolved_aliases(redirects: DataFrame) -> DataFrame:
    """``source, final`` of every redirect; a cycle, or a walk into one, has no final route. Of a repeated source, the smallest destination counts.

    Pointer doubling: every round doubles the steps of each walk. If after some steps so many walks are still at a source, then a walk that ends does so within
    as many steps more, as all on its way but the last are among them; what is at a source after that is in a cycle. Tables of this size are merged, not sent through the driver."""
    walks = _cut(redirects.groupBy("source").agg(F.min("destination").alias("at")).withColumn("moving", F.lit(True)))
    steps, most = 1, walks.count()
    while steps <= most:
        jump = walks.select(F.col("source").alias("at"), F.col("at").alias("next")).hint("merge")
        walks = _cut(walks.join(jump, "at", "left").select("source", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moving")))
        moving = walks.where("moving").count()
        most = min(most, steps + moving) if moving else 0
        steps *= 2
    cyclic = walks.select(F.col("source").alias("at"), F.lit(True).alias("cycle")).hint("merge")
    return walks.join(cyclic, "at", "left").select("source", F.when(F.col("cycle").isNull(), F.col("at")).alias("final"))


def closure(edges: DataFrame) -> DataFrame:
    """``root, node, depth``: all that a node reaches, each with its least depth.

    Roots from which there is one way only, that ends, reach every node once: nothing of theirs is held against what is known (``_ways``).
    The others go breadth first: every step joins the frontier to the edges and drops what is known; it ends when nothing is new, however deep.
    The frontier is cut from its lineage at every step, what is known now and then."""
    pairs = _cut(edges.where("source <> target").select("source", "target").distinct())
    degree = pairs.groupBy("source").agg(F.count("*").alias("n"), F.min("target").alias("destination"))
    ends = resolved_aliases(degree.where("n = 1").select("source", "destination")).where("final IS NOT NULL")
    lone = _cut(ends.join(degree.where("n > 1").select(F.col("source").alias("final")), "final", "left_anti").select("source"))
    ways = _ways(pairs.join(lone.hint("merge"), "source", "left_semi"))
    known = frontier = pairs.join(lone.hint("merge"), "source", "left_anti").select(F.col("source").alias("root"), F.col("target").alias("node"), F.lit(1).alias("depth"))
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(pairs.select(F.col("source").alias("node"), "target"), "node").select("root", F.col("target").alias("node"), F.lit(depth).alias("depth")).where("root <> node").distinct()
        frontier = _cut(step.join(known.select("root", "node"), ["root", "node"], "left_anti"))
        known = known.unionByName(frontier)
        if depth % 8 == 0:
            known = _cut(known)
    return ways.unionByName(known)


def _ways(pairs: DataFrame) -> DataFrame:
    """The ``closure`` of sources with one target each and no cycle: a round doubles the depth, and makes each pair once, so what is moved goes with what comes out."""
    known = newest = _cut(pairs.select(F.col("source").alias("root"), F.col("target").alias("node"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        more = known.select(F.col("root").alias("node"), F.col("node").alias("target"), F.col("depth").alias("further")).hint("merge")
        farthest = newest.where(F.col("depth") == reach)
        newest = _cut(farthest.join(more, "node").select("root", F.col("target").alias("node"), (F.col("depth") + F.col("further")).alias("depth")))
        if newest.isEmpty():
            return known
        known, reach = known.unionByName(newest), 2 * reach


def lookup(pages: DataFrame, asked: DataFrame, path: str = "path") -> DataFrame:
    """``asked, path`` by exact path, else the first path that ends with it; null if there is none. Outer slashes and the suffix don't count."""
    stem = F.regexp_replace(F.regexp_replace("asked", "^/+", ""), r"\.mdx$", "")
    wanted = asked.select("asked", stem.alias("stem"))
    tails = pages.select(F.col(path).alias("_p"), F.explode(_tails(F.col(path))).alias("t"))
    both = wanted.join(tails.select(F.col("t.tail").alias("stem"), F.col("t.exact").alias("exact"), F.col("_p").alias("path")), "stem", "left")
    return both.groupBy("asked").agg(F.min_by("path", F.struct((~F.col("exact")).alias("later"), "path")).alias("path"))


def _tails(path: Column) -> Column:
    """All endings of a path at a slash: equal keys instead of a suffix test on every pair."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("tail"), (i == 1).alias("exact")))


def matched_sections(nav: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked, section``: equal whatever the case, else one contains the other's text, else a word of one begins a word of the other; the first
    in navigation order of the best tier.  Both are short lists; every asked name is held against every section."""
    both = asked.crossJoin(F.broadcast(nav.where("kind = 'group'").select(F.col("value").alias("section"), "node_id")))
    a, s = F.lower("asked"), F.lower("section")
    words = lambda c: F.split(c, r"[^a-z0-9]+")
    prefix = F.exists(words(a), lambda x: F.exists(words(s), lambda y: (x != "") & (y != "") & (x.startswith(y) | y.startswith(x))))
    tier = F.when(a == s, 1).when(F.contains(s, a), 2).when(prefix, 3)
    return both.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("asked").agg(F.min_by("section", F.struct("tier", "node_id")).alias("section"))


def sampled_evenly(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced from the first to the last; positions are rounded half to even."""
    w = Window.partitionBy(by)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.bround(p * (F.col("_n") - 1) / F.lit(most - 1), 0).cast("int"))
    return numbered.where((F.col("_n") <= most) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")
