"""Queries of catalogue operators; parts of the star schema stand for catalogue records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..registry import query
from ..session import table
from .inline import Inline

RAW = Inline(
    {"name": "string", "version": "string", "labels": "array<string>", "display": "string", "scd_publisher": "string", "author": "string", "direct": "boolean", "tag_direct": "string", "lifecycle": "string", "preview": "string", "tasks": "array<string>", "task": "string", "context": "string"},
    [
        ("m1", "1", [], "Model One", "Pub", "Other", True, None, "", None, ["chat"], "x,y", "1000"),
        ("m2", "2", ["Preview build"], "", "", "Author", False, " True ", None, None, [], " a , b,", "x"),
        ("m3", None, ["deprecated"], None, None, "A", None, None, None, "yes", None, None, None),
        ("m4", "4", [], "D", "P", None, None, None, "Deprecated", "yes", [], "", ""),
        ("", "5", [], "no name", "P", None, None, None, None, None, [], None, None),
        ("m6", "6", [], "no publisher", "", "", None, None, None, None, [], None, None),
        ("m7", "7", [], None, None, "A", None, "false", "active", "yes", ["t"], None, "42"),
    ],
)


def _raw(spark):
    r = RAW.df(spark)
    tags = F.map_filter(F.create_map(F.lit("author"), F.col("author"), F.lit("direct"), F.col("tag_direct"), F.lit("Preview"), F.col("preview"), F.lit("task"), F.col("task")), lambda k, v: v.isNotNull())
    detail = F.struct(F.col("display").alias("display_name"), F.col("scd_publisher").alias("publisher"), "direct", "lifecycle", "tasks", "context")
    return r.select("name", "version", "labels", tags.alias("tags"), detail.alias("detail"))


@query(
    "catalog_normalize",
    f"""SELECT name AS id, COALESCE(NULLIF(display, ''), name) AS display_name, COALESCE(NULLIF(scd_publisher, ''), NULLIF(author, '')) AS publisher, COALESCE(version, '') AS version,
    COALESCE(direct, false) OR lower(trim(COALESCE(tag_direct, ''))) = 'true' AS direct,
    CASE WHEN lower(COALESCE(lifecycle, '')) = 'deprecated' OR len(list_filter(labels, lambda x: contains(lower(x), 'deprecated'))) > 0 THEN 'deprecated'
         WHEN preview IS NOT NULL OR len(list_filter(labels, lambda x: contains(lower(x), 'preview'))) > 0 THEN 'preview' ELSE 'generally-available' END AS lifecycle,
    array_to_string(CASE WHEN len(COALESCE(tasks, [])) > 0 THEN tasks ELSE list_filter(list_transform(string_split(COALESCE(task, ''), ','), lambda x: trim(x)), lambda x: x <> '') END, '|') AS tasks,
    TRY_CAST(NULLIF(context, '') AS BIGINT) AS context FROM {RAW.sql} WHERE COALESCE(name, '') <> '' AND COALESCE(NULLIF(scd_publisher, ''), NULLIF(author, '')) IS NOT NULL""",
)
def catalog_normalize(spark, sf_dir):
    return catalog.normalized(_raw(spark)).withColumn("tasks", F.array_join("tasks", "|"))


def models(spark, sf_dir):
    """Parts as models: brand = publisher, type = lifecycle, words of the name = tasks, size = context."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("kind"), F.split("p_name", " ").alias("tasks"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


@query(
    "catalog_dedupe",
    """WITH m AS (SELECT p_brand AS publisher, p_type AS kind, lpad((p_partkey % 97)::VARCHAR, 3, '0') || '-' || p_partkey AS version, string_split(p_name, ' ') AS tasks, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS created, p_size FROM part),
    g AS (SELECT lower(publisher) AS a, lower(kind) AS b, max(version) AS latest_version, arg_max(p_size, version) AS size, min(NULLIF(created, '')) AS created, any_value(publisher) AS publisher, any_value(kind) AS kind, COUNT(DISTINCT version)::BIGINT AS n_versions, array_to_string(list_sort(list_distinct(flatten(list(tasks)))), '|') AS tasks FROM m GROUP BY ALL)
    SELECT publisher, kind, latest_version, size, created, n_versions, tasks FROM (SELECT a, b, publisher, kind, latest_version, size, created, n_versions, tasks FROM g)""",
)
def catalog_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("publisher"), F.col("p_type").alias("kind"), F.concat(F.lpad((F.col("p_partkey") % 97).cast("string"), 3, "0"), F.lit("-"), F.col("p_partkey").cast("string")).alias("version"),
        F.split("p_name", " ").alias("tasks"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("created"), F.col("p_size").alias("size"),
    )
    got = catalog.deduplicated(rows, ["publisher", "kind"], "version", ["size"], ["tasks"], ["created"])
    return got.select("publisher", "kind", "latest_version", "size", "created", F.size("versions").cast("long").alias("n_versions"), F.array_join("tasks", "|").alias("tasks"))


@query("latest_version", "SELECT p_brand AS publisher, p_type AS kind, arg_max(p_partkey, lpad((p_partkey % 97)::VARCHAR, 3, '0') || '-' || p_partkey) AS id FROM part GROUP BY ALL")
def latest_version(spark, sf_dir):
    version = F.concat(F.lpad((F.col("p_partkey") % 97).cast("string"), 3, "0"), F.lit("-"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("publisher"), F.col("p_type").alias("kind")).agg(F.max_by("p_partkey", version).alias("id"))


def availability(spark, sf_dir):
    """Line items as availability: brand = model, return flag = sku, the supplier's nation = region, line status = lifecycle."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("p_brand").alias("model"), F.col("l_returnflag").alias("sku"), F.col("n_name").alias("region"), F.when(F.col("l_linestatus") == "F", "Deprecated").otherwise("active").alias("lifecycle"))


AVAILABLE = "SELECT p_brand AS model, l_returnflag AS sku, n_name AS region, l_linestatus = 'F' AS deprecated FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


@query("region_matrix", f"SELECT model, sku, COUNT(DISTINCT region)::BIGINT AS n_regions, array_to_string(list_sort(list(DISTINCT region)), '|') AS regions FROM ({AVAILABLE}) WHERE NOT deprecated GROUP BY ALL")
def region_matrix(spark, sf_dir):
    rows = availability(spark, sf_dir).where("lifecycle <> 'Deprecated'").groupBy("model", "sku").agg(F.array_sort(F.collect_set("region")).alias("r"))
    return rows.select("model", "sku", F.size("r").cast("long").alias("n_regions"), F.array_join("r", "|").alias("regions"))


@query("region_merge", f"SELECT lower(model) AS model, array_to_string(list_sort(list(DISTINCT sku || ':' || region)), '|') AS regions FROM ({AVAILABLE}) WHERE NOT deprecated GROUP BY 1")
def region_merge(spark, sf_dir):
    merged = catalog.regions_of(availability(spark, sf_dir))
    pairs = F.flatten(F.transform(F.map_entries("regions"), lambda e: F.transform(e["value"], lambda r: F.concat(e["key"], F.lit(":"), r))))
    return merged.select("model", F.array_join(F.array_sort(pairs), "|").alias("regions"))


@query("region_pivot", f"SELECT region, COUNT(*) FILTER (WHERE sku = 'A')::BIGINT AS a, COUNT(*) FILTER (WHERE sku = 'N')::BIGINT AS n, COUNT(*) FILTER (WHERE sku = 'R')::BIGINT AS r FROM (SELECT DISTINCT region, sku, model FROM ({AVAILABLE})) GROUP BY region")
def region_pivot(spark, sf_dir):
    seen = availability(spark, sf_dir).select("region", "sku", "model").distinct()
    out = seen.groupBy("region").pivot("sku", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return out.select("region", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "ANR"])


@query("rollcall", f"SELECT COUNT(DISTINCT model)::BIGINT AS models, COUNT(DISTINCT region)::BIGINT AS regions, COUNT(DISTINCT sku)::BIGINT AS skus FROM ({AVAILABLE})")
def rollcall(spark, sf_dir):
    return availability(spark, sf_dir).agg(*[F.countDistinct(c).alias(f"{c}s") for c in ("model", "region", "sku")])


@query("carry_forward", "SELECT p_brand AS model, CASE WHEN p_brand LIKE '%1' THEN 'A|N' ELSE 'old' END AS regions FROM (SELECT DISTINCT p_brand FROM part)")
def carry_forward(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model")).distinct()
    now = brands.withColumn("regions", F.when(F.col("model").endswith("1"), F.array(F.lit("A"), F.lit("N"))).otherwise(F.array().cast("array<string>")))
    old = brands.withColumn("regions", F.array(F.lit("old")))
    return catalog.filled(now, old, "model", "regions").withColumn("regions", F.array_join("regions", "|"))


DEFAULTS = Inline({"publisher": "string", "offers": "array<string>"}, [("Brand#11", ["standard"]), ("Brand#12", ["batch", "global"])])


@query("enrichment_override", f"SELECT p_partkey AS id, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['own'] ELSE COALESCE(d.offers, []) END, '|') AS offers FROM part LEFT JOIN {DEFAULTS.sql} d ON d.publisher = p_brand")
def enrichment_override(spark, sf_dir):
    rows = models(spark, sf_dir).withColumn("offers", F.when(F.col("size") % 2 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")))
    return catalog.filled(rows, DEFAULTS.df(spark), "publisher", "offers", small=True).select("id", F.array_join("offers", "|").alias("offers"))


ICONS = Inline({"publisher": "string", "icon": "string"}, [("a", "<svg a>"), ("b", "<svg b>")])


@query("icon_fallback", "SELECT * FROM (VALUES ('a', '<svg a>'), ('b', '<svg b>'), ('c', '<svg a>'), ('d', '<svg a>')) AS t(publisher, icon)")
def icon_fallback(spark, sf_dir):
    return catalog.icon_fallbacks(ICONS.df(spark), [("c", "a"), ("d", "c"), ("b", "a"), ("e", "missing"), ("f", "g"), ("g", "zz")])


@query("deprecated_filter", "SELECT p_partkey AS id FROM part WHERE lower(p_brand) NOT IN ('brand#11', 'brand#23') AND p_type NOT LIKE 'PROMO%'")
def deprecated_filter(spark, sf_dir):
    rows = models(spark, sf_dir).withColumn("lifecycle", F.when(F.col("kind").startswith("PROMO"), "deprecated"))
    return catalog.without_deprecated(rows, ["BRAND#11", "Brand#23"], "publisher", "lifecycle").select("id")


@query("catalog_search", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_type), 'st') OR contains(lower(p_brand), 'st') OR len(list_filter(string_split(p_name, ' '), lambda k: contains(lower(k), 'st'))) > 0")
def catalog_search(spark, sf_dir):
    return models(spark, sf_dir).where(catalog.matches_text("ST", ["kind", "publisher"], "tasks")).select("id")


CHOSEN = {"publisher": ["Brand#11", "Brand#12", "Brand#13"], "size": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10"]}


def facets():
    return {"publisher": F.array("publisher"), "kind": F.array("kind"), "tasks": F.col("tasks"), "size": F.array(F.col("size").cast("string"))}


@query("facet_filter", "SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size <= 10")
def facet_filter(spark, sf_dir):
    return models(spark, sf_dir).where(catalog.matches_facets(facets(), CHOSEN)).select("id")


@query(
    "facet_counts",
    """WITH m AS (SELECT *, p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AS b, p_size <= 10 AS s FROM part)
    SELECT 'publisher' AS facet, p_brand AS value, COUNT(*)::BIGINT AS n FROM m WHERE s GROUP BY p_brand UNION ALL SELECT 'kind', p_type, COUNT(*) FROM m WHERE b AND s GROUP BY p_type
    UNION ALL SELECT 'size', p_size::VARCHAR, COUNT(*) FROM m WHERE b GROUP BY p_size UNION ALL SELECT 'tasks', t, COUNT(*) FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM m WHERE b AND s) GROUP BY t""",
)
def facet_counts(spark, sf_dir):
    return catalog.facet_counts(models(spark, sf_dir), facets(), CHOSEN)


@query("publisher_groups", "SELECT publisher, COUNT(*)::BIGINT AS n, array_to_string(list_sort(list(name)), '|') AS names FROM (SELECT p_brand AS publisher, p_name AS name FROM part ORDER BY p_size DESC, p_partkey LIMIT 50) GROUP BY publisher")
def publisher_groups(spark, sf_dir):
    visible = catalog.page(models(spark, sf_dir), [F.col("size").desc(), F.col("id")], 50)
    return catalog.grouped_page(visible, "publisher", "name")


@query("sort_modes", "SELECT id, mode, n::INTEGER AS n FROM (SELECT p_partkey AS id, 'newest' AS mode, row_number() OVER (ORDER BY p_retailprice DESC, p_name, p_partkey) AS n FROM part UNION ALL SELECT p_partkey, 'context', row_number() OVER (ORDER BY COALESCE(CASE WHEN p_size > 25 THEN p_size END, 0) DESC, p_partkey) FROM part) WHERE n <= 100")
def sort_modes(spark, sf_dir):
    rows = models(spark, sf_dir)
    context = F.coalesce(F.when(F.col("size") > 25, F.col("size")), F.lit(0))
    out = None
    for mode, order in (("newest", [F.col("price").desc(), F.col("name"), F.col("id")]), ("context", [context.desc(), F.col("id")])):
        first = catalog.page(rows, order, 50, 2)
        # the numbers of a hundred rows
        from pyspark.sql import Window

        got = first.withColumn("n", F.row_number().over(Window.orderBy(*order))).select("id", F.lit(mode).alias("mode"), "n")
        out = got if out is None else out.unionByName(got)
    return out


def changed_parts(spark, sf_dir):
    """Two states of the parts: some gone, some new, some changed, a null among the values."""
    before = models(spark, sf_dir).where("id % 10 <> 3").select("id", "name", "size", "price")
    after = models(spark, sf_dir).where("id % 10 <> 4").select("id", F.when(F.col("id") % 7 == 0, "renamed").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("size")).alias("size"), "price")
    return catalog.compared(before, after, ["id"], ["name", "size", "price"])


CHANGES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 3 THEN 'added' WHEN p_partkey % 10 = 4 THEN 'removed' WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'changed' ELSE 'same' END AS change,
    CASE WHEN p_partkey % 10 IN (3, 4) THEN [] ELSE list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'name' END, CASE WHEN p_partkey % 11 = 0 THEN 'size' END], lambda x: x IS NOT NULL) END AS fields FROM part"""


@query("catalog_diff", f"SELECT id, change, array_to_string(fields, '|') AS changed_fields FROM ({CHANGES})")
def catalog_diff(spark, sf_dir):
    return changed_parts(spark, sf_dir).withColumn("changed_fields", F.array_join("changed_fields", "|"))


@query("changed_fields", f"SELECT field, COUNT(*)::BIGINT AS n FROM (SELECT unnest(fields) AS field FROM ({CHANGES})) GROUP BY field")
def changed_fields(spark, sf_dir):
    return catalog.changed_field_counts(changed_parts(spark, sf_dir))


@query("change_samples", f"SELECT change, COUNT(*)::BIGINT AS total, array_to_string(list_sort(list(lpad(id::VARCHAR, 9, '0')))[1:20], '|') AS sample, COUNT(*) > 20 AS truncated FROM ({CHANGES}) GROUP BY change")
def change_samples(spark, sf_dir):
    return catalog.bounded_sample(changed_parts(spark, sf_dir), ["change"], F.lpad(F.col("id").cast("string"), 9, "0"), 20)


@query("shard_duplicates", "SELECT publisher, name, COUNT(*)::BIGINT AS n FROM (SELECT p_brand AS publisher, p_name AS name FROM part WHERE p_size > 10 UNION ALL SELECT p_brand, p_name FROM part WHERE p_size <= 12) GROUP BY ALL HAVING COUNT(*) > 1")
def shard_duplicates(spark, sf_dir):
    rows = models(spark, sf_dir)
    return catalog.duplicates([rows.where("size > 10"), rows.where("size <= 12")], ["publisher", "name"])


@query("shard_split", "SELECT CASE WHEN p_brand = 'Brand#11' THEN 'one' ELSE 'rest' END AS shard, COUNT(*)::BIGINT AS n FROM part GROUP BY 1")
def shard_split(spark, sf_dir):
    return models(spark, sf_dir).groupBy(F.when(F.col("publisher") == "Brand#11", "one").otherwise("rest").alias("shard")).agg(F.count("*").alias("n"))


@query(
    "catalog_validation",
    """WITH s AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE p_size > 45) AS direct, COUNT(*) FILTER (WHERE p_partkey % 100 = 0) AS no_name, (SELECT COUNT(*) FROM part) AS before FROM part WHERE p_partkey % 3 <> 0)
    SELECT 'few-direct' AS error, direct::BIGINT AS n FROM s WHERE direct < 1000000 UNION ALL SELECT 'dropped', before - n FROM s WHERE (before - n) / before > 0.2 UNION ALL SELECT 'missing-name', no_name FROM s WHERE no_name > 0""",
)
def catalog_validation(spark, sf_dir):
    rows = models(spark, sf_dir)
    now = rows.where("id % 3 <> 0").withColumn("name", F.when(F.col("id") % 100 == 0, "").otherwise(F.col("name"))).withColumn("direct", F.col("size") > 45)
    return catalog.output_errors(now, rows, ["name", "publisher"], "direct", 1_000_000)


@query("model_order", "SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey)::INTEGER AS n FROM part")
def model_order(spark, sf_dir):
    from pyspark.sql import Window

    return models(spark, sf_dir).select("id", F.row_number().over(Window.partitionBy("publisher").orderBy(F.lower("name"), "id")).alias("n"))
