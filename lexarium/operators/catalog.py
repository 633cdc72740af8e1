"""Catalogues of records: normalise, deduplicate, merge, filter, count facets, compare snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import first_nonempty, first_truthy, text_list


def normalized(raw: DataFrame) -> DataFrame:
    """Records from nested annotations.

    ``raw``: ``name``, ``version``, ``labels array<string>``, ``tags map<string,string>``, ``detail`` (struct of display_name, publisher, direct,
    lifecycle, tasks, context). The detail counts before the tags; empty text and empty lists fall through.  Records without a name or a publisher go."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    publisher = F.coalesce(first_truthy(F.col("detail.publisher"), tag("author")), F.lit(""))
    marked = lambda word: F.exists("labels", lambda x: F.contains(F.lower(x), F.lit(word)))
    deprecated = (F.lower(F.coalesce("detail.lifecycle", F.lit(""))) == "deprecated") | tag("Deprecated").isNotNull() | marked("deprecated")
    preview = tag("Preview").isNotNull() | marked("preview")
    return raw.where((F.coalesce("name", F.lit("")) != "") & (publisher != "")).select(
        F.col("name").alias("id"),
        F.coalesce(first_truthy(F.col("detail.display_name"), tag("displayName")), F.col("name")).alias("display_name"),
        publisher.alias("publisher"),
        F.coalesce("version", F.lit("")).alias("version"),
        (F.coalesce("detail.direct", F.lit(False)) | (F.lower(F.trim(F.coalesce(tag("direct"), F.lit("")))) == "true")).alias("direct"),
        F.when(deprecated, "deprecated").when(preview, "preview").otherwise("generally-available").alias("lifecycle"),
        first_nonempty(F.col("detail.tasks"), text_list(tag("task"))).alias("tasks"),
        first_truthy(F.col("detail.context"), tag("context")).try_cast("long").alias("context"),
    )


def deduplicated(rows: DataFrame, keys: list[str], version: str, latest: list[str], unions: list[str], least: list[str]) -> DataFrame:
    """One row per key (whatever the case): ``latest`` columns from the greatest version string, ``unions`` of lists sorted, ``least`` of nonempty texts.

    Lists are exploded and pre-aggregated as sets of a key, so a key with many versions is combined map-side."""
    lowered = rows.select("*", *[F.lower(k).alias(f"_{k}") for k in keys])
    group = [f"_{k}" for k in keys]
    pick = [F.max_by(c, F.struct(F.col(version), *keys)).alias(c) for c in [*keys, *latest]]
    flat = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in unions]
    small = [F.min(F.nullif(c, F.lit(""))).alias(c) for c in least]
    versions = F.sort_array(F.collect_set(version), asc=False).alias("versions")
    return lowered.groupBy(*group).agg(*pick, *flat, *small, F.max(version).alias("latest_version"), versions).drop(*group)


def regions_of(availability: DataFrame) -> DataFrame:
    """``model, regions map<sku, array<region>>`` from exploded rows (``model, sku, region, lifecycle``); rows marked exactly Deprecated don't count."""
    per_sku = availability.where((F.coalesce("lifecycle", F.lit("")) != "Deprecated") & (F.col("sku") != "") & (F.col("region") != "")).groupBy(F.lower("model").alias("model"), "sku").agg(F.array_sort(F.collect_set("region")).alias("regions"))
    return per_sku.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sku", "regions")))).alias("regions"))


def filled(rows: DataFrame, other: DataFrame, key: str, column: str, small: bool = False) -> DataFrame:
    """``column`` from ``other`` where a row's own is empty. ``small``: ``other`` is a bounded dictionary."""
    side = other.select(key, F.col(column).alias("_other"))
    empty = F.col(column).isNull() | (F.size(column) <= 0)
    return rows.join(F.broadcast(side) if small else side, key, "left").withColumn(column, F.when(empty, F.coalesce("_other", column)).otherwise(F.col(column))).drop("_other")


def icon_fallbacks(icons: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Icons with those of other publishers where one is missing. Rules hold one after another, so a filled icon can fill a later one; the rules
    are a short list, folded to the publishers each may take from before one join."""
    source: dict[str, list[str]] = {}
    for name, other in rules:
        if name not in source:
            source[name] = [other, *source.get(other, [])]
    if not source:
        return icons
    wanted = icons.sparkSession.createDataFrame([(n, i, o) for n, others in source.items() for i, o in enumerate(others)], "publisher string, i int, other string")
    have = icons.select(F.col("publisher").alias("other"), F.col("icon"))
    found = F.broadcast(wanted).join(have, "other").groupBy("publisher").agg(F.min_by("icon", "i").alias("icon")).join(icons.select("publisher"), "publisher", "left_anti")
    return icons.unionByName(found.select(*icons.columns))


def without_deprecated(rows: DataFrame, blocked: list[str], key: str, lifecycle: str) -> DataFrame:
    """Rows neither on the block list (whatever the case) nor deprecated by their own word."""
    low = [b.lower() for b in blocked]
    return rows.where(~F.lower(key).isin(low) & (F.coalesce(lifecycle, F.lit("")) != "deprecated")) if low else rows.where(F.coalesce(lifecycle, F.lit("")) != "deprecated")


def matches_text(needle: str, columns: list[str], keywords: str) -> Column:
    """A substring of any of the columns or keywords, whatever the case."""
    q = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), q) for c in columns]) | F.exists(keywords, lambda k: F.contains(F.lower(k), q))


def matches_facets(values: dict[str, Column], chosen: dict[str, list[str]]) -> Column:
    """Every facet with choices has one of them."""
    return reduce(lambda a, b: a & b, [F.arrays_overlap(values[f], F.array(*map(F.lit, v))) for f, v in chosen.items() if v], F.lit(True))


def facet_counts(rows: DataFrame, values: dict[str, Column], chosen: dict[str, list[str]]) -> DataFrame:
    """``facet, value, n``: for each facet, rows that all other choices keep.

    Each row tells once which facets it misses; it counts for a facet if it misses none but that one. One scan and one exploded pass, however many facets."""
    misses = {f: ~F.arrays_overlap(values[f], F.array(*map(F.lit, v))) for f, v in chosen.items() if v}
    total = reduce(lambda a, b: a + b, [m.cast("int") for m in misses.values()], F.lit(0))

    def pairs_of(facet: str, v: Column) -> Column:
        kept = total - (misses[facet].cast("int") if facet in misses else F.lit(0)) == 0
        named = F.transform(v, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value")))
        return F.when(kept, named).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))

    pairs = [pairs_of(facet, v) for facet, v in values.items()]
    return rows.select(F.explode(F.flatten(F.array(*pairs))).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """The first ``number`` pages, as a list that loads more shows them."""
    return rows.orderBy(*order).limit(size * number)


def grouped_page(visible: DataFrame, by: str, name: str) -> DataFrame:
    """Groups of the visible rows alone, with their size and names."""
    return visible.groupBy(by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(name)), "|").alias("names"))


def compared(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``change`` per key: added, removed, changed or same; ``changed_fields``: names of fields that differ, null-safely. One aggregate over both sides, so null keys are keys like others.

    Of several rows of a key on one side the least, by its JSON, stands for them."""
    sides = [rows.select(*keys, F.struct(*fields).alias("_row"), F.to_json(F.struct(*fields)).alias("_text"), F.lit(new).alias("_new")) for rows, new in ((before, False), (after, True))]
    one = lambda new: F.min_by("_row", F.when(F.col("_new") == new, F.col("_text")))
    both = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.bool_or(~F.col("_new")).alias("was"), F.bool_or("_new").alias("came"), one(False).alias("b"), one(True).alias("a"))
    differ = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    both = both.withColumn("changed_fields", F.when(F.col("was") & F.col("came"), differ).otherwise(F.array().cast("array<string>")))
    change = F.when(~F.col("was"), "added").when(~F.col("came"), "removed").when(F.size("changed_fields") > 0, "changed").otherwise("same")
    return both.select(*keys, change.alias("change"), "changed_fields")


def changed_field_counts(diff: DataFrame) -> DataFrame:
    return diff.select(F.explode("changed_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def bounded_sample(rows: DataFrame, by: list[str], name: Column, most: int) -> DataFrame:
    """Per group: how many, the first ``most`` names, and whether some are left out. Ranks are cut before names are gathered."""
    numbered = rows.withColumn("_name", name).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_name")))
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"))
    sample = numbered.where(F.col("_n") <= most).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("_name")), "|").alias("sample"))
    return totals.join(sample, by).withColumn("truncated", F.col("total") > most)


def duplicates(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that occur more than once within or across shards."""
    whole = reduce(lambda a, b: a.unionByName(b), [s.select(*keys) for s in shards])
    return whole.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def output_errors(rows: DataFrame, previous: DataFrame, needed: list[str], direct: str, least_direct: int, drop: float = 0.2) -> DataFrame:
    """``error, n`` of a catalogue: too few direct rows, a drop beyond ``drop`` against the previous one, and rows that miss a field."""
    stats = rows.agg(F.count("*").alias("n"), F.count_if(F.col(direct)).alias("direct"), *[F.count_if(F.coalesce(c, F.lit("")) == "").alias(f"no_{c}") for c in needed])
    stats = stats.crossJoin(previous.agg(F.count("*").alias("before")))
    rules = [F.when(F.col("direct") < least_direct, F.struct(F.lit("few-direct").alias("error"), F.col("direct").alias("n")))]
    rules.append(F.when((F.col("before") > 0) & ((F.col("before") - F.col("n")) / F.col("before") > drop), F.struct(F.lit("dropped").alias("error"), (F.col("before") - F.col("n")).alias("n"))))
    rules += [F.when(F.col(f"no_{c}") > 0, F.struct(F.lit(f"missing-{c}").alias("error"), F.col(f"no_{c}").alias("n"))) for c in needed]
    return stats.select(F.explode(F.array_compact(F.array(*rules))).alias("e")).select("e.*")


def next_phase(mirror_differs: Column, generated_differs: Column) -> Column:
    """What a two-phase sync does: the mirror first, then the primary copy, else nothing."""
    return F.when(mirror_differs, "mirror").when(generated_differs, "primary").otherwise("noop")


def sync_phases(mirror: DataFrame, primary: DataFrame, generated: DataFrame, by: str, keys: list[str], fields: list[str]) -> DataFrame:
    """``by, phase, changes`` of every catalogue: its mirror follows the primary copy first; then what was generated is staged, with how many rows differ. ``by`` is one of ``keys``."""
    count = lambda a, b, name: compared(a, b, keys, fields).groupBy(by).agg(F.count_if(F.col("change") != "same").alias(name))
    both = count(mirror, primary, "_m").join(count(primary, generated, "_g"), by, "full_outer")
    behind, fresh = F.coalesce("_m", F.lit(0)), F.coalesce("_g", F.lit(0))
    phase = next_phase(behind > 0, fresh > 0)
    return both.select(by, phase.alias("phase"), F.when(phase == "mirror", behind).when(phase == "primary", fresh).otherwise(0).alias("changes"))
