"""Evaluation: gates, matrices with completeness, scores, comparisons, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(rows: DataFrame, ok: str, threshold: float, least: int = 1) -> DataFrame:
    """``total, passed, pass_rate, decision``: pass at the threshold or above, with at least ``least`` rows; a rate of 0 for none."""
    counted = rows.agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("passed"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("passed") / F.col("total"))
    return counted.withColumn("pass_rate", rate).withColumn("decision", F.when((F.col("total") >= least) & (F.col("pass_rate") >= threshold), "pass").otherwise("fail"))


def required(selectors: list[DataFrame]) -> DataFrame:
    """All combinations of the selectors' rows: lists of names, a few rows each."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), selectors)


def completeness(observed: DataFrame, wanted: DataFrame, keys: list[str], valid: str) -> DataFrame:
    """Every key's ``status``: complete, missing, duplicate, invalid, or unexpected. One aggregate over both sides, so null keys are keys like others; a key wanted twice is wanted."""
    sides = observed.select(*keys, F.coalesce(F.expr(valid), F.lit(False)).alias("_valid"), F.lit(1).alias("_seen")).unionByName(wanted.select(*keys, F.lit(None).cast("boolean").alias("_valid"), F.lit(0).alias("_seen")))
    both = sides.groupBy(*keys).agg(F.sum("_seen").alias("n"), F.bool_and("_valid").alias("_valid"), (F.min("_seen") == 0).alias("_wanted"))
    status = F.when(~F.col("_wanted"), "unexpected").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "duplicate").when(~F.col("_valid"), "invalid").otherwise("complete")
    return both.select(*keys, "n", status.alias("status"))


def hit_share(expected: Column, found: Column) -> Column:
    """Share of expected values that are found; 1 if none is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.filter(expected, lambda e: F.array_contains(found, e))) / F.size(expected))


def suffix_hits(found: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """``case, first_rank`` of every case: the least rank of a found path that equals an expected one or ends with a slash and its last part; null for a miss.

    ``found``: ``case, rank, path``; ``cases``: ``case, expected`` (an array).  Both sides meet by the last part, so nothing is held against all paths."""
    last = lambda p: F.element_at(F.split(p, "/"), -1)
    wanted = cases.select(case, F.explode("expected").alias("_e")).withColumn("_last", last(F.col("_e")))
    ranked = found.withColumn("_last", last(F.col("path")))
    met = ranked.join(wanted, [case, "_last"]).where((F.col("path") == F.col("_e")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("_last"))))
    first = met.groupBy(case).agg(F.min("rank").alias("first_rank"))
    return cases.select(case).distinct().join(first, case, "left")


def composite(parts: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, b: a + b, [c * w for c, w in parts])


def means_by(rows: DataFrame, value: str, groups: list[list[str]], valid: str) -> DataFrame:
    """Means of valid rows by each of ``groups``, in one pass: columns that a group doesn't have are null."""
    columns = list(dict.fromkeys(c for g in groups for c in g))
    sets = [[F.col(c) for c in g] for g in groups]
    return rows.where(valid).groupingSets(sets, *columns).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def operational(rows: DataFrame, by: list[str], measures: list[str], status: str) -> DataFrame:
    """Null-aware means and presence counts per measure, and rows by status; what wasn't captured stays null."""
    out = [F.count("*").alias("n")]
    for m in measures:
        out += [F.avg(m).alias(f"avg_{m}"), F.count(m).alias(f"present_{m}"), F.count_if(F.col(m).isNull()).alias(f"missing_{m}"), F.when(F.abs(F.sum(m)) <= 1e15, F.sum(m)).alias(f"sum_{m}")]
    return rows.groupBy(*by).agg(*out, F.count_if(F.col(status) == "F").alias("n_final"))


def compared(current: DataFrame, baseline: DataFrame, keys: list[str], value: str, band: float = 0.05) -> DataFrame:
    """``verdict`` of current against baseline: better or worse beyond the band, same within, inconclusive without one of them."""
    both = current.select(*keys, F.col(value).alias("current")).join(baseline.select(*keys, F.col(value).alias("baseline")), keys, "full_outer")
    delta = F.col("current") - F.col("baseline")
    return both.withColumn("verdict", F.when(delta.isNull(), "inconclusive").when(delta > band, "better").when(delta < -band, "worse").otherwise("same"))


def ranked(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Order by falling value, ties by name; the first three get a medal."""
    window = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(name))
    medal = F.element_at(F.array(F.lit("gold"), F.lit("silver"), F.lit("bronze")), F.least(F.col("rank"), F.lit(3)))
    return rows.withColumn("rank", F.row_number().over(window)).withColumn("medal", F.when(F.col("rank") <= 3, medal))


def rankings_agree(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Whether every group ranks the names alike: ``n_groups, n_orders, agree``."""
    lists = ranked(rows, [by], value, name).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda s: s[name]), ">").alias("order"))
    return lists.agg(F.count("*").alias("n_groups"), F.countDistinct("order").alias("n_orders")).withColumn("agree", F.col("n_orders") <= 1)


def delta_band(delta: Column, wide: float = 0.05) -> Column:
    return F.when(delta.isNull(), "untested").when(delta > wide, "supported").when(delta > 0, "marginal").when(delta == 0, "neutral").otherwise("rejected")


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """Reason of the first rule that fails, null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in rules])


def failures(rules: list[tuple[Column, str]]) -> Column:
    """Reasons of all rules that fail, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in rules]))


def histogram(rows: DataFrame, by: str, order: list[str], detail: int) -> tuple[DataFrame, DataFrame]:
    """Counts of all rows by class, and the first ``detail`` rows of each class."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return counts, numbered.where(F.col("_n") <= detail).drop("_n")


def bounded_history(rows: DataFrame, key: str, run: str, at: str, keep: int) -> DataFrame:
    """Latest ``keep`` entries of each key, one per run (the newest)."""
    newest = rows.withColumn("_d", F.row_number().over(Window.partitionBy(key, run).orderBy(F.col(at).desc()))).where("_d = 1").drop("_d")
    return newest.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), run))).where(F.col("position") <= keep)


def mismatches(pairs: list[tuple[str, Column, Column]]) -> Column:
    """Names of the pairs that differ (null-safe)."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs]))
