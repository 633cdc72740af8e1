"""Record-level rules: schemas, probes, examples, branches, tools, ordered unions, hash embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import failures, first_failure

# Fields of an evaluation row, by type, and the states a row can be in.
ROW_TEXT = ("scenario_id", "server", "model", "category", "question", "status")
ROW_STATES = ("ok", "error", "timeout", "skipped")
MOST_USAGE = 10**15


def row_errors(present: set[str], text: tuple[str, ...] = ROW_TEXT, states: tuple[str, ...] = ROW_STATES, counters: tuple[str, ...] = ("turns", "output_tokens")) -> Column:
    """Ordered list of what is wrong with an evaluation row; the row itself stays. ``present``: columns that the table has.

    Texts are needed and not blank; a state is one of the known ones; a row that is ok has a response, one that isn't has none;
    counters are null or between 0 and a bound; a score is null or between 0 and 1."""
    missing = [(F.lit(c in present), f"missing-{c}") for c in text]
    blank = [(F.trim(F.coalesce(c, F.lit(""))) != "", f"blank-{c}") for c in text if c in present]
    rules = [*missing, *blank]
    if "status" in present:
        rules.append((F.col("status").isin(*states), "unknown-status"))
        if "response" in present:
            has = F.trim(F.coalesce("response", F.lit(""))) != ""
            rules.append((has == (F.col("status") == "ok"), "response-status"))
    rules += [(F.col(c).isNull() | F.col(c).between(0, MOST_USAGE), f"range-{c}") for c in counters if c in present]
    if "composite" in present:
        rules.append((F.col("composite").isNull() | (F.col("composite").between(0, 1) & ~F.isnan("composite")), "range-composite"))
    return failures(rules)


def probe_verdict(status: Column, error: Column, body: Column, final_url: Column, wanted_origin: Column, markers: Column) -> Column:
    """First reason why a probed page isn't the expected one, null if it is: unreachable, bad status, another origin, empty, stale (a marker is missing)."""
    low = F.lower(body)
    return first_failure(
        [
            (error.isNull() & status.isNotNull(), "unreachable"),
            (status.between(200, 299), "bad-status"),
            (final_url.startswith(wanted_origin), "redirected-away"),
            (F.trim(F.coalesce(body, F.lit(""))) != "", "empty"),
            (F.forall(markers, lambda m: F.contains(low, F.lower(m))), "stale"),
        ]
    )


def with_examples(operations: DataFrame, examples: DataFrame, key: str, column: str) -> DataFrame:
    """Operations with examples from a static table where they have none of their own."""
    return operations.join(examples.select(key, F.col(column).alias("_given")), key, "left").withColumn(column, F.coalesce(column, "_given")).drop("_given")


def matched_branches(batches: DataFrame, pulls: DataFrame) -> DataFrame:
    """``batch, number, problem``: the pull request of each batch's branch; several are a problem, none isn't yet."""
    found = pulls.groupBy(F.col("head_ref").alias("branch")).agg(F.count("*").alias("n"), F.min("number").alias("number"))
    both = batches.join(found, "branch", "left")
    return both.select("batch", F.when(F.col("n") == 1, F.col("number")).alias("number"), F.when(F.col("n") > 1, "ambiguous").alias("problem"))


def source_tools(observed: DataFrame, configured: DataFrame) -> DataFrame:
    """Observed tools that are a source's: its prefix, a separator, and one of its tools, or just a tool that any source lists. ``configured``: ``prefix, tool``, a short list."""
    parts = observed.withColumn("_prefix", F.regexp_extract("tool", r"^(.*?)(?:-|__|/|\.)", 1)).withColumn("_rest", F.regexp_extract("tool", r"^.*?(?:-|__|/|\.)(.*)$", 1))
    exact = parts.join(configured.select(F.col("prefix").alias("_prefix"), F.col("tool").alias("_rest")).distinct(), ["_prefix", "_rest"], "left_semi")
    bare = parts.join(configured.select("tool").distinct(), "tool", "left_semi")
    return exact.select("tool").unionByName(bare.select("tool")).distinct()


def merged_metadata(files: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Lists of run files merged in order, each value once, where it first stands. Run files are few; one row comes out."""
    merge = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda s: s[c]))).alias(c)
    return files.agg(*[merge(c) for c in columns])


def unmet(plan: DataFrame, present: DataFrame) -> DataFrame:
    """Operations whose target is no longer what the plan saw: a hash that differs, a file that came or went."""
    seen = plan.select("path", F.col("target_sha").alias("planned"))
    now = present.select("path", F.col("sha256").alias("found"))
    return seen.join(now, "path", "left").where(~F.col("planned").eqNullSafe(F.col("found"))).select("path", "planned", "found")


def result_row(cause: str, threshold: float) -> Column:
    """A result without evidence, for runs that were blocked or failed."""
    return F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("passed"), F.lit(0.0).alias("pass_rate"), F.lit(threshold).alias("threshold"), F.lit(cause).alias("status"))


def exit_code(status: Column, phase: Column) -> Column:
    """0 for a pass, 1 for a fail of the gating phase, 2 for a run without evidence; other phases only report."""
    return F.when(status.isin("blocked", "error"), 2).when((status == "fail") & (phase == "gate"), 1).otherwise(0)


def state_marker(fields: Column, prefix: str) -> Column:
    """State as base64 JSON inside a comment."""
    return F.concat(F.lit(f"<!-- {prefix}:"), F.regexp_replace(F.base64(F.encode(F.to_json(fields), "UTF-8")), r"[\r\n]", ""), F.lit(" -->"))


def state_of(body: Column, prefix: str, schema: str) -> Column:
    """State from a body's comment; null if there is none that can be read."""
    raw = F.regexp_extract(body, rf"<!-- {prefix}:([A-Za-z0-9+/=]+) -->", 1)
    return F.from_json(F.try_to_binary(raw, F.lit("base64")).cast("string"), schema)


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """Unit vector of signed token counts by hash: the offline stand-in for a remote embedding. Tokens are hashed where Catalyst plans it; an Arrow batch of hashes is counted in one pass."""

    @F.pandas_udf("array<double>")
    def counted(hashes: pd.Series) -> pd.Series:
        rows = [np.asarray(h if h is not None else (), np.int64) for h in hashes]
        flat, at = np.concatenate([np.zeros(0, np.int64), *rows]), np.repeat(np.arange(len(rows)), np.array([len(r) for r in rows], np.int64))
        sign = np.where((flat >> 33) % 2 == 0, 1.0, -1.0)
        dense = np.bincount(at * size + flat % size, weights=sign, minlength=len(rows) * size).astype(float).reshape(len(rows), size)
        length = np.linalg.norm(dense, axis=1, keepdims=True)
        return pd.Series(list(np.divide(dense, length, out=np.zeros_like(dense), where=length > 0)))

    return counted(F.transform(tokens, lambda t: F.xxhash64(t)))


def latest_per(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")
