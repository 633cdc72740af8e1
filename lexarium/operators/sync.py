"""Incremental sync: inventories, plans, batches; and comparison of two document trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.text import digest
from ..storage import written
from .ordering import running

ORDER = ("add", "modify", "remove", "preserve")


def inventory(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """``path, bytes, sha256`` of contents (text or binary)."""
    raw = content.cast("binary")
    return rows.select(path.alias("path"), F.octet_length(raw).cast("long").alias("bytes"), F.sha2(raw, 256).alias("sha256"))


def index_diff(incoming: DataFrame, existing: DataFrame, key: str, digest_col: str) -> DataFrame:
    """``state`` of every key: new, changed, unchanged or deleted. One aggregate over both sides, so a null key is a key like others.

    Rows of one key are taken together: they are unchanged if all of both sides have the same digest."""
    sides = [rows.select(key, F.col(digest_col).alias("_d"), F.lit(new).alias("_new")) for rows, new in ((incoming, True), (existing, False))]
    seen = sides[0].unionByName(sides[1]).groupBy(key).agg(F.bool_or("_new").alias("came"), F.bool_or(~F.col("_new")).alias("was"), F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.count("_d").alias("known"), F.count("*").alias("n"))
    alike = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)) & F.col("known").isin(0, F.col("n"))
    state = F.when(~F.col("was"), "new").when(~F.col("came"), "deleted").when(alike, "unchanged").otherwise("changed")
    return seen.select(key, state.alias("state"))


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with the incoming ones in place of those of the same keys."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def deleted(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys), keys, "left_anti")


def first_rule(path: Column, rules: list[tuple[str, str]]) -> Column:
    """``kind:path`` of the first preserve rule of a path: a file by equality, a directory by prefix. Rules are a short list."""
    out = [F.when((path == p) if kind == "file" else ((path == p) | path.startswith(p + "/")), F.lit(f"{kind}:{p}")) for kind, p in rules]
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def tree_plan(source: DataFrame, target: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Operations that make ``target`` like ``source`` (inventories), preserved paths apart; equal files need none.

    An add weighs the source's bytes, a modify both, a remove the target's, a preserve nothing."""
    side = lambda df, p: df.select("path", F.col("bytes").alias(f"{p}_bytes"), F.col("sha256").alias(f"{p}_sha"))
    both = side(source, "s").join(side(target, "t"), "path", "full_outer").withColumn("rule", first_rule(F.col("path"), rules))
    decision = (
        F.when(F.col("rule").isNotNull(), "preserve").when(F.col("s_sha").isNull(), "remove").when(F.col("t_sha").isNull(), "add")
        .when((F.col("s_sha") != F.col("t_sha")) | (F.col("s_bytes") != F.col("t_bytes")), "modify")
    )
    s, t = F.coalesce("s_bytes", F.lit(0)), F.coalesce("t_bytes", F.lit(0))
    payload = F.when(F.col("decision") == "add", s).when(F.col("decision") == "modify", s + t).when(F.col("decision") == "remove", t).otherwise(F.lit(0)).cast("long")
    rows = both.withColumn("decision", decision).where(F.col("decision").isNotNull())
    return rows.select(digest(F.col("decision"), F.col("path")).alias("id"), "decision", "path", "rule", payload.alias("payload_bytes"), "t_bytes")


def decision_order(decision: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), decision)


def decision_summary(plan: DataFrame) -> DataFrame:
    """Files and bytes of every decision, also of those that don't occur."""
    counted = plan.groupBy("decision").agg(F.count("*").alias("files"), F.sum("payload_bytes").alias("bytes"))
    every = plan.sparkSession.createDataFrame([(d,) for d in ORDER], "decision string")
    return every.join(counted, "decision", "left").select("decision", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def rule_summary(plan: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Matched files and target bytes of every rule, also of those that match none."""
    counted = plan.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.count("*").alias("files"), F.sum(F.coalesce("t_bytes", F.lit(0))).alias("bytes"))
    every = plan.sparkSession.createDataFrame([(f"{k}:{p}",) for k, p in rules], "rule string")
    return every.join(counted, "rule", "left").select("rule", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def stale(files: DataFrame, used: DataFrame, kept: list[str]) -> DataFrame:
    """Files that navigation doesn't use and no one asked to keep."""
    return files.join(used, "path", "left_anti").where(~F.col("path").isin(kept)) if kept else files.join(used, "path", "left_anti")


def path_conflicts(paths: DataFrame) -> DataFrame:
    """``path, ancestor`` of every path below another: an equi-join on exploded ancestors, no pairing of all paths."""
    below = paths.select("path", F.explode(ancestors(F.col("path"))).alias("ancestor"))
    return below.join(paths.select(F.col("path").alias("ancestor")).distinct(), "ancestor").select("path", "ancestor").distinct()


def minimal_paths(paths: DataFrame) -> DataFrame:
    """Paths that no other one covers."""
    return paths.select("path").distinct().join(path_conflicts(paths).select("path"), "path", "left_anti")


def atomic_groups(plan: DataFrame, position: str = "seq") -> DataFrame:
    """``plan`` with ``group_no``: operations whose paths cover each other, with all that stand between them in order.

    Every path below another spans the positions from one to the other; overlapping spans merge (gaps and islands), so a group is a stretch of
    positions and order is kept."""
    at = plan.select("path", F.col(position).alias("_p"))
    pairs = path_conflicts(plan).join(at, "path").join(at.select(F.col("path").alias("ancestor"), F.col("_p").alias("_q")), "ancestor")
    spans = pairs.select(F.least("_p", "_q").alias("lo"), F.greatest("_p", "_q").alias("hi"))
    reach = spans.groupBy(F.col("lo").alias("_p")).agg(F.max("hi").alias("hi"))
    rows = running(plan.join(reach.withColumnRenamed("_p", position), position, "left"), position, "_far", F.coalesce("hi", F.col(position)), F.max, before=True)
    starts = F.when(F.col("_far").isNull() | (F.col("_far") < F.col(position)), 1).otherwise(0)
    return running(rows, position, "group_no", starts, F.sum, before=False).drop("hi", "_far")


#: Groups of a block of the plan; a block has at least as many as a batch may have files.
BLOCK = 1 << 16


def planned_batches(plan: DataFrame, max_files: int, max_bytes: int, position: str = "seq") -> DataFrame:
    """``plan`` with ``batch_no`` from 1: groups in order fill a batch until a ceiling would be passed (both inclusive).

    No task sees the whole order.  Within a block of groups running sums give each group the group where the batch after it would begin, if one began there; a block also has its next ``max_files`` groups, which no
    batch passes.  Following these pointers from every place where a first batch can begin in the block gives where the first batch of the next block then begins, and how many batches began.  What remains
    in order is one look-up a block.  A group that alone passes a ceiling is an error, as is one without files."""
    grouped = plan if "group_no" in plan.columns else atomic_groups(plan, position)
    sizes = grouped.groupBy("group_no").agg(F.count("*").alias("files"), F.sum("payload_bytes").alias("bytes"))
    size = max(BLOCK, max_files)
    block = F.floor((F.col("group_no") - 1) / size).cast("long")
    # the first groups of a block stand at the end of the one before too
    ahead = (F.col("group_no") - 1) % size < max_files
    both = F.array_compact(F.array(block, F.when(ahead & (block > 0), block - 1)))
    dealt = written(sizes.select("group_no", "files", "bytes", F.explode(both).alias("block")), "batches")

    def pointers(part: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        """Group numbers in order, the place where the next batch begins for each, and how many groups are the block's own."""
        part = part.sort_by("group_no")
        number, files, weight = (part.column(c).to_numpy() for c in ("group_no", "files", "bytes"))
        bad = (files > max_files) | (weight > max_bytes) | (files < 1)
        if bad.any():
            i = int(np.argmax(bad))
            raise ValueError(f"group {number[i]} has {files[i]} files and {weight[i]} bytes, above {max_files} and {max_bytes}")
        nexts = []
        for value, most in ((files, max_files), (weight, max_bytes)):
            sums = np.concatenate([[0], np.cumsum(value)])
            nexts.append(np.searchsorted(sums, sums[:-1] + most, side="right") - 1)
        own = int(np.searchsorted(number, (part.column("block")[0].as_py() + 1) * size, side="right"))
        return number, np.minimum(*nexts), own

    def exits(part: pa.Table) -> pa.Table:
        number, after, own = pointers(part)
        at, begun = np.arange(min(own, max_files)), np.zeros(min(own, max_files), np.int64)
        while (inside := at < own).any():
            begun[inside] += 1
            at[inside] = after[at[inside]]
        return pa.table({"block": part.column("block").slice(0, 1), "exits": pa.array([(at - own).tolist()], pa.list_(pa.int64())), "begun": pa.array([begun.tolist()], pa.list_(pa.int64()))})

    steps = dealt.groupBy("block").applyInArrow(exits, "block long, exits array<long>, begun array<long>")
    entry, base, starts = 0, 0, []
    for r in steps.orderBy("block").toLocalIterator():  # a row for each ``BLOCK`` groups, one at a time
        starts.append((r["block"], entry, base))
        entry, base = r["exits"][entry], base + r["begun"][entry]

    def numbered_groups(_, part: pa.Table, start: pa.Table) -> pa.Table:
        number, after, own = pointers(part)
        begins, at = np.zeros(own, np.int64), start.column("entry")[0].as_py()
        while at < own:
            begins[at] = 1
            at = int(after[at])
        return pa.table({"group_no": pa.array(number[:own]), "batch_no": pa.array(np.cumsum(begins) + start.column("base")[0].as_py())})

    known = plan.sparkSession.createDataFrame(starts, "block long, entry long, base long")
    numbers = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(numbered_groups, "group_no long, batch_no long")
    return grouped.join(numbers, "group_no")


def assigned_once(plan: DataFrame, batches: DataFrame, key: str = "id") -> DataFrame:
    """Keys that batches miss, add or repeat; none for a right plan."""
    a, b = plan.select(key), batches.select(key)
    return a.exceptAll(b).withColumn("problem", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("extra")))


def tree_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """``path, side, word_delta, same`` over both trees (``path, content``)."""
    words = lambda c: F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))
    both = left.select("path", F.col("content").alias("l")).join(right.select("path", F.col("content").alias("r")), "path", "full_outer")
    side = F.when(F.col("r").isNull(), "left-only").when(F.col("l").isNull(), "right-only").when(F.col("l") == F.col("r"), "same").otherwise("modified")
    return both.select("path", side.alias("side"), (words(F.col("r")) - words(F.col("l"))).cast("long").alias("word_delta"))


def edit_counts(x: list[str], y: list[str]) -> tuple[int, int]:
    """Lines added and removed by a shortest edit script from ``x`` to ``y``.

    Equal ends and lines that only one side has are settled at once.  On the rest the furthest points by diagonal are carried forward, one more edit at a time, in space that grows with the lines."""
    n, m = len(x), len(y)
    head = 0
    while head < min(n, m) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and x[n - 1 - tail] == y[m - 1 - tail]:
        tail += 1
    a, b = x[head : n - tail], y[head : m - tail]
    both = {*a} & {*b}
    number = {line: i for i, line in enumerate(both)}
    a, b = [number[line] for line in a if line in both], [number[line] for line in b if line in both]
    common = head + tail + (len(a) + len(b) - _edits(a, b)) // 2
    return m - common, n - common


def _edits(a: list[int], b: list[int]) -> int:
    """Length of a shortest edit script."""
    n, m = len(a), len(b)
    far = {1: 0}
    for edits in range(n + m + 1):
        for k in range(-edits, edits + 1, 2):
            i = far[k + 1] if k == -edits or (k != edits and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while i < n and 0 <= i - k < m and a[i] == b[i - k]:
                i += 1
            if i >= n and i - k >= m:
                return edits
            far[k] = i
    return n + m


def line_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """``path, added, removed`` lines of files in both trees, by a shortest edit script."""
    both = left.select("path", F.col("content").alias("l")).join(right.select("path", F.col("content").alias("r")), "path").where("l <> r")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(path, *edit_counts(a.splitlines(), b.splitlines())) for path, a, b in frame[["path", "l", "r"]].itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "added", "removed"])

    return both.mapInPandas(run, f"path {left.schema['path'].dataType.simpleString()}, added long, removed long")


def within_window(rows: DataFrame, times: list[str], now: Column, days: int) -> DataFrame:
    """Rows one of whose times, where it can be read, lies in the last ``days`` days."""
    since = now - F.expr(f"INTERVAL {days} DAYS")
    inside = F.lit(False)
    for t in times:
        inside = inside | F.coalesce(F.try_to_timestamp(F.col(t)) >= since, F.lit(False))
    return rows.where(inside)


def merge_rate(rows: DataFrame, merged: str, created: str, order: list[Column], most: int) -> DataFrame:
    """Created, merged and the rate in percent of the first ``most`` rows; no rate for none created."""
    some = rows.orderBy(*order).limit(most)
    out = some.agg(F.count_if(F.col(created).isNotNull()).alias("created"), F.count_if(F.col(merged).isNotNull()).alias("merged"))
    return out.withColumn("rate", F.when(F.col("created") > 0, F.round(F.col("merged") / F.col("created") * 100, 1)))
