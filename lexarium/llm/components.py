"""Connected components by alternating large and small stars (Kiveris et al., 2014), as DataFrame joins.

Every round pre-aggregates the minimum of a node's neighbours before it shuffles, and its result
is written to the shared folder, so lineage stays short and no link is gathered on the driver.  A table of
few edges (``LOCAL_EDGES``, 16 MB) is settled by one task in one pass instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import written


#: Edges that one task may hold.
LOCAL_EDGES = 1_000_000
#: Neighbours from which a node is dealt out, how many such nodes are broadcast (1 MB; any other has fewer, or less than one in so many
#: of all edges), and the tasks that one is dealt to.
HOT_DEGREE, HOT_NODES, SALTS = 1 << 16, 1 << 16, 64


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges; roots are the smallest nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "comp"])


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their node ``u``. Nodes of very many neighbours are dealt out to several tasks, by a list of them that is broadcast."""
    hot = F.broadcast(low.where(F.col("degree") >= HOT_DEGREE).orderBy(F.desc("degree"), "u").limit(HOT_NODES).select("u", F.lit(True).alias("hot")))
    dealt = edges.join(hot, "u", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(low.join(hot, "u", "left").select("u", "m", F.explode(spread).alias("salt")), ["u", "salt"]).drop("salt")


def components(edges: DataFrame, max_rounds: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """``edges``: ``a long, b long``.  Returns ``node long, comp long`` for every node of an edge between
    two different nodes; ``comp`` is the smallest node of its component.  No edges: no rows."""
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = written(stars, "edges")
    if stars.count() <= local:
        return written(stars.coalesce(1).mapInArrow(_settle, "node long, comp long"), "components")
    stars = stars.distinct()
    before = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, written(low, "low")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "low")
        small = _with_least(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        seen = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == before:
            break
        before = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
