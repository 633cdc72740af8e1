"""Cosine neighbours: exact by tiles, and approximate by an inverted file.

Both meet queries and vectors in tiles: a shard of vectors and a block of queries, each of bounded size, are brought to one task by their numbers and multiplied there, so neither side passes through
the driver and no row meets another outside a product.  The inverted file puts each vector to the nearest of a set of centroids, its cell; a query is sent to the shards of the few cells whose centroids
are nearest to it, and only there compared.  How few are enough is measured on a bounded sample of the queries, against exact neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a shard and queries of a block, at most; shards of an exact search, where every query meets every shard, are larger.
SHARD, BLOCK, EXACT_SHARD = 1 << 13, 1 << 12, 1 << 17
#: Centroids at most; vectors of the sample they are fitted on, for each; rounds.
CELLS, PER_CELL, ROUNDS = 1 << 14, 32, 8
#: Queries answered exactly to choose the number of probes.
MEASURED = 256
#: Queries of one product.
ROWS = 256


def dimension(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, of equals the greater; 0 without vectors."""
    sizes = rows.select(F.size(vector).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return first["n"] if first else 0


def usable(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``key, vector`` of rows whose vector has a direction: of ``size`` finite entries, not all zero."""
    good = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))
    v = F.col(vector)
    fits = F.coalesce((F.size(v) == size) & F.forall(v, good) & F.exists(v, lambda c: c != 0), F.lit(False))
    return rows.select(F.col(key).alias("key"), v.alias("vector")).where(fits)


def _units(vectors: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), size)
    rows = rows / np.abs(rows).max(axis=1, initial=0, keepdims=True).clip(np.finfo(float).tiny)  # squares of huge entries would overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True).clip(np.finfo(float).tiny)


def _names(ids: pa.ChunkedArray) -> np.ndarray:
    """Keys as an array that sorts: numbers, or texts of one width."""
    return ids.to_numpy() if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=None if len(ids) else "U1")


def _tiles(entries: DataFrame, asked: DataFrame, k: int, size: int, kind: str) -> DataFrame:
    """``key, neighbor, sim``: the k best of each tile for each of its queries. ``entries`` and ``asked`` have ``shard, block, key, vector``, and ``cell`` and ``cells``: only entries of a query's
    cells count, all if it has none."""

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = _names(right.column("key")), _names(left.column("key"))
        found: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(names):
            have, of = np.unique(left.column("cell").to_numpy(), return_inverse=True)
            others, lists = _units(left.column("vector"), size), right.column("cells").to_pylist()
            for a in range(0, len(ids), ROWS):
                mine = ids[a : a + ROWS]
                sims = np.round(_units(right.column("vector").slice(a, ROWS), size) @ others.T, 9)
                met = mine[:, None] != names[None, :]
                if lists[a] is not None:
                    probed = np.zeros((len(mine), len(have)), bool)
                    for i, cells in enumerate(lists[a : a + ROWS]):
                        probed[i] = np.isin(have, cells)
                    met &= probed[:, of]
                sims[~met] = -np.inf
                least = -np.partition(-sims, k - 1, axis=1)[:, k - 1] if sims.shape[1] > k else np.full(len(mine), -np.inf)
                q, e = np.nonzero((sims >= least[:, None]) & met)
                order = np.lexsort((names[e], -sims[q, e], q))
                q, e = q[order], e[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                found.append((a + q[first], e[first], sims[q[first], e[first]]))
        q, e, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"key": right.column("key").take(pa.array(q)), "neighbor": left.column("key").take(pa.array(e)), "sim": pa.array(s)})

    both = entries.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    return both.applyInArrow(meet, f"key {kind}, neighbor {kind}, sim double")


def _ranked(sims: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("sim"), "neighbor")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("key").alias(key), "neighbor", "sim", "rank")


def _number(rows: DataFrame, most: int, tasks: int = 1) -> int:
    """How many parts of at most about ``most`` rows, and for few rows as many as have a thousand each."""
    n = rows.count()
    return max(1, -(-n // most), min(tasks, n // 1000))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine neighbours of a stated query set among all vectors, themselves excluded: ``key, neighbor, sim, rank``.

    Every shard of vectors meets every block of queries once; a tile gives k rows a query.  Ties go to the smaller neighbour.  Rows whose vector is null, has a null or
    non-finite entry or another length than most, or no direction take no part."""
    size, kind, tasks = dimension(vectors, vector), vectors.schema[key].dataType.simpleString(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries, asked = usable(vectors, key, vector, size), usable(queries, key, vector, size)
    shards, blocks = _number(entries, EXACT_SHARD, tasks), _number(asked, BLOCK)
    part = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select(part(shards).alias("shard"), each(blocks).alias("block"), "key", "vector", F.lit(0).alias("cell"))
    right = asked.select(each(shards).alias("shard"), part(blocks).alias("block"), "key", "vector", F.lit(None).cast("array<int>").alias("cells"))
    return _ranked(_tiles(left, right, k, size, kind), k, key)


# ---- inverted file


@dataclass(frozen=True)
class Cells:
    """What an inverted file knows of its cells: unit centroids, and how many vectors each has."""

    centroids: np.ndarray
    counts: np.ndarray
    kind: str


def _fitted(points: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the first ``k`` distinct points, which are in an order of no meaning."""
    _, at = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(at)[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(points[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / length.clip(1e-12), centres)
    return centres


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> None:
    """Write the inverted file of ``vectors`` to ``path``: ``entries`` (``cell, key, vector``, in the order of cells) and ``centroids``.

    There are as many cells as the root of the number of vectors, ``CELLS`` at most, unless ``cells`` says.  Centroids are fitted in one task on a sample bounded by ``PER_CELL`` vectors for each,
    chosen by hash; every vector is entered."""
    spark, size = vectors.sparkSession, dimension(vectors, vector)
    good = usable(vectors, key, vector, size)
    n = good.count()
    wanted = max(1, min(cells or round(n**0.5), CELLS))
    sample = good.orderBy(F.xxhash64("key", "vector"), "key").limit(wanted * PER_CELL).select("vector", F.xxhash64("key", "vector").alias("_h"), F.lit(0).alias("_one"))

    def fit(part: pa.Table) -> pa.Table:
        found = _fitted(_units(part.sort_by("_h").column("vector"), size), wanted)
        return pa.table({"cell": pa.array(np.arange(len(found), dtype=np.int32)), "centroid": pa.array(found.tolist(), pa.list_(pa.float64()))})

    sample.groupBy("_one").applyInArrow(fit, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    if n:
        _entered(good, path, size, "overwrite")
    else:
        good.select(F.lit(0).alias("cell"), "key", "vector").write.mode("overwrite").parquet(f"{path}/entries")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # ``CELLS`` at most
    return np.array([r["centroid"] for r in rows], np.float64)


def _entered(good: DataFrame, path: str, size: int, mode: str) -> None:
    sent = good.sparkSession.sparkContext.broadcast(_centroids(good.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_units(batch.column(1), size) @ sent.value.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], ["cell", "key", "vector"])

    placed = good.mapInArrow(run, T.StructType([T.StructField("cell", T.IntegerType()), *good.schema.fields]))
    # a cell of very many vectors is several ranges
    placed.repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell").write.mode(mode).option("parquet.block.size", 8 << 20).parquet(f"{path}/entries")
    sent.destroy()


def added(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Enter more vectors, in files of their own; centroids stay."""
    size = len(_centroids(vectors.sparkSession, path)[0])
    _entered(usable(vectors, key, vector, size), path, size, "append")


def opened(spark: SparkSession, path: str) -> Cells:
    centroids, entries = _centroids(spark, path), spark.read.parquet(f"{path}/entries")
    counts = np.zeros(max(1, len(centroids)), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # ``CELLS`` at most
        counts[r["cell"]] = r["n"]
    return Cells(centroids, counts, entries.schema["key"].dataType.simpleString())


def measured(spark: SparkSession, path: str, queries: DataFrame, k: int, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> int:
    """The smallest number of probes that reaches the wanted share of exact neighbours, over ``MEASURED`` queries at most, chosen by hash."""
    index = opened(spark, path)
    size, entries = index.centroids.shape[1] if len(index.centroids) else 0, spark.read.parquet(f"{path}/entries")
    sample = usable(queries, key, vector, size).orderBy(F.xxhash64("key"), "key").limit(MEASURED)
    got = sample.toArrow()
    if not got.num_rows:
        return 1
    rank = np.argsort(np.argsort(-(_units(got.column("vector"), size) @ index.centroids.T), axis=1, kind="stable"), axis=1)
    best = nearest(sample, entries, k, "key", "vector")
    cells = best.join(entries.select(F.col("key").alias("neighbor"), "cell"), "neighbor").select("key", "cell").collect()  # ``MEASURED`` times k rows
    place = {q: i for i, q in enumerate(got.column("key").to_pylist())}
    needs = np.sort([rank[place[r["key"]], r["cell"]] + 1 for r in cells])
    return int(needs[int(np.ceil(recall * len(needs))) - 1]) if len(needs) else 1


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, neighbor, sim, rank`` of the ``k`` nearest entries in each query's ``probes`` nearest cells, themselves excluded; ``probes`` is measured for a recall of 0.95 unless it is given.

    Of the entries' files only the probed cells' rows are read, if those are few.  A query may have fewer than ``k`` if its cells hold no more."""
    index = opened(spark, path)
    if not index.counts.sum():
        return spark.createDataFrame([], f"`{key}` {index.kind}, neighbor {index.kind}, sim double, rank int")
    probes = measured(spark, path, queries, k, 0.95, key, vector) if probes is None else probes
    size = index.centroids.shape[1]
    # cells in order fill shards; a larger one is several
    many = np.maximum(1, -(-index.counts // SHARD))
    group = np.cumsum(np.where(many > 1, 0, index.counts)) // SHARD + np.cumsum((many > 1) | np.concatenate([[False], many[:-1] > 1]))
    first = np.cumsum(np.concatenate([[0], (np.diff(group) != 0) + many[:-1] - 1]))
    asked = usable(queries, key, vector, size)
    centroids, blocks = spark.sparkContext.broadcast(index.centroids), _number(asked, BLOCK)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard that a query goes to, with its cells there."""
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _units(batch.column(1), size) @ centroids.value.T
            row, shard, cells = [], [], []
            for i, cell in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :probes]):
                to = np.repeat(first[cell], many[cell]) + np.concatenate([np.arange(m) for m in many[cell]])
                of = np.repeat(cell, many[cell])
                for s in np.unique(to):
                    row.append(i)
                    shard.append(s)
                    cells.append(of[to == s].astype(np.int32))
            columns = [c.take(pa.array(row, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(shard, np.int32)), *columns, pa.array(cells, pa.list_(pa.int32()))], ["shard", "key", "vector", "cells"])

    rows = asked.mapInArrow(probe, T.StructType([T.StructField("shard", T.IntegerType()), *asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    right = rows.select("shard", block, "key", "vector", "cells")
    entries = spark.read.parquet(f"{path}/entries")
    probed = [r["cell"] for r in rows.select(F.explode("cells").alias("cell")).distinct().collect()] if probes * 8 < len(index.counts) else []
    if probed and len(probed) < len(index.counts) / 2:
        entries = entries.where(F.col("cell").isin(probed))
    lookup = spark.createDataFrame([(i, int(f), int(m)) for i, (f, m) in enumerate(zip(first, many, strict=True))], "cell int, _first int, _many int")
    chunk = (F.col("_first") + F.pmod(F.xxhash64("key"), F.col("_many"))).cast("int").alias("shard")
    left = entries.join(F.broadcast(lookup), "cell").select(chunk, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "key", "vector", "cell")  # ``CELLS`` rows at most
    return _ranked(_tiles(left, right, k, size, index.kind), k, key)


def recall(found: DataFrame, best: DataFrame, key: str = "vec_id") -> float:
    """Share of the neighbours in ``best`` (``key, neighbor``) that ``found`` has."""
    hits = best.select(key, "neighbor").join(found.select(key, "neighbor", F.lit(1).alias("hit")), [key, "neighbor"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
