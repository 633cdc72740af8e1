"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by centroids of their own, so K + K centroids make K x K cells.  A query goes through the pairs of
centroids in the order of their summed distances, by a heap, until the cells it has met hold enough entries; these are reranked by their
distance to the query.  How many are enough is measured: a bounded sample of queries is answered exactly, and the smallest number that
finds the wanted share of their neighbours is taken.

Cells are dealt to shards of about equal size, in cell order; a cell larger than a shard is several.  A query goes to the shards that hold a
cell of its traversal, as its vector and the summed distance at which the traversal ended, which says in a few comparisons which cells of a shard it
has met.  Shards with many queries are several tiles.  Copies of a vector are one entry with as many of the smallest ids as a query can need."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as vs
from .durable import written

#: Queries of one matrix product.
BLOCK = 256


@dataclass(frozen=True)
class Setting:
    k: int = 10
    recall: float = 0.95  # share of the exact neighbours of the measured queries that the traversal must reach
    measured: int = 256  # queries answered exactly to choose how far to go; a bounded sample by hash, all if there are fewer
    centroids: int = 1024  # of a half, at most; the cube root of the number of rows, so cells grow with the rows too
    per_centroid: int = 64  # vectors of the bounded sample that centroids are fitted on
    iterations: int = 10
    shard: int = 8192  # entries
    queries: int = 8192  # of a tile


@dataclass(frozen=True)
class Index:
    """``entries``: ``cell, vector, ids``, a row for each distinct vector; ``counts``: entries by pair of centroids."""

    entries: DataFrame
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    setting: Setting

    @property
    def size(self) -> int:
        return self.first.shape[1] + self.second.shape[1]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows; good to rounding of the squared lengths, infinite where those overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)
    found[np.isnan(found)] = np.inf
    return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row i of ``a`` to row i of ``b``, from differences summed entry by entry in order."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def centroids_of(points: np.ndarray, k: int, iterations: int) -> np.ndarray:
    """Lloyd's rounds from the first ``k`` distinct points, which are in an order of no meaning."""
    _, at = np.unique(points, axis=0, return_index=True)
    found = points[np.sort(at)[:k]].copy()
    for _ in range(iterations):
        near = np.concatenate([squares(points[i : i + 4096], found).argmin(1) for i in range(0, len(points), 4096)])
        many = np.bincount(near, minlength=len(found))
        order = np.argsort(near, kind="stable")
        with np.errstate(over="ignore", invalid="ignore"):
            sums = np.add.reduceat(points[order], np.minimum(np.cumsum(many) - many, len(points) - 1), axis=0)
        found = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], found)
    return found


def _fitted(rows: DataFrame, size: int, k: int, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, each fitted in a task of its own; what is gathered is at most ``2 k`` centroids."""
    half = size // 2
    sample = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(k * setting.per_centroid)
    halves = sample.select(F.explode(F.array(F.struct(F.lit(0).alias("half"), F.slice("vector", 1, half).alias("part")), F.struct(F.lit(1).alias("half"), F.slice("vector", half + 1, size - half).alias("part")))).alias("r"), F.xxhash64("id", "vector").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            which = table.column("half")[0].as_py()
            found = centroids_of(vs.matrix(table.column("part"), (half, size - half)[which]), k, setting.iterations)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), which, np.int32)), vs.lists(found)], ["half", "centroid"])

    dealt = halves.select("r.half", "r.part", "h").repartitionById(2, "half").sortWithinPartitions("half", "h")
    rows_ = dealt.mapInArrow(run, "half int, centroid array<double>").collect()
    one = lambda which, width: np.array([r["centroid"] for r in rows_ if r["half"] == which], np.float64).reshape(-1, width)
    return one(0, half), one(1, size - half)


def usable(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    v = vs.floats(F.col(vector), rows.schema[vector].dataType)
    some = F.exists(F.col("vector"), lambda c: c != 0)
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & vs.finite(F.col("vector"), size)).where(some)


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", setting: Setting = Setting()) -> Index | None:
    """The index of all rows of a table; none where no row takes part.

    Rows whose id or vector is null take no part, nor do vectors without length, with a null or non-finite entry, or of another length than most rows'
    have.  An id that stands with a vector in several rows counts once with it.  Other columns are ignored."""
    spark, size = rows.sparkSession, vs.dimension(rows, vector)
    good = usable(rows, key, vector, size)
    n = good.count() if size > 1 else 0
    if not n:
        return None
    k = max(2, min(setting.centroids, round(n ** (1 / 3))))
    first, second = _fitted(good, size, k, setting)
    half, sent = size // 2, spark.sparkContext.broadcast((first, second))
    # equal vectors come to one task after each task has kept its smallest ids of each
    kept = good.withColumn("_n", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("_n") <= setting.k + 1)
    single = kept.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sent.value
        for batch in batches:
            x = vs.matrix(batch.column(0), size)
            cell = squares(x[:, :half], a).argmin(1) * len(b) + squares(x[:, half:], b).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], ["cell", "vector", "ids"])

    kind = T.StructType([T.StructField("cell", T.IntegerType()), good.schema["vector"], T.StructField("ids", T.ArrayType(T.LongType()))])
    entries = written(single.mapInArrow(run, kind), "multi-index")
    sent.unpersist()
    counts = np.zeros(len(first) * len(second), np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row a cell, of which there are ``centroids`` squared at most
        counts[r["cell"]] = r["n"]
    return Index(entries, first, second, counts.reshape(len(first), len(second)), setting)


def traversed(near: np.ndarray, far: np.ndarray, counts: np.ndarray, enough: int) -> Iterator[tuple[float, int, int, int]]:
    """Pairs of centroids by summed distance: ``sum, first, second, entries so far``, until there are ``enough``.

    ``near`` and ``far`` are a query's distances to the centroids of both halves.  Every pair enters the heap once: its successor in the second half always,
    in the first half only from the first column."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    x, y = near[a].tolist(), far[b].tolist()
    table = counts[np.ix_(a, b)].tolist()
    heap, seen = [(x[0] + y[0], 0, 0)], 0
    while heap and seen < enough:
        total, i, j = heapq.heappop(heap)
        seen += table[i][j]
        yield total, int(a[i]), int(b[j]), seen
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def exact(index: Index, ids: np.ndarray, asked: np.ndarray) -> DataFrame:
    """The ``k`` nearest of a bounded set of queries among all entries, by comparing each with each: ``query_id, vec_id, score, cell``."""
    spark, k, size = index.entries.sparkSession, index.setting.k, index.size
    sent = spark.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        for batch in batches:
            if batch.num_rows:
                x, cells = vs.matrix(batch.column(1), size), batch.column(0).to_numpy()
                for at in range(0, len(ids), BLOCK):
                    yield _best(ids[at : at + BLOCK], asked[at : at + BLOCK], x, batch.column(2), k, None, cells)

    found = index.entries.mapInArrow(run, "query_id long, vec_id long, score double, cell int")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(ids: np.ndarray, asked: np.ndarray, x: np.ndarray, names: pa.ListArray, k: int, met: np.ndarray | None, cells: np.ndarray) -> pa.RecordBatch:
    """Of each query the ``k`` nearest rows of ``x``, its own id left out: products choose who can be among them, differences decide.

    ``met``: which pairs count, all if none."""
    near = squares(asked, x)
    if met is not None:
        near = np.where(met, near, np.inf)
    # one more than k, as an entry may hold the query's id alone; rounding of the products is far below the slack
    most = np.partition(near, k, axis=1)[:, k] if near.shape[1] > k + 1 else np.full(len(ids), np.inf)
    with np.errstate(over="ignore"):
        slack = 1e-9 * ((asked * asked).sum(1) + (x * x).sum(1).max(initial=0))
    keep = ~(near > (most + slack)[:, None])
    if met is not None:
        keep &= met
    q, e = np.nonzero(keep)
    score = distances(asked[q], x[e])
    starts = names.offsets.to_numpy()
    held = np.diff(starts)[e]
    flat = names.values.to_numpy(zero_copy_only=False)
    at = np.repeat(starts[e], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    q, e, score, vec = np.repeat(q, held), np.repeat(e, held), np.repeat(score, held), flat[at]
    other = vec != ids[q]
    q, e, score, vec = q[other], e[other], score[other], vec[other]
    order = np.lexsort((vec, score, q))
    q, e, score, vec = q[order], e[order], score[order], vec[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    first = place < k
    return pa.RecordBatch.from_arrays([pa.array(ids[q[first]]), pa.array(vec[first]), pa.array(score[first]), pa.array(cells[e[first]].astype(np.int32))], ["query_id", "vec_id", "score", "cell"])


def measured(index: Index, queries: DataFrame) -> tuple[int, float]:
    """How many entries a traversal must meet for the wanted recall, and the recall it then has, both on the sample: ``Setting.measured`` queries with the
    smallest hashes, against their exact neighbours."""
    s, half = index.setting, index.first.shape[1]
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(s.measured).toArrow()
    least = min(s.k + 1, int(index.counts.sum()))
    if not sample.num_rows:
        return least, 1.0
    ids, asked = sample.column("id").to_numpy(), vs.matrix(sample.column("vector"), index.size)
    near, far = squares(asked[:, :half], index.first), squares(asked[:, half:], index.second)
    place = {q: i for i, q in enumerate(ids.tolist())}
    want: dict[int, list[int]] = {}
    for r in exact(index, ids, asked).select("query_id", "cell").collect():  # ``measured`` times ``k`` rows
        want.setdefault(place[r["query_id"]], []).append(r["cell"])
    needs = []
    for q, cells in want.items():
        left, wide = {*cells}, len(index.second)
        for _, a, b, seen in traversed(near[q], far[q], index.counts, int(index.counts.sum())):
            if a * wide + b in left:
                left.remove(a * wide + b)
                needs += [seen] * cells.count(a * wide + b)
                if not left:
                    break
    if not needs:
        return least, 1.0
    needs = np.sort(needs)
    enough = max(least, int(needs[min(len(needs) - 1, int(np.ceil(s.recall * len(needs))) - 1)]))
    return enough, float((needs <= enough).mean())


@dataclass(frozen=True)
class _Shards:
    """Shard of each cell, and how many it has of its own if it is larger than one."""

    first: np.ndarray
    many: np.ndarray
    total: int


def _shards(counts: np.ndarray, most: int, least: int) -> _Shards:
    flat = counts.ravel()
    size = max(1, min(most, -(-int(flat.sum()) // least)))
    large = flat > size
    many = np.where(large, -(-flat // size), 1)
    # small cells in order fill a shard; a large one begins anew
    step = np.where(large, 0, flat)
    group = np.cumsum(step) // size + np.cumsum(large | np.concatenate([[False], large[:-1]]))
    new = np.concatenate([[0], (np.diff(group) != 0).astype(np.int64)])
    first = np.cumsum(new + np.concatenate([[0], many[:-1] - 1]))
    return _Shards(first.astype(np.int32), many.astype(np.int32), int(first[-1] + many[-1]))


def search(index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", enough: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest that each query's traversal meets, by Euclidean distance of the given vectors, ties to the smaller id.

    Of rows that share an id, the least vector is the query; rows with the query's id are no candidates of it.  All queries have ``k`` results where there are
    so many other rows, as a traversal goes on until it has met more than ``k`` entries.  ``enough``: entries to meet, measured if it isn't given."""
    spark, s, size, half = queries.sparkSession, index.setting, index.size, index.first.shape[1]
    asked = usable(queries, key, vector, size).groupBy("id").agg(F.min("vector").alias("vector"))
    if enough is None:
        enough, _ = measured(index, asked)
    enough = max(enough, s.k + 1)
    shards = _shards(index.counts, s.shard, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = spark.sparkContext.broadcast((index.first, index.second, index.counts, shards))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, counts, shards = sent.value
        for batch in batches:
            x = vs.matrix(batch.column(1), size)
            near, far = squares(x[:, :half], first), squares(x[:, half:], second)
            ends, visits = [], []
            for q in range(len(x)):
                for end, *_ in traversed(near[q], far[q], counts, enough):
                    pass
                end = end * (1 + 1e-9) + 1e-300  # sums are made again elsewhere, perhaps in another order
                cells = np.flatnonzero((near[q][:, None] + far[q][None, :] <= end).ravel() & (counts.ravel() > 0))
                begin, many = shards.first[cells], shards.many[cells]
                every = np.unique(np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                ends.append(end)
                visits.append(every.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.float64()), pa.array(visits, pa.list_(pa.int32()))], ["id", "vector", "end", "shards"])

    # a query's row takes far longer than its bytes tell
    spread = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    visits = written(spread.mapInArrow(go, T.StructType([*asked.schema.fields, T.StructField("end", T.DoubleType()), T.StructField("shards", T.ArrayType(T.IntegerType()))])), "visits")
    load = np.zeros(shards.total, np.int64)
    for r in visits.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("n")).collect():  # a row a shard
        load[r["shard"]] = r["n"]
    blocks = np.maximum(1, -(-load // s.queries))
    base = np.concatenate([[0], np.cumsum(blocks)])
    plan = spark.sparkContext.broadcast((shards.first, shards.many, blocks, base))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries to their shard's tiles; the chunk of a large cell is the hash column's."""
        first, many, blocks, base = plan.value
        for batch in batches:
            cell = batch.column(0).to_numpy()
            shard = first[cell] + batch.column(3).to_numpy() % many[cell]
            n = blocks[shard]
            at = np.repeat(np.arange(len(cell)), n)
            tile = np.repeat(base[shard], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), *(c.take(pa.array(at)) for c in batch.columns[:3])], ["tile", "cell", "vector", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, blocks, base = plan.value
        for batch in batches:
            shard = batch.column(3).to_numpy()
            tile = base[shard] + batch.column(4).to_numpy() % blocks[shard]
            yield pa.RecordBatch.from_arrays([pa.array(tile.astype(np.int32)), *batch.columns[:3]], ["tile", "id", "vector", "end"])

    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)).cast("int").alias("h")
    tile = T.StructField("tile", T.IntegerType())
    entries = index.entries.select("cell", "vector", "ids", hashed("vector")).mapInArrow(deal, T.StructType([tile, *index.entries.schema.fields]))
    asks = visits.select("id", "vector", "end", F.explode("shards").alias("shard"), hashed("id")).mapInArrow(ask, T.StructType([tile, *visits.schema.fields[:3]]))
    none = lambda kind: F.lit(None).cast(kind)
    both = entries.select("tile", F.lit(0).alias("asks"), "cell", "vector", "ids", none("long").alias("id"), none("double").alias("end")).unionByName(
        asks.select("tile", F.lit(1).alias("asks"), none("int").alias("cell"), "vector", none("array<long>").alias("ids"), "id", "end")
    )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, *_ = sent.value
        now, held, x = None, [], None
        for batch in batches:
            tiles, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)], strict=True):
                if a == b:
                    continue
                if tiles[a] != now:
                    now, held, x = tiles[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if x is None:  # the tile's entries are there: they come before its queries
                    whole = pa.Table.from_batches(held)
                    x, names = vs.matrix(whole.column("vector"), size), whole.column("ids").combine_chunks()
                    names = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(names.offsets.to_numpy()))]).astype(np.int32)), names.flatten())
                    cells = whole.column("cell").to_numpy()
                    own, of = np.unique(cells, return_inverse=True)
                    left, right = first[own // len(second)], second[own % len(second)]
                for at in range(0, part.num_rows, BLOCK):
                    some = part.slice(at, BLOCK)
                    asked, end = vs.matrix(some.column(3), size), some.column(6).to_numpy()
                    met = squares(asked[:, :half], left) + squares(asked[:, half:], right) <= end[:, None]
                    yield _best(some.column(5).to_numpy(), asked, x, names, s.k, met[:, of], cells).select(["query_id", "vec_id", "score"])

    dealt = both.repartitionById(int(base[-1]), "tile").sortWithinPartitions("tile", "asks")
    found = dealt.mapInArrow(rerank, "query_id long, vec_id long, score double")
    return _ranked(found, s.k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", setting: Setting = Setting()) -> DataFrame:
    """``search`` of ``queries`` in the index of ``rows``; no rows where none takes part."""
    index = build(rows, key, vector, setting)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, queries, key, vector)


def recall(found: DataFrame, best: DataFrame) -> float:
    """Share of the exact neighbours (``query_id, vec_id``) that ``found`` has."""
    hits = best.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
