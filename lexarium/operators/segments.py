"""An inverted index of immutable segments: block-max postings by document, deletion bitmaps, tiered merges.

A segment is dealt to shards of up to ``SHARD_DOCS`` documents.  A shard has one list a token: ordinals of documents with tf and document length, cut into blocks of ``WINDOW`` ordinals.
A block keeps the (tf, length) pairs that no other of its postings outdoes, so its greatest BM25 part is exact whatever the corpus' mean length has become.  Postings never
leave the task that cut the texts: building shuffles nothing.

An update writes a segment of the documents it brings, the deletion bitmaps of the shards that lose one, and a manifest, to which the pointer file then leads; a second writer of the same version fails.
``merged`` joins segments of a size class once there are ``FAN`` of them, and leaves deleted documents out.  Scores are those of a fresh index of the live documents at any time: df
is counted from the live postings of the asked tokens.

``search`` goes through a shard's windows by the sum of its tokens' block maxima, greatest first, and ends when a sum can't reach the k-th score; within a window tokens go by weight, and the
window is left when what it has and what the other tokens could add is too little.  Blocks that are passed over aren't scored; ``opened`` reports them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import files
from ..storage import exists
from .search import K1, B, idf

#: Documents of a shard, and token occurrences after which a shard of long documents ends: they bound what a task that makes or searches a shard holds.
SHARD_DOCS, SHARD_TOKENS = 1 << 14, 1 << 22
#: Token occurrences that are counted at a time, and postings that are written at a time; a longer document or list goes by itself.
FOLD_TOKENS, LISTED = 1 << 18, 1 << 18
#: Ordinals of a block.
WINDOW = 128
#: Segments of a size class that are merged into one, and by which size classes differ.
FAN = 8
#: Distinct tokens of a batch up to which the scan is told each; of more, it is told the batch's join.
FILTERED_TOKENS = 200
#: Windows opened at a time, and the rounding within which scores are equal.
STEP, SLACK = 8, 2e-9
#: Rows of lists that go to Spark at a time.
ROWS = 4096

_LISTS = "shard long, token string, df int, ords array<int>, tfs array<int>, ns array<int>, windows array<int>, starts array<int>, front_starts array<int>, front_tfs array<int>, front_ns array<int>"
_LIST_NAMES = [column.split()[0] for column in _LISTS.split(", ")]
_INTS = ["ords", "tfs", "ns", "windows", "starts", "front_starts", "front_tfs", "front_ns"]


@dataclass
class Manifest:
    """One state of an index: its segments, and the deletions that count for them."""

    version: int
    key: str
    kind: str  # of the keys, as Spark names it
    segments: list[dict] = field(default_factory=list)  # id, docs, tokens, shards: as the segment was written
    deletes: list[dict] = field(default_factory=list)  # id, and by segment the documents and tokens that are gone

    def gone(self, segment: str, what: str) -> int:
        return sum(d["by"].get(segment, {}).get(what, 0) for d in self.deletes)

    @property
    def total(self) -> int:
        return sum(s["docs"] - self.gone(s["id"], "docs") for s in self.segments)

    @property
    def mean(self) -> float:
        """Tokens of a live document, 1 at least."""
        tokens = sum(s["tokens"] - self.gone(s["id"], "tokens") for s in self.segments)
        return max(1.0, tokens / self.total) if self.total else 1.0


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The state that the pointer file leads to; null if there is no index."""
    now = files.current(spark, path)
    return Manifest(**json.loads(spark.read.text(now, wholetext=True).first()["value"])) if now else None


def _commit(spark: SparkSession, path: str, state: Manifest) -> None:
    """Make ``state`` the current one. Its file is made only if there is none of that version: of two writers, one fails."""
    files.put_text(spark, f"{path}/v{state.version}", json.dumps(state.__dict__, sort_keys=True), overwrite=False)
    files.put_text(spark, f"{path}/current", str(state.version))


# ---- building a shard


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _fronts(block: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the postings that none of their block outdoes: by rising length, those whose tf is the greatest so far."""
    order = np.lexsort((-tf, n, block))
    key = block[order].astype(np.int64) * (int(tf.max(initial=0)) + 1) + tf[order]
    before = np.concatenate([[-1], np.maximum.accumulate(key)[:-1]]) if len(key) else key
    return order[key > before]


def _listed(flat: np.ndarray, bounds: np.ndarray, a: int, b: int) -> pa.ListArray:
    """``flat`` as lists, those from ``a`` to ``b`` of ``bounds``."""
    part = bounds[a : b + 1]
    return pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(flat[part[0] : part[-1]].astype(np.int32)))


def _lists(shard: int, vocabulary: pa.Array, token: np.ndarray, ords: np.ndarray, tf: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a shard's lists, some tokens at a time; postings come sorted by token and ordinal, ``n`` is the length by ordinal."""
    count, a = len(vocabulary), 0
    places = np.searchsorted(token, np.arange(count + 1, dtype=token.dtype))
    while a < count:
        b = min(count, a + ROWS, max(a + 1, int(np.searchsorted(places, places[a] + LISTED, side="right")) - 1))
        some = slice(places[a], places[b])
        yield _listed_rows(shard, vocabulary.slice(a, b - a), token[some] - a, ords[some], tf[some], n[ords[some]])
        a = b


def _listed_rows(shard: int, vocabulary: pa.Array, token: np.ndarray, ords: np.ndarray, tf: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    count, window = len(vocabulary), ords // WINDOW
    bounds = np.searchsorted(token, np.arange(count + 1, dtype=token.dtype))
    new = np.concatenate([[True], (np.diff(token) != 0) | (np.diff(window) != 0)]) if len(token) else np.zeros(0, bool)
    first, block = np.flatnonzero(new), np.cumsum(new) - 1
    block_bounds = np.searchsorted(token[first], np.arange(count + 1, dtype=token.dtype))
    front = _fronts(block, tf, length)
    front_first = np.searchsorted(block[front], np.arange(len(first)))
    front_bounds = np.concatenate([front_first, [len(front)]])[block_bounds]
    within = lambda at, of: at - np.repeat(of[:-1], np.diff(block_bounds))
    starts, front_starts = within(first, bounds), within(front_first, front_bounds)
    columns = {"ords": (ords, bounds), "tfs": (tf, bounds), "ns": (length, bounds), "windows": (window[first], block_bounds), "starts": (starts, block_bounds), "front_starts": (front_starts, block_bounds), "front_tfs": (tf[front], front_bounds), "front_ns": (length[front], front_bounds)}
    rows = [pa.array(np.full(count, shard)), vocabulary.cast(pa.string()), pa.array(np.diff(bounds).astype(np.int32)), *(_listed(*columns[c], 0, count) for c in _INTS)]
    return pa.RecordBatch.from_arrays(rows, _LIST_NAMES)


def _documents(shard: int, docs: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """A shard's row of keys and lengths, in the order of ordinals."""
    bounds = np.array([0, len(n)])
    keys = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), docs)
    return pa.RecordBatch.from_arrays([pa.array([shard]), keys, pa.array([len(n)], pa.int32()), _listed(n, bounds, 0, 1)], ["shard", "docs", "df", "ns"])


def _schema(kind: str) -> T.StructType:
    """Rows of both kinds: a shard's documents (``kind`` docs), and its lists."""
    return T.StructType([T.StructField("kind", T.StringType()), *T.StructType.fromDDL(_LISTS).fields, *T.StructType.fromDDL(f"docs array<{kind}>").fields])


def _whole(batch: pa.RecordBatch, names: list[str], kinds: dict[str, pa.DataType], label: str) -> pa.RecordBatch:
    """The batch with all columns, those it hasn't as nulls."""
    have = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"kind": pa.array([label] * batch.num_rows, pa.string())}
    return pa.RecordBatch.from_arrays([have.get(c) if c in have else pa.nulls(batch.num_rows, kinds[c]) for c in names], names)


def _kinds(shape: T.StructType) -> dict[str, pa.DataType]:
    return {f.name: f.type for f in to_arrow_schema(shape)}


@dataclass
class _Fold:
    """Counted tokens of some documents: ``code`` is a token's place in ``vocabulary``, ``row`` a document's among the keys."""

    docs: pa.Array
    sizes: np.ndarray
    vocabulary: pa.Array
    code: np.ndarray
    row: np.ndarray
    tf: np.ndarray


def _folds(batch: pa.RecordBatch) -> Iterator[_Fold]:
    """A batch of documents (``doc, tokens``), counted; nothing of it stays in memory by its folds."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + FOLD_TOKENS, side="right")))
        coded, n = batch.column(1).slice(a, b - a).flatten().cast(pa.large_string()).dictionary_encode(), b - a
        key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes[a:b])
        key, tf = np.unique(key, return_counts=True)
        # taken, as a slice would keep the whole batch
        yield _Fold(batch.column(0).take(pa.array(np.arange(a, b))), sizes[a:b], coded.dictionary, (key // n).astype(np.int32), (key % n).astype(np.int32), tf.astype(np.int32))
        a = b


def _shards_of(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of both kinds for documents (``doc, tokens``), made where they lie.

    Tokens are counted as they come; a task holds the postings of one shard, twelve bytes each and some more while they are sorted."""
    shape = _schema(kind)
    names, kinds = shape.names, _kinds(shape)

    def close(held: list[_Fold], shard: int) -> Iterator[pa.RecordBatch]:
        docs = pa.concat_arrays([f.docs for f in held])
        order = pc.sort_indices(docs).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.concatenate([f.sizes for f in held])[order]
        coded = pa.concat_arrays([f.vocabulary for f in held]).dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        rank = rank[coded.indices.to_numpy()]
        key, tf = np.empty(sum(len(f.tf) for f in held), np.int64), np.empty(sum(len(f.tf) for f in held), np.int32)
        at = names_at = docs_at = 0
        for i, f in enumerate(held):
            some = slice(at, at + len(f.tf))
            key[some] = rank[names_at + f.code] * len(order) + place[docs_at + f.row]
            tf[some] = f.tf
            at, names_at, docs_at = some.stop, names_at + len(f.vocabulary), docs_at + len(f.docs)
            held[i] = None
        sorted_ = np.argsort(key)
        key, tf = key[sorted_], tf[sorted_]
        del sorted_
        token, ords = (key // len(order)).astype(np.int32), (key % len(order)).astype(np.int32)
        del key
        yield _whole(_documents(shard, docs.take(pa.array(order)), n), names, kinds, "docs")
        for batch in _lists(shard, coded.dictionary.take(pa.array(by_name)), token, ords, tf, n):
            yield _whole(batch, names, kinds, "lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, docs, tokens = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            while batch.num_rows:
                sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
                take = max(1 if not docs else 0, min(SHARD_DOCS - docs, int(np.searchsorted(sizes, SHARD_TOKENS - tokens, side="right"))))
                if take:
                    taken = batch.slice(0, take)
                    held += _folds(taken)
                    docs, tokens = docs + taken.num_rows, tokens + int(sizes[taken.num_rows - 1])
                    batch = batch.slice(take)
                if batch.num_rows:
                    yield from close(held, shard)
                    shard, held, docs, tokens = shard + 1, [], 0, 0
        if held:
            yield from close(held, shard)

    return rows.mapInArrow(run, shape)


def _name() -> str:
    return f"s{uuid.uuid4().hex[:16]}"


def _written(spark: SparkSession, path: str, rows: DataFrame, name: str) -> dict | None:
    """``rows`` of both kinds as a new segment, and its entry in a manifest; null for a segment without documents."""
    at = f"{path}/segments/segment={name}"
    # by token within a shard, and small groups of rows, so a scan's token filter skips most of a file
    ordered = rows.sortWithinPartitions("kind", "shard", F.col("token").asc_nulls_first())
    ordered.write.partitionBy("kind").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(at)
    if not exists(spark, f"{at}/kind=docs"):
        return None
    got = spark.read.schema(T.StructType([f for f in rows.schema.fields if f.name != "kind"])).parquet(f"{at}/kind=docs")
    sums = got.agg(F.sum("df").alias("docs"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n)).alias("tokens"), F.count("*").alias("shards")).first()
    return {"id": name, **{k: int(sums[k] or 0) for k in ("docs", "tokens", "shards")}}


def create(docs: DataFrame, key: str, tokens: Column, path: str, keep: list[str] | None = None) -> Manifest:
    """An index of ``docs`` in place of any at ``path``. ``keep``: columns stored with it, which ``rows`` gives back.

    Documents without tokens count, and so do several rows of one key, each as a document; a null key is one like others."""
    spark, now = docs.sparkSession, manifest(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()
    state = Manifest(now.version + 1 if now else 0, key, kind)
    _add(state, docs, tokens, path, keep)
    _commit(spark, path, state)
    return state


def _add(state: Manifest, docs: DataFrame, tokens: Column, path: str, keep: list[str] | None) -> None:
    spark, name = docs.sparkSession, _name()
    if keep:
        # first, as what is stored may be dear to make: vectors of texts
        docs.select(*keep).write.option("compression", "zstd").parquet(f"{path}/rows/segment={name}")
        docs = spark.read.schema(docs.select(*keep).schema).parquet(f"{path}/rows/segment={name}")
    cut = docs.select(F.col(state.key).alias("doc"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    entry = _written(spark, path, _shards_of(cut, state.kind), name)
    if entry:
        state.segments.append(entry)


# ---- reading


def _read(spark: SparkSession, path: str, state: Manifest, kind: str, segments: list[str] | None = None) -> DataFrame:
    """Rows of one kind of the state's segments, with ``segment``."""
    names = [s["id"] for s in state.segments] if segments is None else segments
    shape = T.StructType([*(f for f in _schema(state.kind).fields if f.name != "kind"), T.StructField("segment", T.StringType()), T.StructField("kind", T.StringType())])
    if not names:
        return spark.createDataFrame([], shape)
    # a segment may have no lists: its documents have no tokens
    at = [f"{path}/segments/segment={n}" for n in names]
    return spark.read.option("basePath", f"{path}/segments").schema(shape).parquet(*at).where(F.col("kind") == kind)


def _bitmaps(spark: SparkSession, path: str, state: Manifest) -> DataFrame | None:
    """``segment, shard, bits``: the deleted ordinals of each shard that has any, of all deletions together; null without any."""
    known = [s["id"] for s in state.segments]
    if not any(d["by"].keys() & set(known) for d in state.deletes):
        return None
    rows = spark.read.parquet(*[f"{path}/deletes/{d['id']}/bitmaps" for d in state.deletes]).where(F.col("segment").isin(known))

    def run(key: tuple, part: pa.Table) -> pa.Table:
        bits = [np.frombuffer(b, np.uint8) for b in part.column("bits").to_pylist()]
        return pa.table({"segment": [key[0].as_py()], "shard": [key[1].as_py()], "bits": [reduce(np.bitwise_or, bits).tobytes()]})

    # as many rows a group as there were updates since the last merge
    return rows.groupBy("segment", "shard").applyInArrow(run, "segment string, shard long, bits binary")


def documents(spark: SparkSession, path: str, state: Manifest | None = None) -> DataFrame:
    """``segment, shard, ord, doc, n`` of every live document."""
    state = state or manifest(spark, path)
    every = _read(spark, path, state, "docs").select("segment", "shard", F.posexplode(F.arrays_zip("docs", "ns")).alias("ord", "d")).select("segment", "shard", "ord", F.col("d.docs").alias("doc"), F.col("d.ns").cast("long").alias("n"))
    dead = _dead(spark, path, state)
    return every.join(dead.select("segment", "shard", "ord"), ["segment", "shard", "ord"], "left_anti") if dead is not None else every


def _dead(spark: SparkSession, path: str, state: Manifest) -> DataFrame | None:
    return spark.read.parquet(*[f"{path}/deletes/{d['id']}/keys" for d in state.deletes]) if state.deletes else None


def rows(spark: SparkSession, path: str, state: Manifest | None = None) -> DataFrame | None:
    """The stored columns of the live documents, if any are stored; null for an index that has none."""
    state = state or manifest(spark, path)
    at = [f"{path}/rows/segment={s['id']}" for s in state.segments]
    if not at:
        return None
    every = spark.read.option("basePath", f"{path}/rows").parquet(*at)
    dead = _dead(spark, path, state)
    if dead is not None:
        # a key's rows in a segment go together
        gone = dead.select(F.col("segment").alias("_segment"), F.col("doc").alias("_doc")).distinct()
        every = every.join(gone, (F.col("segment") == F.col("_segment")) & F.col(state.key).eqNullSafe(F.col("_doc")), "left_anti")
    return every.drop("segment")


def _asked_lists(spark: SparkSession, path: str, state: Manifest, tokens: DataFrame) -> DataFrame:
    """Lists of the asked tokens with ``bits``, null where nothing of the shard is deleted."""
    few = [r["token"] for r in tokens.limit(FILTERED_TOKENS + 1).collect()]
    lists = _read(spark, path, state, "lists")
    if len(few) <= FILTERED_TOKENS:
        # one comparison a token: a long IN would reach the scan as its least and greatest value
        lists = lists.where(reduce(lambda a, b: a | b, [F.col("token") == t for t in few], F.lit(False)))
    else:
        lists = lists.join(tokens, "token", "left_semi")
    bits = _bitmaps(spark, path, state)
    return lists.join(bits, ["segment", "shard"], "left") if bits is not None else lists.withColumn("bits", F.lit(None).cast("binary"))


def _live(lists: DataFrame) -> DataFrame:
    """``token, df`` of lists: live postings of all shards."""
    whole = lists.where("bits IS NULL").select("token", "df")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [int((~_bits(b)[o]).sum()) for o, b in zip(_split(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.int32())], ["token", "df"])

    part = lists.where("bits IS NOT NULL").select("token", "ords", "bits").mapInArrow(run, "token string, df int")
    return whole.unionByName(part).groupBy("token").agg(F.sum("df").cast("long").alias("df")).where("df > 0")


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)


def _split(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as arrays, without a copy."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


# ---- search


def part(tf: np.ndarray, n: np.ndarray, mean: float) -> np.ndarray:
    """What a posting adds to a score, without its token's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


@dataclass
class _List:
    """A token's postings in a shard, with its blocks' greatest parts."""

    ords: np.ndarray
    tfs: np.ndarray
    ns: np.ndarray
    windows: np.ndarray
    starts: np.ndarray
    maxima: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], len(self.ords))


def best(lists: list[_List], weights: list[float], k: int, mean: float, dead: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The k best live documents of a shard: ordinals and scores, best first, ties by ordinal; and how many blocks were opened, of how many."""
    order = sorted(range(len(lists)), key=lambda i: -weights[i] * lists[i].maxima.max())
    lists, weights = [lists[i] for i in order], [weights[i] for i in order]
    width = 1 + max(int(one.windows[-1]) for one in lists)
    # bound[i]: what the tokens from i on can add in a window; at[i]: the token's block there
    bound, at = np.zeros((len(lists) + 1, width)), np.full((len(lists), width), -1)
    for i in reversed(range(len(lists))):
        bound[i] = bound[i + 1]
        bound[i][lists[i].windows] += weights[i] * lists[i].maxima
        at[i][lists[i].windows] = np.arange(len(lists[i].windows))
    turn = np.argsort(-bound[0], kind="stable")
    turn = turn[bound[0][turn] > 0]
    ords, scores, least, opened = np.zeros(0, np.int64), np.zeros(0), -np.inf, 0
    for a in range(0, len(turn), STEP):
        some = turn[a : a + STEP]
        some = some[bound[0][some] >= least - SLACK]
        if not len(some):
            break
        sums, alive = np.zeros((len(some), WINDOW)), np.arange(len(some))
        for i, (one, weight) in enumerate(zip(lists, weights, strict=True)):
            if i:
                alive = alive[sums[alive].max(1) + bound[i][some[alive]] >= least - SLACK]
            block = at[i][some[alive]]
            where, block = alive[block >= 0], block[block >= 0]
            opened += len(block)
            sizes = one.ends[block] - one.starts[block]
            p, row = _ranges(one.starts[block], sizes), np.repeat(where, sizes)
            sums[row, one.ords[p] % WINDOW] += weight * part(one.tfs[p], one.ns[p], mean)
        row, column = np.nonzero(sums[alive])
        found, value = some[alive][row] * WINDOW + column, sums[alive][row, column]
        if dead is not None:
            live = ~dead[found]
            found, value = found[live], value[live]
        ords, scores = np.concatenate([ords, found]), np.concatenate([scores, value])
        first = np.lexsort((ords, -np.round(scores, 9)))[:k]
        ords, scores = ords[first], scores[first]
        least = scores.min() if len(scores) == k else -np.inf
    return ords, scores, opened, sum(len(one.windows) for one in lists)


def _evaluated(spark: SparkSession, path: str, state: Manifest, queries: DataFrame, k: int, query_key: str) -> tuple[DataFrame, str]:
    """``query, segment, shard, ord, score, opened, blocks`` of each shard's best, and a row without ``ord`` for what it opened."""
    asked = queries.groupBy(F.col(query_key).alias("query"), "token").agg(F.count("*").alias("times")).where("token IS NOT NULL")
    kind = queries.schema[query_key].dataType.simpleString()
    lists = _asked_lists(spark, path, state, asked.select("token").distinct())
    weighed = asked.join(_live(lists), "token").withColumn("weight", F.col("times") * idf(F.lit(state.total), F.col("df")))
    # a list is sent once, however many of the batch's queries ask for it
    askers = weighed.groupBy("token").agg(F.collect_list(F.struct("query", "weight")).alias("askers"))
    joined = lists.join(askers, "token").select("segment", "shard", "token", "askers", "bits", *_INTS)
    mean = state.mean
    shape = T.StructType.fromDDL(f"query {kind}, segment string, shard long, ord int, score double, opened long, blocks long")
    kinds = _kinds(shape)

    def close(group: tuple[str, int], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists, asked, dead = [], {}, None
        for batch in held:
            column = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            arrays = [_split(column[n]) for n in _INTS]
            for i, (asks, bits) in enumerate(zip(column["askers"].to_pylist(), column["bits"].to_pylist(), strict=True)):
                ords, tfs, ns, windows, starts, front_starts, front_tfs, front_ns = (a[i] for a in arrays)
                dead = _bits(bits) if bits is not None and dead is None else dead
                for a in asks:
                    asked.setdefault(a["query"], []).append((len(lists), a["weight"]))
                lists.append(_List(ords, tfs, ns, windows, starts, np.maximum.reduceat(part(front_tfs, front_ns, mean), front_starts)))
        out: list[tuple] = []
        for query, of in asked.items():
            ords, scores, opened, blocks = best([lists[i] for i, _ in of], [w for _, w in of], k, mean, dead)
            out += [(query, *group, o, s, None, None) for o, s in zip(ords.tolist(), scores.tolist(), strict=True)]
            out.append((query, *group, None, None, opened, blocks))
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[n]) for c, n in zip(zip(*out, strict=True), shape.names, strict=True)], shape.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            cuts = [i for i in range(1, len(groups)) if groups[i] != groups[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(groups)], strict=True):
                if a == b:
                    continue
                if groups[a] != now and held:
                    yield close(now, held)
                    held = []
                now = groups[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close(now, held)

    dealt = joined.repartition("segment", "shard").sortWithinPartitions("segment", "shard", "token")
    return dealt.mapInArrow(run, shape), kind


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, query_key: str = "query_id") -> DataFrame:
    """Top ``k`` of each query (``query_id, token`` per occurrence): ``query_id, rank, doc, score``, as ``search.bm25`` gives it over the live documents."""
    state = manifest(spark, path)
    hits, _ = _evaluated(spark, path, state, queries, k, query_key)
    near = hits.where("ord IS NOT NULL").withColumn("_r", F.round("score", 9))
    # keys are looked up for the best only, and for those that tie with the last of them
    tied = near.withColumn("_n", F.rank().over(Window.partitionBy("query").orderBy(F.desc("_r")))).where(F.col("_n") <= k)
    keys = _read(spark, path, state, "docs").select("segment", "shard", "docs")
    named = tied.join(keys, ["segment", "shard"]).select("query", F.get("docs", F.col("ord")).alias("doc"), "score", "_r")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_r"), "doc"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_key), "rank", "doc", "score")


def opened(spark: SparkSession, path: str, queries: DataFrame, k: int, query_key: str = "query_id") -> DataFrame:
    """``query_id, opened, blocks``: blocks of the query's lists that its search scored, of all they have."""
    work, _ = _evaluated(spark, path, manifest(spark, path), queries, k, query_key)
    return work.where("ord IS NULL").groupBy(F.col("query").alias(query_key)).agg(F.sum("opened").alias("opened"), F.sum("blocks").alias("blocks"))


def term_stats(spark: SparkSession, path: str) -> DataFrame:
    """``token, df, total`` over the live documents."""
    state = manifest(spark, path)
    lists, bits = _read(spark, path, state, "lists"), _bitmaps(spark, path, state)
    lists = lists.join(bits, ["segment", "shard"], "left") if bits is not None else lists.withColumn("bits", F.lit(None).cast("binary"))
    return _live(lists).select("token", "df", F.lit(state.total).cast("long").alias("total"))


def term_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``doc, token, tf`` of the live documents."""
    state = manifest(spark, path)
    postings = _read(spark, path, state, "lists").select("segment", "shard", "token", F.explode(F.arrays_zip("ords", "tfs")).alias("p")).select("segment", "shard", F.col("p.ords").alias("ord"), "token", F.col("p.tfs").cast("long").alias("tf"))
    return postings.join(documents(spark, path, state), ["segment", "shard", "ord"]).select("doc", "token", "tf")


# ---- change


def updated(spark: SparkSession, path: str, docs: DataFrame | None, tokens: Column | None = None, gone: DataFrame | None = None, keep: list[str] | None = None) -> Manifest:
    """The index after ``docs`` came, in place of documents of the same keys, and those whose key ``gone`` names went.

    Written are a segment of ``docs``, the deleted places, and a manifest; nothing else is touched.  Without anything to do there is no new version."""
    state = manifest(spark, path)
    new = Manifest(state.version + 1, state.key, state.kind, list(state.segments), list(state.deletes))
    keys = [d.select(F.col(state.key).alias("doc")) for d in (docs, gone) if d is not None]
    if keys and state.segments:
        wanted = reduce(DataFrame.unionByName, keys).distinct().select(F.col("doc").alias("_doc"))
        name = _name()
        at = f"{path}/deletes/{name}"
        live = documents(spark, path, state)
        live.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi").write.parquet(f"{at}/keys")
        dead = spark.read.schema(live.schema).parquet(f"{at}/keys")
        # a row a segment, of which there are a few of each size
        by = {r["segment"]: {"docs": r["docs"], "tokens": r["tokens"]} for r in dead.groupBy("segment").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).collect()}
        if by:
            dead.groupBy("segment", "shard").agg(F.collect_list("ord").alias("ords")).mapInArrow(_packed, "segment string, shard long, bits binary").write.parquet(f"{at}/bitmaps")
            new.deletes.append({"id": name, "by": by})
    if docs is not None:
        _add(new, docs, tokens, path, keep)
    if (new.segments, new.deletes) == (state.segments, state.deletes):
        return state
    _commit(spark, path, new)
    return new


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordinals of a shard as bits; a shard has at most ``SHARD_DOCS``."""
    for batch in batches:
        bits = []
        for ords in batch.column(2).to_pylist():
            row = np.zeros(SHARD_DOCS, np.uint8)
            row[ords] = 1
            bits.append(np.packbits(row, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["segment", "shard", "bits"])


def due(state: Manifest, fan: int = FAN) -> list[list[str]]:
    """Groups of segments to be merged: those of a size class once there are ``fan`` of them, and each that has lost over half of its documents."""
    classes: dict[int, list[str]] = {}
    lost = []
    for s in state.segments:
        live = s["docs"] - state.gone(s["id"], "docs")
        if 2 * live < s["docs"]:
            lost.append([s["id"]])
        else:
            level, size = 0, live
            while size >= fan:
                level, size = level + 1, size // fan
            classes.setdefault(level, []).append(s["id"])
    return [c for c in classes.values() if len(c) >= fan] + lost


def merged(spark: SparkSession, path: str, groups: list[list[str]] | None = None) -> Manifest:
    """The index after the groups of segments, those that are ``due`` unless they are given, became one segment each.

    Shards are joined up to their size again, in documents and in tokens; deleted documents stay behind.  A shard's task reads the keys of the shards that it joins, and then one token's postings at a time."""
    state = manifest(spark, path)
    groups = due(state) if groups is None else groups
    if not groups:
        return state
    new = Manifest(state.version + 1, state.key, state.kind, list(state.segments), [])
    for group in groups:
        entry = _written(spark, path, _joined(spark, path, state, group), _name())
        new.segments = [s for s in new.segments if s["id"] not in group]
        if entry:
            at = [f"{path}/rows/segment={s}" for s in group]
            if exists(spark, at[0]):
                part = Manifest(state.version, state.key, state.kind, [s for s in state.segments if s["id"] in group], state.deletes)
                rows(spark, path, part).write.option("compression", "zstd").parquet(f"{path}/rows/segment={entry['id']}")
            new.segments.append(entry)
    left = {s["id"] for s in new.segments}
    for d in state.deletes:
        by = {s: v for s, v in d["by"].items() if s in left}
        if by:
            new.deletes.append({"id": d["id"], "by": by})
    _commit(spark, path, new)
    return new


def _joined(spark: SparkSession, path: str, state: Manifest, group: list[str]) -> DataFrame:
    """Rows of both kinds for the live documents of some segments."""
    bits = _bitmaps(spark, path, state)
    with_bits = lambda df: df.join(bits, ["segment", "shard"], "left") if bits is not None else df.withColumn("bits", F.lit(None).cast("binary"))
    docs = with_bits(_read(spark, path, state, "docs", group))
    dead = _dead(spark, path, state)
    lost = dead.groupBy("segment", "shard").agg(F.count("*").alias("lost"), F.sum("n").alias("lost_tokens")) if dead is not None else spark.createDataFrame([], "segment string, shard long, lost long, lost_tokens long")
    had = docs.select("segment", "shard", "df", F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n).alias("tokens"))
    left = lambda of, gone: F.col(of) - F.coalesce(gone, F.lit(0))
    sizes = had.join(lost, ["segment", "shard"], "left").select("segment", "shard", left("df", "lost").alias("live"), left("tokens", "lost_tokens").alias("tokens"))
    # a row a shard; small shards in order fill one of the full size, in documents or in tokens
    to, number, filled, tokens = {}, 0, 0, 0
    for r in sorted(sizes.collect(), key=lambda r: (group.index(r["segment"]), r["shard"])):
        if filled and (filled + r["live"] > SHARD_DOCS or tokens + r["tokens"] > SHARD_TOKENS):
            number, filled, tokens = number + 1, 0, 0
        to[(r["segment"], r["shard"])] = number
        filled, tokens = filled + r["live"], tokens + r["tokens"]
    places = spark.createDataFrame([(*k, v) for k, v in to.items()], "segment string, shard long, into int")
    everything = docs.unionByName(with_bits(_read(spark, path, state, "lists", group))).join(places, ["segment", "shard"])
    shape = _schema(state.kind)
    names, kinds = shape.names, _kinds(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, shards, place, n, token, held = None, [], {}, None, None, []

        def settle() -> Iterator[pa.RecordBatch]:
            """All documents of the shard are known: their order by key is their new ordinal."""
            nonlocal n
            docs, lengths, origins = [], [], []
            for at, keys, ns, dead in shards:
                live = np.flatnonzero(~dead[: len(ns)]) if dead is not None else np.arange(len(ns))
                docs.append(keys.take(pa.array(live)))
                lengths.append(np.asarray(ns)[live])
                origins.append((at, live, len(ns)))
            every = pa.concat_arrays(docs)
            order = pc.sort_indices(every).to_numpy().astype(np.int64)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            start = 0
            for at, live, size in origins:
                place[at] = np.full(size, -1, np.int64)
                place[at][live] = back[start : start + len(live)]
                start += len(live)
            n = np.concatenate(lengths)[order].astype(np.int64)
            if len(n):
                yield _whole(_documents(into, every.take(pa.array(order)), n), names, kinds, "docs")

        def close() -> Iterator[pa.RecordBatch]:
            """Lists of the tokens held, each from all its shards."""
            words = sorted({t for t, *_ in held})
            code = {t: i for i, t in enumerate(words)}
            token_ = np.concatenate([np.full(len(o), code[t]) for t, o, _ in held]) if held else np.zeros(0, np.int64)
            ords = np.concatenate([o for _, o, _ in held]) if held else token_
            tf = np.concatenate([f for *_, f in held]) if held else token_
            live = ords >= 0
            token_, ords, tf = token_[live], ords[live], tf[live]
            order = np.lexsort((ords, token_))
            known, token_ = np.unique(token_[order], return_inverse=True)
            if len(known):
                for batch in _lists(into, pa.array([words[i] for i in known], pa.large_string()), token_, ords[order], tf[order], n):
                    yield _whole(batch, names, kinds, "lists")

        size = 0
        for batch in batches:
            column = {c: v for c, v in zip(batch.schema.names, batch.columns, strict=True)}
            ords, tfs = _split(column["ords"]), _split(column["tfs"])
            for i in range(batch.num_rows):
                number, word = column["into"][i].as_py(), column["token"][i].as_py()
                if number != into:
                    if into is not None:
                        if n is None:
                            yield from settle()
                        yield from close()
                    into, shards, place, n, held, size, token = number, [], {}, None, [], 0, None
                at = (column["segment"][i].as_py(), column["shard"][i].as_py())
                if word is None:
                    bits = column["bits"][i].as_py()
                    shards.append((at, column["docs"][i].values, column["ns"][i].values.to_numpy(), _bits(bits) if bits is not None else None))
                    continue
                if n is None:
                    yield from settle()
                if word != token and size >= LISTED:
                    yield from close()
                    held, size = [], 0
                token = word
                held.append((word, place[at][ords[i]], tfs[i].astype(np.int64)))
                size += len(ords[i])
        if into is not None:
            if n is None:
                yield from settle()
            yield from close()

    picked = everything.select("into", "segment", "shard", "token", "bits", "docs", "ns", "ords", "tfs")
    return picked.repartitionById(number + 1, "into").sortWithinPartitions("into", F.col("token").asc_nulls_first(), "segment", "shard").mapInArrow(run, shape)


def vacuumed(spark: SparkSession, path: str) -> int:
    """Delete what no search of the current version reads: segments and deletions that it doesn't name, and older manifests. How many went. To be called when no reader of an older version is left."""
    state = manifest(spark, path)
    wanted = {f"segment={s['id']}" for s in state.segments} | {d["id"] for d in state.deletes} | {f"v{state.version}", "current", "synonyms", "segments", "deletes", "rows"}
    return sum(files.removed_below(spark, f"{path}/{folder}".rstrip("/"), wanted) for folder in ("segments", "rows", "deletes", ""))
