"""Importance resampling towards a target distribution.

Runs of words are hashed to buckets; a bucket's gain is the logarithm of how much likelier the target's texts hold it than the table's.  A document's weight is the sum of its
features' gains, looked up in one array.  Drawing without replacement by these weights is a draw of the highest scores, a score being a weight with Gumbel noise from the id's hash.

The draw is exact and no task sees it whole.  Each task sorts its eligible rows into a run, cut into blocks.  Ranges of scores hold about equal numbers of rows; a range's task
merges the blocks of all runs in it by a tournament tree.  Blocks come in the order of their first rows, so a block is opened only when the merge reaches it, and a task holds as many as
overlap.  Ranges beyond the draw aren't merged, and the range where it ends stops there; a range's rows before it give its ranks their start."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as tb
from .durable import written

#: What parts words: every ASCII character but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a block of a run.
BLOCK = 1024


@dataclass(frozen=True)
class Setting:
    longest: int = 1  # words of a feature, at most
    buckets: int = 10_000
    least_words: int = 20  # of a document that may be drawn
    percent: int = 10  # of these that are drawn
    seed: str = "2024"
    range_rows: int = 500_000  # drawn rows that one task merges; at least as many tasks as a shuffle has partitions


def _features(texts: pa.LargeStringArray, setting: Setting) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bounds of the texts' features and the features' buckets, for each length of run from one word; a longer run's checksum goes on from the shorter one's."""
    words = tb.words(tb.lower_ascii(texts), NOT_WORD)
    names = [w.encode() for w in words.vocabulary.to_pylist()]
    sums = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    code, row = words.code, words.row
    for length in range(1, setting.longest + 1):
        if length > 1:
            # runs that end a word later in the same text; equal pairs of (run, word) are one run
            inside = row[length - 1 :] == row[: len(row) - length + 1] if len(row) >= length else np.zeros(0, bool)
            pairs = code[: len(inside)][inside[: len(code)]] * np.int64(max(1, len(names))) + words.code[length - 1 :][inside]
            known, code_in = np.unique(pairs, return_inverse=True)
            sums = np.fromiter((zlib.crc32(b" " + names[p % len(names)], int(sums[p // len(names)])) for p in known.tolist()), np.int64, len(known))
            grown = np.full(len(inside), -1, np.int64)
            grown[inside] = code_in
            code, starts = grown, row[: len(inside)]
            live = code >= 0
            yield np.searchsorted(starts[live], np.arange(words.n_rows + 1)), sums[code[live]] % setting.buckets
        else:
            yield words.bounds, sums[code] % setting.buckets


def bucket_counts(rows: DataFrame, setting: Setting = Setting(), text: str = "text") -> np.ndarray:
    """Features of all texts by bucket. Tasks send a row a bucket; the sums, as many as there are buckets, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(setting.buckets, np.int64)
        for batch in batches:
            texts = tb.texts_of(batch.column(0))
            for part in tb.slices(texts):
                for _, buckets in _features(texts[part], setting):
                    total += np.bincount(buckets, minlength=setting.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counts = np.zeros(setting.buckets, np.int64)
    for r in rows.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    k, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (all_s + k)) / ((s + 1.0) * (all_t + k)))) for s, t in pairs], np.int64)


def noise(name: str, seed: str) -> int:
    """Gumbel noise in thousandths, from the hash of the seed and an id."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, setting: Setting = Setting()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row; a null text has no words, a null id is hashed as ``null``."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            texts = tb.texts_of(batch.column(1))
            n_words, n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for part in tb.slices(texts):
                for i, (bounds, buckets) in enumerate(_features(texts[part], setting)):
                    sums = np.concatenate([[0], np.cumsum(gain[buckets])])
                    n_features[part] += np.diff(bounds)
                    weight[part] += sums[bounds[1:]] - sums[bounds[:-1]]
                    if i == 0:
                        n_words[part] = np.diff(bounds)
            score = weight + np.fromiter((noise(n, setting.seed) for n in batch.column(2).to_pylist()), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(a) for a in (n_words, n_features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    base = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"))
    return base.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


class Tournament:
    """Winner tree over open blocks: the root holds the slot whose first row comes first. A slot that runs out is free for another block."""

    def __init__(self):
        self.size = 1
        self.keys: list[tuple | None] = [None]
        self.blocks: list[Iterator] = [iter(())]
        self.tree = [0, 0]
        self.free = [0]

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return b if x is None or (y is not None and y < x) else a

    def _replay(self, slot: int) -> None:
        at = (slot + self.size) // 2
        while at:
            self.tree[at] = self._better(self.tree[2 * at], self.tree[2 * at + 1])
            at //= 2

    def _grow(self) -> None:
        old, self.size = self.size, 2 * self.size
        self.keys += [None] * old
        self.blocks += [iter(())] * old
        self.free += range(old, self.size)
        self.tree = [0] * self.size + list(range(self.size))
        for at in range(self.size - 1, 0, -1):
            self.tree[at] = self._better(self.tree[2 * at], self.tree[2 * at + 1])

    def open(self, block: Iterator[tuple]) -> None:
        """Add a block of rows in order, each a tuple that begins with its key."""
        if not self.free:
            self._grow()
        slot = self.free.pop()
        self.blocks[slot] = block
        self.keys[slot] = next(block, None)
        if self.keys[slot] is None:
            self.free.append(slot)
        elif self.size == 1:
            self.tree[1] = 0
        else:
            self._replay(slot)

    def first(self) -> tuple | None:
        """The row that comes first, if any."""
        return self.keys[self.tree[1]]

    def pop(self) -> tuple:
        slot = self.tree[1]
        row = self.keys[slot]
        self.keys[slot] = next(self.blocks[slot], None)
        if self.keys[slot] is None:
            self.free.append(slot)
        self._replay(slot)
        return row


def _rows(block: dict) -> Iterator[tuple]:
    """A block's rows: the key (score falling, then id, null first, then place in the table) and what else is returned."""
    for s, i, r, n, w in zip(block["scores"], block["ids"], block["places"], block["features"], block["weights"], strict=True):
        yield (-s, i is not None, i, r), n, w


def merged(blocks: Iterator[dict], most: int) -> Iterator[tuple]:
    """The first ``most`` rows of sorted blocks that come in the order of their first rows."""
    tree, ahead, n = Tournament(), next(blocks, None), 0
    while n < most:
        best = tree.first()
        # no block that is still to come begins before the next row
        while ahead is not None and (best is None or _key(ahead) < best[0]):
            tree.open(_rows(ahead))
            ahead, best = next(blocks, None), tree.first()
        if best is None:
            return
        yield tree.pop()
        n += 1


def _key(block: dict) -> tuple:
    i = block["ids"][0]
    return -block["scores"][0], i is not None, i, block["places"][0]


def resampled(docs: DataFrame, target: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id, text``); ``rank`` from 1 for the rows that are drawn, null for others.

    ``target`` has the texts (``text``) that the draw is to be like.  Null texts have no words; rows with too few words aren't drawn.  Rows that are equal in score go by id, null first, then by
    their place in the table, so repeated rows are drawn one by one.  An empty table gives no rows, an empty target an even draw but for common features.  Other columns are ignored."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, setting), bucket_counts(target, setting))
    every = written(weighed(docs, gain, setting).withColumn("place", F.monotonically_increasing_id()), "weighed")
    eligible = every.where(F.col("n_words") >= setting.least_words)
    names = ["doc_id", "n_features", "weight", "score"]
    total = eligible.count()
    draw = setting.percent * total // 100
    if not draw:
        return every.select(*names, F.lit(None).cast("long").alias("rank"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-draw // setting.range_rows))
    # scores where ranges end, from the highest, and some below the draw's end as these are approximate
    shares = [max(0.0, 1 - draw / total * i / ranges) for i in range(1, ranges + ranges // 8 + 2)]
    splits = eligible.agg(F.percentile_approx("score", shares, max(10_000, 40 * ranges * total // draw)).alias("s")).first()["s"]
    splits = np.unique(np.array(splits, np.int64))  # rising
    sizes = _sizes(eligible, splits)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    quota = np.clip(draw - starts, 0, sizes)
    live = int((quota > 0).sum())
    drawn = written(_merged_ranges(eligible, splits, starts, quota, live), "drawn")
    last = drawn.where(F.col("rank") == draw).select("score", "doc_id", "place").first()
    same = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]))
    smaller = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") > last["doc_id"], F.lit(False))
    # every row after the last that was drawn
    after = (F.col("score") < last["score"]) | ((F.col("score") == last["score"]) & (smaller | (same & (F.col("place") > last["place"]))))
    rest = every.where((F.col("n_words") < setting.least_words) | after)
    return drawn.select(*names, "rank").unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank")))


def _number(scores: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Range of each score: 0 holds the highest; the last, all below the lowest split."""
    return len(splits) - np.searchsorted(splits, scores, side="right")


def _sizes(eligible: DataFrame, splits: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(len(splits) + 1, np.int64)
        for batch in batches:
            sizes += np.bincount(_number(batch.column(0).to_numpy(), splits), minlength=len(sizes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(sizes)], ["range", "n"])

    sizes = np.zeros(len(splits) + 1, np.int64)
    for r in eligible.select("score").mapInArrow(run, "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():  # a row a range
        sizes[r["range"]] = r["n"]
    return sizes


def _merged_ranges(eligible: DataFrame, splits: np.ndarray, starts: np.ndarray, quota: np.ndarray, live: int) -> DataFrame:
    """The drawn rows with their ranks: sorted runs, cut into blocks by range, and merged range by range."""
    id_type = eligible.schema["doc_id"].dataType
    lowest = int(splits[len(splits) - live]) if live <= len(splits) else None
    reached = eligible if lowest is None else eligible.where(F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("place")]
    runs = reached.select("score", "doc_id", "place", "n_features", "weight").sortWithinPartitions(*order)
    fields = ["scores", "ids", "places", "features", "weights"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = _number(batch.column(0).to_numpy(), splits)
            bounds = np.unique(np.concatenate([np.arange(0, len(number), BLOCK), np.flatnonzero(np.diff(number)) + 1, [len(number)]])).astype(np.int32)
            if len(number):
                at = pa.array(bounds[:-1])
                first = [c.take(at) for c in batch.columns[:3]]
                held = [pa.ListArray.from_arrays(pa.array(bounds), c) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(number[bounds[:-1]].astype(np.int32)), *first, *held], ["range", "score", "doc_id", "place", *fields])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.select(["range", *fields]).to_pylist())
        ahead = next(stream, None)
        while ahead is not None:
            number, held = ahead["range"], [ahead]

            def of_range(number=number, held=held) -> Iterator[dict]:
                """Blocks of one range; the first of the next stays in ``held``."""
                while held and held[0]["range"] == number:
                    block = held.pop()
                    if (after := next(stream, None)) is not None:
                        held.append(after)
                    yield block

            blocks, rank, out = of_range(), int(starts[number]), []
            for (score, _, i, place), n, w in merged(blocks, int(quota[number])):
                rank += 1
                out.append((i, n, w, -score, rank, place))
                if len(out) == 8192:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
            for _ in blocks:  # what the draw leaves of the range
                pass
            ahead = held[0] if held else None

    shape = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("n_features long, weight long, score long, rank long, place long").fields])
    arrow_id = eligible.select("doc_id").limit(0).toArrow().schema.field(0).type

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [arrow_id, *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], shape.names)

    long = T.LongType()
    listed = lambda name, kind: T.StructField(name, T.ArrayType(kind))
    block_shape = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("score", long), T.StructField("doc_id", id_type), T.StructField("place", long), listed("scores", long), listed("ids", id_type), listed("places", long), listed("features", long), listed("weights", long)])
    blocks = runs.mapInArrow(cut, block_shape)
    # a range is a task: by hash several would meet in one
    dealt = blocks.repartitionById(live, "range").sortWithinPartitions("range", *order)
    return dealt.mapInArrow(merge, shape)
