"""Mixing sources to target weights.

Each source's rows get a hash-random key and are range-partitioned by it into
buckets.  Bucket totals are aggregated first, so the prefix sums run over bucket
totals and then inside one bucket at a time: no task ever holds a whole source,
however large its share.  A source is cut at its exact budget; what the budget
exceeds the source by is served by whole repeats (epochs).

Everything is DataFrame code; the keys are MD5 of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .durable import written

#: Words, as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Range buckets of a source: bits taken from the key. 2**12 buckets keep a source of 10**10 rows at 2.4 million rows a bucket.
BUCKET_BITS = 12
#: Copies of equal rows (id, source and size) that one task makes.
COPIES = 1 << 16
#: Sources whose cuts are broadcast: some 100 bytes each.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Targets of sources.

    ``sizes``: one row per source (``skey string`` without nulls, ``source``, ``source_size long``).
    Sources in code-point order, null last, weigh ``weights`` in turn.  The total to share
    is ``share`` times the sum of sizes; a target stops at ``max_epochs`` times its source's
    size and the excess goes to the others by weight, until none is above.  That fixed
    point is min(cap, weight * level): with sources sorted by cap / weight, those below the
    level form a prefix, so two running sums find it without iterating.

    The windows here see one row per source, never the documents.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = sizes.withColumn("_i", (F.row_number().over(order) - 1) % n).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_i") + 1).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_epochs).withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double") * F.lit(float(share))
    ranked = (
        ranked.withColumn("_left", total - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_wleft", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_capped", F.col("_cap").cast("double") * F.col("_wleft") < F.col("_left") * F.col("_w"))
    )
    # the first source that isn't capped fixes the level of all that follow
    level = Window.partitionBy("_capped").orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.first("_left").over(level) * F.col("_w") / F.first("_wleft").over(level))
    return ranked.withColumn("target", target).select("skey", "source_size", "target")


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, cut: str = "word") -> DataFrame:
    """How many words of each row the mix takes.

    ``rows``: ``doc_id``, ``source``, ``size long``; other columns are ignored.  Returns ``doc_id, source, size,
    source_size, target, taken``, one row per input row.

    * ``cut="word"``: the row at the cut gives just the words that are missing, so a source's taken
      words are its target, rounded.  ``cut="document"``: that row is taken if at least half of it fits.
    * null ``source`` is a source of its own, last in order; null ``doc_id`` is keyed as the text ``null``.
    * equal ids, and repeated rows, are ordered by (key, id, size): equal rows are interchangeable, and counted before they are shuffled.
    * an empty table gives an empty result; a source of size 0 has target 0 and taken 0.
    """
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("long")
    return _placed(rows, weights, max_epochs, share, cut).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole; those that it doesn't take are gone.

    The cut of a source is a place in its order of keys, so a row is decided by its source's epochs and cut: one small
    row per source.  Up to ``BROADCAST_SOURCES`` of them are broadcast, so the texts needn't move; more are joined by
    source, where Spark splits a hot one.  Repeated rows at a cut are taken together.  Columns of any names pass through."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    placed = _placed(sized, weights, max_epochs, share, "document")
    last = F.max(F.when(F.col("extra") > 0, F.struct("key", F.col("doc_id").cast("string").alias("id"))))
    cuts = placed.groupBy("skey").agg(F.first("epochs").alias("_epochs"), last.alias("_last"))
    cuts = written(cuts, "mix-cuts")
    side = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    mine = {name: tb.free(name, docs.columns) for name in ("key", "skey", "_epochs", "_last", "time")}
    side = side.select(*[F.col(c).alias(mine[c]) for c in ("skey", "_epochs", "_last")])
    here = docs.withColumn(mine["key"], _key()).withColumn(mine["skey"], _skey()).join(side, mine["skey"])
    under = F.coalesce(F.struct(F.col(mine["key"]).alias("key"), F.col("doc_id").cast("string").alias("id")) <= F.col(mine["_last"]), F.lit(False))
    times = F.col(mine["_epochs"]) + F.when(under, 1).otherwise(0)
    every = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<long>"))
    return here.withColumn(mine["time"], F.explode(every)).select(*[f"`{c}`" for c in docs.columns])


def _key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


def _skey() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _placed(rows: DataFrame, weights: tuple[int, ...], max_epochs: int, share: float, cut: str) -> DataFrame:
    """Rows with their place in the mix: ``epochs`` whole repeats of the source and ``extra`` words of this row."""
    if cut not in ("word", "document"):
        raise ValueError(f"cut is 'word' or 'document', not {cut!r}")
    bucket = F.shiftright(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), 16 - BUCKET_BITS)
    keyed = rows.select("doc_id", "source", F.col("size").cast("long").alias("size"), _key().alias("key"), _skey().alias("skey")).withColumn("bucket", bucket)
    # rows that agree in all that counts are one group: an id, or its absence, that many rows share is no bucket's burden
    same = keyed.groupBy("skey", "bucket", "key", "doc_id", "size").agg(F.first("source").alias("source"), F.count("*").alias("copies"))
    same = written(same, "mix-groups")  # the texts are read and counted once
    buckets = same.groupBy("skey", "bucket").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("copies")).alias("bucket_size"))
    sizes = buckets.groupBy("skey").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
        .join(source_targets(sizes, weights, max_epochs, share), "skey")
        .select("skey", "bucket", "bucket_start", "source_size", "target")
    )
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("bucket_start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    groups = same.join(starts, ["skey", "bucket"]).withColumn("_start", before)
    if same.where(F.col("copies") > COPIES).isEmpty():
        rows = groups.withColumn("_copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    else:  # the copies of a large group are dealt out before they are made
        chunks = written(groups, "mix-starts").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES).cast("int")))).repartition("key", "size", "_chunk")
        last = F.least((F.col("_chunk") + 1) * COPIES, F.col("copies")) - 1
        rows = chunks.withColumn("_copy", F.explode(F.sequence((F.col("_chunk") * COPIES).cast("long"), last.cast("long"))))
    rows = rows.withColumn("_before", F.col("_start") + F.col("_copy") * F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size") - F.col("_before")
    if cut == "word":
        extra = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    else:
        extra = F.when((rest > 0) & (2 * rest >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    return rows.withColumn("epochs", epochs).withColumn("extra", extra.cast("long")).select("doc_id", "source", "size", "source_size", "target", "epochs", "extra", "key", "skey")
