"""N-gram Jaccard self-join with prefix, length, positional and suffix filters.

1. *Classes.* Every text becomes its set of distinct word n-grams (48-bit hashes).  Equal sets form one
   class, named by a hash of the set; copies never meet pair by pair.
2. *Rare-first order.* N-grams that recur within stretches of the corpus are counted in the first pass
   over all documents and the most frequent ``FREQUENT`` of them are ordered last, by count; the others come
   before them by hash.  Any one order common to all sets is correct; this one keeps frequent passages
   out of prefixes.
3. *Prefix postings.* Two sets can only reach the threshold if their prefixes share ``Setting.common`` n-grams (or
   all that the smaller overlap needs).  Postings of n-grams that one class alone has are dropped.
4. *Pairs.* Members of a small group of postings (``Setting.small``) are paired with each other; in a large one each
   member is first paired with a few pivots, which is linear in the group.  Pairs pass the length filter, the positional
   filter and a suffix filter (a bound on the overlap from counts of n-grams per hash cell), and each remaining
   pair is verified once on the whole sets.  Components of the links follow.
5. *Rest.* Pairs of a large group whose members are in one component already need no test: they can't change the
   result.  All others are joined, filtered and verified, so that no link between different components is lost.
   While that rest would be large, more stars with other pivots shrink it first.

The result is exact up to hash collisions: 48 bits within a pair of sets, 128 bits between sets.  Sets are named by 64 bits; the first pass
has a second name of 64 bits, and where two unlike sets share the first, both go by the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .components import components
from .durable import written


@dataclass(frozen=True)
class Setting:
    """Two sets link when ``per * intersection >= least * union``."""

    n: int = 5
    least: int = 80
    per: int = 100
    frequent: int = 1 << 18  # n-grams ordered by count; bounds what is broadcast (2 MB)
    cells: int = 128  # hash cells of the suffix filter
    bitmap_bits: int = 1 << 25  # of the broadcast filter on classes that have a candidate (4 MB)
    common: int = 3  # n-grams that two prefixes must share
    small: int = 32  # groups of up to this many postings are paired at once
    pivots: int = 16  # members of a larger group that all others are paired with in a round
    star_rounds: int = 6
    members: int = 256  # of a group that one task compares with all of it in the last round

    def prefix(self, size):
        """Length of the prefix that shares ``common`` n-grams with every set within reach, if they share as many at all."""
        least = -(-self.least * size // self.per)
        return size - least + np.minimum(self.common, least)


# Tables with hash cells or salted copies, and self-joins, ask for a merge join: their files shrink far more than what would be broadcast.

#: Grams gathered before counts are taken in the first pass; bounds a task's memory.
COUNT_EVERY = 4 << 20
#: A gram is reported from a stretch if this many different sets of the stretch have it.
COUNT_FROM = 3
#: Names that two unlike sets may share before the run gives up: at 10**10 sets three are expected.
MOST_CLASHES = 100_000
#: Tasks that a large group, a component, or a class of many copies, is dealt to.
SALTS = 32
#: Copies from which a class is dealt out, and how many such classes are broadcast (1 MB): any other class has fewer copies, or
#: less than one in so many of all rows.
MANY_COPIES, HOT_CLASSES = 1000, 1 << 16
#: Counts of a cell stop here; sets that could have more skip the suffix filter.
CELL_MOST = 32767
MASK48 = np.uint64((1 << 48) - 1)


@dataclass
class Sets:
    """Sets of n-grams of some texts: ``gram`` sorted within ``row``; ``size``, ``cls`` and ``alt`` (the second name) by row (size 0: no set)."""

    row: np.ndarray
    gram: np.ndarray
    size: np.ndarray
    cls: np.ndarray
    alt: np.ndarray | None = None


def _names(gram: np.ndarray, starts: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    mixed = tb.mix64(gram * np.uint64(2 * seed + 1) + np.uint64(seed + 1))
    return tb.mix64(np.add.reduceat(mixed, starts) ^ (np.bitwise_xor.reduceat(tb.mix64(mixed), starts) << np.uint64(1)) ^ size.astype(np.uint64))


def shingle_sets(texts: pa.LargeStringArray, n: int, clashes: np.ndarray | None = None) -> Sets:
    """``clashes``: first names, sorted, whose sets go by the second; None asks for both names. A-Z are lower-cased. Fewer words than ``n``: the whole sequence is the only n-gram; no word: no set."""
    w = tb.words(tb.lower_ascii(texts))
    rows = len(texts)
    if not len(w.code):
        return Sets(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64))
    h = tb.hash64(w.vocabulary)[w.code]
    bounds = w.bounds
    length = np.diff(bounds)
    prime = np.uint64(0x9E3779B97F4A7C15)
    # polynomial over n consecutive words; positions whose window leaves the text are cut below
    total = len(h)
    gram = np.zeros(total, np.uint64)
    for k in range(min(n, total)):
        gram[: total - k] = gram[: total - k] * prime + h[k:]
    place = np.arange(total) - bounds[w.row]
    ok = place + n <= length[w.row]
    short = np.flatnonzero((length > 0) & (length < n))
    row, gram = w.row[ok], gram[ok]
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        left = length[short].copy()
        at = bounds[short].copy()
        while (live := left > 0).any():
            whole[live] = whole[live] * prime + h[at[live]]
            at[live] += 1
            left[live] -= 1
        row = np.concatenate([row, short])
        gram = np.concatenate([gram, whole + length[short].astype(np.uint64)])
    gram = tb.mix64(gram) & MASK48
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | gram)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row, gram = (key >> np.uint64(48)).astype(np.int64), key & MASK48
    size = np.bincount(row, minlength=rows).astype(np.int64)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    cls, alt = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    some = row[starts]
    cls[some] = _names(gram, starts, size[some], 0)
    if clashes is None or len(clashes):
        alt[some] = _names(gram, starts, size[some], 1)
    cls, alt = cls.view(np.int64), alt.view(np.int64)
    if clashes is not None and len(clashes):
        cls = np.where(np.isin(cls, clashes), alt, cls)
    return Sets(row, gram, size, cls, alt)


def _parts(texts: pa.LargeStringArray) -> Iterator[slice]:
    """Slices of at most 2**16 rows: a row's number has 16 bits beside a gram."""
    for part in tb.slices(texts):
        for start in range(part.start, part.stop, 1 << 16):
            yield slice(start, min(part.stop, start + (1 << 16)))


def _first_pass(docs: DataFrame, setting: Setting) -> DataFrame:
    """Rows of two kinds: a document (``doc_id, cls, alt, n, hist``), or a gram with the number of sets of a stretch that have it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    names = ["doc_id", "cls", "alt", "n", "hist", "gram"]

    def flush(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        gram = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(gram)))
        gram, count = gram[starts][count >= COUNT_FROM], count[count >= COUNT_FROM]
        none = len(gram)
        return pa.RecordBatch.from_arrays([pa.nulls(none, id_type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.array(count, pa.int64()), pa.nulls(none, pa.list_(pa.int16())), pa.array(gram.view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [], 0, set()
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = tb.texts_of(batch.column(1))
            for part in _parts(texts):
                s = shingle_sets(texts[part.start : part.stop], setting.n)
                rows = len(s.size)
                cells = np.bincount(s.row * setting.cells + (s.gram % np.uint64(setting.cells)).astype(np.int64), minlength=rows * setting.cells)
                cells = np.minimum(cells, CELL_MOST).astype(np.int16)
                hist = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * setting.cells), pa.array(cells))
                none = s.size == 0
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(s.cls, mask=none), pa.array(s.alt, mask=none), pa.array(s.size), hist, pa.nulls(rows, pa.int64())], names)
                new = np.array([not (c in seen or seen.add(c)) for c in s.cls.tolist()], bool)
                gram = s.gram[new[s.row]]
                held.append(gram)
                n_held += len(gram)
                if n_held >= COUNT_EVERY:
                    yield flush(held, id_type)
                    held, n_held, seen = [], 0, set()
        if n_held:
            yield flush(held, id_type)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, cls long, alt long, n long, hist array<smallint>, gram long")


def _prefix_postings(docs: DataFrame, setting: Setting, frequent: np.ndarray, clashes: np.ndarray) -> DataFrame:
    """``gram, cls, np, hot`` of every prefix n-gram; ``np`` has the set's size above the gram's position. ``frequent``: grams from the least to the most frequent."""
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], order + 1, clashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, clashes = sent.value
        seen: set[int] = set()
        for batch in batches:
            texts = tb.texts_of(batch.column(0))
            for part in _parts(texts):
                s = shingle_sets(texts[part.start : part.stop], setting.n, clashes)
                new = np.array([not (c in seen or seen.add(c)) for c in s.cls.tolist()], bool)
                keep = new[s.row]
                row, gram = s.row[keep], s.gram[keep]
                late = np.zeros(len(gram), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    late = np.where(known[at] == gram, rank[at], 0)
                mixed = np.zeros(len(s.size), bool)
                mixed[row[late > 0]] = True
                again = np.flatnonzero(mixed[row])
                if len(again):  # rows are runs, and stay in place; within them the frequent go last
                    by = again[np.lexsort((late[again], row[again]))]
                    gram[again], late[again] = gram[by], late[by]
                starts = np.searchsorted(row, np.arange(len(s.size)))
                pos = np.arange(len(row)) - starts[row]
                take = pos < setting.prefix(s.size[row])
                row = row[take]
                yield pa.RecordBatch.from_arrays([pa.array(gram[take].view(np.int64)), pa.array(s.cls[row]), pa.array((s.size[row] << 32) | pos[take]), pa.array(late[take] > 0)], ["gram", "cls", "np", "hot"])

    return docs.select("text").mapInArrow(run, "gram long, cls long, np long, hot boolean")


def _wanted_sets(docs: DataFrame, setting: Setting, bitmap: np.ndarray, clashes: np.ndarray) -> DataFrame:
    """``cls, grams`` of the classes in the bitmap (and a few others)."""
    sent = docs.sparkSession.sparkContext.broadcast((bitmap, clashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, clashes), seen = sent.value, set()
        for batch in batches:
            texts = tb.texts_of(batch.column(0))
            for part in _parts(texts):
                s = shingle_sets(texts[part.start : part.stop], setting.n, clashes)
                bit = (s.cls.view(np.uint64) & np.uint64(setting.bitmap_bits - 1)).astype(np.int64)
                want = (s.size > 0) & ((bits[bit >> 3] >> (bit & 7)) & 1).astype(bool)
                want &= np.array([not w or not (c in seen or seen.add(c)) for c, w in zip(s.cls.tolist(), want.tolist(), strict=True)], bool)
                gram = s.gram[want[s.row]]
                ends = np.concatenate([[0], np.cumsum(s.size[want])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(s.cls[want]), pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))], ["cls", "grams"])

    return docs.select("text").mapInArrow(run, "cls long, grams array<long>")


def _bitmap(classes: DataFrame, bits: int) -> np.ndarray:
    """A bit per class, by its lowest bits; of fixed size however many classes there are."""
    bit = F.col("cls").bitwiseAND(bits - 1)
    blocks = classes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for block, part in zip(*blocks.toArrow().to_pydict().values(), strict=True):  # at most ``bits`` bits
        out[block * 4096 : block * 4096 + len(part)] = np.frombuffer(part, np.uint8)
    return out


def _possible(setting: Setting, a: str, b: str) -> Column:
    """Length and positional filters on two postings of one n-gram."""
    size = f"least({a}.n, {b}.n) * cast({setting.per} as bigint) >= greatest({a}.n, {b}.n) * cast({setting.least} as bigint)"
    place = f"{setting.per + setting.least} * cast(least({a}.pos, {b}.pos) + least({a}.n - {a}.pos, {b}.n - {b}.pos) as bigint) >= {setting.least} * (cast({a}.n as bigint) + {b}.n)"
    return F.expr(f"({size}) AND ({place})")


def _cells(setting: Setting, a: str, b: str) -> str:
    """Suffix filter: the smaller count of every hash cell bounds the overlap."""
    most = f"cast(aggregate(zip_with({a}.hist, {b}.hist, (x, y) -> least(x, y)), 0, (s, x) -> s + x) as bigint)"
    return f"(least({a}.n, {b}.n) >= {CELL_MOST} OR {setting.per + setting.least} * {most} >= {setting.least} * (cast({a}.n as bigint) + {b}.n))"


def _near(pairs: DataFrame, hists: DataFrame, setting: Setting) -> DataFrame:
    """Those of ``pairs`` (a < b, each once) that pass the suffix filter."""
    for side in ("b", "a"):
        pairs = pairs.join(hists.select(F.col("cls").alias(side), F.struct("n", "hist").alias(f"s{side}")).hint("merge"), side)
    return pairs.where(F.expr(_cells(setting, "sa", "sb"))).select("a", "b")


def _links(near: DataFrame, sets: DataFrame, setting: Setting) -> DataFrame:
    """Those of ``near`` (a, b) whose whole sets reach the threshold; each pair is verified once."""
    a = sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    b = sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb")).cast("long")
    return near.join(b, "b").join(a, "a").where(setting.per * both >= setting.least * (F.size("ga") + F.size("gb") - both)).select("a", "b")


def _shared(postings: DataFrame) -> DataFrame:
    """Postings of grams that several classes have, with their number ``m``.

    Frequent grams are counted by partial aggregation and joined back, so that a hot one is split by
    the join; others are seldom: one shuffle brings them together, and a window, which may spill, counts them.  A gram that isn't among the
    frequent has fewer classes than those, or fewer than ``COUNT_FROM`` in every stretch of ``COUNT_EVERY`` grams."""
    gram = Window.partitionBy("gram")
    rare = postings.where(~F.col("hot")).select("gram", "cls", "np").repartition("gram").dropDuplicates(["gram", "cls"]).withColumn("m", F.count("*").over(gram)).where("m > 1")
    hot = postings.where("hot").select("gram", "cls", "np").dropDuplicates(["gram", "cls"])
    sizes = hot.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    size, position = F.shiftright("np", 32).cast("int"), F.col("np").bitwiseAND(0xFFFFFFFF).cast("int")
    return rare.unionByName(hot.join(sizes, "gram")).select("gram", "cls", size.alias("n"), position.alias("pos"), "m")


#: Two members whose n-grams before this one are the same have met there already.
NOT_MET = "NOT (a.before <=> b.before AND a.before IS NOT NULL)"


def _few_pairs(postings: DataFrame, setting: Setting) -> DataFrame:
    """Pairs of classes that meet in small groups and pass the filters there, each once, if they share as many n-grams as they must."""
    met = postings.alias("a").join(postings.alias("b").hint("merge"), (F.col("a.gram") == F.col("b.gram")) & F.expr("a.cls < b.cls") & _possible(setting, "a", "b"))
    overlap = F.ceil(F.lit(setting.least) * (F.col("a.n").cast("long") + F.col("b.n")) / (setting.per + setting.least))
    pairs = met.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.least(F.lit(setting.common), overlap).alias("need"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("k"), F.max("need").alias("need")).where("k >= need").select("a", "b")


def _rest_pairs(alive: DataFrame, setting: Setting) -> DataFrame:
    """Pairs of members of different components that pass the filters.

    One of the two isn't in the group's largest component: only such members are copied, to each part of ``Setting.members`` or so of the
    group, so the copies follow the pairs that are to be tested and not the square of the group."""
    parts = F.ceil(F.col("m") / setting.members).cast("int")
    a = alive.withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).alias("a")
    b = alive.where("comp <> top").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("b")
    once = F.expr(f"a.comp <> b.comp AND (a.comp = a.top OR a.cls < b.cls) AND {NOT_MET}")
    met = a.join(b.hint("merge"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.part") == F.col("b.part")) & once & _possible(setting, "a", "b") & F.expr(_cells(setting, "a", "b")))
    return met.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"))


def _unsettled(many: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings of the groups whose members aren't all in one component yet, with ``comp`` and the largest component ``top``."""
    base = many.select("gram", "cls", "n", "pos", "m", "before", "hist")
    labelled = base.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    by_comp = labelled.groupBy("gram", "comp").agg(F.count("*").alias("k"))
    groups = by_comp.groupBy("gram").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp"))["comp"].alias("top")).where("comps > 1")
    # a group is dealt to several tasks: ``groups`` has one row for at least ``small`` of the others, so its copies are few
    dealt = labelled.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    copied = groups.select("gram", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return written(dealt.join(copied.hint("merge"), ["gram", "salt"]).drop("salt"), "unsettled")


def _star(postings: DataFrame, number: int, setting: Setting, also: str = "true") -> DataFrame:
    """Pairs of each member with its group's pivots. A class draws the same number in all groups, so groups of the same
    members have the same pivots."""
    columns = [c for c in ("cls", "n", "pos", "hist", "comp") if c in postings.columns]
    drawn = F.struct(F.xxhash64("cls", F.lit(number)).alias("draw"), *columns)
    # the smallest of each hash cell: several pivots from one partial aggregation
    cell = F.pmod(F.xxhash64("cls", F.lit(number), F.lit("cell")), F.lit(setting.pivots))
    pivots = postings.groupBy("gram", cell.alias("cell")).agg(F.min(drawn).alias("p"))
    met = postings.alias("b").join(pivots.hint("merge"), "gram").where(F.expr("b.cls <> p.cls") & F.expr(also) & _possible(setting, "p", "b") & F.expr(_cells(setting, "p", "b")))
    return met.select(F.col("p.cls").alias("a"), F.col("b.cls").alias("b"))


def _classes(docs: DataFrame, setting: Setting) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``doc_id, cls, n``), classes (``cls, n, hist, least, copies``: the smallest ``doc_id`` and the rows) and the components of
    linked classes (``node, comp``)."""
    passed = written(_first_pass(docs, setting), "sets")
    rows = passed.where("gram IS NULL").select("doc_id", "cls", "alt", "n", "hist")
    by_class = lambda rows: rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("n").alias("n"), F.first("hist").alias("hist"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("alt").alias("lo"), F.max("alt").alias("hi"))
    classes = written(by_class(rows), "classes")
    clashes = np.sort(classes.where("lo <> hi").select("cls").limit(MOST_CLASHES + 1).toArrow().column("cls").to_numpy().astype(np.int64))
    if len(clashes) > MOST_CLASHES:
        raise RuntimeError(f"over {MOST_CLASHES} names of sets clash")
    if len(clashes):
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(clashes.tolist()), F.col("alt")).otherwise(F.col("cls")))
        classes = written(by_class(rows), "classes")
    counts = passed.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "gram").limit(setting.frequent).toArrow()
    frequent = top.column("gram").to_numpy().astype(np.int64).view(np.uint64)[::-1].copy()

    postings = written(_prefix_postings(docs, setting, frequent, clashes), "prefixes")
    live = written(_shared(postings), "postings")
    hists = classes.select("cls", "n", "hist")

    # Small groups: all pairs, at most ``small`` times as many as postings, and those that share enough n-grams.
    # Large groups: pivots first; a pair that shares an n-gram of a large group is looked for there, whatever else it shares.
    few, many = live.where(F.col("m") <= setting.small), live.where(F.col("m") > setting.small)
    many = many.withColumn("before", F.lag("gram").over(Window.partitionBy("cls").orderBy("pos")))
    many = written(many.join(hists.select("cls", "hist").hint("merge"), "cls"), "large")
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = written(_near(_few_pairs(few, setting), hists, setting).unionByName(ordered(_star(many, 0, setting))).distinct(), "pairs")
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(many.select("cls")).distinct(), "wanted")
    sets = written(_wanted_sets(docs, setting, _bitmap(wanted, setting.bitmap_bits), clashes).join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    comps = components(_links(near, sets, setting))
    alive, left = many, None
    for k in range(1, setting.star_rounds + 1):
        # groups whose members are all in one component are done
        alive = _unsettled(alive, comps)
        rest = alive.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("comp") != F.col("top"), F.col("m"))).alias("pairs")).first()
        if not rest["rows"]:
            break
        # pivots go on while they help
        last = k == setting.star_rounds or rest["pairs"] <= setting.small * rest["rows"] or (left is not None and 2 * rest["pairs"] > left)
        left = rest["pairs"]
        pairs = _rest_pairs(alive, setting) if last else _star(alive, k, setting, "b.comp <> p.comp")
        comps = components(_links(ordered(pairs), sets, setting).unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        if last:
            break
    return rows.select("doc_id", "cls", "n"), classes, comps


def _smallest(comps: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of components (``node, comp``), and the smallest id of each component (``comp, id``), counted up in each task first."""
    inside = comps.join(classes.select(F.col("cls").alias("node"), "least"), "node")
    return inside.select("node", "comp"), inside.groupBy("comp").agg(F.min("least").alias("id"))


def linked(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """``doc_id, n_shingles, cls, component_id`` of every row.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included.  A null or empty text, or
    one without words, has an empty set, ``n_shingles`` 0, no class, and its own id.  Repeated rows and equal
    texts share a class; a null ``doc_id`` is ignored in the minimum unless it is the only one.  Other columns are
    ignored.  An empty table gives an empty result.

    A component's id reaches its classes by salted keys, and a class's id its copies likewise, so neither a component nor a class
    is one task's work."""
    rows, classes, comps = _classes(docs, setting)
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    inside, smallest = _smallest(comps, classes)
    salted = inside.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    named = salted.join(smallest.withColumn("salt", every).hint("merge"), ["comp", "salt"]).select(F.col("node").alias("cls"), "id")
    again = classes.where("copies > 1").select("cls", "least")
    ids = named.join(again, "cls", "full_outer").select("cls", F.coalesce("id", "least").alias("id"))

    hot = F.broadcast(classes.where(F.col("copies") >= MANY_COPIES).orderBy(F.desc("copies"), "cls").limit(HOT_CLASSES).select("cls", F.lit(True).alias("hot")))
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).join(hot, "cls", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod("row", F.lit(SALTS))).otherwise(0).cast("int"))
    spread = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    ids = ids.join(hot, "cls", "left").select("cls", "id", F.explode(spread).alias("salt"))
    out = dealt.join(ids.hint("merge"), ["cls", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """One row of each group of near copies: that with the smallest ``doc_id``, null last; of equal ids, that with the smallest hash of
    its text.  Rows of different groups stay, whatever their ids, and so does every row without words; of rows with the same id and text that
    has words, one stays.  Columns of any names pass through."""
    key, number = tb.free("key", docs.columns), tb.free("number", docs.columns)
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))
    name = lambda doc_id, digest: F.concat(F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n")), F.lit(":"), digest)
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", digest.alias("digest")).alias("doc_id"), "text")
    _, classes, comps = _classes(rows, setting)
    _, smallest = _smallest(comps, classes)
    alone = classes.join(comps.select(F.col("node").alias("cls")), "cls", "left_anti").select(F.col("least").alias("id"))
    keep = smallest.select("id").unionByName(alone).select(name(F.col("id.doc_id"), F.col("id.digest")).alias(key))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # the window cuts repeats in each task before it shuffles, and shares the shuffle with the join
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    once = docs.where(words).withColumn(key, name(F.col("doc_id"), digest)).withColumn(number, rank).where(F.col(number) == 1)
    return once.join(keep, key, "left_semi").select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(~words))
