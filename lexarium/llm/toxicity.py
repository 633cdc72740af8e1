"""Toxicity by nearest labelled examples: exact weighted TF-IDF cosine over all words.

Features are all lower-cased words of the labelled examples and, once more and ``Setting.emphasis`` times as heavy, the words and
word beginnings (word families) that a likelihood-ratio test ties to the toxic label; their document frequencies are
counted over all documents.  Labelled examples are a sample bounded in rows and bytes, all of them that have a
word indexed by all their features.

The index is block-max: examples lie in blocks of like ones.  Rare features have postings; frequent ones a row over all examples, and the largest
weight of each block.  What the rare features give is added up exactly; with the block maxima of the frequent ones it bounds what any example of a block can
reach.  Blocks are opened by falling bound until the next can't hold one of the nearest, so neighbours are exact and other blocks stay closed.  Texts are
held against a block together.  Votes are weighted by squared similarity and by what each example stands
for in its class, against a fixed weight of clean votes, so far neighbours alone don't decide.  The share of toxic votes is calibrated by
isotonic regression on left-out examples, those without any word among them.  Features are chosen and the index is built in tasks; the driver
passes them on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .durable import written

NOT_LETTERS = r"[^\p{L}\p{M}]+"
#: Kinds of features: 0 is the word, n the first n letters of a longer word. The first has every word, the others those that the label favours.
KINDS = (0, 0, 3, 4, 5, 6, 7, 8)
#: Hashed dimensions by which like examples are brought together.
SKETCH = 64
#: Decimals of a similarity: equal ones come out equal. A bound must fall short by more than this before its block stays closed.
DIGITS, MARGIN = 6, 4e-6
#: Features of at least one in so many examples are frequent. Postings and similarities held at a time.
FREQUENT, HELD = 16, 1 << 22
#: Labelled texts that are cut into words at a time while features are chosen and indexed.
AT_ONCE = 512


EXAMPLES = pa.schema([("digest", pa.string()), ("label", pa.int32()), ("weight", pa.float64()), ("text", pa.string())])


@dataclass(frozen=True)
class Setting:
    toxic: int = 2000  # bound on sampled toxic examples
    clean: int = 4000  # and on others
    sample_bytes: int = 64 << 20  # bound on their texts together
    features: int = 1500  # bound on those that the label favours
    least_ratio: float = 15.0  # likelihood-ratio statistic from which a feature counts
    neighbours: int = 25
    doubt: float = 0.25  # clean votes that always count, as a share of all neighbours at full similarity
    block: int = 32  # examples of a block
    batch: int = 128  # texts held against the blocks at a time
    emphasis: float = 4.0  # weight of what the label favours, beside 1 for every word
    threshold: float = 0.7


@dataclass
class Index:
    """Inverted index over unit vectors. Postings of feature f: ``ids[start[f]:start[f + 1]]``, rising, and ``weights``."""

    features: list[pa.Array]  # by kind: the strings
    first: list[int]  # number of a kind's first feature
    idf: np.ndarray
    start: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    names: np.ndarray
    setting: Setting
    prior: float = 0.0
    nothing: float = 0.0  # score of a text without any word of the examples
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    opened: int = 0  # blocks that searches opened, and those that stayed closed
    closed: int = 0

    def unfolded(self) -> "Index":
        """With the rows and block maxima of frequent features that searching uses, made once per worker."""
        if not hasattr(self, "rows"):
            size = len(self.toxic)
            many = np.flatnonzero(np.diff(self.start) * FREQUENT >= max(size, 1))
            self.row_of = np.full(len(self.idf), -1, np.int64)
            self.row_of[many] = np.arange(len(many))
            length = np.diff(self.start)[many]
            at = _ranges(self.start[many], length)
            self.rows = np.zeros((len(many), size), np.float32)
            self.rows[np.repeat(np.arange(len(many)), length), self.ids[at]] = self.weights[at]
            self.blocks = np.arange(0, size, self.setting.block)
            self.maxima = np.maximum.reduceat(self.rows, self.blocks, axis=1) if size else np.zeros((len(many), 0), np.float32)
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "row_of", "maxima", "blocks")}

    def similarities(self, row: np.ndarray, feat: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
        """Cosines of ``n`` texts, given as unit vectors beside (row, feature), to examples: exact for all that can be among the ``k`` nearest, 0 for others."""
        size, place = len(self.toxic), self.row_of[feat]
        often = place >= 0
        asked = np.zeros((n, len(self.rows)), np.float32)
        asked[row[often], place[often]] = weight[often]
        row, feat, weight = row[~often], feat[~often], weight[~often]
        length = self.start[feat + 1] - self.start[feat]
        at = _ranges(self.start[feat], length)
        rare = np.bincount(np.repeat(row * size, length) + self.ids[at], np.repeat(weight, length) * self.weights[at], n * size).reshape(n, size)
        bound = asked @ self.maxima + np.maximum.reduceat(rare, self.blocks, axis=1)
        sims = np.zeros((n, size))

        def open_blocks(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(axis=0)).tolist():
                texts, block = np.flatnonzero(chosen[:, b]), slice(b * self.setting.block, (b + 1) * self.setting.block)
                sims[texts, block] = np.round(asked[texts] @ self.rows[:, block] + rare[texts, block], DIGITS)
            self.opened += int(chosen.sum())

        some = min(len(self.blocks), -(-2 * k // self.setting.block))
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, some - 1, axis=1)[:, :some], True, axis=1)
        first &= bound > 0
        open_blocks(first)
        enough = np.partition(sims, size - k, axis=1)[:, size - k] if size > k else np.zeros(n)
        rest = ~first & (bound > 0) & (bound >= enough[:, None] - MARGIN)
        open_blocks(rest)
        self.closed += int(bound.size - first.sum() - rest.sum())
        return sims

    def _best(self, sims: np.ndarray, k: int) -> np.ndarray:
        """The k examples of largest positive similarity, falling; of equal ones those first in the index."""
        least = np.partition(sims, len(sims) - k)[len(sims) - k] if len(sims) > k else 0.0
        ids = np.flatnonzero((sims > 0) & (sims >= least))
        return ids[np.lexsort((ids, -sims[ids]))[:k]]

    def nearest(self, feat: np.ndarray, weight: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples nearest to a unit vector and their cosines, all positive, falling. Exact."""
        k = self.setting.neighbours if k is None else k
        if not len(self.toxic):
            return np.zeros(0, np.int64), np.zeros(0)
        sims = self.unfolded().similarities(np.zeros(len(feat), np.int64), feat, weight, 1, k)[0]
        ids = self._best(sims, k)
        return ids, sims[ids]

    def votes(self, row: np.ndarray, feat: np.ndarray, weight: np.ndarray, n: int, without: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray]]:
        """Of each text, given as unit vectors beside (row, feature), the share of toxic votes and the examples by falling similarity;
        ``without`` has an example to leave out of each."""
        self.unfolded()
        size, k = len(self.toxic), self.setting.neighbours
        ends = np.searchsorted(row, np.arange(n + 1))
        cost = np.concatenate([[0], np.cumsum(np.where(self.row_of[feat] < 0, np.diff(self.start)[feat], 0))])[ends] + np.arange(n + 1) * size
        clean = self.setting.doubt * k * float(self.stands_for.mean() if len(self.stands_for) else 1)
        i = 0
        while i < n:
            j = min(max(i + 1, int(np.searchsorted(cost, cost[i] + HELD, side="right")) - 1), i + self.setting.batch, n)
            at = slice(ends[i], ends[j])
            for m, sims in enumerate(self.similarities(row[at] - i, feat[at], weight[at], j - i, k + (without is not None)), i):
                ids = self._best(sims, k + (without is not None))
                if without is not None:
                    ids = ids[ids != without[m]][:k]
                w = sims[ids] ** 2 * self.stands_for[ids]
                yield float((w * self.toxic[ids]).sum() / (w.sum() + clean)), ids
            i = j

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, self.knots, self.values))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after another."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def _kinds(vocabulary: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Per kind: the places in the vocabulary that have such a feature, and the features."""
    length = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)
    for kind in KINDS:
        if kind == 0:
            yield kind, np.arange(len(vocabulary)), vocabulary
        else:
            at = np.flatnonzero(length > kind)
            yield kind, at, pc.utf8_slice_codeunits(vocabulary.take(pa.array(at)), 0, kind)


def _spread(w: tb.Words, place: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word whose place in the vocabulary has a feature (-1: none)."""
    by_word = np.full(len(w.vocabulary), -1, np.int64)
    by_word[place] = feature
    got = by_word[w.code]
    return w.row[got >= 0], got[got >= 0]


def featured(texts: pa.LargeStringArray, features: list[pa.Array], first: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of features by text: row, feature, times, sorted by (row, feature)."""
    w = tb.words(pc.utf8_lower(texts), NOT_LETTERS)
    total = first[-1] + len(features[-1])
    rows, found = [], []
    for k, (_, place, strings) in enumerate(_kinds(w.vocabulary)):
        if len(features[k]):
            at = pc.fill_null(pc.index_in(strings, value_set=features[k]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, got = _spread(w, place[at >= 0], at[at >= 0] + first[k])
            rows.append(row)
            found.append(got)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, times = np.unique(np.concatenate(rows) * total + np.concatenate(found), return_counts=True)
    return key // total, key % total, times


def _presence(texts: list[str], toxic: np.ndarray, kind: int) -> pa.Table:
    """``feature, toxic, clean``: how many texts of each label have a feature, words cut a few texts at a time."""
    out = []
    for start in range(0, len(texts), AT_ONCE):
        w = tb.words(pc.utf8_lower(tb.texts_of(pa.array(texts[start : start + AT_ONCE], pa.string()))), NOT_LETTERS)
        place, strings = next((place, strings) for k, (_, place, strings) in enumerate(_kinds(w.vocabulary)) if k == kind)
        coded = strings.dictionary_encode()
        row, got = _spread(w, place, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        size = max(len(coded.dictionary), 1)
        pair = np.unique(row * size + got)
        label = toxic[start : start + AT_ONCE][pair // size]
        count = lambda x: pa.array(np.bincount((pair % size)[label == x], minlength=len(coded.dictionary)).astype(np.int64))  # noqa: B023, E731
        out.append(pa.table({"feature": coded.dictionary, "toxic": count(1), "clean": count(0)}))
    if not out:
        return pa.table({"feature": pa.array([], pa.large_string()), "toxic": pa.array([], pa.int64()), "clean": pa.array([], pa.int64())})
    found = pa.concat_tables(out).group_by("feature").aggregate([("toxic", "sum"), ("clean", "sum")])
    return found.rename_columns(["feature", "toxic", "clean"]).sort_by("feature")


def _select(texts: list[str], toxic: np.ndarray, setting: Setting) -> list[pa.Array]:
    """Features by kind: all words, and those that the toxic label favours by the likelihood ratio of presence in texts."""
    every = _presence(texts, toxic, 0).column("feature").combine_chunks()
    scored: list[tuple[float, int, str]] = []
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    for k in range(1, len(KINDS)) if 0 < n1 < len(toxic) else ():
        found = _presence(texts, toxic, k)
        a, b = (found.column(c).to_numpy().astype(np.float64) for c in ("toxic", "clean"))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = (a + b) / (n1 + n0)
            part = lambda x, n: np.where(x > 0, x * np.log(x / (n * share)), 0) + np.where(n - x > 0, (n - x) * np.log((n - x) / (n * (1 - share))), 0)  # noqa: B023, E731
            ratio = np.nan_to_num(2 * (part(a, n1) + part(b, n0)))
        good = np.flatnonzero((ratio >= setting.least_ratio) & (a * n0 > 3 * b * n1))
        scored += [(-r, k, s) for r, s in zip(ratio[good].tolist(), found.column("feature").take(pa.array(good)).to_pylist(), strict=True)]
    scored.sort()
    best = scored[: setting.features]
    return [every] + [pa.array(sorted(s for _, kind, s in best if kind == k), pa.large_string()) for k in range(1, len(KINDS))]


def _featured_all(texts: list[str], features: list[pa.Array], first: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``featured`` of many texts, a few at a time."""
    parts = []
    for start in range(0, len(texts), AT_ONCE):
        row, feat, times = featured(tb.texts_of(pa.array(texts[start : start + AT_ONCE], pa.string())), features, first)
        parts.append((row + start, feat, times))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def _vectors(row: np.ndarray, feat: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Unit TF-IDF weights beside (row, feature)."""
    weight = (1 + np.log(times)) * idf[feat]
    norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=n))
    return weight / norm[row]


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising step function as knots and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, smallest x, largest x
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, v, _, hi = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * v) / (p[1] + v), p[1] + v, hi
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    return knots, np.array([b[0] for b in blocks for _ in range(2)])


def _alike(row: np.ndarray, feat: np.ndarray, weight: np.ndarray, n: int, groups: int, rounds: int = 6) -> np.ndarray:
    """An order of ``n`` unit vectors that brings like ones together: means of hashed vectors, refined a few times from evenly spaced ones."""
    h = tb.mix64(feat.astype(np.uint64))
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    x = np.bincount(row * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64), weight * sign, n * SKETCH).reshape(n, SKETCH)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.argsort(x[:, 0], kind="stable")[np.linspace(0, n - 1, max(1, min(groups, n))).astype(int)]]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(SKETCH)], axis=1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    close, between = x @ centres.T, centres @ centres.T
    near = close.argmax(axis=1)
    # groups follow one another by likeness, so a block that two share is of like ones too
    rank, here, left = np.zeros(len(centres), np.int64), 0, np.ones(len(centres), bool)
    for i in range(len(centres)):
        rank[here], left[here] = i, False
        here = int(np.where(left, between[here], -np.inf).argmax())
    return np.lexsort((-close[np.arange(n), near], rank[near]))


def index_of(ids: list, texts: list[str], toxic: np.ndarray, stands_for: np.ndarray, features: list[pa.Array], idf: np.ndarray, setting: Setting) -> Index:
    """The index over examples that have a word, calibrated on itself with each example left out in turn."""
    first = np.concatenate([[0], np.cumsum([len(f) for f in features])[:-1]]).astype(int).tolist()
    total = first[-1] + len(features[-1])
    idf = idf * np.where(np.arange(total) < first[1], 1.0, setting.emphasis)
    row, feat, times = _featured_all(texts, features, first)
    weight = _vectors(row, feat, times, idf, len(texts))
    has = np.zeros(len(texts), bool)
    has[row] = True
    chosen = np.flatnonzero(has)
    if len(chosen):
        compact = np.cumsum(has) - 1
        chosen = chosen[_alike(compact[row], feat, weight, len(chosen), max(1, len(chosen) // (2 * setting.block)))]
    place = np.full(len(texts), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    by = np.lexsort((place[row], feat))
    index = Index(
        features, first, idf, np.searchsorted(feat[by], np.arange(total + 1)), place[row[by]].astype(np.int32), weight[by].astype(np.float32),
        toxic[chosen].astype(np.float64), stands_for[chosen], np.array(ids, dtype=object)[chosen], setting,
    )
    index.prior = float((stands_for * toxic).sum() / stands_for.sum()) if len(texts) else 0.0
    if len(texts):
        raw = np.array([share for share, _ in index.votes(row, feat, weight, len(texts), place)])
        index.knots, index.values = _isotonic(raw, toxic.astype(float), stands_for.astype(float))
        index.nothing = index.calibrated(0.0)
    return index


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows whose labels training must not see: crc32 of the id as text, modulo ``folds``, is ``fold`` (null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == fold


def document_frequencies(docs: DataFrame, features: list[pa.Array], first: list[int]) -> tuple[np.ndarray, int]:
    """Of each feature, the documents of the whole table that have it; and the number of documents."""
    total = first[-1] + len(features[-1])
    sent = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = np.zeros(total + 1, np.int64), 0
        for batch in batches:
            texts = tb.texts_of(batch.column(0))
            for part in tb.slices(texts):
                _, feat, _ = featured(texts[part.start : part.stop], sent.value, first)
                count[:total] += np.bincount(feat, minlength=total)
            rows += len(texts)
        count[total] = rows
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["feature", "df"])

    out = np.zeros(total + 1, np.int64)
    got = docs.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    out[got["feature"].to_numpy()] = got["df"].to_numpy()
    return out[:total], int(out[total])


def learn(docs: DataFrame, labels: DataFrame, setting: Setting = Setting()) -> Index:
    """The index from ``text`` and ``toxic`` of labelled rows outside the held-out fold.

    A sample of each class is drawn by a hash of the id, at most ``toxic`` and ``clean`` texts or so and ``sample_bytes`` together, by falling share of
    the draw; rows with a null label are ignored; equal texts count once, with the smallest id.  The sampled labels are what is broadcast to the
    documents; the texts go by the shared folder, and only what is within the bounds comes to the driver, however often an id is repeated."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bound = {1: setting.toxic, 0: setting.clean}
    share = {k: min(1.0, bound[k] / max(counts.get(k, 0), 1)) for k in bound}
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    part = draw / F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    drawn = rows.withColumn("draw", part).where("draw < 1")
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    sample = written(found.select("doc_id", "toxic", "draw", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("size"), "text"), "labelled")
    best = F.min(F.struct(F.col("doc_id").cast("string").alias("name"), "toxic", "doc_id", "draw"))
    listed = sample.groupBy("digest").agg(best.alias("best"), F.first("size").alias("size")).orderBy("best.draw", "digest").limit(setting.toxic + setting.clean + 1000)
    picked, held = [], 0
    for r in listed.collect():
        held += r["size"]
        if held > setting.sample_bytes and picked:
            break
        picked.append(r)
    before = {k: sum(r["best"]["toxic"] == k for r in picked) for k in bound}
    weight = {k: counts.get(k, 0) / before[k] if before[k] else 1.0 for k in bound}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["digest"], r["best"]["toxic"], weight[r["best"]["toxic"]]) for r in picked], "digest string, label int, weight double")
    names = {r["digest"]: r["best"]["doc_id"] for r in picked}
    chosen = sample.select("digest", "text").join(F.broadcast(wanted), "digest").dropDuplicates(["digest"]).select("digest", "label", "weight", "text")
    chosen = written(chosen.coalesce(1).sortWithinPartitions("digest"), "examples").coalesce(1).sortWithinPartitions("digest")

    def held_rows(batches: Iterator[pa.RecordBatch]) -> tuple[list, np.ndarray, np.ndarray, list[str]]:
        rows = pa.Table.from_batches(list(batches), schema=EXAMPLES)
        return rows.column("digest").to_pylist(), rows.column("label").to_numpy().astype(np.int64), rows.column("weight").to_numpy(), rows.column("text").to_pylist()

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, toxic, _, texts = held_rows(batches)
        for kind, strings in enumerate(_select(texts, toxic, setting)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(strings), kind, np.int32)), strings.cast(pa.string())], ["kind", "feature"])

    got = chosen.mapInArrow(select, "kind int, feature string").toArrow()
    kinds = got.column("kind").to_numpy()
    features = [x.take(pc.array_sort_indices(x)) for x in (got.column("feature").filter(pa.array(kinds == k)).combine_chunks().cast(pa.large_string()) for k in range(len(KINDS)))]
    first = np.concatenate([[0], np.cumsum([len(f) for f in features])[:-1]]).astype(int).tolist()
    df, n = document_frequencies(docs, features, first)
    idf = np.log((1 + n) / (1 + df)) + 1
    sent = spark.sparkContext.broadcast((features, idf))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, toxic, stands_for, texts = held_rows(batches)
        index = index_of(digests, texts, toxic, stands_for, *sent.value, setting)
        blob = pickle.dumps(index, 5)
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["index"])

    index = pickle.loads(chosen.mapInArrow(build, "index binary").first()["index"])
    sent.destroy()
    index.names = np.array([names[d] for d in index.names.tolist()], dtype=object)
    return index


def score_texts(index: Index, texts: pa.LargeStringArray) -> tuple[np.ndarray, list[list]]:
    """Score and nearest examples (at most three names) of each text."""
    index.unfolded()
    n = len(texts)
    row, feat, times = featured(texts, index.features, index.first)
    score, evidence = np.full(n, index.nothing), [[] for _ in range(n)]
    if not len(row):
        return score, evidence
    weight = _vectors(row, feat, times, index.idf, n)
    some, at = np.unique(row, return_inverse=True)
    for i, (raw, ids) in zip(some.tolist(), index.votes(at, feat, weight, len(some)), strict=True):
        score[i] = index.calibrated(raw)
        evidence[i] = index.names[ids[:3]].tolist()
    return score, evidence


def score(docs: DataFrame, index: Index) -> DataFrame:
    """``doc_id, score, predicted, evidence`` of every whole text; ``evidence`` has the ids of nearest examples.

    Null and empty texts, and texts without any word of the examples, get the calibrated rate of such examples (0 where there are no
    examples at all).  Repeated rows and null ids pass through; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    threshold = index.setting.threshold
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = tb.texts_of(batch.column(1))
            for part in tb.slices(texts):
                got, evidence = score_texts(sent.value, texts[part.start : part.stop])
                predicted = (got >= threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(got), pa.array(predicted), pa.array(evidence, pa.list_(id_type))], ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<{kind}>")
