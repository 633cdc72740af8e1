"""Language identification with interpolated Kneser-Ney character models.

One model per language is trained, a language a task, on a bounded, hash-drawn sample of labelled documents
(the bound is ``Training.docs_per_language``); every language that is a label is learned.  The models are stored together, in groups
of ``Training.group`` languages: one sorted array of n-gram hashes per order, and beside it a matrix with a column per language.  A
document gets, per language, its cross-entropy per character; the lowest wins, of equal ones the language first in code-point order.
A softmax whose temperature is fitted on part of the sample gives the score, and a document whose
lowest cross-entropy lies beyond what calibration texts show is marked as rejected.

Words are scored once per slice of text and language, then summed by document, so the
cost follows the number of distinct words.  N-grams run within a word and its edges.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .durable import written

#: Runs of characters that aren't letters or marks part words; a word is lower-cased letters.
NOT_LETTERS = r"[^\p{L}\p{M}]+"
UNDETERMINED = "und"
#: Languages whose sampling shares are broadcast (some 50 bytes each); more are joined.
BROADCAST_LANGUAGES = 50_000
#: Cells of a block's matrix of characters and languages.
BLOCK_CELLS = 1 << 23


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and shape of the model."""

    docs_per_language: int = 400
    order: int = 4
    grams: int = 50_000  # of each order and language that are kept: the most frequent, and what those end and begin with; back-off weights are then made anew
    group: int = 32  # languages that share a matrix
    alphabet: int = 1024  # characters that an unseen one is taken to be one of
    calibration_part: int = 5  # every fifth sampled document calibrates instead of training
    reject_sigmas: float = 8.0


@dataclass
class Fitted:
    """One language's model.  By order n from 1: ``keys[n]`` sorted hashes of n-grams, hashes ``suffix[n]`` of all but the first and
    ``context[n]`` of all but the last character, ``logp[n]``; ``back_keys[n]`` and ``back[n]``: log back-off weights of contexts of n characters."""

    keys: list[np.ndarray]
    suffix: list[np.ndarray]
    context: list[np.ndarray]
    logp: list[np.ndarray]
    back_keys: list[np.ndarray]
    back: list[np.ndarray]


@dataclass
class Group:
    """``logp[n][i]``: log-probabilities, one per language, of the last character of the n-gram with hash
    ``keys[n][i]`` after the others; ``back[n]``: log back-off weight of contexts of n characters."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back_keys: list[np.ndarray]
    back: list[np.ndarray]
    width: int


@dataclass
class Models:
    languages: list[str]
    order: int
    groups: list[Group]
    unknown: float
    scale: float = 1.0
    reject_above: float = float("inf")


def _key(chars: np.ndarray) -> np.ndarray:
    """Hashes of rows of code points (21 bits each, mixed)."""
    key = np.zeros(len(chars), np.uint64)
    for k in range(chars.shape[1]):
        key = (key << np.uint64(21)) ^ (key >> np.uint64(43)) ^ chars[:, k].astype(np.uint64)
    return tb.mix64(key)


def _ngrams(vocabulary: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words, with an edge before and after each, as one array of code points; the word of each point
    and its place in the word (the first edge is at place 0)."""
    n = len(vocabulary)
    lengths = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    text = "".join(f" {w} " for w in vocabulary.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    word = np.repeat(np.arange(n), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return points, word, place


def _window(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([points[at - n + 1 + k] for k in range(n)], axis=1)


def word_counts(texts: pa.LargeStringArray) -> tuple[list[str], np.ndarray]:
    """Distinct words of some texts and how often each is there."""
    w = tb.words(pc.utf8_lower(texts), NOT_LETTERS)
    return w.vocabulary.to_pylist(), np.bincount(w.code, minlength=len(w.vocabulary))


def fit(words: dict[str, int], setting: Training) -> Fitted:
    """Interpolated Kneser-Ney over the words of one language.

    The highest order counts occurrences, and so does a gram that starts with a word's edge; other grams count the characters that stand before them."""
    order = setting.order
    grams = [Counter() for _ in range(order + 1)]
    for word, times in words.items():
        padded = f" {word} "
        for end in range(2, len(padded) + 1):
            grams[min(order, end)][padded[max(0, end - order) : end]] += times
    for n in range(order - 1, 0, -1):
        grams[n].update(Counter(g[1:] for g in grams[n + 1]))
    p: list[dict[str, float]] = [{"": 1.0 / setting.alphabet}] + [{} for _ in range(order)]
    back: list[dict[str, float]] = [{} for _ in range(order + 1)]
    for n in range(1, order + 1):
        sizes = Counter(grams[n].values())
        d = min(0.95, max(0.1, sizes[1] / (sizes[1] + 2 * sizes[2]))) if sizes[1] + sizes[2] else 0.5
        total, kinds = Counter(), Counter()
        for g, c in grams[n].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        back[n - 1] = {h: d * kinds[h] / total[h] for h in total}
        for g, c in grams[n].items():
            p[n][g] = max(c - d, 0) / total[g[:-1]] + back[n - 1][g[:-1]] * _lower(p, back, g[1:], n - 1)
    kept: list[set[str]] = [set() for _ in range(order + 2)]
    for n in range(order, 0, -1):
        often = grams[n] if len(grams[n]) <= setting.grams else sorted(grams[n], key=lambda g: (-grams[n][g], g))[: setting.grams]
        kept[n] = {*often, *(x for g in kept[n + 1] for x in (g[1:], g[:-1]) if x in p[n])}
    for n in range(1, order + 1):
        if len(kept[n]) < len(grams[n]):
            back[n - 1] |= renormalised(kept[n], p[n], lambda g, n=n: p[n - 1][g[1:]])
    out = Fitted([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)], [], [])
    for n in range(1, order + 1):
        names = list(kept[n])
        points = _points(names, n)
        k = _key(points)
        at = np.argsort(k)
        out.keys.append(k[at])
        out.suffix.append(_key(points[:, 1:])[at])
        out.context.append(_key(points[:, :-1])[at])
        out.logp.append(np.log(np.array([p[n][g] for g in names], np.float64))[at].astype(np.float32))
        contexts = list({g[:-1] for g in names})
        k = _key(_points(contexts, n - 1))
        at = np.argsort(k)
        out.back_keys.append(k[at])
        out.back.append(np.log(np.array([back[n - 1][h] for h in contexts], np.float64))[at].astype(np.float32))
    return out


def renormalised(kept: set[str], p: dict[str, float], lower: Callable[[str], float]) -> dict[str, float]:
    """Back-off weights of contexts of which only ``kept`` grams stay: what these leave of the whole, over what they leave of the lower order, so that a context's probabilities sum to one again."""
    mass, below = Counter(), Counter()
    for g in kept:
        mass[g[:-1]] += p[g]
        below[g[:-1]] += lower(g)
    # the lowest order is one chance for each character and may be shared out more than once
    return {h: max(1e-9, 1 - mass[h]) / (1 - below[h] if below[h] < 0.999 else 1.0) for h in mass}


def _lower(p: list[dict], back: list[dict], gram: str, n: int) -> float:
    weight = 1.0
    while n and gram not in p[n]:
        weight *= back[n - 1].get(gram[:-1], 1.0)
        gram, n = gram[1:], n - 1
    return weight * p[n][gram if n else ""]


def merged(models: list[Fitted], setting: Training, unknown: float) -> Group:
    """The models of some languages side by side: what a language lacks gets its back-off, so a search finds all languages at once."""
    width = len(models)
    group = Group([np.zeros(0, np.uint64)], [np.zeros((0, width), np.float32)], [], [], width)
    for n in range(1, setting.order + 1):
        contexts = np.unique(np.concatenate([m.back_keys[n - 1] for m in models]))
        back = np.zeros((len(contexts), width), np.float32)
        for k, m in enumerate(models):
            back[np.searchsorted(contexts, m.back_keys[n - 1]), k] = m.back[n - 1]
        keys, first = np.unique(np.concatenate([m.keys[n] for m in models]), return_index=True)
        suffix, context = (np.concatenate([getattr(m, name)[n] for m in models])[first] for name in ("suffix", "context"))
        logp = np.full((len(keys), width), unknown, np.float32)
        if n > 1:
            at, ok = _found(group.keys[n - 1], suffix)
            logp[ok] = group.logp[n - 1][at[ok]]
        at, ok = _found(contexts, context)
        logp[ok] += back[at[ok]]
        for k, m in enumerate(models):
            logp[np.searchsorted(keys, m.keys[n]), k] = m.logp[n]
        group.keys.append(keys)
        group.logp.append(logp)
        group.back_keys.append(contexts)
        group.back.append(back)
    return group


def together(fitted: dict[str, Fitted], setting: Training) -> Models:
    languages, unknown = sorted(fitted), float(-np.log(setting.alphabet))
    groups = [merged([fitted[x] for x in languages[i : i + setting.group]], setting, unknown) for i in range(0, len(languages), setting.group)]
    return Models(languages, setting.order, groups, unknown)


def train(samples: dict[str, list[str]], setting: Training = Training()) -> Models:
    """Models from texts by language, here and now: for samples at hand.  A language without a letter isn't learned."""
    part, fitted, held = setting.calibration_part, {}, []
    for lang, texts in samples.items():
        some = len(texts) >= 2 * part
        words, times = word_counts(tb.texts_of(pa.array([t for i, t in enumerate(texts) if i % part or not some], pa.string())))
        if not words:
            continue
        fitted[lang] = fit(dict(zip(words, times.tolist(), strict=True)), setting)
        held += [(lang, t) for i, t in enumerate(texts) if not (i % part and some)]
    models = together(fitted, setting)
    _calibrate(models, _fits(models, [x for x, _ in held], tb.texts_of(pa.array([t for _, t in held], pa.string()))), setting)
    return models


def _points(grams: list[str], n: int) -> np.ndarray:
    points = np.array([], np.uint32) if not n else np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32)
    return points.reshape(len(grams), n)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _score_points(group: Group, order: int, unknown: float, points: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log-probability per language of each point given those before it in its word; the first edge is given."""
    out = np.zeros((len(points), group.width), np.float32)
    at = np.flatnonzero(place > 0)
    n = np.minimum(place[at] + 1, order)
    for k in range(order, 0, -1):
        here = at[n >= k]
        if not len(here):
            continue
        window = _window(points, here, k)
        row, ok = _found(group.keys[k], _key(window))
        out[here[ok]] += group.logp[k][row[ok]]
        rest = here[~ok]
        if len(rest):
            row, ok2 = _found(group.back_keys[k - 1], _key(window[~ok, :-1]))
            out[rest[ok2]] += group.back[k - 1][row[ok2]]
        keep = np.ones(len(at), bool)
        keep[np.flatnonzero(n >= k)[ok]] = False
        at, n = at[keep], n[keep]
    out[at] += unknown
    return out


def cross_entropies(models: Models, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: cross-entropy per character in each language (nan without letters), and its characters."""
    w = tb.words(pc.utf8_lower(texts), NOT_LETTERS)
    n, size = len(texts), len(w.vocabulary)
    if not len(w.code) or not models.languages:
        return np.full((n, len(models.languages)), np.nan), np.zeros(n, np.int64)
    chars = pc.utf8_length(w.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    length = np.bincount(w.row, weights=chars[w.code], minlength=n)
    total = np.zeros((n, len(models.languages)))
    step = max(256, BLOCK_CELLS // (16 * max(g.width for g in models.groups)))
    column = 0
    for group in models.groups:
        by_word = np.empty((size, group.width), np.float32)
        for start in range(0, size, step):
            points, _, place = _ngrams(w.vocabulary.slice(start, step))
            by_word[start : start + step] = np.add.reduceat(_score_points(group, models.order, models.unknown, points, place), np.flatnonzero(place == 0), axis=0)
        for k in range(group.width):
            total[:, column + k] = np.bincount(w.row, weights=by_word[w.code, k], minlength=n)
        column += group.width
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length[:, None] > 0, -total / length[:, None], np.nan), length.astype(np.int64)


SCALES = (1, 2, 4, 8, 16, 32)


def _fits(models: Models, truth: list[str], texts: pa.LargeStringArray) -> pa.Table:
    """Of each labelled text with letters: the cross-entropy in its language (``own``), and the log-likelihood of that at each of ``SCALES``."""
    entropy, length = cross_entropies(models, texts)
    known = length > 0
    entropy = entropy[known]
    at = np.searchsorted(np.array(models.languages, dtype=object), np.array(truth, dtype=object)[known]) if known.any() else np.zeros(0, np.int64)
    own = entropy[np.arange(len(entropy)), at]
    columns = {"own": own}
    for scale in SCALES:
        z = -scale * entropy
        z -= z.max(axis=1, keepdims=True) if z.size else 0
        columns[f"s{scale}"] = z[np.arange(len(z)), at] - np.log(np.exp(z).sum(axis=1))
    return pa.table(columns)


def _calibrate(models: Models, fits: pa.Table, setting: Training) -> None:
    """Temperature by likelihood over a grid, and the cross-entropy beyond which a text is rejected."""
    if not len(fits):
        return
    means = {scale: fits.column(f"s{scale}").to_numpy().mean() for scale in SCALES}
    models.scale = float(max(SCALES, key=lambda scale: (round(means[scale], 9), -scale)))
    own = fits.column("own").to_numpy()
    # robust spread: a few odd texts in the sample must not widen it, nor a narrow sample make it tight
    centre = float(np.median(own))
    spread = max(0.05, 1.4826 * float(np.median(np.abs(own - centre))))
    models.reject_above = max(centre + setting.reject_sigmas * spread, float(np.quantile(own, 0.999)) + 2 * spread)


def predict(models: Models, texts: pa.LargeStringArray, null: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    entropy, length = cross_entropies(models, texts)
    letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    known = letters & ~null & (length > 0) & bool(models.languages)
    out = np.full(len(texts), UNDETERMINED, dtype=object)
    score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
    if known.any():
        e = entropy[known]
        best = e.argmin(axis=1)
        z = np.exp(-(e - e.min(axis=1, keepdims=True)) * models.scale)
        out[known] = np.array(models.languages, dtype=object)[best]
        score[known] = 1 / z.sum(axis=1)
        # a short text's mean varies more
        rejected[known] = e.min(axis=1) > models.reject_above + 4 / np.sqrt(length[known])
    return out.tolist(), score, rejected


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that training must not see: crc32 of the id as text, modulo ``folds``, is 0 (null id: of no text, 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == 0


FITTED = "lang string, n int, keys array<long>, suffix array<long>, context array<long>, logp array<float>, back_keys array<long>, back array<float>"


def learn(docs: DataFrame, setting: Training = Training(), folds: int = 5) -> Models:
    """Models from ``text`` and ``lang`` of the rows that aren't held out; every ``lang`` value is learned.

    Of each language about ``docs_per_language`` documents are drawn by a hash of their id, whole.  Their words are counted and each
    language's model is fitted in a task; the driver gets finished models, at most some ten MB a language, and a few numbers of each calibration text."""
    spark = docs.sparkSession
    rows = docs.where(~held_out(F.col("doc_id"), folds) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = written(rows.groupBy("lang").agg(F.least(F.lit(1.0), setting.docs_per_language / F.count("*")).alias("share")), "languages")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    side = F.broadcast(shares) if shares.count() <= BROADCAST_LANGUAGES else shares
    drawn = rows.withColumn("draw", draw).join(side, "lang").where("draw < share").select("lang", "draw", "text")
    by = Window.partitionBy("lang")
    numbered = drawn.withColumn("i", F.row_number().over(by.orderBy("draw", "text"))).withColumn("all", F.count("*").over(by) < 2 * setting.calibration_part)
    calibrates = F.col("all") | (F.col("i") % setting.calibration_part == 1)
    sample = written(numbered.select("lang", "text", calibrates.alias("held"), (F.col("all") | ~calibrates).alias("fits")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, times = word_counts(tb.texts_of(pa.array([text.as_py()], pa.string())))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(times.astype(np.int64))], ["lang", "word", "times"])

    def one(table: pa.Table) -> pa.Table:
        model = fit(dict(zip(table.column("word").to_pylist(), table.column("times").to_pylist(), strict=True)), setting)
        signed = lambda arrays: pa.array([a.view(np.int64) for a in arrays], pa.list_(pa.int64()))
        floats = lambda arrays: pa.array(list(arrays), pa.list_(pa.float32()))
        n = setting.order
        return pa.table(
            [pa.array([table.column("lang")[0].as_py()] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), signed(model.keys[1:]), signed(model.suffix[1:]), signed(model.context[1:]), floats(model.logp[1:]), signed(model.back_keys), floats(model.back)],
            names=["lang", "n", "keys", "suffix", "context", "logp", "back_keys", "back"],
        )

    words = sample.where("fits").select("lang", "text").mapInArrow(count, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    found = words.groupBy("lang").applyInArrow(one, FITTED).toArrow()
    fitted: dict[str, Fitted] = {}
    for r in sorted(range(len(found)), key=lambda r: found.column("n")[r].as_py()):
        get = lambda name, kind, r=r: found.column(name)[r].values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
        hashes = lambda name, r=r: found.column(name)[r].values.to_numpy(zero_copy_only=False).view(np.uint64)
        empty = np.zeros(0, np.uint64)
        model = fitted.setdefault(found.column("lang")[r].as_py(), Fitted([empty], [empty], [empty], [np.zeros(0, np.float32)], [], []))
        model.keys.append(hashes("keys"))
        model.suffix.append(hashes("suffix"))
        model.context.append(hashes("context"))
        model.logp.append(get("logp", np.float32))
        model.back_keys.append(hashes("back_keys"))
        model.back.append(get("back", np.float32))
    models = together(fitted, setting)
    if not models.languages:
        return models
    sent = spark.sparkContext.broadcast(models)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.texts_of(batch.column(1))
            for part in tb.slices(texts):
                truth = batch.column(0)[part.start : part.stop].to_pylist()
                here = [i for i, x in enumerate(truth) if x in sent.value.languages]
                yield from _fits(sent.value, [truth[i] for i in here], texts[part.start : part.stop].take(pa.array(here, pa.int64()))).to_batches()

    schema = ", ".join(["own double", *(f"s{scale} double" for scale in SCALES)])
    _calibrate(models, sample.where("held").select("lang", "text").mapInArrow(fits, schema).toArrow(), setting)
    sent.destroy()
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every whole text, one row per row.

    A null text, or one without a letter, is ``und`` with score 0 and rejected.  Without any labelled row all
    are ``und``.  Of equally likely languages the first in code-point order is given.  Repeated rows and a null ``doc_id`` pass through; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            texts = tb.texts_of(batch.column(1))
            for part in tb.slices(texts):
                lang, score, rejected = predict(sent.value, texts[part.start : part.stop], null[part])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of ``docs`` whose language is found, with ``lang`` set to it; rejected rows go."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            texts = tb.texts_of(batch.column(at))
            for part in tb.slices(texts):
                lang, _, rejected = predict(sent.value, texts[part.start : part.stop], null[part])
                rows = batch.slice(part.start, part.stop - part.start)
                rows = rows.set_column(lang_at, rows.schema.field(lang_at), pa.array(lang, pa.string()).cast(rows.schema.field(lang_at).type))
                yield rows.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
