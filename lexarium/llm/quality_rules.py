"""Quality rules over repetition, from suffix arrays of words.

For every document the suffix array of its words is built by prefix doubling (many documents at once, so the work is in numpy sorts), and from it the common prefixes of neighbouring suffixes, in the order of
the text.  A common prefix that the word before would lengthen is one less than its predecessor's; only the others are compared word by word, which is linear work but for a logarithm.  The larger common
prefix of a suffix with its two neighbours is the value of the deepest interval it lies in: the longest maximal repeat that begins there.  The union of these spans gives the share of words
that lie in a repeat, and the longest repeat is the largest common prefix.  Documents never meet: a repeat counts within one text.

All of it is linear in memory: a handful of whole numbers a word, however long and repetitive a text is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textbatch as tb


@dataclass(frozen=True)
class Limits:
    """A document fails if it has fewer words than ``min_words``; if words in repeated windows of ``window``
    words are over ``max_window_percent``; if maximal repeats of at least ``repeat_words`` words cover over
    ``max_repeat_percent``; or if one repeat has ``longest_repeat`` words or more."""

    min_words: int = 50
    window: int = 3
    max_window_percent: int = 50
    repeat_words: int = 6
    max_repeat_percent: int = 40
    longest_repeat: int = 60


FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("n_long_repeat_words", pa.int64()),
    ("longest_repeat", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
]
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_long_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"


#: Words that all pairs are compared by together; what is equal beyond is compared pair by pair, in growing stretches.
TOGETHER = 48


def suffix_array(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes of their rows; rows in order, a suffix before those it begins."""
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.searchsorted(row, row, side="right")  # first position after the row
    count, rank = _group_starts(row, code)
    # a very long text is one slice: big temporaries go as soon as they are used
    active, width = np.flatnonzero(count > 1), 1
    del count
    while len(active):
        key = rank[active] * (n + 2)
        step = active + width
        inside = step < end[active]
        key[inside] += rank[step[inside]] + 1
        del step, inside
        order = np.argsort(key)
        active, key = active[order], key[order]
        del order
        new_group = np.ones(len(key), bool)
        new_group[1:] = key[1:] != key[:-1]
        key //= n + 2
        new_rank = np.ones(len(key), bool)
        new_rank[1:] = key[1:] != key[:-1]
        at = np.arange(len(key))
        key += np.maximum.accumulate(np.where(new_group, at, 0))
        key -= np.maximum.accumulate(np.where(new_rank, at, 0))
        rank[active] = key
        del at, key, new_rank
        sizes = np.diff(np.append(np.flatnonzero(new_group), len(new_group)))
        active = active[np.repeat(sizes > 1, sizes)]
        width *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


def longest_repeats(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each word position, the length in words of the longest substring that starts there and occurs
    elsewhere in the same row: the larger common prefix with the two neighbours in the suffix array."""
    n = len(code)
    if n == 0:
        return np.zeros(0, np.int64)
    suffixes = suffix_array(row, code)
    before = np.full(n, -1, np.int64)  # the suffix that stands before, in the same row
    same = row[suffixes[1:]] == row[suffixes[:-1]]
    before[suffixes[1:][same]] = suffixes[:-1][same]
    del suffixes, same
    # where the words before differ the common prefix can't be told from that of the position before
    alone = np.ones(n, bool)
    p = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    q = before[p]
    alone[p] = (row[p - 1] != row[p]) | (row[q - 1] != row[q]) | (code[p - 1] != code[q - 1])
    del p, q
    start = np.flatnonzero(alone & (before >= 0))
    common = np.zeros(n, np.int64)
    common[start] = _common(code, np.searchsorted(row, row[start], side="right"), start, before[start])
    last = np.maximum.accumulate(np.where(alone, np.arange(n), 0))
    common = common[last] - (np.arange(n) - last)
    del last, alone
    best = common.copy()
    after = np.flatnonzero(before >= 0)
    best[before[after]] = np.maximum(best[before[after]], common[after])
    return best


def _common(code: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of suffixes of one row, which ends at ``end``."""
    length, most = np.zeros(len(a), np.int64), end - np.maximum(a, b)
    left = np.arange(len(a))
    for k in range(TOGETHER):
        left = left[most[left] > k]
        left = left[code[a[left] + k] == code[b[left] + k]]
        length[left] += 1
        if not len(left):
            break
    for i in left.tolist():
        x, y, k, stop, step = int(a[i]), int(b[i]), TOGETHER, int(most[i]), 256
        while k < stop:
            size = min(step, stop - k)
            other = code[x + k : x + k + size] != code[y + k : y + k + size]
            first = int(other.argmax())
            if other[first]:
                k += first
                break
            k, step = k + size, min(2 * step, 1 << 20)
        length[i] = k
    return length


def _group_starts(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of the group of equal (row, code) that a position is in, and where that group starts when sorted."""
    key = row * (int(code.max()) + 1) + code
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.cumsum(counts) - counts
    return counts[inverse], starts[inverse]


def covered(row: np.ndarray, repeats: np.ndarray, least: int, n_rows: int) -> np.ndarray:
    """Words per row in the union of the repeats of at least ``least`` words."""
    n = len(repeats)
    at = np.flatnonzero(repeats >= least)
    change = np.bincount(at, minlength=n + 1).astype(np.int64) - np.bincount(at + repeats[at], minlength=n + 1)
    return np.bincount(row, weights=np.cumsum(change[:n]) > 0, minlength=n_rows).astype(np.int64)


def measure(texts: pa.LargeStringArray, limits: Limits = Limits()) -> pa.RecordBatch:
    """The rule columns for some texts."""
    n = len(texts)
    w = tb.words(texts)
    n_words = np.bincount(w.row, minlength=n).astype(np.int64)
    chars = pc.utf8_length(w.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    word_chars = np.bincount(w.row, weights=chars[w.code], minlength=n).astype(np.int64)
    symbols = pc.count_substring_regex(texts, pattern=r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)

    lines = pc.split_pattern(texts, "\n")
    flat, line_row = lines.flatten(), pc.list_parent_indices(lines)
    some = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]")
    flat, line_row = flat.filter(some), line_row.filter(some).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(line_row * (len(flat) + 1) + coded) // (len(flat) + 1)
    dup_lines = np.bincount(line_row, minlength=n) - np.bincount(distinct, minlength=n)

    repeats = longest_repeats(w.row, w.code)
    in_windows = covered(w.row, repeats, limits.window, n)
    in_long = covered(w.row, repeats, limits.repeat_words, n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.row, repeats)
    failed = (n_words < limits.min_words) | (100 * in_windows > limits.max_window_percent * n_words)
    kept = ~failed & (100 * in_long <= limits.max_repeat_percent * n_words) & (longest < limits.longest_repeat)
    values = [n_words, word_chars, symbols, dup_lines.astype(np.int64), in_windows, in_long, longest, failed, kept]
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, FIELDS, strict=True)], [name for name, _ in FIELDS])


def assess(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id`` with the rule columns of every whole text.

    A null or empty text has no words: all counts are 0, it fails.  A null ``doc_id`` and repeated rows pass
    through, one row each; other columns are ignored; an empty table gives an empty result.  A task holds
    slices of at most 2 MB of text, or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.texts_of(batch.column(1))
            for part in tb.slices(texts):
                got = measure(texts[part.start : part.stop], limits)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], *got.columns], ["doc_id", *got.schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {DDL}")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns: a filter inside one pass over the
    texts, so nothing is shuffled or joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.texts_of(batch.column(at))
            for part in tb.slices(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                yield rows.filter(measure(texts[part.start : part.stop], limits).column("kept"))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
