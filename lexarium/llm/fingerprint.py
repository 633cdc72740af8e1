"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases: the shortest string not parsed before, from where the last phrase ended
(the incremental parsing of 1978).  The set of phrases is hashed and its smallest hashes are the fingerprint.  The
likeness of two fingerprints is the share of common hashes among the smallest of their union, an estimate of
the Jaccard likeness of phrase sets, which follows compression distance (Raff and Nicholas, 2017).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hashes of a fingerprint; the standard error of a likeness of 0.5 is 0.044.
SIZE = 128
#: Rows of one range of ids; a range's texts are read by one task, one after another.
ROWS_PER_RANGE = 4096
#: Bound on the ranges, whose first keys are broadcast (1.7 MB), and keys sampled for each range to find them (at most 54 MB to the driver).
MOST_RANGES, SAMPLED = 100_000, 32
#: Bytes of a key: whether there is an id, the id, a hash of the text; as bytes they sort in this order.
KEY = 17


def phrases(text: str, known: set[str] | None = None) -> list[str]:
    """New phrases in order. ``known``: phrases parsed before; it is added to."""
    known = set() if known is None else known
    add, out, phrase = known.add, [], ""
    for c in text:
        phrase += c
        if phrase not in known:
            add(phrase)
            out.append(phrase)
            phrase = ""
    return out


def _hashes(found: list[str]) -> np.ndarray:
    """Sorted distinct 32-bit hashes."""
    import pandas as pd

    if not found:
        return np.zeros(0, np.uint32)
    return (pd.util.hash_array(np.array(found, dtype=object), categorize=False) >> np.uint64(32)).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The ``SIZE`` smallest distinct hashes, sorted."""
    if len(hashes) > 4 * SIZE:
        hashes = np.partition(hashes, 2 * SIZE)[: 2 * SIZE + 1]  # equal hashes are rare: enough are distinct
    return np.unique(hashes)[:SIZE]


def text_of(sig: np.ndarray) -> str:
    """Hex of the hashes, eight digits each; empty for a text without phrases."""
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the phrase sets; 1 for two empty sets."""
    union = np.union1d(a, b)[:SIZE]
    if not len(union):
        return 1.0
    return float(len(np.intersect1d(np.intersect1d(a, b), union)) / len(union))


def both(text: str, keep: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``text`` and of its first ``keep`` characters followed by ``tail``: the common part is parsed once."""
    known: set[str] = set()
    add, out, phrase = known.add, [], ""
    for c in text[:keep]:
        phrase += c
        if phrase not in known:
            add(phrase)
            out.append(phrase)
            phrase = ""
    shared = _hashes(out)
    first = _hashes(phrases(phrase + text[keep:], known))
    second = _hashes(phrases(phrase + tail, set(out)))
    # an unfinished phrase at the cut is a known one, so parsing it again from its start changes nothing
    return signature(np.concatenate([shared, first])), signature(np.concatenate([shared, second]))


def keys_of(batch: pa.RecordBatch) -> np.ndarray:
    """Keys of rows (``doc_id, text``): null ids first, then by id, equal ids by a hash of their texts. So many rows of one id are many keys."""
    import xxhash

    null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
    ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    texts = np.fromiter((xxhash.xxh3_64_intdigest(t.as_py() or "") for t in batch.column(1)), np.uint64, len(ids))
    raw = np.zeros((len(ids), KEY), np.uint8)
    raw[:, 0] = ~null
    raw[:, 1:9] = (ids.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    raw[:, 9:] = texts.astype(">u8").view(np.uint8).reshape(-1, 8)
    return raw.reshape(-1).view(f"S{KEY}")


def _starts(docs: DataFrame) -> np.ndarray:
    """First keys of ranges of about ``ROWS_PER_RANGE`` rows, the smallest key of all first; at most ``MOST_RANGES``."""
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_PER_RANGE))
    share = min(1.0, SAMPLED * ranges / max(n, 1)) if ranges > 1 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for batch in batches:
            if batch.num_rows:
                keys = keys_of(batch)
                least = min(*keys.tolist(), least) if least is not None else min(keys.tolist())
                drawn = np.array([zlib.crc32(k) < share * 2**32 for k in keys.tolist()], bool)
                yield pa.RecordBatch.from_arrays([pa.array([k.ljust(KEY, b"\0") for k in keys[drawn].tolist()], pa.binary()), pa.array(np.zeros(drawn.sum(), bool))], ["key", "least"])
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([bytes(least).ljust(KEY, b"\0")], pa.binary()), pa.array([True])], ["key", "least"])

    got = docs.mapInArrow(run, "key binary, least boolean").toArrow()
    column = got.column("key").combine_chunks()
    if not len(column):
        return np.zeros(0, f"S{KEY}")
    keys = np.frombuffer(column.buffers()[2], f"S{KEY}", len(column), column.offset * KEY)  # all of one length, one after another
    drawn = np.sort(keys[~got.column("least").to_numpy()])
    cuts = drawn[[i * len(drawn) // ranges for i in range(1, ranges)]] if len(drawn) else drawn
    return np.unique(np.append(cuts, np.sort(keys)[:1]))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Every whole text against its edited text and its successor.

    Of each row, the last floor(n/4) code points give way to the first as many of the next row by ascending ``doc_id``
    (after the last row: the first).  Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    ``doc_id`` is a whole number.  Null ids come first, equal ids are ordered by a hash of their texts; a null text is empty, and two
    empty texts are alike (1); other columns are ignored; an empty table gives an empty result; a single row is its own
    successor.  Texts are shuffled once, into ranges of (id, hash of the text), so rows of one id, or without any, are many ranges' work; rows
    equal in both are one range's, where each text is parsed once.  The first row of each range goes to the range before as well,
    and the first of all to the last, so that every row meets its successor in one task, however texts are dealt."""
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(_starts(docs))
    n = max(1, len(sent.value))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, copied = sent.value, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = keys_of(batch)
            at = np.maximum(np.searchsorted(bounds, keys, side="right") - 1, 0)
            key = [k.ljust(KEY, b"\0") for k in keys.tolist()]
            start = [i for i in np.flatnonzero(bounds[at] == keys).tolist() if at[i] not in copied and not copied.add(at[i])]
            for rows, to, extra in ((range(len(at)), at, False), (start, (at[start] - 1) % n, True)):
                if len(rows):
                    got = batch.take(pa.array(rows, pa.int64())) if extra else batch
                    columns = [pa.array(to, pa.int32()), pa.array(np.full(len(rows), extra)), pa.array([key[i] for i in rows], pa.binary()), *got.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["to", "extra", "key", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.mapInArrow(deal, f"to int, extra boolean, key binary, doc_id {kind}, text string")
    # a range is a task: by hash several would meet in one. Its own rows come before the copies, whose keys may be the smallest of all
    dealt = dealt.repartitionById(n, "to").sortWithinPartitions("to", "extra", "key")
    return dealt.drop("key").mapInArrow(_walk, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out: list[tuple] = []
    last = None  # (to, id, text): waits for its successor
    pending = None  # (row without near_next, signature): waits for the successor's signature
    same = None  # the last pair of text and tail, and their signatures
    id_type = pa.int64()

    def done() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        out.clear()
        return got

    for batch in batches:
        id_type = batch.schema.field(2).type
        for to, extra, name, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            to, extra, name, text = to.as_py(), extra.as_py(), name.as_py(), text.as_py() or ""
            if last is not None and last[0] == to:
                keep = len(last[2]) - len(last[2]) // 4
                tail = text[: len(last[2]) // 4]
                if same is None or same[0] != (last[2], tail):  # rows of one id and text are parsed once
                    same = ((last[2], tail), both(last[2], keep, tail))
                own, edited = same[1]
                if pending is not None:
                    out.append((*pending[0], likeness(pending[1], own)))
                sha = hashlib.sha256((last[2][:keep] + tail).encode("utf-8")).hexdigest()
                row = (last[1], len(last[2]), sha, text_of(own), text_of(edited), likeness(own, edited))
                if extra:
                    # the range ends here: the copy is only a successor
                    out.append((*row, likeness(own, signature(_hashes(phrases(text))))))
                    last = pending = None
                    continue
                pending = (row, own)
            elif last is not None:
                raise RuntimeError(f"range {last[0]} has no successor")
            elif extra:
                continue  # further rows of the successor's id
            last = (to, name, text)
        if len(out) >= 256:
            yield done()
    if out:
        yield done()
