"""Arrow helpers: texts of a batch as flat word arrays, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text in one slice; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def free(name: str, columns: list[str]) -> str:
    """A column name that isn't among ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column) -> pa.LargeStringArray:
    """A column as one large-string array, null as the empty text. Large offsets: a split may outgrow 2 GB."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.LargeStringArray, limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Row ranges whose texts have at most ``limit`` bytes together, or that are one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n, base = 0, len(texts), 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield slice(start, stop)
        base = int(ends[stop - 1])
        start = stop


@dataclass
class Words:
    """Words of some texts: ``row`` has the text of each word, ``code`` its place in ``vocabulary``."""

    n_rows: int
    row: np.ndarray
    code: np.ndarray
    vocabulary: pa.LargeStringArray

    @property
    def bounds(self) -> np.ndarray:
        """``bounds[i]:bounds[i + 1]`` are the words of text ``i``."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))


def split(texts: pa.LargeStringArray, pattern: str = SPACES) -> tuple[np.ndarray, pa.LargeStringArray]:
    """The nonempty pieces between matches of ``pattern``, with the row of each."""
    pieces = pc.split_pattern_regex(texts, pattern)
    flat, row = pieces.flatten(), pc.list_parent_indices(pieces)
    some = pc.greater(pc.binary_length(flat), 0)
    return row.filter(some).to_numpy(zero_copy_only=False).astype(np.int64), flat.filter(some)


def words(texts: pa.LargeStringArray, pattern: str = SPACES) -> Words:
    row, flat = split(texts, pattern)
    coded = flat.dictionary_encode()
    return Words(len(texts), row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def lower_ascii(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """A-Z to a-z and nothing else: the texts' bytes are changed in place of a copy."""
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    if data is None or not data.size:
        return texts
    raw = np.frombuffer(data, dtype=np.uint8).copy()
    raw[(raw >= 65) & (raw <= 90)] |= 32
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(raw), offset=texts.offset)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash64(strings: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of strings (SipHash with pandas' fixed key)."""
    import pandas as pd

    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False)
