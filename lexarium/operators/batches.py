"""Arrow batches by parts, so that what a task makes of them stays small however wide their rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a part; one longer text is a part of its own.
PART_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices whose texts in ``column`` have at most ``most`` bytes together."""
    most = most or PART_BYTES
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, side="right")))
            yield batch.slice(a, b - a)
            a = b
