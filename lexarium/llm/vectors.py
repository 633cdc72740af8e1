"""What the operators on vectors share: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` entries, none of them null, NaN or infinite."""
    good = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, good), F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, of equals the greater; 0 without vectors. One small row per length is gathered."""
    sizes = rows.select(F.size(vector).alias("n")).where("n > 0").groupBy("n").agg(F.count("*").alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return first["n"] if first else 0


def floats(column: Column, kind: T.DataType) -> Column:
    """A vector column as an array of floats or doubles, whichever it is; other numbers become doubles."""
    return column if kind.simpleString() in ("array<float>", "array<double>") else column.cast("array<double>")


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size)


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow column of lists."""
    n, size = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.array(np.ascontiguousarray(rows).ravel()))
