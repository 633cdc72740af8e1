"""Whitening of embeddings: principal components by matrix-free block Lanczos.

The covariance is never formed.  A pass over the distributed rows multiplies it with a block of vectors: each task centres its rows, takes
its part of ``X'(X Q)``, and the parts are summed by Spark.  The Krylov basis is small and stays on the driver; each new block is made orthogonal to all of it, twice.
A block that loses rank (an invariant subspace is found) starts again from random directions outside the basis.  Iteration ends when the residuals of the wanted pairs are
rounding, or when the basis spans the space.

The total variance isn't a sum of eigenvalues: it is that of the rows' exact squared deviations, so explained shares need the leading components only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as vs
from .durable import written

#: Grid entries are below this in size: sums and products with a few rows stay exact, or are made of Python's whole numbers.
MOST = float(1 << 62)


@dataclass(frozen=True)
class Setting:
    components: int = 4
    scale: int = 256  # entries become floor(scale * entry)
    block: int = 8  # vectors multiplied in one pass
    basis: int = 256  # vectors; a longer basis starts again from its best ones
    residual: float = 1e-14  # of a component, as a share of the largest eigenvalue
    passes: int = 500
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``sums`` are exact whole numbers; ``components`` has a unit vector a row; ``passes`` tells how many products were taken, ``residuals`` what was left."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int
    residuals: np.ndarray
    setting: Setting

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def grid(rows: DataFrame, vector: str, setting: Setting) -> Column | None:
    """The column of whole numbers that a vector becomes, null for a row that goes: its vector is null, holds null or non-finite entries or one without a 64-bit
    number, or has another length than most."""
    size = vs.dimension(rows, vector)
    if not size:
        return None
    scaled = F.transform(F.col(vector), lambda c: c.cast("double") * setting.scale)
    fits = vs.finite(F.col(vector), size) & F.coalesce(F.forall(scaled, lambda c: F.abs(c) < MOST), F.lit(False))
    return F.when(fits, F.transform(scaled, lambda c: F.floor(c).cast("long")))


def _longs(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray | list], size: int, kind: str = "double") -> list:
    """The sum over all tasks of what ``part`` gives for their rows, entry by entry: tasks send one row of numbers each, Spark adds them up."""
    arrow = pa.float64() if kind == "double" else pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(_longs(batch.column(0), size))
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)] if isinstance(got, list) else total + got
        if total is not None:
            values = total.ravel() if isinstance(total, np.ndarray) else [Decimal(v) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values, arrow)], ["at", "value"])

    sums = rows.select("x").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    found = sums.collect()  # as many rows as the product has entries
    return [r["value"] for r in sorted(found, key=lambda r: r["at"])]


def _wide_sum(x: np.ndarray) -> list[int]:
    """Exact column sums of 64-bit numbers, as Python's."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int] | np.ndarray:
    """Sum over dimensions of ``(n x - S)^2``, exact: 64-bit numbers where the largest possible fits, else Python's."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 1 << 63:
        gap = x * n - np.array(sums, np.int64)
        return (gap * gap).sum(1)
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, room: int, fresh: float) -> np.ndarray:
    """Up to ``room`` orthonormal columns: those of ``block`` outside ``basis``; columns with nothing left start again at random."""
    out = basis
    for column in block.T[:room]:
        size = np.linalg.norm(column)
        for attempt in range(8):
            v = column if attempt == 0 else rng.standard_normal(len(column))
            before = size if attempt == 0 else np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > (fresh if attempt == 0 else 1e-8 * before):
                out = np.column_stack([out, v / left])
                break
    return out[:, basis.shape[1] :]


def lanczos(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, setting: Setting = Setting()) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenpairs of a symmetric operator known by its products with blocks: values, vectors (columns), residuals, passes."""
    rng, wanted = np.random.default_rng(setting.seed), min(wanted, size)
    most = max(setting.basis, 4 * wanted + 2 * setting.block)
    block = _orthogonal(rng.standard_normal((size, min(size, max(setting.block, wanted)))), np.zeros((size, 0)), rng, size, 0.0)
    basis, images, best, stale = np.zeros((size, 0)), np.zeros((size, 0)), np.inf, 0
    for passes in range(1, setting.passes + 1):
        image = product(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        ritz, top = basis @ inner[:, :wanted], values[:wanted]
        scale = max(float(np.abs(values).max()), np.finfo(float).tiny)
        residuals = np.linalg.norm(images @ inner[:, :wanted] - ritz * top, axis=0) / scale
        worst = float(residuals.max()) if basis.shape[1] >= wanted else np.inf
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        # the space is spent, the residuals are rounding, or they were nearly and no longer fall
        if basis.shape[1] >= size or worst <= setting.residual or worst < 1e3 * setting.residual and stale >= 3:
            break
        # outside the whole basis, also where only its best part goes on
        block = _orthogonal(image, basis, rng, size - basis.shape[1], 1e-12 * scale)
        if basis.shape[1] + block.shape[1] > most:
            keep = most // 2
            basis, images = basis @ inner[:, :keep], images @ inner[:, :keep]
    return top, ritz, residuals, passes


def fit(rows: DataFrame, vector: str = "embedding", setting: Setting = Setting()) -> Model | None:
    """The components of the distinct grid vectors of a table; none where no row is left.

    Components without variance (less than 1e-11 of the first's) can't be whitened and are left out, so there may be fewer than asked for."""
    x = grid(rows, vector, setting)
    if x is None:
        return None
    once = written(rows.select(x.alias("x")).where("x IS NOT NULL").distinct(), "whitening")
    first = once.first()
    if first is None:
        return None
    size = len(first["x"])
    found = [int(v) for v in _summed(once, lambda x: [len(x), *_wide_sum(x)], size, "decimal(38,0)")]
    n, sums = found[0], found[1:]
    mean = np.array([s / n for s in sums])
    squared = sum(int(v) for v in _summed(once, lambda x: [_total(deviations(x, n, sums))], size, "decimal(38,0)"))
    trace = squared / n**3

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return np.array(_summed(once, part, size)).reshape(size, -1) / n

    if not squared:
        none = np.zeros(0)
        return Model(n, sums, np.zeros((0, size)), none, 0.0, 0.0, 0, none, setting)
    values, columns, residuals, passes = lanczos(product, size, setting.components, setting)
    kept = values > 1e-11 * values[0]
    values, columns, residuals = values[kept], columns[:, kept] / np.linalg.norm(columns[:, kept], axis=0), residuals[kept]

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ columns / np.sqrt(values)
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    k = len(values)
    got = np.array(_summed(once, moments, size)) / n
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    return Model(n, sums, columns.T, values, trace, error, passes, residuals, setting)


def _total(values: list[int] | np.ndarray) -> int:
    return sum(values) if isinstance(values, list) else _wide_sum(values[:, None])[0]


def whiten(rows: DataFrame, model: Model | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row that has a grid vector, for every component of the model.

    Repeated rows give rows each, a null id stays null; other columns are ignored.  A deviation that outgrows 64 bits is null.  Without rows to fit on, or where all vectors are
    the same, there are no components and so no rows."""
    kind = rows.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], T.StructType.fromDDL(shape))
    size, k = model.components.shape[1], len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, root = model.mean, np.sqrt(model.eigenvalues)
        for batch in batches:
            x, m = _longs(batch.column(1), size), batch.num_rows
            gaps = deviations(x, model.n, model.sums)
            gaps = pa.array([v if v < 1 << 63 else None for v in gaps], pa.int64()) if isinstance(gaps, list) else pa.array(gaps)
            y = (x - mean) @ model.components.T / root
            at = pa.array(np.repeat(np.arange(m), k))
            each = lambda v: pa.array(np.tile(v, m))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(m * k, model.n, np.int64)), gaps.take(at), pa.array(y.ravel()), each(model.eigenvalues / model.trace), pa.array(np.full(m * k, model.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    x = F.col("x")
    left = rows.select(key, grid(rows, vector, model.setting).alias("x")).where(x.isNotNull() & (F.size(x) == size))
    return left.mapInArrow(run, shape)
