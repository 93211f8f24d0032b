"""Matrix work over tables of any width: sums of arrays over tasks, principal components, correlations by tiles.

No task and no driver step holds a number for every pair of columns. Components come from subspace iteration: a thin
matrix with a few columns more than components asked for travels to the rows and back, once for each round. Correlations are
taken tile by tile: a pair of column ranges reads its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.scale import chunks, col

OVERSAMPLE = 10
ROUNDS = 300
TOLERANCE = 1e-11  # change of the ratios that ends the rounds
SETTLED = 3        # rounds in a row within it
BLOCK = 1 << 13    # numbers of an array that travel together
TILE = 512         # columns of a tile
TASKS = 4096       # tasks that return a product each
FLAT = 1e-12       # share of a column's squares below which its variance is rounding


def summed_arrays(parts: DataFrame) -> DataFrame:
    """(key, data): float64 arrays (as bytes) summed by key; a task holds one array for each key it is dealt."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, np.float64)
                if key in held:
                    held[key] += part
                else:
                    held[key] = part.copy()
        for some in chunks(list(held), 64):
            yield pa.record_batch({"key": pa.array(some, pa.int64()), "data": pa.array([held[k].tobytes() for k in some], pa.binary())})

    return parts.repartition("key").mapInArrow(add, "key long, data binary")


def _array_sum(parts: DataFrame, size: int) -> np.ndarray:
    """One array of ``size`` numbers from blocks (key, data)."""
    out = np.zeros(-(-size // BLOCK) * BLOCK)
    for row in summed_arrays(parts).collect():  # ``size`` numbers at most
        out[row["key"] * BLOCK : (row["key"] + 1) * BLOCK] = np.frombuffer(bytes(row["data"]), np.float64)
    return out[:size]


def _blocks(array: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = np.concatenate([array.ravel(), np.zeros(-array.size % BLOCK)])
    for first in range(0, len(flat), 64 * BLOCK):
        some = range(first // BLOCK, min(first // BLOCK + 64, len(flat) // BLOCK))
        yield pa.record_batch({"key": pa.array(list(some), pa.int64()), "data": pa.array([flat[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in some], pa.binary())})


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def component_ratios(rows: DataFrame, column: str, width: int, k: int, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, seed: int = 42) -> list[float]:
    """Shares of the variance of the first ``k`` principal components of an array column without nulls.

    Rounds end when no ratio has changed by more than ``TOLERANCE`` in the last ``SETTLED`` of them. Columns as many as the subspace has are exact in one.
    """
    x = rows.select(col(column).cast("array<double>").alias("x"))
    spark = rows.sparkSession

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            if batch.num_rows:
                total[:width] += _matrix(batch, width).sum(axis=0)
                total[width] += batch.num_rows
        if total[width]:
            yield from _blocks(total)

    few = x.coalesce(TASKS)
    sums = _array_sum(few.mapInArrow(means, "key long, data binary"), width + 1)
    if sums[width] < 2:
        raise ValueError("components need two rows or more")
    size = min(width, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    centre = spark.sparkContext.broadcast(sums[:width] / sums[width])

    def applied(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The scatter matrix times the basis, and its trace."""
        sent = spark.sparkContext.broadcast(basis)

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros(width * size + 1), False
            for batch in batches:
                if batch.num_rows:
                    some = True
                    y = _matrix(batch, width) - centre.value
                    total[:-1] += (y.T @ (y @ sent.value)).ravel()
                    total[-1] += (y * y).sum()
            if some:
                yield from _blocks(total)

        out = _array_sum(few.mapInArrow(product, "key long, data binary"), width * size + 1)
        return out[:-1].reshape(width, size), float(out[-1])

    before, calm = np.full(min(k, size), np.inf), 0
    for _ in range(rounds):
        image, trace = applied(basis)
        if trace <= 0:
            return [0.0] * min(k, size)
        values = np.sort(np.linalg.eigvalsh((basis.T @ image + image.T @ basis) / 2))[::-1][: min(k, size)] / trace
        calm = calm + 1 if np.abs(values - before).max() <= TOLERANCE else 0
        if size == width or calm >= SETTLED:
            break
        before, basis = values, np.linalg.qr(image)[0]
    return [float(max(v, 0.0)) for v in values]


def tiled_corr(values: DataFrame, names: Sequence[str], tile: int = TILE) -> DataFrame:
    """(x, y, corr): pairwise-complete Pearson of all pairs of numeric columns, null where a side doesn't vary.

    A pair of tiles is a scan of its own two column ranges. A task adds up six sums for each pair of their columns, and
    returns them by the row of the tile; its memory follows the tile's size and not the width of the table.
    """
    parts = chunks(list(names), tile)
    ends = {}
    for some in chunks(list(names), 50):
        row = values.agg(*[F.struct(F.avg(col(c)).alias("m"), F.min(col(c)).alias("low"), F.max(col(c)).alias("high")).alias(f"m{i}") for i, c in enumerate(some)]).first()
        ends |= dict(zip(some, row, strict=True))
    # a constant is its own centre to the last bit, so that rounding leaves no variance
    centres = {c: 0.0 if e.m is None else e.low if e.low == e.high else e.m for c, e in ends.items()}
    out = None
    for i, left in enumerate(parts):
        for j, right in enumerate(parts[i:], i):
            found = _tile_pair(values, left, right if j > i else None, centres)
            out = found if out is None else out.unionByName(found)
    return out


def _tile_pair(values: DataFrame, left: Sequence[str], right: Sequence[str] | None, centres: dict[str, float]) -> DataFrame:
    names = [*left, *(right or [])]
    centre = np.array([centres[c] for c in names])
    second = list(right or left)
    n, m = len(left), len(second)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64) - centre
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(np.float64)
            a, p = x[:, :n], there[:, :n]
            b, q = (x[:, n:], there[:, n:]) if right else (a, p)
            part = np.stack([p.T @ q, a.T @ q, p.T @ b, (a * a).T @ q, p.T @ (b * b), a.T @ b], axis=1)
            total = part if total is None else total + part
        if total is not None:
            for first in range(0, n, 32):
                yield pa.record_batch({"key": pa.array(range(first, min(n, first + 32)), pa.int64()), "data": pa.array([total[r].tobytes() for r in range(first, min(n, first + 32))], pa.binary())})

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count, a, b, aa, bb, ab = np.frombuffer(data, np.float64).reshape(6, m)
                with np.errstate(divide="ignore", invalid="ignore"):
                    var_a, var_b = aa - a * a / count, bb - b * b / count
                    corr = np.clip((ab - a * b / count) / np.sqrt(var_a * var_b), -1.0, 1.0)
                corr = pa.array(corr, mask=~((count > 1) & (var_a > FLAT * aa) & (var_b > FLAT * bb)))
                one, others = pa.array([left[row]] * m), pa.array(second)
                yield pa.record_batch({"x": one, "y": others, "corr": corr})
                if right:
                    yield pa.record_batch({"x": others, "y": one, "corr": corr})

    sums = summed_arrays(values.select(*[col(c) for c in names]).coalesce(TASKS).mapInArrow(products, "key long, data binary"))
    return sums.mapInArrow(ratios, "x string, y string, corr double")
