"""Approximate nearest neighbours by random projections, with a recall that is measured and not assumed.

Where distances are all alike, triangle bounds close no cell and the exact join (``knn``) reads everything. Here each of
several tables gives every train and test row a key, the signs of random projections, and orders all rows by it, so that rows on the
same side of many random planes stand side by side. The order is cut into cells of equal length and into blocks of ``SPAN`` cells, and a test row
is compared with the train rows of its block and of the cell on either side of it. Only the rows of a block's first and last cell are sent
twice for a table, and a cell has as many rows as any other, whatever the density: no bucket can grow hot, as rows with equal signs are
ordered by a projection and then by a hash.

Before the join, ``sample`` test rows are answered exactly, and tables are added until their answers have the wanted recall. The sample travels
to the train rows for that, so no train row is sent before the tables are settled; if
``most`` tables don't reach it, all rows are answered by the exact join. Train rows that are equal as a whole count up to k times,
which is all that k nearest can need, and equal test rows are searched once. Rows with a null vector, a null or a non-finite
element take no part, and have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators.knn import _matrix, _nearest, _stack, neighbors
from tabwright.operators.scale import col, running_totals
from tabwright.session import checkpointed

BITS, PLACE_BITS, SALT_BITS = 40, 12, 11
SAMPLE = 200       # test rows whose exact answer is sought
PIVOTS = 2_000     # train rows that set the planes' places
WIDTH = 1_000      # rows of a cell at least
SPAN = 8           # cells of a block
CELLS = 500_000    # cells of all tables at most: their borders are broadcast, 8 bytes each
TABLES, MOST = 4, 64
FOUND = "id bigint, tid bigint, label string, d2 double"


def _usable(df: DataFrame, id_col: str, features: str, *more) -> DataFrame:
    x = col(features).cast("array<double>")
    real = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.select(col(id_col).cast("bigint").alias("id"), *more, x.alias("x")).where(F.col("id").isNotNull() & (F.size("x") > 0) & real)


class Planes:
    """Keys of one table: signs of projections cut at the median of the pivots, the place along the first one, and a hash of the row."""

    def __init__(self, pivots: np.ndarray, table: int, seed: int):
        rng = np.random.default_rng([seed, table])
        self.directions = rng.standard_normal((pivots.shape[1], BITS))
        self.cuts = np.median(pivots @ self.directions, axis=0)
        self.places = np.quantile(pivots @ self.directions[:, 0], np.linspace(0, 1, (1 << PLACE_BITS) + 1)[1:-1])

    def keys(self, x: np.ndarray, salt: np.ndarray) -> np.ndarray:
        along = x @ self.directions
        code = (along > self.cuts) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        place = np.searchsorted(self.places, along[:, 0])
        return (((code << PLACE_BITS) | place) << SALT_BITS) | (salt & ((1 << SALT_BITS) - 1))


def _keyed(rows: DataFrame, planes: list[Planes], first: int, borders: dict[int, np.ndarray] | None) -> DataFrame:
    """(t, key) of every row in each table, or with ``borders`` (t, cell, id, label, train, x)."""
    shared = rows.sparkSession.sparkContext.broadcast((planes, borders))
    row_schema = "t int, cell int, id bigint, label string, train boolean, x array<double>"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, borders = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            salt = batch.column(4).to_numpy(zero_copy_only=False)
            for t, one in enumerate(planes, first):
                key = one.keys(x, salt)
                table = pa.array(np.full(len(x), t, np.int32))
                if borders is None:
                    yield pa.record_batch({"t": table, "key": pa.array(key)})
                else:
                    cell = pa.array(np.searchsorted(borders[t], key, "right").astype(np.int32))
                    yield pa.RecordBatch.from_arrays([table, cell, *batch.columns[:4]], names=["t", "cell", "id", "label", "train", "x"])

    named = rows.select("id", "label", "train", "x", F.xxhash64("id", "train").alias("salt"))
    return named.mapInArrow(hashed, "t int, key bigint" if borders is None else row_schema)


def _borders(keys: DataFrame, tables: range, length: int) -> dict[int, np.ndarray]:
    """The keys at every ``length``-th place of each table's order."""
    counts = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counts, ["t", "key"], {"below": F.col("n")})
    cut = placed.where(F.floor((F.col("below") + F.col("n")) / length) > F.floor(F.col("below") / length)).select("t", "key").toPandas()  # CELLS rows at most
    return {t: np.sort(cut.loc[cut["t"] == t, "key"].to_numpy(np.int64)) for t in tables}


def _compared(train: DataFrame, test: DataFrame, planes: list[Planes], borders: dict[int, np.ndarray], k: int) -> DataFrame:
    """The k nearest train rows of each test row among those of its block and the cell on either side of it, in each table."""
    block, inside = F.floor(F.col("cell") / SPAN), F.col("cell") % SPAN
    beside = F.array_compact(F.array(block, F.when(inside == 0, block - 1), F.when(inside == SPAN - 1, block + 1)))
    asked = _keyed(test, planes, 0, borders).select("t", block.alias("block"), "id", "x")
    known = _keyed(train, planes, 0, borders).withColumn("block", F.explode(beside)).select("t", "block", "id", "label", "x")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"id": pa.array([], pa.int64()), "tid": pa.array([], pa.int64()), "label": pa.array([], pa.string()), "d2": pa.array([], pa.float64())})
        ids, train = right.column("id").to_numpy(), _matrix(right)
        parts = [(pos, d2) for _, pos, d2 in _nearest(_matrix(left), train, ids, k)]
        where = np.concatenate([pos for pos, _ in parts])
        asked = np.repeat(left.column("id").to_numpy(), [len(p) for p, _ in parts])
        return pa.table({"id": asked, "tid": ids[where], "label": right.column("label").cast(pa.string()).take(pa.array(where)), "d2": np.concatenate([d for _, d in parts])})

    return asked.groupBy("t", "block").cogroup(known.groupBy("t", "block")).applyInArrow(meet, FOUND)


def _sampled(train: DataFrame, asked: pd.DataFrame, planes: list[Planes], first: int, borders: dict[int, np.ndarray], k: int) -> DataFrame:
    """What ``_compared`` finds for a few test rows in the tables from ``first`` on; they travel to the train rows, which stay where they are."""
    x, ids, salt = _stack(asked["x"]), asked["id"].to_numpy(), asked["salt"].to_numpy()
    blocks = [np.searchsorted(borders[t], one.keys(x, salt), "right") // SPAN for t, one in enumerate(planes, first)]
    used = {t: borders[t] for t in range(first, first + len(planes))}
    shared = train.sparkSession.sparkContext.broadcast((x, ids, planes, blocks, used))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, planes, blocks, used = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tids, salt = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            beside = np.zeros((len(x), len(rows)), dtype=bool)
            for t, (one, block) in enumerate(zip(planes, blocks, strict=True), first):
                cell = np.searchsorted(used[t], one.keys(rows, salt), "right")
                beside |= (cell[None, :] >= block[:, None] * SPAN - 1) & (cell[None, :] <= block[:, None] * SPAN + SPAN)
            for i in range(len(x)):
                some = np.flatnonzero(beside[i])
                if len(some):
                    _, pos, d2 = next(_nearest(x[i : i + 1], rows[some], tids[some], k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pos), ids[i])), pa.array(tids[some][pos]), batch.column(1).cast(pa.string()).take(pa.array(some[pos])), pa.array(d2)],
                        names=["id", "tid", "label", "d2"])

    return train.select("id", "label", "x", F.xxhash64("id", F.lit(True)).alias("salt")).mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(id, tid, label, d2, rank) of the k nearest that any table found."""
    best = Window.partitionBy("id").orderBy("d2", "tid")
    return found.dropDuplicates(["id", "tid"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _exact_sample(t: DataFrame, asked: pd.DataFrame, k: int) -> DataFrame:
    """The exact answers of a few test rows: they travel to the train rows, and every task returns its k nearest."""
    shared = t.sparkSession.sparkContext.broadcast((_stack(asked["x"]), asked["id"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, ids = shared.value
        for pdf in batches:
            if len(pdf):
                tids, labels = pdf["id"].to_numpy(), pdf["label"].to_numpy()
                parts = [(i, pos, d2) for i, pos, d2 in _nearest(x, _stack(pdf["x"]), tids, k)]
                where = np.concatenate([p for _, p, _ in parts])
                yield pd.DataFrame({"id": np.repeat(ids, [len(p) for _, p, _ in parts]), "tid": tids[where], "label": labels[where], "d2": np.concatenate([d for _, _, d in parts])})

    return _merged(t.select("id", "label", "x").mapInPandas(run, FOUND), k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours, all test rows together, that were found; a found row at the same distance as the exact one of its rank counts."""
    both = exact.select("id", "rank", F.col("d2").alias("want")).join(found.select("id", "rank", "d2"), ["id", "rank"], "left")
    last = both.groupBy("id").agg(F.max("want").alias("last"), F.count(F.lit(1)).alias("n"))
    hit = found.join(last, "id").where(F.col("d2") <= F.col("last")).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    share = last.join(hit, "id", "left").agg(F.sum(F.least(F.coalesce("hits", F.lit(0)), F.col("n"))), F.sum("n")).first()
    return 1.0 if not share[1] else share[0] / share[1]


def approx_neighbors(
    train: DataFrame, test: DataFrame, k: int, recall: float = 0.95, features: str = "features", id_col: str = "id", label: str = "label",
    width: int = WIDTH, tables: int = TABLES, most: int = MOST, sample: int = SAMPLE, seed: int = 42,
) -> tuple[DataFrame, dict]:
    """((id, neighbor_id, label, distance, rank), report): near neighbours of every test row, ties to the smaller train id.

    The report has the ``tables`` used (0: exact join) and the ``recall`` measured on the sample. Vectors of different lengths are an error.
    """
    spark = train.sparkSession
    t = checkpointed(_usable(train, id_col, features, col(label).cast("string").alias("label")))
    q = checkpointed(_usable(test, id_col, features))
    spans = [df.agg(F.min(F.size("x")), F.max(F.size("x"))).first() for df in (t, q)]
    sizes = {n for row in spans for n in row if n is not None}
    if spans[0][0] is None:
        raise ValueError("no train rows")
    if len(sizes) > 1:
        raise ValueError(f"vectors of {min(sizes)} to {max(sizes)} elements")
    pick = F.md5(F.col("id").cast("string"))
    pivots = _stack(t.orderBy(pick).limit(PIVOTS).toPandas()["x"])
    copies = Window.partitionBy("x").orderBy("id")
    t = checkpointed(t.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy"))
    key = [F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(1), "x").alias("k2")]
    once = checkpointed(q.select("id", *key, "x").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("x").alias("x")))
    asked = once.select("id", "x", F.xxhash64("id", F.lit(False)).alias("salt")).orderBy(pick).limit(sample).toPandas()
    if not len(asked):
        return spark.createDataFrame([], "id bigint, neighbor_id bigint, label string, distance double, rank int"), {"tables": 0, "recall": 1.0}
    exact = checkpointed(_exact_sample(t, asked, k))
    known = t.select("id", "label", F.lit(True).alias("train"), "x")
    sought = once.select("id", F.lit(None).cast("string").alias("label"), F.lit(False).alias("train"), "x")
    rows = t.count() + once.count()

    planes: list[Planes] = []
    borders: dict[int, np.ndarray] = {}
    found, done, measured = None, 0, 0.0
    while done < most:
        planes += [Planes(pivots, n, seed) for n in range(done, tables)]
        keys = _keyed(known, planes[done:], done, None).unionByName(_keyed(sought, planes[done:], done, None))
        borders |= _borders(keys, range(done, tables), max(width, -(-rows * tables // CELLS)))
        more = _sampled(t, asked, planes[done:], done, borders, k)
        found = checkpointed(more if found is None else found.unionByName(more))
        done, measured = tables, recall_of(_merged(found, k), exact)
        if measured >= recall:
            break
        tables = min(2 * tables, most)
    if measured < recall:
        return neighbors(t, q, k, features="x"), {"tables": 0, "recall": 1.0}
    near = _merged(_compared(known, sought, planes, borders, k), k).join(once.select("id", "k1", "k2"), "id").drop("id")
    near = q.select("id", *key).join(near, ["k1", "k2"])
    return near.select("id", F.col("tid").alias("neighbor_id"), "label", F.sqrt("d2").alias("distance"), "rank"), {"tables": done, "recall": measured}
