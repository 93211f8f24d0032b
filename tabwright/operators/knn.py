"""Exact nearest neighbours without a cross join.

A short train table travels to the tasks that hold the test rows. A longer one is cut into
cells around pivot rows. The cell counts and radii alone give each test row an upper bound of
its k-th distance, and only cells that can hold a neighbour are compared. Rows travel in blocks of
many cells and chunks of many test rows, so a test row is sent once for each block with a cell for it, and
a block once for each chunk. Each meeting keeps k rows and a last top-k per test row merges them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators.scale import col, small_side
from tabwright.session import checkpointed

BROADCAST_VALUES = 4_000_000   # numbers a train table may hold to travel to the tasks: 32 MB
PIVOTS = 512
BLOCK_ROWS = 32_768
DENSE = 0.25                   # share of a chunk's rows from which a cell is compared with all of them at once
MATRIX_VALUES = 4_000_000      # numbers one distance block may hold


def _stack(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype="float64").reshape(len(values), -1)


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)


def _nearest(x: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of x the positions and squared distances of its k nearest rows of t, ties by id.

    A matrix product finds the candidates; their distances are then taken from the plain
    differences, so rounding in the product cannot change the answer.
    """
    t2 = (t * t).sum(axis=1)
    step = max(1, MATRIX_VALUES // max(1, len(t)))
    for start in range(0, len(x), step):
        part = x[start : start + step]
        x2 = (part * part).sum(axis=1)
        rough = x2[:, None] + t2[None, :] - 2.0 * (part @ t.T)
        kth = np.partition(rough, min(k, len(t)) - 1, axis=1)[:, min(k, len(t)) - 1]
        slack = 1e-9 * (1.0 + x2 + t2.max())
        for i in range(len(part)):
            near = np.flatnonzero(rough[i] <= kth[i] + slack[i])
            diff = t[near] - part[i]
            d2 = (diff * diff).sum(axis=1)
            order = np.lexsort((ids[near], d2))[:k]
            yield start + i, near[order], d2[order]


def neighbors(
    train: DataFrame, test: DataFrame, k: int, features: str = "features", id_col: str = "id",
    label: str = "label", max_values: int = BROADCAST_VALUES, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, neighbor_id, label, distance, rank): the k nearest train rows of every test row.

    ``features`` are arrays of numbers, ids are bigints, and ties go to the smaller train id.
    """
    t = train.select(col(id_col).cast("bigint").alias("tid"), col(label).cast("string").alias("label"), col(features).cast("array<double>").alias("x"))
    q = test.select(col(id_col).cast("bigint").alias("id"), col(features).cast("array<double>").alias("x"))
    rows, longest = t.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not rows:
        raise ValueError("no train rows")
    limit = max(1, max_values // max(1, longest))
    found = _near_all(t.toPandas(), q, k) if rows <= limit else _near_cells(t, q, k, pivots, block_rows)
    return found.select("id", F.col("tid").alias("neighbor_id"), "label", F.sqrt("d2").alias("distance"), "rank")


SCHEMA = "id bigint, tid bigint, label string, d2 double, rank int"


def _pick(pdf: pd.DataFrame, t, ids, labels, k) -> pd.DataFrame:
    parts = [(i, pos, d2) for i, pos, d2 in _nearest(_stack(pdf["x"]), t, ids, k)]
    where = np.concatenate([pos for _, pos, _ in parts])
    return pd.DataFrame({
        "id": np.repeat(pdf["id"].to_numpy(), [len(p) for _, p, _ in parts]),
        "tid": ids[where], "label": labels[where], "d2": np.concatenate([d for _, _, d in parts]),
        "rank": np.concatenate([np.arange(1, len(p) + 1) for _, p, _ in parts]).astype("int32"),
    })


def _near_all(rows: pd.DataFrame, q: DataFrame, k: int) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast((_stack(rows["x"]), rows["tid"].to_numpy(), rows["label"].to_numpy()))

    def run(batches):
        t, ids, labels = shared.value
        for pdf in batches:
            if len(pdf):
                yield _pick(pdf, t, ids, labels, k)

    return q.mapInPandas(run, SCHEMA)


def _packed(names: list[int], sizes: list[int], most: int) -> dict[int, tuple[int, int]]:
    """Number of the first bin of each name and how many bins it fills: small ones share a bin, one beyond ``most`` rows has several."""
    out, at, held = {}, 0, 0
    for name, n in zip(names, sizes, strict=True):
        if held and held + n > most:
            at, held = at + 1, 0
        count = max(1, ceil(n / most))
        out[name] = (at, count)
        at, held = (at + count, 0) if count > 1 else (at, held + n)
    return out


def _bin_of(bins: dict[int, tuple[int, int]], name: str, key: str):
    """The bin of a row, as a column; rows of a name with several bins are dealt by their key."""
    first, count = (F.create_map(*[F.lit(v) for c, b in bins.items() for v in (c, b[i])]) for i in (0, 1))
    return F.element_at(first, F.col(name)) + F.pmod(F.xxhash64(key), F.element_at(count, F.col(name))).cast("int")


def _open_cells(x: np.ndarray, bound: np.ndarray, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells (columns) can hold a row within each row's bound; the margin keeps rounding from closing a cell that just touches it."""
    d = np.stack([np.sqrt(((points - row) ** 2).sum(axis=1)) for row in x])
    return d - radius <= (bound * (1 + 1e-9) + 1e-12)[:, None]


def _near_cells(t: DataFrame, q: DataFrame, k: int, pivots: int, block_rows: int) -> DataFrame:
    sc = t.sparkSession.sparkContext
    centre = _stack(t.orderBy(F.md5(F.col("tid").cast("string"))).limit(pivots).toPandas()["x"])
    centre = centre[np.argsort(((centre - centre[0]) ** 2).sum(axis=1), kind="stable")]  # cells that share a block lie in one shell
    shared = sc.broadcast(centre)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                best = [(pos[0], np.sqrt(d2[0])) for _, pos, d2 in _nearest(_stack(pdf["x"]), shared.value, np.arange(len(shared.value)), 1)]
                yield pdf.assign(cell=np.array([b[0] for b in best], dtype="int32"), reach=[b[1] for b in best])

    # of identical rows only the k smallest ids can ever be neighbours
    same = Window.partitionBy("x").orderBy("tid")
    distinct = t.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k).drop("_copy")
    placed = checkpointed(distinct.mapInPandas(assign, "tid bigint, label string, x array<double>, cell int, reach double"))
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).orderBy("cell").toPandas()
    blocks = _packed([int(c) for c in stats["cell"]], [int(n) for n in stats["n"]], block_rows)
    homes = np.array([blocks[int(c)][0] for c in stats["cell"]], dtype="int32")
    held = np.zeros((len(stats), max(first + count for first, count in blocks.values())), dtype=bool)
    for i, c in enumerate(stats["cell"]):
        held[i, blocks[int(c)][0] : sum(blocks[int(c)])] = True
    cells = sc.broadcast((centre[stats["cell"].to_numpy()], stats["cell"].to_numpy(), stats["n"].to_numpy(), stats["radius"].to_numpy(), homes, held))

    def visits(batches):
        points, _, sizes, radius, homes, held = cells.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _stack(pdf["x"])
            bounds, home = np.empty(len(x)), np.empty(len(x), dtype="int32")
            for i, row in enumerate(x):
                d = np.sqrt(((points - row) ** 2).sum(axis=1))
                far = d + radius
                order = np.argsort(far)
                enough = np.searchsorted(np.cumsum(sizes[order]), k)
                bounds[i], home[i] = far[order[min(enough, len(order) - 1)]], homes[d.argmin()]
            needed = _open_cells(x, bounds, points, radius).astype("float32") @ held.astype("float32") > 0
            yield pdf.assign(bound=bounds, home=home, blocks=[np.flatnonzero(row).tolist() for row in needed])

    blocked = placed.withColumn("block", _bin_of(blocks, "cell", "tid")).select("tid", "label", "x", "cell", "block")
    asked = checkpointed(q.mapInPandas(visits, "id bigint, x array<double>, bound double, home int, blocks array<int>"))
    load = asked.groupBy("home").agg(F.count("*").alias("n")).orderBy("home").collect()  # at most one row per pivot
    chunks = _packed([r["home"] for r in load], [r["n"] for r in load], block_rows) if load else {0: (0, 1)}
    asked = asked.withColumn("chunk", _bin_of(chunks, "home", "id")).withColumn("block", F.explode("blocks")).select("id", "x", "bound", "block", "chunk")
    met = asked.select("block", (F.col("chunk") + 0).alias("chunk")).distinct()
    blocked = blocked.join(small_side(met), "block")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        if len(left) and len(right):
            points, names, _, radius, _, _ = cells.value
            x, t, tids, cell = _matrix(left), _matrix(right), right.column("tid").to_numpy(), right.column("cell").to_numpy()
            here = np.isin(names, cell)
            opened = _open_cells(x, left.column("bound").to_numpy(), points[here], radius[here])
            dense = opened.mean(axis=0) >= DENSE
            near = [(np.arange(len(x)), np.flatnonzero(np.isin(cell, names[here][dense])))]
            near += [(np.flatnonzero(opened[:, j]), np.flatnonzero(cell == names[here][j])) for j in np.flatnonzero(~dense)]
            for rows, some in near:
                if len(rows) and len(some):
                    found += [(np.full(len(pos), rows[i]), some[pos], d2) for i, pos, d2 in _nearest(x[rows], t[some], tids[some], k)]
        rows, pos, d2 = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(rows):
            return pa.table({"id": pa.array([], pa.int64()), "tid": pa.array([], pa.int64()), "label": pa.array([], pa.string()), "d2": pa.array([], pa.float64())})
        order = np.lexsort((tids[pos], d2, rows))
        rows, pos, d2 = rows[order], pos[order], d2[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, pos, d2 = rows[kept], pos[kept], d2[kept]
        return pa.table({"id": left.column("id").to_numpy()[rows], "tid": tids[pos], "label": right.column("label").cast(pa.string()).take(pa.array(pos)), "d2": d2})

    keys = ["block", "chunk"]
    met = asked.groupBy(*keys).cogroup(blocked.groupBy(*keys)).applyInArrow(meet, "id bigint, tid bigint, label string, d2 double")
    best = Window.partitionBy("id").orderBy("d2", "tid")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def vote(near: DataFrame, k: int, weights: str = "uniform") -> DataFrame:
    """(id, prediction, confidence, shares) from neighbour rows: majority or inverse-distance vote.

    A neighbour at distance zero outvotes all others; equal votes go to the smaller label.
    """
    used = near.where(F.col("rank") <= k)
    if weights == "distance":
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("id"))  # k rows per id
        used = used.withColumn("_exact", exact)
        weight = F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.when(F.col("distance") > 0, F.col("distance")))
    else:
        weight = F.lit(1.0)
    votes = used.groupBy("id", "label").agg(F.sum(weight).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), F.col("label").alias("label")))
    split = F.map_from_entries(F.collect_list(F.struct("label", "votes")))  # at most k entries
    return votes.groupBy("id").agg(best.alias("b"), F.sum("votes").alias("total"), split.alias("split")).select(
        "id", F.col("b.label").alias("prediction"), (-F.col("b.v") / F.col("total")).alias("confidence"),
        F.transform_values("split", lambda _, v: v / F.col("total")).alias("shares"),
    )


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", **columns) -> DataFrame:
    return vote(neighbors(train, test, k, **columns), k, weights)
