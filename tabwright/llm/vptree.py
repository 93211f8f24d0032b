"""Approximate nearest neighbours: vantage-point trees per shard with relaxed triangle-inequality pruning (operator 9).

*Shards.* A top tree of vantage points is fitted on a bounded sample (``SAMPLE`` vectors); each vector goes to the leaf it falls in. Leaves
with many vectors (copies of one vector, say) are split by hash into shards of about ``SHARD`` vectors, so none grows with the data.

*Search.* Queries come in blocks of ``BLOCK``. Each first visits the shard of its own leaf, which bounds the distance ``r`` of its k-th
neighbour; it then visits the shards whose leaves the triangle inequality doesn't exclude: a subtree beyond the boundary ``m`` of a vantage
point ``v`` can hold neighbours only if ``|d(q, v) - m| <= r * factor``. In each shard a vantage-point tree is pruned by the same
rule. ``factor`` 1 is exact search; less prunes more and may miss neighbours.

Distances that rank are computed in double precision on the original vectors. A vector that is null, zero, of another length than most,
or that holds a null or non-finite component takes no part. A null id takes no part. Ties go to the smaller id. Rows that share an id are queries
and candidates each: a query leaves out its own row alone. Factor 1 is exact for vectors anywhere: candidates are chosen around the
shard's centre. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import shared_table

SAMPLE = 20_000
SHARD = 8_192
BLOCK = 2_048
LEAF = 128
TOP = 10
#: The relaxation of the pruning rule: figures in the README.
FACTOR = 0.5


@dataclass
class Tree:
    """Inner nodes: vantage vector, boundary, near and far child; a child below 0 is leaf -1 - child."""

    vantage: np.ndarray
    boundary: np.ndarray
    children: np.ndarray
    leaves: list[np.ndarray]

    @staticmethod
    def grown(vectors: np.ndarray, leaf: int, seed: int = 7) -> Tree:
        """Split at the median distance from a random vector until ``leaf`` or fewer remain, or until all are equally far."""
        rng = np.random.default_rng(seed)
        vantage, boundary, children, leaves = [], [], [], []
        pending = [(np.arange(len(vectors)), -1, 0)]
        while pending:
            rows, parent, side = pending.pop()
            far = np.zeros(0)
            if len(rows) > leaf:
                v = vectors[rows[rng.integers(len(rows))]]
                far = np.sqrt(((vectors[rows] - v) ** 2).sum(axis=1))
                middle = np.partition(far, len(far) // 2)[len(far) // 2]
                if not (far < middle).any():
                    middle = far[far > middle].min() if (far > middle).any() else np.nan
            if len(far) and np.isfinite(middle):
                here = len(vantage)
                vantage.append(v)
                boundary.append(middle)
                children.append([0, 0])
                pending += [(rows[far < middle], here, 0), (rows[far >= middle], here, 1)]
            else:
                leaves.append(rows)
                here = -len(leaves)
            if parent >= 0:
                children[parent][side] = here
        shape = (len(vantage), vectors.shape[1] if vectors.ndim == 2 else 0)
        return Tree(np.array(vantage).reshape(shape), np.array(boundary), np.array(children, np.int64).reshape(-1, 2), leaves)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector falls in."""
        out = np.zeros(len(vectors), np.int64)
        pending = [(0 if len(self.vantage) else -1, np.arange(len(vectors)))]
        while pending:
            node, rows = pending.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                near = np.sqrt(((vectors[rows] - self.vantage[node]) ** 2).sum(axis=1)) < self.boundary[node]
                pending += [(self.children[node][0], rows[near]), (self.children[node][1], rows[~near])]
        return out

    def reachable(self, queries: np.ndarray, radius: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) that pruning with a fixed radius leaves."""
        pending = [(0 if len(self.vantage) else -1, np.arange(len(queries)))]
        while pending:
            node, rows = pending.pop()
            if node < 0:
                yield -1 - node, rows
            elif len(rows):
                gap = np.sqrt(((queries[rows] - self.vantage[node]) ** 2).sum(axis=1)) - self.boundary[node]
                pending += [(self.children[node][0], rows[gap < radius[rows]]), (self.children[node][1], rows[gap >= -radius[rows]])]


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, radius: np.ndarray, rows_of: np.ndarray | None = None, query_rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best ids and distances, queries by ``k`` (missing: id -1, distance infinite). ``radius`` bounds each k-th distance from outside.

    A query leaves out the vector of its own row number (``rows_of``, ``query_rows``), or where none are given those of its own id.

    Queries go down together, each to its nearer side first; a batch that reaches a leaf is compared with it as a matrix.
    """
    best = np.full((len(queries), k), np.inf)
    names = np.full((len(queries), k), -1, np.int64)
    mine, theirs = (ids, query_ids) if rows_of is None else (rows_of, query_rows)
    # products of centred vectors choose candidates; the slack is far above their rounding, and distances come from the vectors themselves
    centre = vectors.mean(axis=0) if len(vectors) else 0.0
    near, asked = vectors - centre, queries - centre
    square = (near**2).sum(axis=1)
    slack = 1e-9 * ((asked**2).sum(axis=1) + (square.max() if len(square) else 0.0))

    def visit(leaf: np.ndarray, rows: np.ndarray) -> None:
        some = vectors[leaf]
        rough = square[leaf] - 2 * asked[rows] @ near[leaf].T
        keep = min(len(leaf), k + 1 + 8)
        pick = np.argpartition(rough, keep - 1, axis=1)[:, :keep] if keep < len(leaf) else np.tile(np.arange(len(leaf)), (len(rows), 1))
        limit = np.take_along_axis(rough, pick, axis=1).max(axis=1)
        limit = limit + slack[rows]
        ties = (rough <= limit[:, None]).sum(axis=1) > keep
        for part, chosen in ((rows[~ties], pick[~ties]), *((rows[t : t + 1], np.flatnonzero(rough[t] <= limit[t])[None]) for t in np.flatnonzero(ties))):
            if not len(part):
                continue
            exact = np.sqrt(((queries[part][:, None] - some[chosen]) ** 2).sum(axis=2))
            who = ids[leaf[chosen]]
            exact[mine[leaf[chosen]] == theirs[part][:, None]] = np.inf
            distance, name = np.hstack([best[part], exact]), np.hstack([names[part], who])
            order = np.lexsort((name, distance), axis=1)[:, :k]
            best[part] = np.take_along_axis(distance, order, axis=1)
            names[part] = np.where(np.isfinite(best[part]), np.take_along_axis(name, order, axis=1), -1)

    pending: list[tuple[int, np.ndarray, np.ndarray]] = [(0 if len(tree.vantage) else -1, np.arange(len(queries)), np.zeros(len(queries)))]
    while pending:
        node, rows, gap = pending.pop()
        still = gap <= factor * np.minimum(best[rows, -1], radius[rows])
        rows = rows[still]
        if not len(rows):
            continue
        if node < 0:
            visit(tree.leaves[-1 - node], rows)
            continue
        over = np.sqrt(((queries[rows] - tree.vantage[node]) ** 2).sum(axis=1)) - tree.boundary[node]
        for side, own in ((1, over < 0), (0, over >= 0)):
            if own.any():  # the last to be pushed is looked at first
                pending.append((int(tree.children[node][side]), rows[own], np.abs(over[own])))
        for side, own in ((0, over < 0), (1, over >= 0)):
            if own.any():
                pending.append((int(tree.children[node][side]), rows[own], np.zeros(int(own.sum()))))
    return names, best


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) in double precision, without what takes no part."""
    named = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return named.where(fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", is_query: str = "vec_id % 100 = 0", k: int = TOP, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query row, by Euclidean distance."""
    spark = df.sparkSession
    good = usable(df, id_column, vector_column)
    width = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("v") == width[0][0])
    total = width[0][1]
    share = min(1.0, 1.2 * SAMPLE / total)
    sample = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    points = _matrix(sample.column("v").combine_chunks()) if len(sample) else np.zeros((0, width[0][0]))
    top = spark.sparkContext.broadcast(Tree.grown(points, max(1, min(SAMPLE // 8, SHARD * len(points) // max(1, total)))))

    @F.arrow_udf("int")
    def home(vectors: pa.Array) -> pa.Array:
        return pa.array(top.value.leaf_of(_matrix(vectors)).astype(np.int32))

    placed = shared_table(good.withColumn("leaf", home("v")).withColumn("row", F.monotonically_increasing_id()))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select("leaf", F.ceil(F.col("n") / SHARD).cast("int").alias("parts"))
    rows = placed.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.col("parts")).cast("int"))
    queries = placed.where(is_query)

    def searched(asked: DataFrame) -> DataFrame:
        """Found rows of queries (query, query_id, v, radius, leaf), each in all shards of its leaf; a leaf's queries come in blocks of ``BLOCK``."""
        loads = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # a row per leaf, like the sizes
        wide = asked.join(F.broadcast(sizes), "leaf").join(F.broadcast(loads), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        block = F.pmod(F.xxhash64("query", F.lit(3)), F.col("blocks")).cast("int")
        wide = wide.select("query", "query_id", "radius", F.col("v").alias("asked"), F.col("leaf").alias("to_leaf"), F.col("part").alias("to_part"), block.alias("from_block"))
        blocks = wide.select(F.col("to_leaf").alias("leaf"), F.col("to_part").alias("part"), F.col("from_block").alias("block")).distinct()
        sent = rows.join(blocks, ["leaf", "part"]).groupBy("leaf", "part", "block")
        schema = "query long, query_id long, vec_id long, score double"

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            vectors, ids, numbers = _matrix(left.column("v").combine_chunks()), left.column("vec_id").to_numpy(), left.column("row").to_numpy()
            asked, asked_ids, radius = _matrix(right.column("asked").combine_chunks()), right.column("query_id").to_numpy(), right.column("radius").to_numpy()
            asked_rows = right.column("query").to_numpy()
            names, far = search(Tree.grown(vectors, LEAF), vectors, ids, asked, asked_ids, k, factor, radius, numbers, asked_rows)
            found = np.isfinite(far)
            times = found.sum(axis=1)
            return pa.table({"query": np.repeat(asked_rows, times), "query_id": np.repeat(asked_ids, times), "vec_id": names[found], "score": far[found]})

        return sent.cogroup(wide.groupBy("to_leaf", "to_part", "from_block")).applyInArrow(look, schema)

    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", F.lit(float("inf")).alias("radius"), "leaf")
    first = shared_table(searched(asked))
    bound = first.groupBy("query").agg(F.sort_array(F.collect_list("score")).alias("s")).select("query", F.get("s", F.lit(k - 1)).alias("radius"))
    known = asked.drop("radius").join(bound, "query", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))

    @F.arrow_udf("array<int>")
    def others(vectors: pa.Array, radius: pa.Array) -> pa.Array:
        out: list[list[int]] = [[] for _ in range(len(vectors))]
        for leaf, who in top.value.reachable(_matrix(vectors), factor * radius.to_numpy(zero_copy_only=False)):
            for q in who:
                out[q].append(leaf)
        return pa.array(out, pa.list_(pa.int32()))

    more = known.withColumn("next", F.explode(others("v", "radius"))).where("next <> leaf").select("query", "query_id", "v", "radius", F.col("next").alias("leaf"))
    found = first.union(searched(shared_table(more))).groupBy("query", "query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return found.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
