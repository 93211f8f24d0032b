"""Mutual information of numbers with a class by nearest neighbours (Ross 2014), exact and without a per-class task.

For a row with value v of a class of c rows, r is the distance to its k-th nearest value in the class (k is lowered to
c - 1) and m the number of rows of any class nearer than r, the row itself included (r = 0: rows with just this value).
The estimate is psi(N) + mean psi(k) - mean psi(c) - mean psi(m), at least 0; rows of classes of one row don't count.

In one dimension neighbours are neighbours in sorted order. All features are counted as (feature, class, value, n) once and
sorted together in ranges; the order is cut into blocks of equal length, each with k rows of the blocks beside it, so a
window sees every neighbour and no task holds a class. The rows nearer than r are the difference of two running totals:
the interval's two ends are sorted in among the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators.profile import numbers
from tabwright.operators.scale import col, running_totals
from tabwright.session import checkpointed

NEIGHBORS = 3
BLOCK = 100_000  # rows of one window
RANGE_ROWS = 100_000  # rows ranked by one task; longer tables are dealt into ranges, so that their windows run side by side


def digamma(x: Column) -> Column:
    """psi(x) for x >= 1 to 12 digits: eight steps of the recurrence, then the series at infinity."""
    y = x.cast("double") + 8
    steps = sum((1 / (x.cast("double") + j) for j in range(1, 8)), 1 / x.cast("double"))
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps


def class_values(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, y, v, n): how often each value of a numeric feature occurs in each class; rows without a value or class are left out."""
    rows = numbers(df.where(col(target).isNotNull()).withColumn("_y", col(target).cast("string")), list(features), ["_y"])
    long = rows.unpivot(["_y"], [col(c) for c in features], "feature", "v").where("v is not null")
    return long.groupBy("feature", F.col("_y").alias("y"), (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def kth_distances(counts: DataFrame, k: int, rank_rows: int = RANGE_ROWS, block: int = BLOCK) -> DataFrame:
    """``counts`` (feature, y, v, n, c) with ``r``, the distance of a row to its least(k, c - 1)-th nearest in the class.

    ``counts`` is read several times: it should follow from a checkpoint row by row.
    """
    placed = running_totals(counts, ["feature", "y", "v"], {"place": F.lit(1)}, rank_rows=rank_rows, stored=True)
    own = F.floor(F.col("place") / block)
    inside = F.col("place") % block
    beside = F.array(own, F.when(inside < k, own - 1), F.when(inside >= block - k, own + 1))
    blocks = placed.withColumn("own", own).withColumn("block", F.explode(F.array_compact(beside)))
    w = Window.partitionBy("block").orderBy("place")
    row = F.struct("feature", "y", "v", "n")
    near = {f"near{i}": f(row, d).over(w) for i, (f, d) in enumerate((f, d) for d in range(1, k + 1) for f in (F.lag, F.lead))}
    seen = blocks.withColumns(near).where("block = own")
    # a row of another class stands for nothing: NaN comes after every distance, of which there are enough
    reach = []
    for name in near:
        x = F.col(name)
        mine = F.coalesce((x["feature"] == F.col("feature")) & (x["y"] == F.col("y")), F.lit(False))
        reach.append(F.array_repeat(F.when(mine, F.abs(x["v"] - F.col("v"))).otherwise(F.lit(float("nan"))), F.when(mine, F.least(x["n"], F.lit(k))).otherwise(1).cast("int")))
    same = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    at = F.least(F.lit(k), F.col("c") - 1).cast("int")
    return seen.select("feature", "y", "v", "n", "c", F.get(F.sort_array(F.concat(same, *reach)), at - 1).alias("r"))


def rows_within(rows: DataFrame, rank_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (feature, y, v, n, c, r) as (feature, y, n, c, m): rows of the feature nearer to v than r, or equal to it.

    The rows are checkpointed and not the three times as many values and ends.
    """
    wide = F.col("r") > 0
    value = F.struct(F.col("v").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("side"))
    high = F.struct((F.col("v") + F.col("r")).alias("at"), F.when(wide, 0).otherwise(2).alias("kind"), F.lit(1).alias("side"))
    low = F.struct((F.col("v") - F.col("r")).alias("at"), F.when(wide, 2).otherwise(0).alias("kind"), F.lit(-1).alias("side"))
    ends = checkpointed(rows).select("feature", "y", "v", "n", "c", F.explode(F.array(value, high, low)).alias("e")).select("feature", "y", "v", "n", "c", "e.*")
    totals = running_totals(ends, ["feature", "at", "kind", "y", "v", "side"], {"below": F.when(F.col("side") == 0, F.col("n")).otherwise(0)}, rank_rows=rank_rows, stored=True)
    return totals.where("side <> 0").groupBy("feature", "y", "v").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.sum(F.col("below") * F.col("side")).alias("m"))


def neighbor_mutual_info(df: DataFrame, target: str, features: Sequence[str], k: int = NEIGHBORS, rank_rows: int = RANGE_ROWS, block: int = BLOCK) -> DataFrame:
    """(feature, mutual_info) in nats of numeric features; null for a feature of which no class has two values."""
    if block <= 2 * k:
        raise ValueError(f"a block of {block} rows is too short for {k} neighbours")
    counts = checkpointed(class_values(df, target, features))
    # numbers for names and classes: the rows that are sorted hold no text
    sizes = checkpointed(counts.groupBy("feature", "y").agg(F.sum("n").alias("c")).where("c > 1").withColumn("code", F.monotonically_increasing_id()))
    place = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature")).cast("int")
    known = counts.join(sizes, ["feature", "y"]).select(place.alias("feature"), F.col("code").alias("y"), "v", "n", "c")
    rows = rows_within(kth_distances(known, k, rank_rows, block), rank_rows)
    n, mean = F.sum("n"), lambda e: F.sum(F.col("n") * digamma(e)) / F.sum("n")
    found = rows.groupBy("feature").agg((digamma(n) + mean(F.least(F.lit(k), F.col("c") - 1)) - mean(F.col("c")) - mean(F.col("m"))).alias("mi"))
    every = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(features, 1)], "name string, feature int").coalesce(1)
    return every.join(found, "feature", "left").select(F.col("name").alias("feature"), F.when(F.col("mi").isNotNull(), F.greatest("mi", F.lit(0.0))).alias("mutual_info"))
