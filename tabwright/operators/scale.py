"""Order statistics, cuts and running totals that no single task has to hold.

A global ``row_number``, an exact ``percentile`` of a long column or a per-class sort
each put one group into one task. The operators here reach the same exact results by
narrowing first (sketch, hash bucket or range partition) and ranking only what is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.session import checkpointed

BROADCAST_ROWS = 100_000      # a side is broadcast only up to this many rows
EXACT_ROWS = 1_000_000        # values of a column one task may hold for an exact percentile
SKETCH_K = 4000               # quantile sketch size, about 0.1 % rank error
SKETCH_GROUPS = 256           # first level of the sketch merge tree
HASH_DIGITS = 4               # 65,536 hash buckets for cuts
SALT = 32                     # copies of a long side that a table is looked up in
RANK_ROWS = 1_000_000         # rows one window may rank without range partitioning
RANGES = 200                  # ranges of a long order, unless one would have more than RANK_ROWS rows


def col(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Small driver rows as a DataFrame in one partition."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The join side as a broadcast table if it is at most ``max_rows`` long, else as it is.

    The rows are fetched once, behind the limit, so the side's plan is not run again.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def lookup(df: DataFrame, key: Column, side: DataFrame, name: str, max_rows: int = BROADCAST_ROWS, salt: int = SALT) -> DataFrame:
    """The rows with the columns of the ``side`` row whose ``name`` equals ``key``, nulls where there is none; ``side`` has each key once.

    A side of at most ``max_rows`` rows is broadcast. A longer one is joined in ``salt`` copies, so that a value, or the null,
    that fills much of the table is spread over as many tasks.
    """
    rows = side.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, side.schema)), key == col(name), "left")
    hashable = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = df.withColumns({"_lookup": key, "_salt": F.pmod(F.xxhash64(*hashable), F.lit(salt))})
    copies = side.where(col(name).isNotNull()).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
    return spread.join(copies, (F.col("_lookup") == col(name)) & (F.col("_salt") == F.col("_copy")), "left").drop("_lookup", "_salt", "_copy")


# --- exact quantiles -----------------------------------------------------------------

def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    rows: int | None = None,
    exact_rows: int = EXACT_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns, exact at any length.

    Up to ``exact_rows`` rows the built-in ``percentile`` answers in one job. Beyond, a
    bracket around each wanted rank comes from merged quantile sketches, is checked by
    exact counts, and is narrowed until its content fits the built-in. Nulls are skipped.
    """
    wanted = {c: list(p) for c, p in wanted.items()}
    if not wanted:
        return {}
    rows = df.count() if rows is None else rows
    if rows <= exact_rows:
        out: dict[str, list[float | None]] = {c: [None] * len(p) for c, p in wanted.items()}
        by_probs: dict[tuple, list[str]] = {}
        for c, p in wanted.items():
            by_probs.setdefault(tuple(p), []).append(c)
        for probs, names in by_probs.items():
            # one group per column, so each column's values meet in a task of their own
            long = df.select(*[col(c).cast("double").alias(c) for c in names]).unpivot([], [col(c) for c in names], "column", "value")
            points = F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]))
            for r in long.groupBy("column").agg(points.alias("q")).collect():
                if r["q"] is not None:
                    out[r["column"]] = list(r["q"])
        return out
    out = {}
    for part in chunks(list(wanted), 10):
        out.update(_narrowed_quantiles(df, {c: wanted[c] for c in part}, exact_rows))
    return out


def _narrowed_quantiles(df, wanted, exact_rows):
    names = list(wanted)
    df = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    first = df.agg(*[
        e for i in range(len(names))
        for e in (F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"))
    ]).first()
    brackets = []
    for i, c in enumerate(names):
        for p in wanted[c]:
            n = first[f"n{i}"]
            brackets.append({
                "column": f"c{i}", "name": c, "n": n, "rank": p * (n - 1) if n else None,
                "lo": first[f"lo{i}"], "hi": first[f"hi{i}"], "below": 0, "inside": n,
            })
    share = max(1, exact_rows // max(1, len(brackets)))
    while True:
        open_ones = [b for b in brackets if b["n"] and b["lo"] < b["hi"] and b["inside"] > share]
        if not open_ones or not _narrow(df, open_ones):
            break
    final = [b for b in brackets if b["n"]]
    answers = {}
    if final:
        row = df.agg(*[
            F.percentile(
                F.when(F.col(b["column"]).between(b["lo"], b["hi"]), F.col(b["column"])),
                F.lit(min(1.0, max(0.0, (b["rank"] - b["below"]) / max(1, b["inside"] - 1)))),
            ) if b["lo"] < b["hi"] else F.max(F.lit(float(b["lo"])))
            for b in final
        ]).first()
        answers = {id(b): row[i] for i, b in enumerate(final)}
    out: dict[str, list[float | None]] = {c: [] for c in wanted}
    for b in brackets:
        out[b["name"]].append(answers.get(id(b)))
    return out


def _narrow(df, brackets) -> bool:
    """One round: sketch each bracket's content, count the proposal exactly, keep what holds."""
    margin = 3.0 / SKETCH_K
    group = (F.spark_partition_id() % SKETCH_GROUPS).alias("g")
    # brackets of the same content share a sketch: at first all those of a column
    spans = list(dict.fromkeys((b["column"], b["lo"], b["hi"]) for b in brackets))
    inside = [F.when(F.col(c).between(lo, hi), F.col(c)) for c, lo, hi in spans]
    partial = df.groupBy(group).agg(*[F.kll_sketch_agg_double(v, SKETCH_K).alias(f"s{i}") for i, v in enumerate(inside)])
    merged = partial.agg(*[F.kll_merge_agg_double(f"s{i}", SKETCH_K).alias(f"s{i}") for i in range(len(spans))])
    exprs = []
    for b in brackets:
        sketch = f"s{spans.index((b['column'], b['lo'], b['hi']))}"
        lower = max(0.0, (floor(b["rank"]) - b["below"]) / b["inside"] - margin)
        upper = min(1.0, (ceil(b["rank"]) - b["below"] + 1) / b["inside"] + margin)
        exprs += [F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (lower, upper)]
    cuts = merged.select(*[e.alias(f"e{k}") for k, e in enumerate(exprs)]).first()
    counts = _counts_at(df, {(b["column"], cuts[2 * i + j]) for i, b in enumerate(brackets) for j in (0, 1)})
    moved = False
    for i, b in enumerate(brackets):
        below, up_to_hi = counts[b["column"], cuts[2 * i]][0], counts[b["column"], cuts[2 * i + 1]][1]
        new_lo, new_hi, new_below = b["lo"], b["hi"], b["below"]
        if below <= floor(b["rank"]) and cuts[2 * i] > b["lo"]:
            new_lo, new_below = cuts[2 * i], below
        end = b["below"] + b["inside"]
        if up_to_hi > ceil(b["rank"]) and cuts[2 * i + 1] < b["hi"]:
            new_hi, end = cuts[2 * i + 1], up_to_hi
        if end - new_below < b["inside"]:
            moved = True
        b.update(lo=new_lo, hi=new_hi, below=new_below, inside=end - new_below)
    return moved


def _counts_at(df, points) -> dict[tuple[str, float], tuple[int, int]]:
    """For each (column, value) how many values lie below it, and how many up to it, from one count of the values between the points."""
    edges: dict[str, list[float]] = {}
    for c, v in sorted(p for p in points if isfinite(p[1])):
        edges.setdefault(c, []).append(v + 0.0)
    edges = {c: sorted(set(cuts)) for c, cuts in edges.items()}
    odd = [(c, v) for c, v in points if not isfinite(v)]
    out = {}
    if odd:
        row = df.agg(*[e.alias(f"k{2 * i + j}") for i, (c, v) in enumerate(odd) for j, e in enumerate((F.count_if(F.col(c) < v), F.count_if(F.col(c) <= v)))]).first()
        out = {p: (row[2 * i], row[2 * i + 1]) for i, p in enumerate(odd)}
    if not edges:
        return out
    splits = [[-float("inf"), *cuts, float("inf")] for cuts in edges.values()]
    values = df.select(*[(F.col(c) + 0.0).alias(c) for c in edges])  # no negative zero
    placed = Bucketizer(splitsArray=splits, inputCols=list(edges), outputCols=[f"at_{c}" for c in edges], handleInvalid="keep").transform(values)
    parts = [
        F.struct(F.lit(c).alias("c"), F.col(f"at_{c}").cast("int").alias("at"), F.coalesce(F.get(F.array(*map(F.lit, cuts)), F.col(f"at_{c}").cast("int") - 1) == F.col(c), F.lit(False)).alias("on"), F.col(c).isNotNull().alias("real"))
        for c, cuts in edges.items()
    ]
    found = placed.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("real").groupBy("c", "at", "on").agg(F.count("*").alias("n")).collect()
    for c, v in points - set(odd):
        i = edges[c].index(v + 0.0)
        below = sum(r["n"] for r in found if r["c"] == c and r["at"] <= i)
        out[c, v] = below, below + sum(r["n"] for r in found if r["c"] == c and r["at"] == i + 1 and r["on"])
    return out


# --- hash-order cuts -----------------------------------------------------------------

def key_hash(key: Sequence[str], seed: int = 42, purpose: str = "split") -> Column:
    """md5 of the key columns, a purpose and a seed: the same order on every cluster and every run.

    Each purpose has an order of its own: were samples and splits cut from the same order, the
    rows of a small sample would all land on the same side of a split.
    """
    def part(c: Column) -> Column:
        """Text in which the separator is marked, and a null that no value looks like."""
        text = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
        return F.coalesce(text, F.lit("\\N"))

    return F.md5(F.concat_ws("#", *[part(col(k)) for k in key], F.lit(purpose), F.lit(str(seed))))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """128-bit hash of a row's values. Null marks are hashed too, because a null by itself
    leaves a hash as it is and (1, null) would equal (null, 1)."""
    parts = []
    for c in columns:
        v = F.to_json(col(c)) if isinstance(df.schema[c].dataType, T.MapType) else col(c)
        parts += [v.isNull(), v]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("b"))


def row_hash(columns: Sequence[str]) -> Column:
    """md5 of a whole row with nulls kept in place, so (1, null) and (null, 1) differ."""
    return F.md5(F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"}))


def hash_part(
    df: DataFrame,
    hashed: Column,
    cut_ranks: Sequence,
    strata: str | None = None,
    name: str = "part",
) -> DataFrame:
    """Number of the slice each row falls in when every stratum is cut at ranks of its hash order.

    ``cut_ranks`` are functions from a stratum's row count (Column) to a rank (Column): rows
    up to the first rank get 0, the next 1 and so on. Counting per hash bucket finds the bucket
    that holds each cut, only those buckets are sorted, and the cut hashes come back as a small
    table, so the rows themselves are never shuffled or ranked. A table short enough for one
    task is ranked directly. Equal hashes stay together either way.
    """
    group = col(strata) if strata is not None else F.lit(0)
    if df.count() <= RANK_ROWS:
        whole = Window.partitionBy("_g")
        ranked = df.withColumns({"_g": group, "_h": hashed}).withColumns({"_r": F.rank().over(whole.orderBy("_h")), "_n": F.count("*").over(whole)})
        part = F.lit(0)
        for r in cut_ranks:
            part = part + (F.col("_r") > r(F.col("_n")).cast("bigint")).cast("int")
        return ranked.withColumn(name, part).drop("_g", "_h", "_r", "_n")
    keyed = df.select(group.alias("_s"), hashed.alias("_h")).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    per_bucket = keyed.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_s")
    summed = per_bucket.select(
        "_s", "_b", "_n",
        F.sum("_n").over(w).alias("_total"),
        F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)).alias("_to"),
    )
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), r(F.col("_total")).cast("bigint").alias("rank")) for i, r in enumerate(cut_ranks)])
    edges = (
        summed.withColumn("_cut", F.explode(ranks))
        .where((F.col("_cut.rank") > F.col("_to") - F.col("_n")) & (F.col("_cut.rank") <= F.col("_to")))
        .select("_s", "_b", F.col("_cut.i").alias("_i"), (F.col("_cut.rank") - F.col("_to") + F.col("_n")).alias("_rank"))
    )
    # equal hashes are counted, so a window holds the different hashes of a bucket, however often each occurs
    met = keyed.join(small_side(edges.withColumnRenamed("_s", "_s2").withColumnRenamed("_b", "_b2")), F.expr("_s <=> _s2 AND _b = _b2"))
    upto = F.sum("_k").over(Window.partitionBy("_s", "_i").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))
    picked = (
        met.groupBy("_s", "_i", "_rank", "_h").agg(F.count("*").alias("_k")).withColumn("_upto", upto)
        .where((F.col("_rank") > F.col("_upto") - F.col("_k")) & (F.col("_rank") <= F.col("_upto")))
    )
    cuts = picked.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_i", "_h"))).alias("_cuts"))
    tagged = df.withColumn("_h", hashed).withColumn("_g", group)
    joined = tagged.join(small_side(cuts), F.expr("_g <=> _s"), "left")
    # a cut whose rank is 0 leaves no row below it and has no entry; all its rows lie above
    part = F.lit(0)
    for i in range(len(cut_ranks)):
        at = F.expr(f"filter(_cuts, e -> e._i = {i})")
        part = part + F.when(F.size(at) > 0, (F.col("_h") > F.get(at, F.lit(0))["_h"]).cast("int")).otherwise(F.lit(1))
    return joined.withColumn(name, part).drop("_h", "_g", "_s", "_cuts")


# --- running totals over an ordered column --------------------------------------------

def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, Column],
    rank_rows: int = RANK_ROWS,
    partitions: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Exclusive running sums over the whole table in the order of ``order``.

    A short table takes one window. One of more than ``rank_rows`` rows is range partitioned and written out, each
    range is summed, and the ranges' offsets are joined back, so ranges run side by side.
    ``order`` must be unique per row, which pre-aggregated input is. With ``stored`` the table is read three times as it is,
    which pays where it follows row by row from a shorter checkpoint.
    """
    df = df if stored else checkpointed(df)
    n = df.count()
    if n <= rank_rows:
        w = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in totals.items()})
    parts = partitions or max(2, min(ceil(n / rank_rows), max(RANGES, ceil(n / RANK_ROWS))))
    ranged = checkpointed(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    offsets = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_o{i}") for i, v in enumerate(totals.values())])
    prior = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        F.col("_range").alias("_r2"),
        *[F.coalesce(F.sum(f"_o{i}").over(prior), F.lit(0)).alias(f"_o{i}") for i in range(len(totals))],
    )
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(small_side(offsets), F.col("_range") == F.col("_r2"))
    return joined.withColumns({
        k: F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"_o{i}") for i, (k, v) in enumerate(totals.items())
    }).drop("_range", "_r2", *[f"_o{i}" for i in range(len(totals))])
