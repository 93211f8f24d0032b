"""The small tables behind each chart of a data dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.profile import HEAVY, corr_matrix, missing_pct, most_variable, num, numbers, per_column
from tabwright.operators.scale import col, exact_quantiles, local_frame, row_hash
from tabwright.operators.valuecounts import cols_of_kind, distinct_counts, value_counts
from tabwright.sources.tables import stable_sample

HISTOGRAM_BINS = 40
MAX_CATEGORIES = 15
MAX_SCATTER_COLUMNS = 5
MAX_CHARTS = 4
CHARTS = ["missing_values", "correlation", "distribution", "bar", "scatter", "boxplot"]  # by priority


def histogram(df: DataFrame, column: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, bin, low, high, n): equal bins from minimum to maximum, empty ones included."""
    if column is None:
        best = most_variable(df).first()
        if best is None:
            raise ValueError("no numeric column with a variance")
        column = best["column"]
    span = df.agg(F.min(num(column)).alias("lo"), F.max(num(column)).alias("hi")).first()
    if span["lo"] is None:
        raise ValueError(f"column {column} has no values")
    lo, width = float(span["lo"]), (float(span["hi"]) - float(span["lo"])) / bins
    x = num(column)
    place = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
    counts = df.where(x.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        F.lit(column).alias("column"), "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def widest_column(df: DataFrame) -> str | None:
    """Numeric column with the highest sample standard deviation, the first on a tie."""
    names = cols_of_kind(df, "numeric")
    if not names:
        return None
    spread = per_column(numbers(df, names), {c: {"std": F.stddev_samp(col(c))} for c in names}, limit=HEAVY)
    known = [(r["std"], -names.index(r["column"])) for r in spread.collect() if r["std"] is not None]
    return names[-max(known)[1]] if known else None


def _fences(df: DataFrame, column: str) -> tuple[list[float], float, float]:
    q = exact_quantiles(df.select(num(column).alias("v")), {"v": [0.25, 0.5, 0.75]})["v"]
    if q[0] is None:
        raise ValueError(f"column {column} has no values")
    reach = 1.5 * (q[2] - q[0])
    return q, q[0] - reach, q[2] + reach


def box_stats(df: DataFrame, column: str | None = None) -> DataFrame:
    """(column, q1, median, q3, low_whisker, high_whisker, outliers) with 1.5 IQR whiskers."""
    column = column or widest_column(df)
    q, low, high = _fences(df, column)
    x = num(column)
    inside = x.between(low, high)
    return df.agg(
        F.min(F.when(inside, x)).alias("low_whisker"), F.max(F.when(inside, x)).alias("high_whisker"),
        F.count_if(x.isNotNull() & ~inside).alias("outliers"),
    ).select(
        F.lit(column).alias("column"), F.lit(q[0]).alias("q1"), F.lit(q[1]).alias("median"), F.lit(q[2]).alias("q3"),
        "low_whisker", "high_whisker", "outliers",
    )


def box_outliers(df: DataFrame, column: str | None = None) -> DataFrame:
    """The rows whose value lies beyond the whiskers."""
    column = column or widest_column(df)
    _, low, high = _fences(df, column)
    x = num(column)
    return df.where((x < low) | (x > high))


def scatter_points(df: DataFrame, columns: Sequence[str] | None = None, n: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """The first five numeric columns (or those given), all rows or a stable sample of n."""
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")[:MAX_SCATTER_COLUMNS]
    if len(names) < 2:
        raise ValueError("a scatter matrix needs at least two numeric columns")
    rows = stable_sample(df, list(key) if key else df.columns, n) if n else df
    return rows.select(*[col(c) for c in names])


def bar_column(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> str | None:
    """Text column with the most distinct values within 2 to ``max_categories``, the first on a tie."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return None
    counts = {r["column"]: r["n_distinct"] for r in distinct_counts(df, columns=text).collect()}
    fits = [(counts.get(c, 0), -i) for i, c in enumerate(text) if 2 <= counts.get(c, 0) <= max_categories]
    return text[-max(fits)[1]] if fits else None


def bar_counts(df: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """(column, value, n) of the column picked by ``bar_column``."""
    column = bar_column(df, max_categories)
    if column is None:
        return local_frame(df.sparkSession, [], "column string, value string, n bigint")
    return value_counts(df, column).select(F.lit(column).alias("column"), "value", "n")


def missing_chart(df: DataFrame) -> DataFrame:
    """(column, missing_pct), ascending; empty when nothing is missing."""
    return missing_pct(df, digits=2, ascending=True)


def dashboard(df: DataFrame, types: Sequence[str] | None = None, scatter_rows: int = 0, limit: int = MAX_CHARTS) -> DataFrame:
    """(chart, priority, series, label, value) of the most telling charts, at most ``limit``."""
    unknown = sorted(set(types or []) - set(CHARTS))
    if unknown:
        raise ValueError(f"unsupported charts: {unknown}")
    wanted = [c for c in CHARTS if not types or c in types]
    numeric = cols_of_kind(df, "numeric")
    parts: list[tuple[str, DataFrame]] = []
    for chart in wanted:
        if len(parts) == limit:
            break
        table = _chart(df, chart, numeric, scatter_rows)
        if table is not None:
            parts.append((chart, table))
    out = local_frame(df.sparkSession, [], "chart string, priority int, series string, label string, value double")
    for chart, table in parts:
        out = out.unionByName(table.select(
            F.lit(chart).alias("chart"), F.lit(CHARTS.index(chart)).alias("priority"), "series", "label", F.col("value").cast("double").alias("value"),
        ))
    return out


def _chart(df, chart, numeric, scatter_rows):
    if chart == "missing_values":
        gaps = missing_chart(df)
        if not gaps.take(1):
            return None
        return gaps.select(F.lit("missing").alias("series"), F.col("column").alias("label"), F.col("missing_pct").alias("value"))
    if chart == "correlation":
        if len(numeric) < 2:
            return None
        return corr_matrix(df, numeric, digits=2).select(F.col("x").alias("series"), F.col("y").alias("label"), F.col("corr").alias("value"))
    if chart == "distribution":
        best = most_variable(df).first() if numeric else None
        if best is None:
            return None
        return histogram(df, best["column"]).select(F.col("column").alias("series"), F.col("bin").cast("string").alias("label"), F.col("n").alias("value"))
    if chart == "bar":
        bars = bar_counts(df)
        if not bars.take(1):
            return None
        return bars.select(F.col("column").alias("series"), F.col("value").alias("label"), F.col("n").alias("value"))
    if chart == "scatter":
        names = numeric[:MAX_SCATTER_COLUMNS]
        if len(names) < 2:
            return None
        rows = stable_sample(df, df.columns, scatter_rows) if scatter_rows else df
        points = rows.select(row_hash(df.columns).alias("label"), *[num(c).alias(c) for c in names])
        return points.unpivot(["label"], [col(c) for c in names], "series", "value")
    column = widest_column(df)
    if column is None:
        return None
    stats = ["q1", "median", "q3", "low_whisker", "high_whisker", "outliers"]
    box = box_stats(df, column)
    return box.select(F.col("column").alias("series"), F.inline(F.array(*[
        F.struct(F.lit(s).alias("label"), F.col(s).cast("double").alias("value")) for s in stats
    ])))

