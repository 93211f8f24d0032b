"""The value-count table: one shuffle that answers every question about distinct values.

``(column, value, n)`` is built by unpivot and a map-side combined count, so a value that
fills a third of a table arrives at its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.scale import chunks, col


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.BooleanType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def cols_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``numeric``, ``text`` (string or boolean), ``time`` or ``other`` columns."""
    test = {"numeric": is_numeric, "text": is_text, "time": is_time}.get(
        kind, lambda t: not (is_numeric(t) or is_text(t) or is_time(t))
    )
    return [f.name for f in df.schema.fields if test(f.dataType)]


def dtype_table(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string")


def long_values(df: DataFrame, columns: Sequence[str], cast: str = "string") -> DataFrame:
    """Rows of (column, value), one per cell."""
    picked = df.select(*[col(c).cast(cast).alias(c) for c in columns])
    return picked.unpivot([], [col(c) for c in columns], "column", "value")


def value_count_table(df: DataFrame, columns: Sequence[str], cast: str = "string") -> DataFrame:
    """(column, value, n) with the null value counted as a row of its own."""
    return long_values(df, columns, cast).groupBy("column", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, dropna: bool = True, k: int | None = None) -> DataFrame:
    """Counts of one column's values, most frequent first, ties by value."""
    counts = df.groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    if dropna:
        counts = counts.where(F.col("value").isNotNull())
    ordered = counts.orderBy(F.desc("n"), F.asc("value"))
    return ordered.limit(k) if k else ordered


def gated_counts(df: DataFrame, columns: Sequence[str], near: Callable[[str, int], bool], dropna: bool = True) -> dict[str, int]:
    """Distinct values by column: sketched in one pass without a shuffle of values, and exact where ``near`` says that a sketch can't decide.

    A sketch's standard error is 2 %; columns that can't be sketched are counted.
    """
    plain = [c for c in columns if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    rough: dict[str, int] = {}
    for part in chunks(plain, 50):
        row = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(part)]).first()
        rough |= {c: row[f"d{i}"] for i, c in enumerate(part)}
    close = [c for c in columns if c not in rough or near(c, rough[c])]
    exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, columns=close, dropna=dropna).collect()} if close else {}
    return rough | {c: exact.get(c, 0) for c in close}


def distinct_counts(df: DataFrame, dropna: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_distinct). Columns are counted per type family so that no number passes through text."""
    names = list(columns) if columns is not None else df.columns
    families: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in names:
            families.setdefault(_family(f.dataType), []).append(f.name)
    parts = []
    for cast, members in families.items():
        vc = long_values(df, members, cast).distinct()
        count = F.count("value") if dropna else F.count("*")
        parts.append(vc.groupBy("column").agg(count.alias("n_distinct")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _family(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "bigint"
    if isinstance(t, T.DecimalType):
        return t.simpleString()
    if is_numeric(t):
        return "double"
    if is_time(t):
        return "timestamp"
    return "string"


def top_values(vc: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column with their rank; each task keeps k rows before the shuffle."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mode_of(value: Column, n: Column) -> Column:
    """Aggregate: the value with the highest count, smallest on a tie, nulls left out."""
    return F.min(F.when(value.isNotNull(), F.struct((-n).alias("n"), value.alias("value"))))["value"]
