"""Data-quality profiles. Numeric statistics come from one wide aggregate, everything about
distinct values from one value-count shuffle, however many columns there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.numbers import finite, parse_number_loose, unbiased_skew
from tabwright.operators.dedupe import duplicate_rows
from tabwright.operators.scale import chunks, col, exact_quantiles, local_frame
from tabwright.operators.subspace import tiled_corr
from tabwright.operators.valuecounts import (
    cols_of_kind,
    distinct_counts,
    gated_counts,
    is_numeric,
    top_values,
    value_count_table,
    value_counts,
)


HEAVY = 24            # moment aggregates per job; more make generated code too large for the JIT
LIGHT = 160           # plain counts per job
JVM_PAIRS = 12        # correlations worth single aggregates; more go through matrix products


def num(name: str) -> Column:
    return finite(col(name))


def numbers(df: DataFrame, names: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as doubles with NaN and infinities nulled, computed once per row."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[col(c) for c in carry], *[(num(c) if c in floats else col(c).cast("double")).alias(c) for c in names])


def _is_missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def per_column(df: DataFrame, exprs: dict[str, dict[str, Column]], label: str = "column", limit: int = LIGHT) -> DataFrame:
    """Aggregate per column, laid out long: ``exprs[column][stat]`` becomes a row per column.

    Columns share passes of ``limit`` aggregates. A columnar source reads each column once all
    the same, since every pass asks for other columns.
    """
    if not exprs:
        raise ValueError("no column of the kind that is asked for")
    stats = list(next(iter(exprs.values())))
    out = None
    for part in chunks(list(exprs), max(1, limit // len(stats))):
        wide = df.agg(*[exprs[c][s].alias(f"{i}_{s}") for i, c in enumerate(part) for s in stats])
        rows = F.array(*[
            F.struct(F.lit(c).alias(label), *[F.col(f"{i}_{s}").alias(s) for s in stats]) for i, c in enumerate(part)
        ])
        long = wide.select(F.inline(rows))
        out = long if out is None else out.unionByName(long)
    return out


def missing_table(df: DataFrame, digits: int = 2) -> DataFrame:
    """(column, missing_count, missing_percent) for every column."""
    return per_column(df, {
        c: {"missing_count": F.count_if(_is_missing(df, c)), "n": F.count("*")} for c in df.columns
    }).select(
        "column", "missing_count",
        F.round(F.lit(100.0) * F.col("missing_count") / F.greatest("n", F.lit(1)), digits).alias("missing_percent"),
    )


def missing_pct(df: DataFrame, k: int | None = None, digits: int = 2, ascending: bool = False) -> DataFrame:
    """Columns with missing values and their percentage, largest first unless ascending."""
    share = per_column(df, {c: {"m": F.count_if(_is_missing(df, c)), "n": F.count("*")} for c in df.columns})
    share = share.where("m > 0").select("column", F.round(F.lit(100.0) * F.col("m") / F.col("n"), digits).alias("missing_pct"))
    order = [F.asc("missing_pct") if ascending else F.desc("missing_pct"), F.asc("column")]
    ordered = share.orderBy(*order)
    return ordered.limit(k) if k else ordered


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) with exact interpolated quartiles."""
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")
    values = numbers(df, names)
    base = per_column(values, {
        c: {
            "count": F.count(col(c)), "mean": F.avg(col(c)), "std": F.stddev_samp(col(c)),
            "min": F.min(col(c)), "max": F.max(col(c)),
        } for c in names
    }, limit=HEAVY).collect()
    q = exact_quantiles(values, {c: [0.25, 0.5, 0.75] for c in names})
    rows = [(r["column"], r["count"], r["mean"], r["std"], r["min"], *q[r["column"]], r["max"]) for r in base]
    return local_frame(
        df.sparkSession, rows,
        "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double",
    )


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, unique, top, freq); the smallest value wins a tie for the top."""
    names = list(columns) if columns is not None else cols_of_kind(df, "text")
    vc = value_count_table(df, names)
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))))
    return vc.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("count"),
        F.count("value").alias("unique"),
        best.alias("_best"),
    ).select("column", "count", "unique", F.col("_best.value").alias("top"), (-F.col("_best.n")).alias("freq"))


def column_profiles(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null_ratio, unique_count, samples): samples are the three smallest values."""
    vc = value_count_table(df, df.columns)
    counts = vc.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("filled"),
        F.count("value").alias("unique_count"),
    )
    first = (
        vc.where("value IS NOT NULL")
        .withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy("value")))
        .where("_r <= 3")
        .groupBy("column")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("samples"))
    )
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return counts.join(first, "column", "left").select(
        "column",
        F.element_at(types, F.col("column")).alias("dtype"),
        F.round(F.col("filled") / F.greatest("rows", F.lit(1)), 4).alias("non_null_ratio"),
        "unique_count",
        F.coalesce("samples", F.lit("")).alias("samples"),
    )


def class_gate(df: DataFrame, target: str) -> DataFrame:
    """(classes, smallest, ok): at least two classes, each with at least two rows."""
    sizes = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("classes"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest")).withColumn(
        "ok", (F.col("classes") >= 2) & (F.col("smallest") >= 2)
    )


def numeric_gate(df: DataFrame, target: str, min_ratio: float = 0.8) -> DataFrame:
    """(valid_ratio, ok): share of target values that read as a number, null counted as not."""
    parsed = num(target) if is_numeric(df.schema[target].dataType) else parse_number_loose(col(target))
    return df.agg(F.coalesce(F.avg(parsed.isNotNull().cast("int")), F.lit(0.0)).alias("valid_ratio")).withColumn(
        "ok", F.col("valid_ratio") >= min_ratio
    )


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """(x, y, corr): Pearson over the rows where both are present; a row for every pair, both triangles and the diagonal.

    Null where a side has no value or is constant over those rows.
    """
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")
    if len(names) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    values = numbers(df, names)
    if len(pairs) <= JVM_PAIRS:
        wide = values.agg(*[varying_corr(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
        cells = F.array(*[
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs) for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
        ])
        out = wide.select(F.inline(cells))
    else:
        out = tiled_corr(values, names)
    value = F.when(~F.isnan("corr"), F.col("corr"))
    return out.select("x", "y", (F.round(value, digits) if digits is not None else value).alias("corr"))


def varying_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, null if a side is constant where both are present (where rounding can pass for variance)."""
    here = a.isNotNull() & b.isNotNull()
    a, b = F.when(here, a), F.when(here, b)
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.covar_pop(a, b) / spread)


def most_variable(df: DataFrame) -> DataFrame:
    """(column, variance) of the numeric column with the highest variance; the first on a tie."""
    names = cols_of_kind(df, "numeric")
    var = per_column(numbers(df, names), {
        c: {"variance": F.var_samp(col(c)), "position": F.max(F.lit(i))} for i, c in enumerate(names)
    }, limit=HEAVY)
    return var.where("variance IS NOT NULL").orderBy(F.desc("variance"), "position").limit(1).select("column", "variance")


def overview(df: DataFrame, targets: Sequence[str] = ()) -> DataFrame:
    """(section, name, value): shape, column kinds, target values, missing values, constant columns."""
    spark = df.sparkSession
    numeric, text = cols_of_kind(df, "numeric"), cols_of_kind(df, "text")
    fixed = [("columns", "", float(len(df.columns))), ("numeric_columns", "", float(len(numeric))), ("categorical_columns", "", float(len(text)))]
    fixed += [("categorical_example", c, float(i)) for i, c in enumerate(text[:6], 1)]
    fixed += [("numeric_example", c, float(i)) for i, c in enumerate(numeric[:6], 1)]
    known = [t for t in targets if t in df.columns]
    fixed += [("target_candidate", c, float(i)) for i, c in enumerate(known, 1)]
    out = local_frame(spark, fixed, "section string, name string, value double")
    out = out.unionByName(df.agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("section"), F.lit("").alias("name"), "value"))
    for t in known:
        top = value_counts(df, t, dropna=False, k=3)
        out = out.unionByName(top.select(
            F.concat(F.lit("target:"), F.lit(t)).alias("section"),
            F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("name"), F.col("n").cast("double").alias("value"),
        ))
    missing = missing_pct(df, k=5, digits=1)
    out = out.unionByName(missing.select(F.lit("missing").alias("section"), F.col("column").alias("name"), F.col("missing_pct").alias("value")))
    few = gated_counts(df, df.columns, lambda c, n: n <= 4, dropna=False)
    constant = local_frame(spark, [(c, n) for c, n in sorted(few.items()) if n <= 1][:8], "column string, n_distinct bigint")
    return out.unionByName(constant.select(F.lit("constant").alias("section"), F.col("column").alias("name"), F.col("n_distinct").cast("double").alias("value")))


def quality_snapshot(df: DataFrame, target: str | None = None) -> DataFrame:
    """(section, name, value): rows, columns, duplicates, top 15 missing, top 30 target values."""
    dup = duplicate_rows(df)
    facts = {"rows": F.col("rows"), "columns": F.lit(len(df.columns)), "duplicate_rows": F.col("duplicates")}
    out = dup.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("section"), F.lit("").alias("name"), v.cast("double").alias("value")) for k, v in facts.items()
    ])))
    missing = missing_pct(df, k=15, digits=4)
    out = out.unionByName(missing.select(F.lit("missing").alias("section"), F.col("column").alias("name"), F.col("missing_pct").alias("value")))
    if target is not None and target in df.columns:
        top = value_counts(df, target, dropna=False, k=30)
        out = out.unionByName(top.select(
            F.lit("target").alias("section"), F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("name"),
            F.col("n").cast("double").alias("value"),
        ))
    return out


def sanity(df: DataFrame) -> DataFrame:
    """One row: rows, columns, null cells, infinite cells and the columns with no value at all."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    rows = per_column(df, {
        c: {
            "n": F.count("*"),
            "missing": F.count_if(_is_missing(df, c)),
            "inf": F.count_if(F.abs(col(c)) == float("inf")) if c in floats else F.count_if(F.lit(False)),
        } for c in df.columns
    })
    return rows.agg(
        F.max("n").alias("rows"),
        F.count("*").alias("columns"),
        F.sum("missing").alias("nan_count"),
        F.sum("inf").alias("inf_count"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("missing") == F.col("n"), F.col("column")))), "|").alias("all_nan_columns"),
    )


def clip_bounds(df: DataFrame, low: float = 0.005, high: float = 0.995, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, low, high) of numeric columns with at least ten values and a spread between the bounds."""
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")
    values = numbers(df, names)
    counts = values.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    q = exact_quantiles(values, {c: [low, high] for i, c in enumerate(names) if counts[i] >= 10})
    rows = [(c, *v) for c, v in q.items() if v[0] is not None and v[0] < v[1]]
    return local_frame(df.sparkSession, rows, "column string, low double, high double")


def log_columns(df: DataFrame, columns: Sequence[str] | None = None, min_rows: int = 20, min_skew: float = 2.0) -> DataFrame:
    """(column, skew) of non-negative numeric columns whose corrected skew is at least two in size."""
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")
    stats = per_column(numbers(df, names), {
        c: {"n": F.count(col(c)), "low": F.min(col(c)), "skew": unbiased_skew(col(c))} for c in names
    }, limit=HEAVY)
    return stats.where(f"n >= {min_rows} AND low >= 0 AND abs(skew) >= {min_skew}").select("column", "skew")


def prune_lists(train: DataFrame) -> DataFrame:
    """(column, reason): high_missing above 60 %, constant, and high_cardinality text columns."""
    missing = missing_table(train, digits=15).withColumn("share", F.col("missing_percent") / 100).select("column", "share")
    rows = train.agg(F.count("*").alias("n")).first()["n"]
    text = cols_of_kind(train, "text")
    counts = gated_counts(train, train.columns, lambda c, n: n <= 4 or c in text and n > 80 and 0.4 <= n / max(1, rows) <= 0.6 or c in text and 80 < n < 130, dropna=False)
    vc = local_frame(train.sparkSession, list(counts.items()), "column string, n_distinct bigint")
    joined = vc.join(missing, "column").withColumn("filled_distinct", F.col("n_distinct") - (F.col("share") > 0).cast("int"))
    reasons = F.array_compact(F.array(
        F.when(F.col("share") > 0.6, F.lit("high_missing")),
        F.when(F.col("n_distinct") <= 1, F.lit("constant")),
        F.when(
            F.col("column").isin(text) & (F.col("filled_distinct") > 100) & (F.col("filled_distinct") / F.lit(max(1, rows)) > 0.5),
            F.lit("high_cardinality"),
        ),
    ))
    return joined.select("column", F.explode(reasons).alias("reason"))


def effective_cv(df: DataFrame, target: str, cv: int, task: str) -> int:
    """Folds the data can carry: limited by the smallest class or by the row count."""
    if cv < 2:
        raise ValueError("cross-validation needs at least two folds")
    if task == "classification":
        smallest = class_gate(df, target).first()["smallest"]
        return min(cv, max(2, smallest))
    folds = min(cv, df.limit(cv).count())
    if folds < 2:
        raise ValueError("not enough rows for cross-validation")
    return folds


QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def profile(df: DataFrame, top: int = 10, high_corr: float = 0.9) -> DataFrame:
    """Long profile (column, stat, value, text) of every column, plus alerts and duplicate rows."""
    spark = df.sparkSession
    numeric, text = cols_of_kind(df, "numeric"), cols_of_kind(df, "text")
    schema = "column string, stat string, value double, text string"
    rows_total = df.count()
    found: list[tuple] = []

    for r in missing_table(df, digits=15).collect():
        found += [(r["column"], "rows", float(rows_total), None), (r["column"], "n_null", float(r["missing_count"]), None)]
        if rows_total and r["missing_count"] / rows_total > 0.05:
            found.append((r["column"], "alert_missing", r["missing_count"] / rows_total, None))
    distinct = {r["column"]: r["n_distinct"] for r in distinct_counts(df).collect()}
    for c, n in distinct.items():
        found.append((c, "n_distinct", float(n), None))
        if n <= 1:
            found.append((c, "alert_constant", float(n), None))
        if c in text and n > 50 and n / max(1, rows_total) > 0.5:
            found.append((c, "alert_high_cardinality", float(n), None))

    if numeric:
        values = numbers(df, numeric)
        floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        infinite = {}
        if floats:
            row = df.agg(*[F.count_if(F.abs(col(c)) == float("inf")).alias(f"i{i}") for i, c in enumerate(floats)]).first()
            infinite = {c: row[i] for i, c in enumerate(floats)}
        basic = per_column(values, {
            c: {
                "n": F.count(col(c)), "n_zero": F.count_if(col(c) == 0), "n_negative": F.count_if(col(c) < 0),
                "mean": F.avg(col(c)), "std": F.stddev_samp(col(c)), "variance": F.var_samp(col(c)),
                "min": F.min(col(c)), "max": F.max(col(c)), "sum": F.sum(col(c)),
                "skewness": unbiased_skew(col(c)),
                "kurtosis": F.when(F.min(col(c)) < F.max(col(c)), F.kurtosis(col(c))),
            } for c in numeric
        }, limit=HEAVY).collect()
        q = exact_quantiles(values, {c: list(QUANTILES.values()) for c in numeric}, rows=rows_total)
        centred = values.select(*[F.abs(col(c) - F.lit(q[c][2])).alias(c) for c in numeric if q[c][2] is not None])
        mad = exact_quantiles(centred, {c: [0.5] for c in centred.columns}, rows=rows_total)
        for r in basic:
            c = r["column"]
            stats = {k: r[k] for k in r.asDict() if k not in ("column", "n")} | {"n_inf": infinite.get(c, 0)}
            if r["n"]:
                stats.update(dict(zip(QUANTILES, q[c])))
                stats.update(range=r["max"] - r["min"], iqr=q[c][3] - q[c][1], mad=mad[c][0])
                stats["cv"] = r["std"] / r["mean"] if r["mean"] and r["std"] is not None else None
            found += [(c, k, None if v is None else float(v), None) for k, v in stats.items()]
            if r["n"] and r["n_zero"] / r["n"] > 0.5:
                found.append((c, "alert_zeros", r["n_zero"] / r["n"], None))
            if r["skewness"] is not None and abs(r["skewness"]) > 20:
                found.append((c, "alert_skewed", float(r["skewness"]), None))
        if len(numeric) > 1:
            for r in corr_matrix(df, numeric).where(f"x < y AND abs(corr) > {high_corr}").collect():
                found.append((r["x"], "alert_high_correlation", r["corr"], r["y"]))
    out = local_frame(spark, found, schema)

    if text:
        lengths = per_column(df, {
            c: {
                "length_min": F.min(F.length(col(c).cast("string"))), "length_mean": F.avg(F.length(col(c).cast("string"))),
                "length_max": F.max(F.length(col(c).cast("string"))),
            } for c in text
        })
        out = out.unionByName(lengths.select("column", F.inline(F.array(*[
            F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
            for s in ("length_min", "length_mean", "length_max")
        ]))))
        tops = top_values(value_count_table(df, text).where("value IS NOT NULL"), top)
        out = out.unionByName(tops.select(
            "column", F.concat(F.lit("top_"), F.col("rank").cast("string")).alias("stat"),
            F.col("n").cast("double").alias("value"), F.col("value").alias("text"),
        ))
    dup = duplicate_rows(df).select(
        F.lit("").alias("column"), F.lit("duplicate_rows").alias("stat"),
        F.col("duplicates").cast("double").alias("value"), F.lit(None).cast("string").alias("text"),
    )
    return out.unionByName(dup)

