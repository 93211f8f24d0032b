"""Feature scores and selection rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.numbers import parse_number_loose
from tabwright.operators.encode import impute_median
from tabwright.operators.neighbor_info import neighbor_mutual_info
from tabwright.operators.profile import HEAVY, corr_matrix, num, numbers, numeric_gate, per_column, prune_lists, varying_corr
from tabwright.operators.scale import RANK_ROWS, chunks, col, exact_quantiles, local_frame, lookup, running_totals
from tabwright.operators.subspace import component_ratios
from tabwright.operators.valuecounts import cols_of_kind, distinct_counts, is_numeric, long_values
from tabwright.session import checkpointed

AGGREGATED_FEATURES = 100
MOMENTS = 10  # correlations per job
PCA_FEATURES = 1000  # up to here the covariance matrix sits on the driver, beyond it is never built
LEAK_CORR = 0.999
ID_RATIO = 0.98


def rank_by_corr(df: DataFrame, target: str, absolute: bool = False, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, corr, rank) by correlation with the target, signed unless ``absolute``; nulls last."""
    names = [c for c in (features or cols_of_kind(df, "numeric")) if c != target]
    values = numbers(df, [*names, target])
    found = per_column(values, {c: {"corr": varying_corr(col(c), col(target))} for c in names}, "feature", limit=MOMENTS)
    value = F.when(~F.isnan("corr"), F.col("corr"))
    found = found.select("feature", value.alias("corr"))
    order = F.abs(F.col("corr")) if absolute else F.col("corr")
    w = Window.partitionBy(F.lit(0)).orderBy(order.desc_nulls_last(), "feature")  # one row per feature
    return found.withColumn("rank", F.row_number().over(w))


def select_regression(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """Correlation ranking and matrix; the target must read as a number in half of the rows."""
    if not numeric_gate(df, target, 0.5).first()["ok"]:
        raise ValueError("fewer than half of the target values are numbers")
    if not is_numeric(df.schema[target].dataType):
        df = df.withColumn(target, parse_number_loose(col(target)))
    return {"ranking": rank_by_corr(df, target), "matrix": corr_matrix(df)}


def label_codes(df: DataFrame, columns: Sequence[str], rank_rows: int = RANK_ROWS) -> DataFrame:
    """(column, value, code): values of each column numbered from 0 in text order, null as ``nan``."""
    values = long_values(df, columns).select("column", F.coalesce("value", F.lit("nan")).alias("value")).distinct()
    placed = running_totals(values, ["column", "value"], {"place": F.lit(1)}, rank_rows=rank_rows)
    starts = placed.groupBy("column").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "column").select("column", "value", (F.col("place") - F.col("start")).cast("bigint").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], rank_rows: int = RANK_ROWS) -> DataFrame:
    """The columns replaced by their codes."""
    codes = label_codes(df, columns, rank_rows)
    out = df
    for i, c in enumerate(columns):
        side = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        out = lookup(out, F.coalesce(col(c).cast("string"), F.lit("nan")), side, f"_v{i}").drop(f"_v{i}")
    keep = [F.col(f"_c{columns.index(c)}").alias(c) if c in columns else col(c) for c in df.columns]
    return out.select(*keep)


def shift_nonneg(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with negative values moved up so that their minimum is zero."""
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")
    low = df.agg(*[F.min(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    moves = {c: low[i] for i, c in enumerate(names) if low[i] is not None and low[i] < 0}
    return df.select(*[(col(c) - F.lit(moves[c])).alias(c) if c in moves else col(c) for c in df.columns])


def chi2_scores(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, chi2) of non-negative features: class sums against sums shared out by class size."""
    names = [c for c in (features or cols_of_kind(df, "numeric")) if c != target]
    out = None
    for part in chunks(names, AGGREGATED_FEATURES):
        per_class = df.where(col(target).isNotNull()).groupBy(col(target).alias("_y")).agg(
            F.count("*").alias("_n"), *[F.sum(num(c)).alias(c) for c in part]
        )
        long = per_class.unpivot(["_y", "_n"], [col(c) for c in part], "feature", "observed")
        totals = long.groupBy("feature").agg(F.sum("observed").alias("total"), F.sum("_n").alias("rows"))
        expected = F.col("total") * F.col("_n") / F.col("rows")
        scored = long.join(F.broadcast(totals), "feature").withColumn("e", expected).groupBy("feature").agg(
            F.sum(F.when(F.col("e") != 0, (F.col("observed") - F.col("e")) ** 2 / F.when(F.col("e") != 0, F.col("e")))).alias("chi2")
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def bucket(c: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted cuts lie below a value, found by halving; null stays null."""
    if not cuts:
        return F.when(c.isNotNull(), F.lit(first))
    middle = len(cuts) // 2
    right = bucket(c, cuts[middle + 1 :], first + middle + 1)
    return F.when(c > F.lit(cuts[middle]), right).otherwise(bucket(c, cuts[:middle], first))


def mutual_info(df: DataFrame, target: str, bins: int = 32, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, mutual_info) in nats. Numbers fall in quantile bins, text values are their own bins."""
    names = [c for c in (features or df.columns) if c != target]
    numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
    text = [c for c in names if c not in numeric]
    kept = df.where(col(target).isNotNull()).select(col(target).cast("string").alias("_y"), *[col(c) for c in names])
    rows = numbers(kept, numeric, ["_y", *text])
    edges = exact_quantiles(rows, {c: [i / bins for i in range(1, bins)] for c in numeric})

    # one pass for all features: the partial counts of a task have one row per bin and class
    places = [(bucket(col(c), sorted({e for e in edges[c] if e is not None})) if c in numeric else col(c)).cast("string").alias(c) for c in names]
    long = rows.select("_y", *places).unpivot(["_y"], [col(c) for c in names], "feature", "bin")
    joint = checkpointed(long.groupBy("feature", F.coalesce("bin", F.lit("nan")).alias("bin"), "_y").agg(F.count("*").alias("n")))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    by_class = joint.groupBy("feature", "_y").agg(F.sum("n").alias("n_class"))
    totals = joint.groupBy("feature").agg(F.sum("n").alias("total"))
    joined = joint.join(by_bin, ["feature", "bin"]).join(by_class, ["feature", "_y"]).join(F.broadcast(totals), "feature")
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    term = n / total * F.log(n * total / (F.col("n_bin").cast("double") * F.col("n_class").cast("double")))
    return joined.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_info"))


def select_classification(df: DataFrame, target: str, features: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Scores and correlations for a class target.

    ``scores`` has (feature, chi2, mutual_info, rank) by mutual information, ties by name: text is numbered in text order, chi2 is
    taken after a shift to a zero minimum, mutual information by nearest neighbours. ``matrix`` correlates the numeric columns.
    """
    names = [c for c in (features or df.columns) if c != target]
    kept = df.where(col(target).isNotNull()).select(*[col(c) for c in [*names, target]])
    flags = [c for c in names if isinstance(df.schema[c].dataType, T.BooleanType)]
    text = [c for c in names if c not in flags and not is_numeric(df.schema[c].dataType)]
    coded = kept.withColumns({c: col(c).cast("int") for c in flags}) if flags else kept
    coded = checkpointed(label_encode(coded, text) if text else coded)
    chi2 = chi2_scores(shift_nonneg(coded, names), target, names)
    found = neighbor_mutual_info(coded, target, names).join(chi2, "feature", "left")  # a row per feature
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("mutual_info"), "feature")
    scores = found.select("feature", "chi2", "mutual_info", F.row_number().over(w).alias("rank"))
    return {"scores": scores, "matrix": corr_matrix(df)}


def variance_filter(df: DataFrame, threshold: float = 0.01, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, variance, keep) by population variance."""
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")
    found = per_column(numbers(df, names), {c: {"variance": F.var_pop(col(c))} for c in names}, "feature", limit=HEAVY)
    return found.withColumn("keep", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def array_columns(df: DataFrame, column: str, size: int, prefix: str = "x") -> DataFrame:
    """The first ``size`` elements of an array column as double columns; null arrays give nulls."""
    return df.select("*", *[F.get(col(column), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(size)]).drop(column)


def array_size(df: DataFrame, column: str) -> int:
    """The length that all arrays of a column have, nulls apart; arrays of different lengths are an error."""
    low, high = df.where(col(column).isNotNull()).agg(F.min(F.size(col(column))), F.max(F.size(col(column)))).first()
    if low != high:
        raise ValueError(f"arrays of {low} to {high} elements in {column}")
    if low is None:
        raise ValueError(f"no array in {column}")
    return low


def pca_ratio(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None, square: int = PCA_FEATURES) -> DataFrame:
    """(component, ratio): share of variance of the first k principal components; nulls count as the median of their feature.

    More than ``square`` features are taken by subspace iteration, to the same ratios.
    """
    names = list(columns) if columns is not None else cols_of_kind(df, "numeric")
    rows = df.select(*[num(c).alias(c) for c in names])
    filled = {c: n for part in chunks(names, AGGREGATED_FEATURES) for c, n in rows.agg(*[F.count(col(c)).alias(c) for c in part]).first().asDict().items()}
    empty = [c for c in names if filled[c] == 0]
    if empty:
        raise ValueError(f"no number in {', '.join(empty)}")
    total = rows.count()
    gaps = [c for c in names if filled[c] < total]
    for part in chunks(gaps, AGGREGATED_FEATURES):
        rows = impute_median(rows, part)
    if len(names) > square:
        ratios = component_ratios(rows.select(F.array(*[col(c) for c in names]).alias("_features")), "_features", len(names), k)
        return local_frame(df.sparkSession, list(enumerate(ratios, 1)), "component int, ratio double")
    features = VectorAssembler(inputCols=names, outputCol="_features").transform(rows).select("_features")
    model = PCA(k=min(k, len(names)), inputCol="_features", outputCol="_pca").fit(features)
    ratios = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return local_frame(df.sparkSession, ratios, "component int, ratio double")


def select_clustering(df: DataFrame, sample_key: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Correlations, variance filter, component shares and five rows for unsupervised work."""
    variance = variance_filter(df)
    kept = [r["feature"] for r in variance.where("keep").collect()]
    return {
        "variance": variance,
        "matrix": corr_matrix(df),
        "pca": pca_ratio(df, 5, kept),
        "sample": df.orderBy(*[col(c) for c in (sample_key or df.columns)]).limit(5),
    }


def rank_features(df: DataFrame, target: str, task: str) -> DataFrame:
    """(feature, score, rank, selected, reason): every feature but the target, once.

    Scores are absolute correlation or mutual information divided by the best one. Dropped:
    identifiers, mostly missing, constant and text columns of too many values, and features
    that repeat the target.
    """
    features = [c for c in df.columns if c != target]
    rows = max(1, df.count())
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    reasons: dict[str, str] = {}
    for r in prune_lists(df.select(*[col(c) for c in features])).orderBy("column", "reason").collect():
        reasons.setdefault(r["column"], r["reason"])
    keyed = [c for c in features if isinstance(df.schema[c].dataType, (T.StringType, T.IntegralType))]
    if keyed:
        for r in distinct_counts(df, columns=keyed).where(F.col("n_distinct") / F.lit(rows) >= ID_RATIO).collect():
            reasons.setdefault(r["column"], "identifier")
    y = df
    if not is_numeric(df.schema[target].dataType):
        y = label_encode(df, [target])
    corr = {r["feature"]: r["corr"] for r in rank_by_corr(y, target, features=numeric).collect()} if numeric else {}
    for c, v in corr.items():
        if v is not None and abs(v) >= LEAK_CORR:
            reasons.setdefault(c, "repeats_target")
    if task == "regression":
        raw = {c: abs(corr.get(c) or 0.0) for c in features}
    else:
        raw = {c: 0.0 for c in features}
        scored = [c for c in features if reasons.get(c) not in ("identifier", "high_cardinality")]
        if scored:
            raw.update({r["feature"]: r["mutual_info"] for r in mutual_info(df, target, features=scored).collect()})
    best = max(raw.values(), default=0.0) or 1.0
    ranked = sorted(features, key=lambda c: (-raw[c], c))
    out = [(c, float(raw[c] / best), i, c not in reasons, reasons.get(c, "informative")) for i, c in enumerate(ranked, 1)]
    return local_frame(df.sparkSession, out, "feature string, score double, rank int, selected boolean, reason string")
