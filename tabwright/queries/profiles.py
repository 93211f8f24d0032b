"""Profiles, aggregates and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import charts, profile
from tabwright.operators.valuecounts import distinct_counts, value_counts
from tabwright.queries.base import add, on, rounded, sql_of, table

MISSING = sql_of("orders_missing")
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


def union(columns, part) -> str:
    return " UNION ALL ".join(part(c) for c in columns)


def missing_sql(digits: int) -> str:
    return union(ORDER_COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), {digits}) AS missing_pct FROM {MISSING}")


TOP_MISSING = "SELECT * FROM ({q}) WHERE missing_pct > 0 ORDER BY missing_pct DESC, \"column\" LIMIT {k}"
add("missing_pct", on("orders_missing", lambda df: profile.missing_pct(df, 10, 2)), TOP_MISSING.format(q=missing_sql(2), k=10))
add("missing_pct_top15", on("orders_missing", lambda df: profile.missing_pct(df, 15, 4)), TOP_MISSING.format(q=missing_sql(4), k=15))
add("missing_table", on("orders_missing", profile.missing_table), union(
    ORDER_COLUMNS, lambda c: f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
        round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS missing_percent FROM {MISSING}"""))
add("distinct_counts", on("orders_missing", distinct_counts), union(
    ORDER_COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM {MISSING}"))
add("distinct_with_null", on("orders_missing", lambda df: distinct_counts(df, dropna=False)), union(
    ORDER_COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CAST({c} IS NULL AS BIGINT)) AS n_distinct FROM {MISSING}"))
add("value_counts", on("orders_missing", lambda df: value_counts(df, "o_orderpriority")), f"""
    SELECT o_orderpriority AS value, count(*) AS n FROM {MISSING} WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
add("value_counts_with_null", on("orders_missing", lambda df: value_counts(df, "o_custkey", dropna=False, k=30)), f"""
    SELECT o_custkey AS value, count(*) AS n FROM {MISSING} GROUP BY 1 ORDER BY n DESC, value LIMIT 30""")
add("class_gate", on("orders_missing", lambda df: profile.class_gate(df, "o_orderpriority")), f"""
    SELECT count(*) AS classes, min(n) AS smallest, count(*) >= 2 AND min(n) >= 2 AS ok
    FROM (SELECT count(*) AS n FROM {MISSING} WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)""")
add("numeric_gate", on("orders_text", lambda df: rounded(profile.numeric_gate(df, "price"), 6, "valid_ratio")), f"""
    SELECT round(avg(CAST(price <> 'N/A' AS INTEGER)), 6) AS valid_ratio, avg(CAST(price <> 'N/A' AS INTEGER)) >= 0.8 AS ok FROM {sql_of("orders_text")}""")
add("describe_numeric", on("lineitem", lambda df: rounded(profile.describe_numeric(df), 4, "mean", "std", "p25", "p50", "p75")), union(
    LINE_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""))
add("describe_categorical", on("orders_missing", profile.describe_categorical), union(
    ["o_orderstatus", "o_orderpriority"], lambda c: f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS "unique",
        (SELECT {c} FROM {MISSING} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
        (SELECT count(*) FROM {MISSING} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq FROM {MISSING}"""))
TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
add("column_profiles", on("orders_missing", profile.column_profiles), union(
    ORDER_COLUMNS, lambda c: f"""SELECT '{c}' AS "column", '{TYPES[c]}' AS dtype, round(count({c}) / count(*), 4) AS non_null_ratio,
        count(DISTINCT {c}) AS unique_count,
        (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {MISSING} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples
        FROM {MISSING}"""))


def corr_sql(columns, digits: int, source: str) -> str:
    pairs = [(a, b) for a in columns for b in columns]
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), {digits}) AS corr FROM {source}" for a, b in pairs)


add("corr_matrix", on("lineitem", lambda df: rounded(profile.corr_matrix(df), 6, "corr")), corr_sql(LINE_NUMBERS, 6, "lineitem"))
add("corr_matrix_gaps", on("orders_missing", lambda df: profile.corr_matrix(df, digits=2)), corr_sql(["o_orderkey", "o_custkey", "o_totalprice"], 2, MISSING))
FLAT_COLUMNS = ["l_quantity", "l_discount", "flat", "empty", "l_tax"]


def _flat(n):
    """Correlations of n columns, one of them constant and one without values: n * n rows either way."""
    def run(df):
        wide = df.withColumns({"flat": F.lit(0.1), "empty": F.lit(None).cast("double")})
        return rounded(profile.corr_matrix(wide, FLAT_COLUMNS[:n]), 6, "corr")
    return run


for _n in (4, 5):
    add(f"corr_constant_{_n}", on("lineitem", _flat(_n)), "\nUNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, " + ("max(CAST(NULL AS DOUBLE))" if {x, y} & {"flat", "empty"} else f"round(corr({x}, {y}), 6)") + " AS corr FROM lineitem"
        for x in FLAT_COLUMNS[:_n] for y in FLAT_COLUMNS[:_n]))
add("most_variable", on("lineitem", lambda df: rounded(profile.most_variable(df), 0, "variance")),
    "SELECT 'l_extendedprice' AS \"column\", round(var_samp(l_extendedprice), 0) AS variance FROM lineitem")
HISTOGRAM = """
    WITH s AS (SELECT {c} AS x, min({c}) OVER () AS lo, (max({c}) OVER () - min({c}) OVER ()) / 40 AS w FROM {t} WHERE {c} IS NOT NULL),
    b AS (SELECT CAST(least(floor((x - lo) / w), 39) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1),
    l AS (SELECT min({c}) AS lo, (max({c}) - min({c})) / 40 AS w FROM {t})
    SELECT '{c}' AS "column", CAST(i AS INTEGER) AS bin, round(lo + i * w, 4) AS low, round(lo + (i + 1) * w, 4) AS high, coalesce(n, 0) AS n
    FROM range(40) r(i) CROSS JOIN l LEFT JOIN b ON b.bin = r.i"""
add("histogram", on("lineitem", lambda df: rounded(charts.histogram(df), 4, "low", "high")), HISTOGRAM.format(c="l_extendedprice", t="lineitem"))
add("histogram_gaps", on("orders_missing", lambda df: rounded(charts.histogram(df, "o_totalprice"), 4, "low", "high")), HISTOGRAM.format(c="o_totalprice", t=MISSING))
BOX = """
    WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS q3 FROM {t}),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""
add("box_stats", on("events", lambda df: rounded(charts.box_stats(df, "value"), 4, "q1", "median", "q3")), BOX.format(c="value", t="events") + """
    SELECT 'value' AS "column", round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3,
           min(value) FILTER (WHERE value BETWEEN lo AND hi) AS low_whisker, max(value) FILTER (WHERE value BETWEEN lo AND hi) AS high_whisker,
           count(*) FILTER (WHERE value NOT BETWEEN lo AND hi) AS outliers FROM events, f""")
add("box_outliers", on("events", lambda df: charts.box_outliers(df, "value").select("event_id", "value")), BOX.format(c="value", t="events") + """
    SELECT event_id, value FROM events, f WHERE value < lo OR value > hi""")
add("scatter_points", on("lineitem", charts.scatter_points), "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem")
add("scatter_sample", on("orders", lambda df: charts.scatter_points(df, n=2000, key=["o_orderkey"])), """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5(concat_ws('#', CAST(o_orderkey AS VARCHAR), 'sample', '42')), o_orderkey LIMIT 2000""")
add("bar_counts", on("orders_missing", charts.bar_counts), f"""
    SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM {MISSING} WHERE o_orderpriority IS NOT NULL GROUP BY 2""")
add("missing_chart", on("orders_missing", charts.missing_chart), f"SELECT * FROM ({missing_sql(2)}) WHERE missing_pct > 0")
DASHBOARD = f"""
    SELECT 'missing_values' AS chart, CAST(0 AS INTEGER) AS priority, 'missing' AS series, "column" AS label, missing_pct AS value FROM ({missing_sql(2)}) WHERE missing_pct > 0
    UNION ALL SELECT 'correlation', 1, x, y, corr FROM ({corr_sql(["o_orderkey", "o_custkey", "o_totalprice"], 2, MISSING)})
    UNION ALL SELECT 'distribution', 2, "column", CAST(bin AS VARCHAR), CAST(n AS DOUBLE) FROM ({HISTOGRAM.format(c="o_totalprice", t=MISSING)})
    UNION ALL SELECT 'bar', 3, 'o_orderpriority', o_orderpriority, CAST(count(*) AS DOUBLE) FROM {MISSING} WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority"""
add("dashboard", on("orders_missing", charts.dashboard), DASHBOARD)
add("dashboard_box_scatter", on("customer", lambda df: charts.dashboard(df.select("c_custkey", "c_acctbal"), ["boxplot", "scatter"]).where("chart = 'boxplot'").withColumn("value", F.round("value", 4))),
    BOX.format(c="c_acctbal", t="customer") + """, s AS (
        SELECT any_value(q1) AS q1, any_value(m) AS median, any_value(q3) AS q3, min(c_acctbal) FILTER (WHERE c_acctbal BETWEEN lo AND hi) AS low_whisker,
               max(c_acctbal) FILTER (WHERE c_acctbal BETWEEN lo AND hi) AS high_whisker, CAST(count(*) FILTER (WHERE c_acctbal NOT BETWEEN lo AND hi) AS DOUBLE) AS outliers
        FROM customer, f)
    SELECT 'boxplot' AS chart, CAST(5 AS INTEGER) AS priority, 'c_acctbal' AS series, label, round(value, 4) AS value
    FROM (UNPIVOT s ON q1, median, q3, low_whisker, high_whisker, outliers INTO NAME label VALUE value)""")
add("overview", on("orders_missing", lambda df: profile.overview(df.withColumn("source", F.lit("shop")), ["o_orderpriority", "absent"])), f"""
    SELECT 'columns' AS section, '' AS name, CAST(7 AS DOUBLE) AS value UNION ALL SELECT 'numeric_columns', '', 3 UNION ALL SELECT 'categorical_columns', '', 3
    UNION ALL SELECT * FROM (VALUES ('categorical_example', 'o_orderstatus', 1), ('categorical_example', 'o_orderpriority', 2), ('categorical_example', 'source', 3),
        ('numeric_example', 'o_orderkey', 1), ('numeric_example', 'o_custkey', 2), ('numeric_example', 'o_totalprice', 3), ('target_candidate', 'o_orderpriority', 1), ('constant', 'source', 1))
    UNION ALL SELECT 'rows', '', count(*) FROM {MISSING}
    UNION ALL (SELECT 'target:o_orderpriority', coalesce(o_orderpriority, 'null'), count(*) AS n FROM {MISSING} GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3)
    UNION ALL SELECT 'missing', "column", missing_pct FROM ({TOP_MISSING.format(q=missing_sql(1), k=5)})""")
add("quality_snapshot", on("orders_dup", lambda df: profile.quality_snapshot(df, "o_orderpriority")), f"""
    SELECT 'rows' AS section, '' AS name, CAST(count(*) AS DOUBLE) AS value FROM {sql_of("orders_dup")}
    UNION ALL SELECT 'columns', '', 6
    UNION ALL SELECT 'duplicate_rows', '', (SELECT count(*) FROM {sql_of("orders_dup")}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {sql_of("orders_dup")}))
    UNION ALL SELECT 'target', o_orderpriority, count(*) FROM {sql_of("orders_dup")} GROUP BY o_orderpriority""")
add("sanity_check", on("line_odd", lambda df: profile.sanity(df.withColumn("empty", F.lit(None).cast("double")))), f"""
    SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(count(*) + count(*) FILTER (WHERE isnan(v)) AS BIGINT) AS nan_count,
           count(*) FILTER (WHERE isinf(v)) AS inf_count, 'empty' AS all_nan_columns FROM {sql_of("line_odd")}""")
add("clip_bounds", on("lineitem", lambda df: rounded(profile.clip_bounds(df), 3, "low", "high")), union(
    LINE_NUMBERS, lambda c: f"""SELECT '{c}' AS "column", round(quantile_cont(CAST({c} AS DOUBLE), 0.005), 3) AS low,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.995), 3) AS high FROM lineitem"""))
SKEWED = "SELECT *, l_extendedprice * l_extendedprice * l_extendedprice * CASE WHEN l_partkey % 50 = 0 THEN 100.0 ELSE 1.0 END AS v FROM {lineitem}"
add("log_columns", lambda s, d: rounded(profile.log_columns(s.sql(SKEWED, lineitem=table(s, d, "lineitem")), ["l_quantity", "v"]), 6, "skew"), f"""
    SELECT 'v' AS "column", round(skewness(v), 6) AS skew FROM ({SKEWED.format(lineitem="lineitem")})""")
PRUNE = """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN NULL ELSE o_totalprice END AS mostly_gone, 'x' AS same,
                  concat('order ', CAST(o_orderkey AS string)) AS code FROM {orders}"""
add("prune_lists", lambda s, d: profile.prune_lists(s.sql(PRUNE, orders=table(s, d, "orders"))), f"""
    WITH t AS ({PRUNE.format(orders="orders")}), n AS (SELECT count(*) AS n FROM t)
    SELECT 'mostly_gone' AS "column", 'high_missing' AS reason FROM t HAVING avg(CAST(mostly_gone IS NULL AS INTEGER)) > 0.6
    UNION ALL SELECT 'same', 'constant' FROM t HAVING count(DISTINCT same) <= 1
    UNION ALL SELECT 'code', 'high_cardinality' FROM t HAVING count(DISTINCT code) > 100 AND count(DISTINCT code) / count(*) > 0.5""")


def _folds(spark, folder):
    rows = table(spark, folder, "part")
    found = [("p_brand", profile.effective_cv(rows, "p_brand", 100, "classification")), ("p_size", profile.effective_cv(rows, "p_size", 5, "regression"))]
    return spark.createDataFrame(found, "target string, folds int")


add("effective_cv", _folds, """
    SELECT 'p_brand' AS target, CAST(least(100, greatest(2, min(n))) AS INTEGER) AS folds FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)
    UNION ALL SELECT 'p_size', CAST(least(5, count(*)) AS INTEGER) FROM part""")


def _profile_sql() -> str:
    t, c, x = MISSING, "o_totalprice", "o_orderpriority"
    stats = {
        "n_zero": f"count(*) FILTER (WHERE {c} = 0)", "n_negative": f"count(*) FILTER (WHERE {c} < 0)", "n_inf": f"count(*) FILTER (WHERE isinf({c}))", "mean": f"avg({c})", "std": f"stddev_samp({c})",
        "min": f"min({c})", "max": f"max({c})", "skewness": f"skewness({c})", "kurtosis": f"kurtosis_pop({c})",
        **{k: f"quantile_cont({c}, {q})" for k, q in profile.QUANTILES.items()}, "range": f"max({c}) - min({c})",
        "iqr": f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "cv": f"stddev_samp({c}) / avg({c})", "mad": f"mad({c})",
    }
    parts = [f"SELECT '{c}' AS \"column\", '{k}' AS stat, round(CAST({e} AS DOUBLE), 3) AS value, NULL AS text FROM {t}" for k, e in stats.items()]
    for col in (c, x):
        parts += [f"SELECT '{col}', 'rows', count(*), NULL FROM {t}", f"SELECT '{col}', 'n_null', count(*) FILTER (WHERE {col} IS NULL), NULL FROM {t}",
                  f"SELECT '{col}', 'n_distinct', count(DISTINCT {col}), NULL FROM {t}",
                  f"SELECT '{col}', 'alert_missing', round(avg(CAST({col} IS NULL AS INTEGER)), 3), NULL FROM {t}"]
    parts += [f"SELECT '{x}', 'length_{k}', round(CAST({k2}(length({x})) AS DOUBLE), 3), NULL FROM {t}" for k, k2 in (("min", "min"), ("mean", "avg"), ("max", "max"))]
    parts.append(f"SELECT '{x}', concat('top_', row_number() OVER (ORDER BY count(*) DESC, {x})), count(*), {x} FROM {t} WHERE {x} IS NOT NULL GROUP BY {x}")
    parts.append(f"SELECT '', 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {c}, {x} FROM {t})), NULL FROM {t}")
    return " UNION ALL ".join(parts)


add("profile", on("orders_missing", lambda df: profile.profile(df.select("o_totalprice", "o_orderpriority")).where(
    "stat NOT IN ('sum', 'variance')").withColumn("value", F.round("value", 3))), _profile_sql())
add("profile_lineitem", on("lineitem", profile.profile))
MOMENT_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
MOMENTS = {"rows": "count(*)", "n_null": "count(*) - count({c})", "n_distinct": "count(DISTINCT {c})", "n_zero": "count(*) FILTER (WHERE {c} = 0)", "n_negative": "count(*) FILTER (WHERE {c} < 0)",
           "n_inf": "0 * count(*)", "mean": "avg({c})", "std": "stddev_samp({c})", "variance": "var_samp({c})", "sum": "sum({c})", "min": "min({c})", "max": "max({c})", "range": "max({c}) - min({c})",
           "cv": "stddev_samp({c}) / avg({c})", "skewness": "skewness({c})", "p5": "quantile_cont({c}, 0.05)", "p50": "quantile_cont({c}, 0.5)", "p95": "quantile_cont({c}, 0.95)"}
add("profile_moments", on("lineitem", lambda df: profile.profile(df.select(*MOMENT_COLUMNS)).where(F.col("stat").isin(list(MOMENTS))).select("column", "stat", F.round("value", 2).alias("value"))),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS stat, round(CAST({e.format(c=c)} AS DOUBLE), 2) AS value FROM lineitem" for c in MOMENT_COLUMNS for k, e in MOMENTS.items()))
