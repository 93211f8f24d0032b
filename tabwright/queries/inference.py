"""Type, kind and target inference, and the cleaner."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import cleaner, infer
from tabwright.operators.scale import local_frame
from tabwright.operators.valuecounts import value_count_table
from tabwright.queries.base import add, on, rounded, scratch, sql_of, table, view

TEXT = sql_of("orders_text")
LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM {TEXT}" for c in ("price", "order_date", "urgent", "status"))
LOOSE = "TRY_CAST(nullif(regexp_replace(v, '[^0-9.\\-]+', '', 'g'), '') AS DOUBLE)"
add("recommend_types", on("orders_text", infer.recommend_types), f"""
    SELECT "column", CASE WHEN avg(CAST({LOOSE} IS NOT NULL AS INTEGER)) >= 0.9 THEN CASE WHEN bool_and({LOOSE} % 1 = 0) THEN 'integer' ELSE 'float' END
                          WHEN avg(CAST(TRY_CAST(v AS DATE) IS NOT NULL AS INTEGER)) >= 0.9 THEN 'date' ELSE 'object' END AS dtype
    FROM ({LONG}) GROUP BY "column" UNION ALL SELECT 'o_orderkey', 'integer'""")
add("recommend_types_rich", on("part_units", lambda df: infer.recommend_types(
    df.select("p_size", "weight", "lasts", F.concat(F.lit("$"), F.col("p_size")).alias("cost"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"),
              F.when(F.col("p_size") > 20, "yes").otherwise("No").alias("big")), "rich")), f"""
    WITH t AS (SELECT weight, lasts, concat('$', p_size) AS cost, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, CASE WHEN p_size > 20 THEN 'yes' ELSE 'No' END AS big FROM {sql_of("part_units")}),
    l AS (SELECT 'weight' AS c, weight AS v FROM t UNION ALL SELECT 'lasts', lasts FROM t UNION ALL SELECT 'cost', cost FROM t UNION ALL SELECT 'code', code FROM t UNION ALL SELECT 'big', big FROM t)
    SELECT c AS "column", CASE WHEN bool_and(lower(v) IN ('yes', 'no')) THEN 'boolean' WHEN bool_or(regexp_matches(v, '^0[0-9]+$')) THEN 'object'
        WHEN bool_or(regexp_matches(v, '^[0-9]+(h 30min| days)$')) THEN 'object' WHEN avg(CAST(regexp_matches(v, '^[$][0-9]+$') AS INTEGER)) >= 0.9 THEN 'float' ELSE 'object' END AS dtype
    FROM l GROUP BY c UNION ALL SELECT 'p_size', 'integer'""")
add("infer_kinds", on("orders_text", infer.infer_kinds), f"""
    SELECT "column", CASE WHEN avg(CAST(lower(v) IN ('yes', 'no', 'f') AS INTEGER)) >= 0.98 THEN 'boolean'
                          WHEN avg(CAST(TRY_CAST(v AS DATE) IS NOT NULL AS INTEGER)) >= CASE WHEN "column" LIKE '%date%' THEN 0.5 ELSE 0.9 END THEN 'datetime'
                          WHEN avg(CAST(TRY_CAST(regexp_replace(v, '[$ ]|usd', '', 'g') AS DOUBLE) IS NOT NULL AS INTEGER)) >= 0.9 THEN 'numeric' ELSE 'categorical' END AS kind
    FROM ({LONG}) WHERE v <> 'N/A' GROUP BY "column" UNION ALL SELECT 'o_orderkey', 'numeric'""")


def _targets(spark, folder):
    orders = table(spark, folder, "orders")
    found = {
        "named": infer.choose_target(orders, "what drives o_orderstatus"), "keyword": infer.choose_target(orders, "predict the churn"),
        "fallback": infer.fallback_target(orders), "fallback_number": infer.fallback_target(orders.select("o_orderstatus", "o_totalprice")),
    }
    return local_frame(spark, [(k, v["target"], v["task"]) for k, v in found.items()], "rule string, target string, task string")


# every choice is taken again in SQL from the counts of the table
add("choose_target", _targets, """
    WITH s AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS d_status, count(DISTINCT o_custkey) AS d_cust, count(DISTINCT o_totalprice) AS d_price FROM orders)
    SELECT 'named' AS rule, 'o_orderstatus' AS target, CASE WHEN d_status <= 20 THEN 'classification' ELSE 'regression' END AS task FROM s
    UNION ALL SELECT 'keyword', 'o_custkey', CASE WHEN d_cust > 25 THEN 'regression' ELSE 'classification' END FROM s
    UNION ALL SELECT 'fallback', 'o_orderpriority', 'classification' FROM s
    UNION ALL SELECT 'fallback_number', 'o_totalprice', CASE WHEN d_price / n > 0.05 THEN 'regression' ELSE 'classification' END FROM s""")


def _cleaned(spark, folder):
    rows = view(spark, folder, "orders_missing").drop("o_orderkey", "o_custkey")
    key = view(spark, folder, "orders_missing").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    model = cleaner.RobustCleaner(carry=["o_orderkey"]).fit(rows)
    return rounded(model.transform(key), 4, "o_totalprice")


add("cleaner_transform", _cleaned, f"""
    WITH t AS {sql_of("orders_missing")}, q AS (SELECT quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM t)
    SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus,
           round(CASE WHEN o_totalprice IS NULL THEN NULL ELSE least(greatest(o_totalprice, lo), hi) END, 4) AS o_totalprice,
           CAST(o_totalprice IS NULL AS INTEGER) AS o_totalprice__missing,
           {", ".join(f"CAST({e} AS DOUBLE) AS o_orderdate__{p}" for p, e in (("year", "year(o_orderdate)"), ("month", "month(o_orderdate)"), ("day", "day(o_orderdate)"),
                      ("weekday", "isodow(o_orderdate) - 1"), ("hour", "hour(o_orderdate)"), ("minute", "minute(o_orderdate)")))},
           lower(o_orderpriority) AS o_orderpriority, CAST(o_orderpriority IS NULL AS INTEGER) AS o_orderpriority__missing
    FROM t, q""")
SEGMENTS = f"""SELECT c_custkey, CASE WHEN trim(lower(segment)) = 'ny' THEN 'new york' WHEN trim(lower(segment)) = 'u s a' THEN 'united states' ELSE trim(lower(segment)) END AS s
    FROM {sql_of("customer_variants")}"""
RARE_LIMIT = "greatest(20, ceil(0.01 * (SELECT count(*) FROM customer)))"


def _categories(spark, folder, unseen):
    rows = view(spark, folder, "customer_variants")
    model = cleaner.RobustCleaner(carry=["c_custkey"]).fit(rows)
    if unseen:
        rows = rows.withColumn("segment", F.when(F.col("c_custkey") % 4 == 0, F.concat("segment", F.lit(" of the moon"))).otherwise(F.col("segment")))
    return model.transform(rows)


add("rare_categories", lambda s, d: _categories(s, d, False), f"""
    WITH s AS ({SEGMENTS}), n AS (SELECT s, count(*) AS n FROM s GROUP BY s)
    SELECT c_custkey, CASE WHEN n < {RARE_LIMIT} THEN '__other__' ELSE s.s END AS segment FROM s JOIN n ON s.s = n.s""")
add("unseen_categories", lambda s, d: _categories(s, d, True), f"""
    WITH s AS ({SEGMENTS}), n AS (SELECT s, count(*) AS n FROM s GROUP BY s)
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR n < {RARE_LIMIT} THEN '__other__' ELSE s.s END AS segment FROM s JOIN n ON s.s = n.s""")
add("rare_table", on("customer_variants", lambda df: cleaner.rare_table(value_count_table(df, ["segment"]))), f"""
    SELECT 'segment' AS "column", segment AS value, count(*) AS n, count(*) < {RARE_LIMIT} AS rare FROM {sql_of("customer_variants")} GROUP BY segment""")
add("fuzzy_map", on("part", lambda df: cleaner.fuzzy_map(value_count_table(df.select("p_name", "p_type"), ["p_name", "p_type"]))))
# spellings of 100 words: as they are, with a letter more, with a blank inside
SPELLED = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN md5(CAST(c_custkey % 100 AS string))
    WHEN 1 THEN concat(md5(CAST(c_custkey % 100 AS string)), 'x') ELSE concat(substr(md5(CAST(c_custkey % 100 AS string)), 1, 9), ' ', substr(md5(CAST(c_custkey % 100 AS string)), 10)) END AS word FROM {customer}"""
add("fuzzy_map_variants", lambda s, d: cleaner.fuzzy_map(value_count_table(s.sql(SPELLED, customer=table(s, d, "customer")), ["word"])), f"""
    WITH v AS (SELECT DISTINCT word FROM ({SPELLED.format(customer="customer")})), g AS (SELECT word, substr(replace(word, ' ', ''), 1, 32) AS base FROM v)
    SELECT 'word' AS "column", word AS value, first_value(word) OVER (PARTITION BY base ORDER BY length(word), word) AS canonical FROM g""")


def _long_dictionary(spark, folder):
    """A cleaner whose category list is a table, saved, loaded and applied."""
    rows = table(spark, folder, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey") % 50).alias("name"), (F.col("p_size") * 1.0).alias("size"))
    limit, cleaner.INLINE_CATEGORIES = cleaner.INLINE_CATEGORIES, 10
    try:
        model = cleaner.RobustCleaner(carry=["p_partkey"], rareMinCount=2, rareFreq=0.0, highCardinality=10_000_000).fit(rows)
    finally:
        cleaner.INLINE_CATEGORIES = limit
    path = f"{scratch(spark)}/cleaner"
    model.write().save(path)
    loaded = cleaner.RobustCleanerModel.load(path)
    return loaded.transform(rows.withColumn("name", F.when(F.col("p_partkey") % 9 > 0, F.col("name")))).select("p_partkey", "name")


add("long_dictionary", _long_dictionary, """
    WITH t AS (SELECT p_partkey, lower(p_name || ' ' || (p_partkey % 50)) AS name FROM part), n AS (SELECT name, count(*) AS n FROM t GROUP BY name)
    SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN CASE WHEN n >= 2 THEN t.name ELSE '__other__' END END AS name FROM t JOIN n ON n.name = t.name""")
KINDS_DROPPED = """SELECT o_orderkey, o_orderstatus, 'same' AS one_word, 7 AS one_number, concat('customer ', CAST(o_orderkey AS string)) AS many_words, CAST('2020-01-01' AS date) AS one_day FROM {orders}"""
add("cleaner_drops", lambda s, d: cleaner.RobustCleaner().fit(s.sql(KINDS_DROPPED, orders=table(s, d, "orders"))).audit(s).where(
    "section = 'dropped'").select("column", F.col("value").alias("reason")), f"""
    WITH t AS ({KINDS_DROPPED.format(orders="orders")})
    SELECT 'one_word' AS "column", 'zero_variance' AS reason FROM t HAVING count(DISTINCT one_word) <= 1
    UNION ALL SELECT 'one_number', 'zero_variance' FROM t HAVING count(DISTINCT one_number) <= 1
    UNION ALL SELECT 'one_day', 'zero_variance' FROM t HAVING count(DISTINCT one_day) <= 1
    UNION ALL SELECT 'many_words', 'high_cardinality' FROM t HAVING count(DISTINCT many_words) > 250 AND count(DISTINCT many_words) / count(*) > 0.7""")
add("missing_indicators", on("orders_missing", lambda df: cleaner.RobustCleaner().fit(df).audit(df.sparkSession).where("section = 'missing_indicator'").select("column")), f"""
    SELECT 'o_totalprice' AS "column" FROM {sql_of("orders_missing")} HAVING count(*) > count(o_totalprice)
    UNION ALL SELECT 'o_orderpriority' FROM {sql_of("orders_missing")} HAVING count(*) > count(o_orderpriority)""")
SKEWED = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice * l_extendedprice * CASE WHEN l_partkey % 50 = 0 THEN 100.0 ELSE 1.0 END AS v FROM {lineitem}"


def _clip_log(spark, folder):
    rows = spark.sql(SKEWED, lineitem=table(spark, folder, "lineitem"))
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return rounded(cleaner.RobustCleaner(carry=key).fit(rows).transform(rows), 6, "v")


add("clip_then_log", _clip_log, f"""
    WITH t AS ({SKEWED.format(lineitem="lineitem")}), q AS (SELECT quantile_cont(CAST(v AS DOUBLE), 0.005) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.995) AS hi FROM t)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(ln(1 + least(greatest(v, lo), hi)), 6) AS v FROM t, q""")
add("cleaner_audit", on("lineitem", lambda df: cleaner.RobustCleaner().fit(df).audit(df.sparkSession)))
