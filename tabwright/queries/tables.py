"""Sources, sinks, schema operators, de-duplication and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import dedupe, infer, schema
from tabwright.operators.valuecounts import dtype_table
from tabwright.plans import ask, contract, prepare
from tabwright.queries.base import add, on, rounded, scratch, sql_of, table, view
from tabwright.sources import tables as src


def _csv_round_trip(spark, folder):
    frame = view(spark, folder, "orders_text").select("o_orderkey", "price", "order_date", "urgent", (F.col("o_orderkey") / 4).alias("quarter"))
    path = f"{scratch(spark)}/orders.csv"
    frame.write.options(**src.CSV).csv(path)
    return src.read_table(spark, path)


def _csv_documents(files=None, multi_line=None):
    """Texts with quotes, commas and line feeds survive the way out and back."""
    def run(spark, folder):
        frame = table(spark, folder, "documents").withColumn("quoted", F.concat(F.lit('say "hi", '), F.col("text"), F.lit('\n"end"')))
        path = f"{scratch(spark)}/documents.csv"
        (frame.coalesce(files) if files else frame).write.options(**src.CSV).csv(path)
        return src.read_table(spark, path, multi_line=multi_line)
    return run


QUOTED = """
    SELECT *, 'say "hi", ' || text || chr(10) || '"end"' AS quoted FROM documents"""
add("csv_documents", _csv_documents(), QUOTED)
add("csv_documents_one_file", _csv_documents(files=1), QUOTED)
add("csv_documents_whole_files", _csv_documents(multi_line=True), QUOTED)


add("csv_read", _csv_round_trip, f"""
    SELECT o_orderkey, CASE WHEN price = 'N/A' THEN NULL ELSE price END AS price, order_date, urgent, o_orderkey / 4 AS quarter
    FROM {sql_of("orders_text")}""")
add("parquet_read", lambda s, d: src.read_table(s, f"{d}/nation.parquet"), "SELECT * FROM nation")
add("shape_gate", on("nation", lambda df: src.require_shape(df, 10, 2)), "SELECT * FROM nation")
add("table_shape", on("lineitem", src.shape), "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
add("preview", on("orders", lambda df: src.preview(df, 20, ["o_totalprice", "o_orderkey"])), "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
add("json_safe", on("line_odd", src.json_safe), f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN isfinite(v) THEN v END AS v FROM {sql_of("line_odd")}""")
add("json_rows", on("nation", src.to_json_rows), """
    SELECT concat('{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}') AS json FROM nation""")
add("stable_sample", on("orders", lambda df: src.stable_sample(df, ["o_orderkey"], 3000)), """
    SELECT * FROM orders ORDER BY md5(concat_ws('#', CAST(o_orderkey AS VARCHAR), 'sample', '42')), o_orderkey LIMIT 3000""")
for _name, _limit in (("stable_sample_ties", 100_000), ("stable_sample_ties_long", 500)):
    add(_name, on("lineitem", lambda df, k=_limit: src.stable_sample(df.select("l_returnflag"), ["l_returnflag"], 2000, limit=k).groupBy("l_returnflag").count()), """
        WITH h AS (SELECT l_returnflag, count(*) AS n, md5(l_returnflag || '#sample#42') AS h FROM lineitem GROUP BY ALL),
        c AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS below FROM h)
        SELECT l_returnflag, CAST(least(n, 2000 - below) AS BIGINT) AS count FROM c WHERE below < 2000""")


def _write_session(spark, folder):
    path = src.write_session(view(spark, folder, "orders_missing"), scratch(spark), "s1", "processed")
    return spark.read.parquet(path)


def _write_predictions(spark, folder):
    path = f"{scratch(spark)}/predictions"
    src.write_predictions(view(spark, folder, "pred_rows").select("l_orderkey", "y", "p"), path)
    return spark.read.schema("l_orderkey bigint, y int, p int").option("header", True).csv(path)


def _write_report(spark, folder):
    path = f"{scratch(spark)}/report"
    src.write_report(view(spark, folder, "line_odd"), path)
    return spark.read.schema("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, v double").json(path)


add("session_write", _write_session, f"SELECT * FROM {sql_of('orders_missing')}")
add("predictions_write", _write_predictions, f"SELECT l_orderkey, y, p FROM {sql_of('pred_rows')}")
add("report_write", _write_report, f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN isfinite(v) THEN v END AS v FROM {sql_of('line_odd')}")

add("normalize_names", on("nation", lambda df: schema.normalize_names(df.toDF(" Nation  Key ", "NAME!", "name"))),
    "SELECT n_nationkey AS nation_key, n_name AS name, n_regionkey AS name_1 FROM nation")
add("align_schema", on("customer", lambda df: schema.align_schema(
    df.withColumnRenamed("c_acctbal", " C_AcctBal "), [("c_custkey", "bigint"), ("c_acctbal", "double"), ("c_rating", "double"), ("c_mktsegment", "string")])),
    "SELECT c_custkey, c_acctbal, CAST(NULL AS DOUBLE) AS c_rating, c_mktsegment FROM customer")
add("drop_columns", on("supplier", lambda df: schema.drop_cols(df, ["s_name", "not_there"])), "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
add("drop_null_target", on("orders_missing", lambda df: schema.drop_null_target(df, "o_totalprice")),
    f"SELECT * FROM {sql_of('orders_missing')} WHERE o_totalprice IS NOT NULL")
NUMBER_TEXT = "TRY_CAST(nullif(regexp_replace({c}, '[^0-9.\\-]+', '', 'g'), '') AS DOUBLE)"
add("numeric_target", on("orders_text", lambda df: schema.numeric_target(df, "price").select("o_orderkey", "price", "status")), f"""
    SELECT o_orderkey, {NUMBER_TEXT.format(c="price")} AS price, status FROM {sql_of("orders_text")}
    WHERE {NUMBER_TEXT.format(c="price")} IS NOT NULL""")
add("column_types", on("orders", dtype_table), """
    SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'),
    ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) t("column", dtype)""")
add("protected_columns", on("lineitem", schema.protected_table), """
    WITH n AS (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS f, count(DISTINCT l_linestatus) AS s FROM lineitem)
    SELECT c AS "column", CASE c WHEN 'l_returnflag' THEN f = 2 OR (f <= 10 AND f / n <= 0.02)
                               WHEN 'l_linestatus' THEN s = 2 OR (s <= 10 AND s / n <= 0.02) ELSE false END AS protected
    FROM n, (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount',
                            'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']) AS c)""")
add("bad_target_examples", on("orders", lambda df: schema.bad_target_examples(df, "o_orderpriority", 5)), """
    SELECT DISTINCT o_orderpriority AS value FROM orders
    WHERE TRY_CAST(nullif(regexp_replace(o_orderpriority, '[^0-9.\\-]+', '', 'g'), '') AS DOUBLE) IS NULL ORDER BY value LIMIT 5""")
add("apply_casts", on("orders_text", lambda df: infer.apply_casts(
    df, {"price": "float", "order_date": "date", "urgent": "boolean", "status": "integer", "absent": "float"}).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))), f"""
    SELECT o_orderkey, {NUMBER_TEXT.format(c="price")} AS price, TRY_CAST(order_date AS TIMESTAMP) AS order_date, urgent = 'Yes' AS urgent, status
    FROM {sql_of("orders_text")}""")

MANIFEST = {
    "session_id": "s1", "task": "classification", "features": ["price", "order_date", "urgent", "status", "region"],
    "kinds": {"price": "numeric", "order_date": "datetime", "urgent": "boolean", "status": "categorical", "region": "categorical"},
    "categories": {"status": ["o", "f"]}, "dropped_features": ["x"], "pruned_features": {}, "versions": {"pyspark": "3.4.0", "python": "3.13.1"},
}
CONTRACT_SQL = f"""
    WITH t AS {sql_of("orders_text")},
    v AS (
        SELECT 'price' AS subject, 'values_not_of_kind' AS "check", CAST(0 AS BIGINT) AS bad, count(*) AS filled FROM t WHERE price <> 'N/A'
        UNION ALL SELECT 'order_date', 'values_not_of_kind', count(*) FILTER (WHERE TRY_CAST(order_date AS DATE) IS NULL), count(*) FROM t
        UNION ALL SELECT 'status', 'unseen_categories', count(*) FILTER (WHERE lower(status) NOT IN ('o', 'f')), count(*) FROM t
    )
    SELECT 'warning' AS severity, "check", subject, round(bad / filled, 6) AS value FROM v WHERE bad > 0
    UNION ALL SELECT 'error', 'missing_column', 'region', NULL
    UNION ALL SELECT 'warning', 'extra_column', 'o_orderkey', NULL
    UNION ALL SELECT 'error', 'version_mismatch', 'pyspark: trained 3.4.0, now 4.1.2', NULL
    UNION ALL SELECT 'error', 'session_mismatch', 's1', NULL"""
VERSIONS = {"pyspark": "4.1.2", "python": "3.13.0"}
add("check_contract", on("orders_text", lambda df: contract.check_contract(df, MANIFEST, True, "s2", VERSIONS)), CONTRACT_SQL)
add("contract_valid", on("orders_text", lambda df: contract.contract_valid(contract.check_contract(df, MANIFEST, True, "s2", VERSIONS))), f"""
    SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS valid, count(*) FILTER (WHERE severity = 'error') AS errors,
           count(*) FILTER (WHERE severity = 'warning') AS warnings FROM ({CONTRACT_SQL})""")

add("dedupe", on("orders_dup", dedupe.dedupe), f"SELECT DISTINCT * FROM {sql_of('orders_dup')}")
add("duplicate_rows", on("orders_dup", dedupe.duplicate_rows), f"""
    SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {sql_of('orders_dup')})) AS distinct_rows,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {sql_of('orders_dup')})) AS duplicates FROM {sql_of('orders_dup')}""")

SAME = ["l_partkey", "l_discount", "l_tax"]


def _sides(spark, folder):
    rows = view(spark, folder, "line_gaps")
    return rows.where("l_linenumber >= 5"), rows.where("l_linenumber < 5")


SIDES = f"""
    WITH test AS (SELECT * FROM {sql_of("line_gaps")} WHERE l_linenumber >= 5), train AS (SELECT * FROM {sql_of("line_gaps")} WHERE l_linenumber < 5)
    SELECT * FROM test WHERE {{no}} EXISTS (SELECT 1 FROM train WHERE {" AND ".join(f"train.{c} IS NOT DISTINCT FROM test.{c}" for c in SAME)})"""
add("remove_overlap", lambda s, d: dedupe.remove_overlap(*_sides(s, d), SAME), SIDES.format(no="NOT"))
add("overlap_rows", lambda s, d: dedupe.overlap_rows(*_sides(s, d), SAME), SIDES.format(no=""))

add("ask_sql", on("orders_missing", lambda df: ask.ask(
    df, "SELECT o_orderstatus, count(*) AS orders, round(avg(o_totalprice), 4) AS mean_price FROM data WHERE o_orderpriority IS NOT NULL GROUP BY o_orderstatus")),
    f"""SELECT o_orderstatus, count(*) AS orders, round(avg(o_totalprice), 4) AS mean_price FROM {sql_of("orders_missing")}
        WHERE o_orderpriority IS NOT NULL GROUP BY o_orderstatus""")

add("prepare_upload", on("part_units", lambda df: rounded(prepare.prepare(df), 6, "weight_value", "lasts_minutes")), f"""
    SELECT DISTINCT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size,
           round(CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.001 ELSE p_size * 1.0 END AS DOUBLE), 6) AS weight_value,
           round(CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size * 1440.0 ELSE p_size * 60.0 + 30 END AS DOUBLE), 6) AS lasts_minutes,
           CAST(p_size AS DOUBLE) AS stock_number, 'items left' AS stock_text,
           split_part(pair, '-', 1) AS pair_part1, split_part(pair, '-', 2) AS pair_part2
    FROM {sql_of("part_units")}""")


def _template(spark, folder):
    from tabwright.plans.scoring import input_template

    return input_template(table(spark, folder, "customer"), {"features": ["c_acctbal", "c_mktsegment", "c_rating"]})


add("input_template", _template, """
    SELECT c_acctbal, c_mktsegment, CAST(NULL AS VARCHAR) AS c_rating FROM customer ORDER BY c_acctbal NULLS FIRST, c_mktsegment NULLS FIRST LIMIT 10""")
