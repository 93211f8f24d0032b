"""Registry, table access and the dirty views that Spark and the checking SQL share."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# The tables hold no gaps, copies or text numbers, so these views make them, over all rows.
VIEWS = {
    "orders_missing": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    "orders_dup": "SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 10 = 0",
    "orders_text": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE concat('$ ', CAST(o_totalprice AS string), ' usd') END AS price,
               CASE WHEN o_orderkey % 17 = 0 THEN 'bad-date' ELSE CAST(CAST(o_orderdate AS date) AS string) END AS order_date,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'no' END AS urgent,
               o_orderstatus AS status
        FROM {orders}""",
    "orders_dates": """
        SELECT o_orderkey,
               CASE o_orderkey % 4
                    WHEN 0 THEN concat(CAST(day(o_orderdate) AS string), '/', CAST(month(o_orderdate) AS string), '/', CAST(year(o_orderdate) AS string))
                    WHEN 1 THEN CAST(CAST(o_orderdate AS date) AS string)
                    WHEN 2 THEN concat(CAST(CAST(o_orderdate AS date) AS string), ' 10:30:05')
                    ELSE 'bad-date' END AS d
        FROM {orders}""",
    "orders_clocks": """
        SELECT o_orderkey,
               concat(lpad(CAST(day(o_orderdate) AS string), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS string), 2, '0'), '/', CAST(year(o_orderdate) AS string), ' ',
                      CAST(CASE WHEN o_orderkey % 24 % 12 = 0 THEN 12 ELSE o_orderkey % 24 % 12 END AS string), ':', lpad(CAST(o_custkey % 60 AS string), 2, '0'),
                      CASE o_orderkey % 3 WHEN 0 THEN '' ELSE ':07.123456789' END, CASE WHEN o_orderkey % 24 < 12 THEN ' am' ELSE ' PM' END,
                      CASE o_orderkey % 5 WHEN 0 THEN ' EST' WHEN 1 THEN '+0200' ELSE '' END) AS d
        FROM {orders}""",
    "part_units": """
        SELECT p_partkey, p_size,
               concat(CAST(p_size AS string), CASE WHEN p_partkey % 3 = 0 THEN ' g' ELSE ' kg' END) AS weight,
               CASE WHEN p_partkey % 5 = 0 THEN concat(CAST(p_size AS string), ' days') ELSE concat(CAST(p_size AS string), 'h 30min') END AS lasts,
               concat(CAST(p_size AS string), ' items left') AS stock,
               replace(p_name, ' ', '-') AS pair
        FROM {part}""",
    "customer_variants": """
        SELECT c_custkey,
               CASE WHEN c_custkey % 499 = 0 THEN 'one of a kind'
                    WHEN c_custkey % 6 = 0 THEN lower(c_mktsegment)
                    WHEN c_custkey % 6 = 1 THEN concat('  ', c_mktsegment, '   ')
                    WHEN c_custkey % 6 = 2 THEN 'NY'
                    WHEN c_custkey % 6 = 3 THEN 'u s a'
                    ELSE c_mktsegment END AS segment
        FROM {customer}""",
    "events_json": """
        SELECT event_id, CASE WHEN event_id % 19 = 0 THEN concat(props, 'x') ELSE props END AS props FROM {events}""",
    "line_gaps": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax, l_returnflag
        FROM {lineitem}""",
    "line_odd": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN l_partkey % 9 = 0 THEN CAST('NaN' AS double)
                    WHEN l_partkey % 9 = 1 THEN CAST('Infinity' AS double)
                    WHEN l_partkey % 9 = 2 THEN CAST('-Infinity' AS double)
                    ELSE l_discount END AS v
        FROM {lineitem}""",
    "pred_rows": """
        SELECT l_orderkey, CAST(l_orderkey % 2 AS int) AS y,
               CAST(CASE WHEN l_partkey % 4 = 0 THEN 1 - l_orderkey % 2 ELSE l_orderkey % 2 END AS int) AS p,
               CAST(l_partkey % 50 + 20 * (l_orderkey % 2) AS double) / 100 AS score
        FROM {lineitem}""",
    "pred_classes": """
        SELECT CAST(l_orderkey % 3 AS int) AS y,
               CAST(CASE WHEN l_partkey % 5 = 0 THEN l_suppkey % 3 ELSE l_orderkey % 3 END AS int) AS p,
               CAST(l_partkey % 40 + CASE WHEN l_orderkey % 3 = 0 THEN 15 ELSE 0 END AS double) / 100 AS s0,
               CAST(l_suppkey % 40 + CASE WHEN l_orderkey % 3 = 1 THEN 10 ELSE 0 END AS double) / 100 AS s1,
               CAST(l_linenumber + CASE WHEN l_orderkey % 3 = 2 THEN 2 ELSE 0 END AS double) / 100 AS s2
        FROM {lineitem}""",
    "board_class": """
        SELECT concat('model_', CAST(l_linenumber AS string)) AS Model,
               round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 4) AS Accuracy,
               round(avg(l_discount) * 10, 2) AS Balanced_Accuracy
        FROM {lineitem} GROUP BY l_linenumber""",
    "board_reg": """
        SELECT concat('model_', CAST(l_linenumber AS string)) AS Model, round(avg(l_tax) * 10, 4) AS R2_Score, round(avg(l_quantity), 4) AS RMSE
        FROM {lineitem} GROUP BY l_linenumber""",
    "line_sample": "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM {lineitem}",
    "doc_quality": "SELECT d.n_chars, d.lang, d.source, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
}


def names_in(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(sql) if f})


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name], **{t: table(spark, folder, t) for t in names_in(VIEWS[name])})


def sql_of(name: str) -> str:
    """A view as a subquery for the checking SQL."""
    text = VIEWS[name]
    return "(" + text.format(**{t: t for t in names_in(text)}) + ")"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def on(source: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of one view or table."""
    read = view if source in VIEWS else table
    return lambda spark, folder: f(read(spark, folder, source))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one; a local one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return f"{root.rstrip('/')}/tabwright-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tabwright-")
