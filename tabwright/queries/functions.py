"""Column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import dates, numbers, text, units
from tabwright.operators import cleaner, infer
from tabwright.queries.base import add, on, rounded, sql_of, table, view

SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"
CLEAN = "nullif(trim(regexp_replace(replace(regexp_replace({c}, '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g'), chr(65533), ''), '" + SPACES.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')), '')"
HOLDERS = ", ".join(f"'{p}'" for p in text.PLACEHOLDERS)


def only(key, exprs):
    """The key and the columns that ``exprs`` builds once a session exists."""
    return lambda df: df.select(key, *[e.alias(n) for n, e in exprs().items()])


add("clean_text", on("documents", only("doc_id", lambda: dict(text=text.clean_text(F.col("text"))))), f"SELECT doc_id, {CLEAN.format(c='text')} AS text FROM documents")
add("lower_text", on("conversations", lambda df: df.select("conv_id", "turn", text.clean_text(F.col("text"), lower=True).alias("text"))),
    f"SELECT conv_id, turn, lower({CLEAN.format(c='text')}) AS text FROM conversations")
# digits as wide as the letters of East Asian text, which composition turns into plain ones
WIDE = """SELECT o_orderkey, concat(translate(CAST(o_orderkey AS string), '0123456789', '０１２３４５６７８９'), '　㎏') AS wide FROM {orders}"""


def _wide(spark, folder):
    return spark.sql(WIDE, orders=table(spark, folder, "orders"))


add("compose_text", lambda s, d: _wide(s, d).select("o_orderkey", text.clean_text(F.col("wide"), compose=True).alias("plain")), "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ' kg' AS plain FROM orders")
add("infer_kinds_composed", lambda s, d: infer.infer_kinds(_wide(s, d)), """
    SELECT 'o_orderkey' AS "column", 'numeric' AS kind UNION ALL
    SELECT 'wide', CASE WHEN avg(CAST(TRY_CAST(o_orderkey AS DOUBLE) IS NOT NULL AS INTEGER)) >= 0.9 THEN 'numeric' ELSE 'categorical' END FROM orders""")
add("null_placeholders", on("orders_text", only("o_orderkey", lambda: dict(price=text.null_placeholders(F.col("price"))))),
    f"SELECT o_orderkey, CASE WHEN lower(price) IN ({HOLDERS}) THEN NULL ELSE price END AS price FROM {sql_of('orders_text')}")
add("canonical_json", on("events_json", only("event_id", lambda: dict(props=text.canonical_json(F.col("props"))))),
    f"SELECT event_id, CASE WHEN json_valid(props) THEN CAST(json(props) AS VARCHAR) ELSE props END AS props FROM {sql_of('events_json')}")
add("flatten_nested", on("nation", lambda df: text.flatten_nested(df.select("n_nationkey", F.struct(F.col("n_name").alias("b"), F.col("n_regionkey").alias("a")).alias("s")))),
    """SELECT n_nationkey, concat('{"a":', n_regionkey, ',"b":"', n_name, '"}') AS s FROM nation""")
add("decode_text", on("documents", only("doc_id", lambda: dict(text=text.decode_text(F.encode(F.col("text"), "UTF-8"))))), "SELECT doc_id, text FROM documents")
add("truncate_text", on("documents", only("doc_id", lambda: dict(text=text.truncate(F.col("text"), 5000)))), "SELECT doc_id, substring(text, 1, 5000) AS text FROM documents")
add("parse_bool", on("orders_text", only("o_orderkey", lambda: dict(urgent=numbers.parse_bool(F.col("urgent")), status=numbers.parse_bool(F.col("status"))))), f"""
    SELECT o_orderkey, CASE WHEN lower(urgent) = 'yes' THEN 1.0::DOUBLE WHEN lower(urgent) = 'no' THEN 0.0::DOUBLE END AS urgent,
           CASE WHEN lower(status) = 'f' THEN 0.0::DOUBLE END AS status FROM {sql_of("orders_text")}""")
add("parse_number", on("orders_text", only("o_orderkey", lambda: dict(price=numbers.parse_number(F.col("price"))))), f"""
    SELECT o_orderkey, TRY_CAST(regexp_replace(regexp_replace(lower(price), '[,%\\s$€£₹¥]', '', 'g'), '({"|".join(numbers.TRAILING_UNITS)})$', '') AS DOUBLE) AS price
    FROM {sql_of("orders_text")}""")
add("parse_number_loose", on("part_units", only("p_partkey", lambda: dict(weight=numbers.parse_number_loose(F.col("weight")), lasts=numbers.parse_number_loose(F.col("lasts"))))), f"""
    SELECT p_partkey, TRY_CAST(regexp_replace(weight, '[^0-9.\\-]+', '', 'g') AS DOUBLE) AS weight,
           TRY_CAST(regexp_replace(lasts, '[^0-9.\\-]+', '', 'g') AS DOUBLE) AS lasts FROM {sql_of("part_units")}""")
add("parse_date_dayfirst", on("orders_dates", only("o_orderkey", lambda: dict(d=dates.parse_date(F.col("d"), dayfirst=True).cast("timestamp_ntz")))), f"""
    SELECT o_orderkey, coalesce(TRY_CAST(d AS TIMESTAMP), try_strptime(d, '%d/%m/%Y')) AS d FROM {sql_of("orders_dates")}""")
CLOCKS_SQL = """CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + to_minutes(CAST(o_custkey % 60 AS BIGINT))
    + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 0 SECOND ELSE INTERVAL 7123456 MICROSECOND END
    + CASE o_orderkey % 5 WHEN 0 THEN INTERVAL 5 HOUR WHEN 1 THEN INTERVAL (-2) HOUR ELSE INTERVAL 0 HOUR END"""
add("parse_date_clocks", on("orders_clocks", only("o_orderkey", lambda: dict(d=dates.parse_date(F.col("d"), dayfirst=True).cast("timestamp_ntz")))), f"SELECT o_orderkey, {CLOCKS_SQL} AS d FROM orders")


def _voted(spark, folder):
    """The cleaner's dates of a column that is written day first, which its days above the twelfth tell."""
    rows = view(spark, folder, "orders_clocks").withColumnRenamed("d", "order_date")
    model = cleaner.RobustCleaner(carry=["o_orderkey"]).fit(rows)
    parts = ["year", "month", "day", "hour", "minute"]
    return model.transform(rows).select("o_orderkey", *[F.col(f"order_date__{p}").cast("int").alias(p) for p in parts])


add("date_order_vote", _voted, f"""
    SELECT o_orderkey, {", ".join(f"CAST({p}(d) AS INTEGER) AS {p}" for p in ("year", "month", "day", "hour", "minute"))} FROM (SELECT o_orderkey, {CLOCKS_SQL} AS d FROM orders)""")
add("parse_date_monthfirst", on("orders_dates", only("o_orderkey", lambda: dict(d=dates.parse_date(F.col("d")).cast("timestamp_ntz")))), f"""
    SELECT o_orderkey, coalesce(TRY_CAST(d AS TIMESTAMP), try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%d/%m/%Y')) AS d FROM {sql_of("orders_dates")}""")
add("time_of_day", on("events", only("event_id", lambda: dict(at=dates.time_of_day(F.col("ts"))))), "SELECT event_id, strftime(ts, '%H:%M:%S') AS at FROM events")
PARTS = {"year": "year({c})", "month": "month({c})", "day": "day({c})", "weekday": "isodow({c}) - 1", "hour": "hour({c})", "minute": "minute({c})"}
add("expand_datetime_clean", on("events", lambda df: dates.expand_datetime(df.select("event_id", "ts"), "ts")), "SELECT event_id, " + ", ".join(
    f"CAST({e.format(c='ts')} AS DOUBLE) AS ts__{p}" for p, e in PARTS.items()) + " FROM events")
add("expand_datetime_upload", on("orders", lambda df: dates.expand_datetime(df.select("o_orderkey", "o_orderdate"), "o_orderdate", "upload")), "SELECT o_orderkey, " + ", ".join(
    f"CAST({e.format(c='o_orderdate')} AS INTEGER) AS o_orderdate_{p}" for p, e in PARTS.items() if p != "year") + " FROM orders")
add("duration_minutes", on("part_units", only("p_partkey", lambda: dict(minutes=units.duration_minutes(F.col("lasts"))))), f"""
    SELECT p_partkey, CAST(CASE WHEN lasts LIKE '% days' THEN p_size * 1440.0 ELSE p_size * 60.0 + 30.0 END AS DOUBLE) AS minutes FROM {sql_of("part_units")}""")
add("unit_value", on("part_units", lambda df: rounded(df.select("p_partkey", units.unit_value(F.col("weight"), "kg").alias("kg")), 6, "kg")), f"""
    SELECT p_partkey, round(CAST(CASE WHEN weight LIKE '% kg' THEN p_size ELSE p_size / 1000.0 END AS DOUBLE), 6) AS kg FROM {sql_of("part_units")}""")
add("split_structured", on("part_units", lambda df: df.select(
    "p_partkey", units.split_structured(F.col("stock"))["number"].alias("number"), F.array_join(units.split_structured(F.col("stock"))["parts"], " ").alias("words"),
    F.get(units.split_structured(F.col("pair"))["parts"], F.lit(0)).alias("part1"), F.get(units.split_structured(F.col("pair"))["parts"], F.lit(1)).alias("part2"))), f"""
    SELECT p_partkey, CAST(regexp_extract(stock, '^([0-9]+)', 1) AS DOUBLE) AS number, 'items left' AS words,
           split_part(pair, '-', 1) AS part1, split_part(pair, '-', 2) AS part2 FROM {sql_of("part_units")}""")
add("safe_extract", on("pages", only("page_id", lambda: dict(lang=text.safe_extract(F.col("html"), 'lang="([a-z]+)"'), nothing=text.safe_extract(F.col("url"), "nomatch([0-9]+)")))), """
    SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, '' AS nothing FROM pages""")
add("category_alias", on("customer_variants", only("c_custkey", lambda: dict(segment=text.apply_alias(F.col("segment"))))), f"""
    SELECT c_custkey, CASE lower(trim(segment)) WHEN 'ny' THEN 'new york' WHEN 'u s a' THEN 'united states' ELSE lower(trim(segment)) END AS segment
    FROM {sql_of("customer_variants")}""")
add("log1p_clipped", on("customer", lambda df: rounded(df.select("c_custkey", numbers.log1p_clipped(F.col("c_acctbal")).alias("v")), 6, "v")),
    "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS v FROM customer")
add("clip_values", on("orders_missing", only("o_orderkey", lambda: dict(v=numbers.clip(F.col("o_totalprice"), 50000.0, 400000.0)))),
    f"SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL ELSE least(greatest(o_totalprice, 50000.0), 400000.0) END AS v FROM {sql_of('orders_missing')}")
add("round_half_even", on("lineitem", lambda df: df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", numbers.to_int(F.col("l_quantity") / 2).alias("v"))),
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS v FROM lineitem")
add("integer_like", on("lineitem", lambda df: df.agg(numbers.is_integral(F.col("l_quantity")).alias("quantity"), numbers.is_integral(F.col("l_tax")).alias("tax"))),
    "SELECT bool_and(l_quantity % 1 = 0) AS quantity, bool_and(l_tax % 1 = 0) AS tax FROM lineitem")
add("missing_flag", on("orders_missing", only("o_orderkey", lambda: dict(flag=numbers.missing_flag(F.col("o_totalprice"))))),
    f"SELECT o_orderkey, CAST(o_totalprice IS NULL AS INTEGER) AS flag FROM {sql_of('orders_missing')}")
