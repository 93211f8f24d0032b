"""Reading flat tables, checking them, and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.scale import BROADCAST_ROWS, chunks, col, fingerprint, hash_part, key_hash
from tabwright.sources.quoted import parsed, quoted_records

# Text a CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
INTEGER_TEXT = r"^\s*[+-]?[0-9]{1,18}\s*$"
DECIMAL_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
FLAG_TEXT = "^(True|False|TRUE|FALSE|true|false)$"

#: Quotes inside a quoted value are doubled, and white space around a value belongs to it.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None, na_tokens: Sequence[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """Parquet as it is; CSV with a header, missing-value tokens nulled, then types inferred.

    Types are inferred after the tokens are gone, so one ``N/A`` does not turn a number
    column into text. All columns are judged in one pass. Whether quoted values hold line feeds is found
    by a scan, and files are read in splits either way (``quoted``). ``multi_line`` names Spark's reader instead:
    off, line feeds always end a row; on, one task reads a whole file.
    """
    fmt = fmt or ("csv" if str(path).lower().endswith(".csv") else "parquet")
    if fmt == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if fmt != "csv":
        raise ValueError(f"unsupported format: {fmt}")
    tokens = NA_TOKENS if na_tokens is None else list(na_tokens)
    records = quoted_records(spark, path) if multi_line is None else None
    raw = spark.read.options(**CSV).option("multiLine", bool(multi_line) or records is not None).csv(path)
    if records is not None:
        raw = parsed(records, raw.columns, CSV)
    text = raw.select(*[F.when(~col(c).isin(tokens), col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        fields = {f.name: f.dataType for f in schema.fields}
        return text.select(*[col(c).try_cast(fields[c]).alias(c) for c in text.columns if c in fields])
    return infer_text_types(text)


def infer_text_types(text: DataFrame) -> DataFrame:
    """Cast text columns whose every value is whole, decimal or a flag."""
    kinds: dict[str, str] = {}
    for part in chunks(text.columns, 40):
        row = text.agg(*[
            e for i, c in enumerate(part) for e in (
                F.bool_and(col(c).rlike(INTEGER_TEXT)).alias(f"i{i}"),
                F.bool_and(col(c).rlike(DECIMAL_TEXT)).alias(f"d{i}"),
                F.bool_and(col(c).rlike(FLAG_TEXT)).alias(f"b{i}"),
            )
        ]).first()
        for i, c in enumerate(part):
            kinds[c] = "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else "boolean" if row[f"b{i}"] else "string"
    return text.select(*[
        (F.trim(col(c)) if k != "string" else col(c)).try_cast(k).alias(c) for c, k in kinds.items()
    ])


def require_shape(df: DataFrame, min_rows: int = 10, min_cols: int = 2) -> DataFrame:
    """The table itself, or an error when it is too small; reads at most ``min_rows`` rows."""
    if len(df.columns) < min_cols:
        raise ValueError(f"table has {len(df.columns)} columns, at least {min_cols} are needed")
    found = df.limit(min_rows).count()
    if found < min_rows:
        raise ValueError(f"table has {found} rows, at least {min_rows} are needed")
    return df


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def _safe(c, t: T.DataType):
    """Value of any type with NaN and infinities turned to null at every depth."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda v: _safe(v, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda _, v: _safe(v, t.valueType))
    if isinstance(t, T.StructType):
        inner = F.struct(*[_safe(c[f.name], f.dataType).alias(f.name) for f in t.fields])
        return F.when(c.isNotNull(), inner)
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """The same table with nothing JSON cannot write."""
    return df.select(*[_safe(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def to_json_rows(df: DataFrame) -> DataFrame:
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[col(c) for c in safe.columns]), {"ignoreNullFields": "false"}).alias("json"))


def stable_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The n rows with the smallest key hash, ties in order of the whole row's hash; all rows for n = 0.

    Exactly n rows at any size, the same on every run. A short sample is a top-n, which each task cuts to n
    rows. A long one would gather n rows in one task, so there the n-th hash is found first and the rows are
    filtered by it; rows that tie with it are equal as a whole, and as many of them stay as are missing.
    """
    if n <= 0:
        return df
    first, whole = key_hash(key, seed, "sample"), fingerprint(df, df.columns)
    if n <= limit:
        return df.orderBy(first, whole).limit(n)
    hashed = F.concat(first, F.to_json(whole))
    cut = hash_part(df, hashed, [lambda total: F.least(total, F.lit(n))], name="_part").where("_part = 0").drop("_part")
    if cut.count() <= n:
        return cut
    last = cut.agg(F.max(hashed)).first()[0]
    sure = cut.where(hashed < last)
    return sure.unionByName(cut.where(hashed == last).limit(n - sure.count()))


def write_session(df: DataFrame, base: str, session_id: str, name: str, csv: bool = False) -> str:
    """Write a session's table under its own prefix; returns the path."""
    path = f"{base}/session_id={session_id}/{name}"
    writer = df.write.mode("overwrite")
    writer.options(**CSV).csv(path) if csv else writer.parquet(path)
    return path


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> str:
    writer = df.write.mode("overwrite")
    writer.options(**CSV).csv(path) if fmt == "csv" else writer.parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    json_safe(df).write.mode("overwrite").json(path)
    return path
