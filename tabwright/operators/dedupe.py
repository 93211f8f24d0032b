"""Row de-duplication and removal of train rows from a test table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.scale import BROADCAST_ROWS, col, fingerprint

SALTS = 32


def dedupe(df: DataFrame) -> DataFrame:
    """Whole-row distinct; nulls compare equal."""
    return df.dropDuplicates()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and how many rows repeat an earlier one."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def _shared(test: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fingerprints found on both sides, each once: copies are combined before any exchange."""
    a = test.select(fingerprint(test, columns).alias("_fp")).distinct()
    b = train.select(fingerprint(train, columns).alias("_fp")).distinct()
    return a.join(b, "_fp", "left_semi")


def _match(test, train, columns, how, max_rows, salts):
    tagged = test.withColumn("_fp", fingerprint(test, columns))
    shared = _shared(test, train, columns)
    found = shared.limit(max_rows + 1).collect()
    if len(found) <= max_rows:
        keys = F.broadcast(test.sparkSession.createDataFrame(found, shared.schema))
        return tagged.join(keys, "_fp", how).drop("_fp")
    # many shared rows: spread each fingerprint, however often it occurs, over several tasks
    tagged = tagged.withColumn("_salt", F.monotonically_increasing_id() % salts)
    keys = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_salt", F.col("_salt").cast("bigint"))
    return tagged.join(keys, ["_fp", "_salt"], how).drop("_fp", "_salt").select(*test.columns)


def remove_overlap(
    test: DataFrame, train: DataFrame, columns: Sequence[str], max_rows: int = BROADCAST_ROWS, salts: int = SALTS
) -> DataFrame:
    """Test rows whose values in ``columns`` do not occur in train."""
    return _match(test, train, columns, "left_anti", max_rows, salts)


def overlap_rows(
    test: DataFrame, train: DataFrame, columns: Sequence[str], max_rows: int = BROADCAST_ROWS, salts: int = SALTS
) -> DataFrame:
    """Test rows whose values in ``columns`` do occur in train."""
    return _match(test, train, columns, "left_semi", max_rows, salts)
