"""Reproducible splits and folds by key hash: no shuffle of the rows, no ranking in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.scale import hash_part, key_hash


def split_random(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` by a threshold on the first 32 bits of the key hash."""
    limit = f"{int(test_size * 2**32):08x}"
    return df.withColumn("is_test", F.substring(key_hash(key, seed), 1, 8) < limit)


def split_stratified(df: DataFrame, target: str, key: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test`` for the first ``round(test_size * n)`` rows of every class in hash order."""
    cut = lambda n: F.round(n * F.lit(test_size))
    return hash_part(df, key_hash(key, seed), [cut], target, "_part").withColumn("is_test", F.col("_part") == 0).drop("_part")


def add_folds(df: DataFrame, k: int, key: Sequence[str], target: str | None = None, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1: near-equal slices of the hash order, per class when a target is given."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    cuts = [lambda n, j=j: F.round(n * F.lit(j) / F.lit(k)) for j in range(1, k)]
    return hash_part(df, key_hash(key, seed, "fold"), cuts, target, "fold")
