"""Column names, alignment to a fitted schema, target filters and protected columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.numbers import finite, parse_number_loose
from tabwright.functions.text import ZERO_WIDTH, name_tokens
from tabwright.operators.scale import col
from tabwright.operators.valuecounts import gated_counts, is_numeric

# Name words that suggest a prediction target.
TARGET_WORDS = [
    "target", "label", "class", "outcome", "y", "price", "sales", "sale", "churn", "default",
    "fraud", "score", "risk", "rain",
]


def normalize_name(name: str) -> str:
    """Lower-case letters, digits and single underscores; ``column`` when nothing is left."""
    text = unicodedata.normalize("NFKC", str(name))
    text = re.sub(ZERO_WIDTH, "", text).strip().lower()
    return re.sub("_+", "_", re.sub("[^0-9a-z_]+", "_", text)).strip("_") or "column"


def normalized_names(names: Iterable[str]) -> list[str]:
    """Normalised names; a repeated one gets its occurrence number, so order decides which is which."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = normalize_name(name)
        count = seen.get(base, 0)
        out.append(base if count == 0 else f"{base}_{count}")
        seen[base] = count + 1
    return out


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def align_schema(df: DataFrame, fields: Sequence[tuple[str, str]], carry: Sequence[str] = ()) -> DataFrame:
    """The fitted columns in fitted order: found by normalised name, null when absent, the rest dropped."""
    source = [c for c in df.columns if c not in carry]
    have = dict(zip(normalized_names(source), source))
    return df.select(
        *[col(c) for c in carry], *[(col(have[n]) if n in have else F.lit(None).cast(t)).alias(n) for n, t in fields]
    )


def drop_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target; an error when none is left or no feature stands beside it."""
    if len([c for c in df.columns if c != target]) == 0:
        raise ValueError("no feature column beside the target")
    kept = df.where(col(target).isNotNull())
    if not kept.take(1):
        raise ValueError("no rows remain after dropping missing target values")
    return kept


def numeric_target(df: DataFrame, target: str) -> DataFrame:
    """Target read as a number, rows without a finite one dropped."""
    c = col(target)
    parsed = finite(c) if is_numeric(df.schema[target].dataType) else parse_number_loose(c)
    return df.withColumn(target, parsed).where(col(target).isNotNull())


def bad_target_examples(df: DataFrame, target: str, n: int = 5) -> DataFrame:
    """The n smallest distinct target values that do not read as a number."""
    c = col(target).cast("string")
    return df.where(c.isNotNull() & parse_number_loose(c).isNull()).select(c.alias("value")).distinct().orderBy("value").limit(n)


def protected_columns(df: DataFrame, words: Sequence[str] = tuple(TARGET_WORDS)) -> list[str]:
    """Columns that look like a target: by a word of the name, two values, or few text values.

    Names are compared word by word, so ``city`` is not caught by ``y``.
    """
    named = {c for c in df.columns if set(name_tokens(c)) & set(words)}
    rest = [c for c in df.columns if c not in named]
    if rest:
        rows = max(1, df.count())
        counts = gated_counts(df, rest, lambda c, n: n <= 20)
        for c in rest:
            n = counts.get(c, 0)
            text = isinstance(df.schema[c].dataType, T.StringType)
            if n == 2 or (text and 0 < n <= 10 and n / rows <= 0.02):
                named.add(c)
    return [c for c in df.columns if c in named]


def protected_table(df: DataFrame) -> DataFrame:
    guarded = set(protected_columns(df))
    return df.sparkSession.createDataFrame([(c, c in guarded) for c in df.columns], "column string, protected boolean")
