"""Text normalisation as Column expressions, evaluated inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# These tokens mean "missing", these mean true and false, and these
# short category spellings stand for the long ones.
PLACEHOLDERS = [
    "", "na", "n/a", "none", "null", "nil", "nan", "-", "--", "?",
    "unknown", "not available", "not_applicable",
]
TRUE_WORDS = ["true", "1", "yes", "y", "t", "on"]
FALSE_WORDS = ["false", "0", "no", "n", "f", "off"]
CATEGORY_ALIASES = {
    "ny": "new york",
    "newyork": "new york",
    "la": "los angeles",
    "sf": "san francisco",
    "u.s.": "united states",
    "us": "united states",
    "usa": "united states",
    "u.k.": "united kingdom",
    "uk": "united kingdom",
}

ZERO_WIDTH = "[\\u200B\\u200C\\u200D\\uFEFF]"
WHITESPACE_RUN = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+"
NESTED_TEXT = r"(?s)^(\{.*\}|\[.*\])$"
REPLACEMENT_CHAR = "\ufffd"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility composition. ASCII values, which it cannot change, stay in the JVM:
    they reach the Arrow batch as nulls."""
    foreign = c.rlike("[^\\x00-\\x7F]")
    return F.coalesce(_nfkc(F.when(foreign, c)), c)


def squeeze(c: Column) -> Column:
    """Drop zero-width and broken characters, collapse whitespace, trim."""
    c = F.replace(F.regexp_replace(c, ZERO_WIDTH, ""), F.lit(REPLACEMENT_CHAR), F.lit(""))
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def clean_text(c: Column, lower: bool = False, compose: bool = False) -> Column:
    """Squeezed text; empty becomes null."""
    c = c.cast("string")
    c = F.nullif(squeeze(nfkc(c) if compose else c), F.lit(""))
    return F.lower(c) if lower else c


def null_placeholders(c: Column) -> Column:
    return F.when(~F.lower(c).isin(PLACEHOLDERS), c)


def canonical_json(c: Column) -> Column:
    """Objects and arrays written as text get sorted keys and fixed spacing; the rest is kept."""
    return F.when(c.rlike(NESTED_TEXT), F.coalesce(F.to_json(F.try_parse_json(c)), c)).otherwise(c)


def normalize(c: Column, lower: bool = True, compose: bool = False) -> Column:
    """The full text rule: clean, drop placeholders, canonicalise embedded JSON, lower-case."""
    text = canonical_json(null_placeholders(squeeze(nfkc(c) if compose else c.cast("string"))))
    return F.lower(text) if lower else text


def normalized(df: DataFrame, columns: Sequence[str], lower: bool = True, compose: bool = False) -> DataFrame:
    """``normalize`` for whole columns, one projection per step.

    Each step uses its input more than once; as one nested expression that multiplies, as
    stacked projections every value is computed once and the code stays compilable.
    """
    steps = [lambda c: c.cast("string")]
    if compose:
        steps.append(nfkc)
    steps += [squeeze, null_placeholders, canonical_json]
    if lower:
        steps.append(F.lower)
    for step in steps:
        df = df.withColumns({c: step(F.col(f"`{c}`")) for c in columns}) if columns else df
    return df


def decode_text(c: Column) -> Column:
    """Bytes to text: UTF-8 when valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))


def flatten_nested(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Structs, arrays and maps become JSON text with sorted keys; binary becomes text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in skip:
            pass
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(c, {"ignoreNullFields": "false"})
            c = F.coalesce(F.to_json(F.try_parse_json(text)), text)
        elif isinstance(field.dataType, T.BinaryType):
            c = decode_text(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def truncate(c: Column, limit: int = 5000) -> Column:
    return F.substring(c, 1, limit)


def apply_alias(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Replace a known short spelling, met as is or with its spaces removed."""
    aliases = CATEGORY_ALIASES if aliases is None else aliases
    text = F.lower(F.trim(c))
    if not aliases:
        return text
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, F.replace(text, F.lit(" "), F.lit(""))), text)


def safe_extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The matched group, or an empty string when nothing matches."""
    return F.regexp_extract(c, pattern, group)


def name_tokens(name: str) -> list[str]:
    """Lower-case words of a column name, split at underscores, digits and case changes."""
    return [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
