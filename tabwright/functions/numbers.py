"""Number and flag parsing, clipping and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabwright.functions.text import FALSE_WORDS, TRUE_WORDS, squeeze

# Unit words that may trail a number, and the currency signs.
TRAILING_UNITS = [
    "kg", "g", "lb", "lbs", "km", "mi", "mile", "miles", "cm", "mm", "m", "in", "ft",
    "usd", "eur", "inr",
]
CURRENCY_SIGNS = "$€£₹¥"

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
NUMBER_WITH_UNIT = NUMBER.replace("^", "^(", 1).removesuffix("$") + f")({'|'.join(TRAILING_UNITS)})?$"
PLAIN_NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def finite(c: Column) -> Column:
    """NaN and infinities become null; NaN is not below infinity in Spark's order."""
    c = c.cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def parse_bool(c: Column, cleaned: bool = False) -> Column:
    """1.0 for the true words, 0.0 for the false words, null for anything else."""
    text = F.lower(c if cleaned else squeeze(c.cast("string")))
    return F.when(text.isin(TRUE_WORDS), F.lit(1.0)).when(text.isin(FALSE_WORDS), F.lit(0.0))


def _as_double(found: Column) -> Column:
    """A regex group as a number. No match is an empty string, which a cast would meet with an
    exception per row, so it becomes null first."""
    return finite(F.nullif(found, F.lit("")).try_cast("double"))


def parse_number(c: Column, cleaned: bool = False) -> Column:
    """Strict number text: separators, percent and currency signs and one trailing unit go.

    Placeholders and JSON need no step of their own, they do not look like a number.
    """
    text = F.lower(c if cleaned else squeeze(c.cast("string")))
    text = F.regexp_replace(text, f"[,%\\s{CURRENCY_SIGNS}]+", "")
    return _as_double(F.regexp_extract(text, NUMBER_WITH_UNIT, 1))


def parse_number_loose(c: Column) -> Column:
    """Lenient number text: every character but digits, point and minus goes.

    ``1e3`` therefore reads 13 and ``2h 50m`` reads 250.
    """
    text = F.regexp_replace(c.cast("string"), "[^0-9.\\-]+", "")
    return _as_double(F.regexp_extract(text, PLAIN_NUMBER, 0))


def to_int(c: Column) -> Column:
    """Round half to even, then a nullable integer."""
    return F.bround(c.cast("double"), 0).try_cast("bigint")


def is_integral(c: Column) -> Column:
    """Aggregate: every non-null value is whole."""
    return F.bool_and(c.cast("double") % 1 == 0)


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def log1p_clipped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def unbiased_skew(c: Column) -> Column:
    """Aggregate: sample skewness with bias correction; null below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when(
        (n > 2) & (F.min(c) < F.max(c)),
        F.skewness(c) * F.sqrt(n * F.greatest(n - 1, F.lit(0.0))) / F.when(n > 2, n - 2),
    )
