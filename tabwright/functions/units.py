"""Durations, values with units and mixed number-and-word text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minutes per duration word and base-unit factors (kilogram and metre).
DURATION_MINUTES = {
    "weeks?|w": 10080.0,
    "days?|d": 1440.0,
    "hours?|hrs?|h": 60.0,
    "minutes?|mins?|m": 1.0,
    "seconds?|secs?|s": 1.0 / 60.0,
}
MASS_IN_KG = {"kg": 1.0, "g": 0.001, "mg": 0.000001, "lb": 0.45359237, "lbs": 0.45359237}
LENGTH_IN_M = {
    "km": 1000.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "in": 0.0254, "ft": 0.3048,
    "mi": 1609.344, "mile": 1609.344, "miles": 1609.344,
}
BASES = {"kg": MASS_IN_KG, "m": LENGTH_IN_M}

AMOUNT = r"([0-9]+(?:\.[0-9]+)?)"
CLOCK_SHAPE = r"^([0-9]+):([0-9]{2})(?::([0-9]{2}))?$"
DURATION_SHAPE = r"^(?:[0-9]+(?:\.[0-9]+)?\s*(?:" + "|".join(DURATION_MINUTES) + r")[\s,]*)+$"
UNIT_SHAPE = r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*([a-z]+)$"


def duration_minutes(c: Column) -> Column:
    """Total minutes of ``2h 50min``, ``5 days`` or ``00:15:30``; null for other text."""
    text = F.lower(F.trim(c))
    spelled = F.lit(0.0)
    for words, minutes in DURATION_MINUTES.items():
        amount = F.regexp_extract(text, AMOUNT + rf"\s*(?:{words})(?:[^a-z]|$)", 1)
        spelled = spelled + F.coalesce(F.nullif(amount, F.lit("")).try_cast("double"), F.lit(0.0)) * minutes
    part = [F.coalesce(F.nullif(F.regexp_extract(text, CLOCK_SHAPE, i), F.lit("")).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3)]
    return (
        F.when(text.rlike(CLOCK_SHAPE), part[0] * 60 + part[1] + part[2] / 60)
        .when(text.rlike(DURATION_SHAPE), spelled)
    )


def unit_value(c: Column, base: str = "kg") -> Column:
    """Number with a unit of the base's family, in the base unit; null for other text."""
    text = F.lower(F.trim(c))
    factors = F.create_map(*[F.lit(x) for pair in BASES[base].items() for x in pair])
    number = F.when(text.rlike(UNIT_SHAPE), F.regexp_extract(text, UNIT_SHAPE, 1)).try_cast("double")
    return number * F.try_element_at(factors, F.regexp_extract(text, UNIT_SHAPE, 2))


def split_structured(c: Column) -> Column:
    """Struct of the first number and the word parts of text such as ``12 items left`` or ``Red-Blue``."""
    number = F.nullif(F.regexp_extract(c, r"(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    words = F.trim(F.regexp_replace(c, r"-?[0-9]+(?:\.[0-9]+)?", " "))
    parts = F.filter(F.split(words, r"[\s\-_/|,;]+"), lambda w: w != "")
    return F.struct(number.alias("number"), parts.alias("parts"))
