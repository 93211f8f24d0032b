"""From a raw upload to a processed table: types, casts, derived features, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.dates import expand_datetime
from tabwright.functions.units import duration_minutes, split_structured, unit_value
from tabwright.operators.dedupe import dedupe
from tabwright.operators.infer import apply_casts, recommend_types, text_stats
from tabwright.operators.scale import col
from tabwright.operators.schema import protected_columns
from tabwright.operators.valuecounts import long_values
from tabwright.sources.tables import require_shape, write_session

DERIVE_SHARE = 0.9
COUNTED_SHAPE = r"^-?[0-9]+(\.[0-9]+)? +[A-Za-z][A-Za-z ]*$"
PAIR_SHAPE = r"^[A-Za-z]+[-/|][A-Za-z]+$"
RULES = ["minutes", "kg", "m", "counted", "pair"]  # by priority


def derive_plan(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Which derivation fits each text column: nine tenths of its values must follow the shape."""
    if not columns:
        return {}
    v = F.trim("value")
    found = text_stats(long_values(df, columns), {
        "filled": F.count("value"), "minutes": F.count(duration_minutes(v)), "kg": F.count(unit_value(v, "kg")), "m": F.count(unit_value(v, "m")),
        "counted": F.count_if(v.rlike(COUNTED_SHAPE)), "pair": F.count_if(v.rlike(PAIR_SHAPE)),
    })
    plan = {}
    for r in found.collect():
        fits = [rule for rule in RULES if r["filled"] and r[rule] / r["filled"] >= DERIVE_SHARE]
        if fits:
            plan[r["column"]] = fits[0]
    return plan


def derive_features(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Replace each planned text column by the numbers or parts it holds."""
    new = {}
    for c, rule in plan.items():
        v = F.trim(col(c))
        if rule == "minutes":
            new[f"{c}_minutes"] = duration_minutes(v)
        elif rule in ("kg", "m"):
            new[f"{c}_value"] = unit_value(v, rule)
        elif rule == "counted":
            new[f"{c}_number"] = split_structured(v)["number"]
            new[f"{c}_text"] = F.array_join(split_structured(v)["parts"], " ")
        else:
            new[f"{c}_part1"] = F.get(split_structured(v)["parts"], F.lit(0))
            new[f"{c}_part2"] = F.get(split_structured(v)["parts"], F.lit(1))
    return df.withColumns(new).drop(*plan) if new else df


def prepare(df: DataFrame, base: str | None = None, session_id: str | None = None, check: bool = True) -> DataFrame:
    """Types are recommended and cast, dates of unprotected columns become parts, durations and
    units become numbers, equal rows are dropped. With ``base`` both tables are also written."""
    if check:
        require_shape(df)
    plan = {r["column"]: r["dtype"] for r in recommend_types(df, "rich").collect()}
    guarded = set(protected_columns(df))
    cast = apply_casts(df, plan)
    for c in df.columns:
        if plan.get(c) == "date" and c not in guarded:
            cast = expand_datetime(cast, c, "upload")
    texts = [c for c in df.columns if plan.get(c) == "object" and c not in guarded]
    out = dedupe(derive_features(cast, derive_plan(cast, texts)))
    if base is not None:
        write_session(df, base, session_id or "default", "raw")
        return df.sparkSession.read.parquet(write_session(out, base, session_id or "default", "processed"))
    return out
