"""Does an incoming table fit what a model was trained on?"""

from __future__ import annotations

import platform
from collections.abc import Mapping
from typing import Any

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.dates import parse_date
from tabwright.functions.numbers import parse_bool, parse_number
from tabwright.functions.text import normalized
from tabwright.operators.scale import col, local_frame
from tabwright.operators.schema import normalized_names
from tabwright.operators.valuecounts import long_values

REQUIRED = ["features", "dropped_features", "pruned_features"]
SCHEMA = "severity string, check string, subject string, value double"


def runtime_versions() -> dict[str, str]:
    return {"python": platform.python_version(), "pyspark": pyspark.__version__}


def _minor(version: str) -> str:
    return ".".join(str(version).split(".")[:2])


def manifest_issues(manifest: Mapping[str, Any], session_id: str | None, strict: bool, versions: Mapping[str, str] | None = None) -> list[tuple]:
    """Problems of the manifest itself: missing keys, wrong session or task, version drift."""
    hard = "error" if strict else "warning"
    versions = versions or runtime_versions()
    out = [(hard, "missing_key", k, None) for k in REQUIRED if k not in manifest]
    if "dropped_features" in manifest and not isinstance(manifest["dropped_features"], list):
        out.append((hard, "bad_type", "dropped_features", None))
    if "pruned_features" in manifest and not isinstance(manifest["pruned_features"], dict):
        out.append((hard, "bad_type", "pruned_features", None))
    tracked = manifest.get("session_id")
    if tracked and session_id is not None and tracked != session_id:
        out.append(("error", "session_mismatch", str(tracked), None))
    if manifest.get("task") and str(manifest["task"]).lower() not in ("classification", "regression"):
        out.append(("warning", "unexpected_task", str(manifest["task"]), None))
    if not isinstance(manifest.get("versions"), Mapping):
        out.append((hard, "missing_key", "versions", None))
    else:
        for name, trained in manifest["versions"].items():
            if name in versions and _minor(trained) != _minor(versions[name]):
                out.append((hard if name == "pyspark" else "warning", "version_mismatch", f"{name}: trained {trained}, now {versions[name]}", None))
    if not manifest.get("dropped_features"):
        out.append(("warning", "no_dropped_features", "", None))
    return out


def check_contract(
    df: DataFrame, manifest: Mapping[str, Any], strict: bool = False, session_id: str | None = None, versions: Mapping[str, str] | None = None
) -> DataFrame:
    """(severity, check, subject, value): what is wrong with the manifest, the columns and the values.

    ``manifest['kinds']`` maps features to kinds, ``manifest['categories']`` to known values, and ``manifest['rare_share']`` to the
    share of training values that were too rare to be kept: unseen values count as drift beyond it. The
    values are judged in one pass over a long (column, value) table; only counts come back.
    """
    spark = df.sparkSession
    features = list(manifest.get("features") or [])
    kinds = dict(zip(normalized_names(list(manifest.get("kinds") or {})), (manifest.get("kinds") or {}).values()))
    expected = local_frame(spark, [(n, kinds.get(n)) for n in normalized_names(features)], "name string, kind string")
    names = normalized_names(df.columns)
    incoming = local_frame(spark, [(n,) for n in names], "incoming string")
    matched = expected.join(incoming, F.col("name") == F.col("incoming"), "full_outer")
    hard = "error" if strict else "warning"
    columns = matched.select(
        F.when(F.col("incoming").isNull(), hard).when(F.col("name").isNull(), "warning").alias("severity"),
        F.when(F.col("incoming").isNull(), "missing_column").when(F.col("name").isNull(), "extra_column").alias("check"),
        F.coalesce("name", "incoming").alias("subject"), F.lit(None).cast("double").alias("value"),
    ).where("severity IS NOT NULL")
    out = local_frame(spark, manifest_issues(manifest, session_id, strict, versions), SCHEMA).unionByName(columns)
    shared = [(n, c) for n, c in zip(names, df.columns) if n in set(normalized_names(features))]
    if not shared:
        return out
    renamed = df.select(*[col(c).alias(n) for n, c in shared])
    return out.unionByName(_value_issues(renamed, kinds, manifest.get("categories") or {}, manifest.get("rare_share") or {}))


def _value_issues(df: DataFrame, kinds: Mapping[str, str], categories: Mapping[str, list], rare: Mapping[str, float]) -> DataFrame:
    text = normalized(long_values(df, df.columns), ["value"], lower=False)
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kinds.get(c, "categorical"))])
    known = F.create_map(*[x for c, v in categories.items() for x in (F.lit(c), F.array(*[F.lit(str(i).lower()) for i in v]))]) if categories else None
    v = F.col("value")
    staged = text.withColumn("kind", F.element_at(kind, F.col("column")))
    fits = (
        F.when(F.col("kind") == "numeric", parse_number(v, cleaned=True).isNotNull())
        .when(F.col("kind") == "boolean", parse_bool(v, cleaned=True).isNotNull() | parse_number(v, cleaned=True).isin(0.0, 1.0))
        .when(F.col("kind") == "datetime", parse_date(v).isNotNull())
        .otherwise(F.lit(True))
    )
    seen = F.lit(True)
    if known is not None:
        words = F.try_element_at(known, F.col("column"))
        seen = F.when(words.isNotNull() & (F.col("kind") == "categorical"), F.array_contains(words, F.lower(v))).otherwise(F.lit(True))
    counts = staged.groupBy("column").agg(
        F.count("value").alias("filled"),
        F.count_if(v.isNotNull() & ~F.coalesce(fits, F.lit(False))).alias("unfit"),
        F.count_if(v.isNotNull() & ~seen).alias("unseen"),
    )
    share = lambda c: F.round(F.col(c) / F.greatest("filled", F.lit(1)), 6)
    usual = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, v in rare.items() for x in (c, float(v) + 1e-12)]), F.col("column")), F.lit(0.0)) if rare else F.lit(0.0)
    issues = F.array_compact(F.array(
        F.when(F.col("filled") == 0, F.struct(F.lit("all_null").alias("check"), F.lit(None).cast("double").alias("value"))),
        F.when(F.col("unfit") > 0, F.struct(F.lit("values_not_of_kind").alias("check"), share("unfit").alias("value"))),
        F.when((F.col("unseen") > 0) & (F.col("unseen") / F.col("filled") > usual), F.struct(F.lit("unseen_categories").alias("check"), share("unseen").alias("value"))),
    ))
    return counts.select(F.col("column").alias("subject"), F.inline(issues)).select(F.lit("warning").alias("severity"), "check", "subject", "value")


def contract_valid(issues: DataFrame) -> DataFrame:
    """(valid, errors, warnings) of a list of issues."""
    return issues.agg(
        (F.count_if(F.col("severity") == "error") == 0).alias("valid"),
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
