"""Batch scoring against a trained run; works the same on a streaming table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.models import ROW, NeighborModel, Trained
from tabwright.operators.scale import col, key_hash
from tabwright.operators.schema import align_schema, normalized_names

CARRIED = "_input"


def score(trained: Trained, df: DataFrame, model: str | None = None) -> DataFrame:
    """The input columns with ``prediction`` and, for classes, the ``confidence`` in it."""
    fitted = trained.models[model or trained.best()]
    row_id = F.conv(F.substring(key_hash(df.columns, purpose="id"), 1, 15), 16, 10).cast("bigint")
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias(CARRIED), row_id.alias(ROW), *[col(c) for c in df.columns])
    rows = rows.drop(*trained.manifest["dropped_features"], trained.manifest["target"])
    cleaner, *rest = trained.preprocessing.stages
    cleaner = cleaner.copy({cleaner.carry: [CARRIED, ROW]})
    ready = cleaner.transform(rows)
    for stage in rest:
        ready = stage.transform(ready)
    found = _unique_votes(fitted, ready) if isinstance(fitted, NeighborModel) else fitted.transform(ready)
    prediction, confidence = F.col("prediction"), None
    if trained.task == "classification":
        names = F.array(*[F.lit(c) for c in trained.manifest["classes"]])
        prediction = F.get(names, F.col("prediction").cast("int"))
        if "probability" in found.columns:
            confidence = F.array_max(vector_to_array("probability"))
        elif "confidence" in found.columns:
            confidence = F.col("confidence")
    out = [F.col(f"{CARRIED}.`{c}`").alias(c) for c in df.columns] + [prediction.alias("prediction")]
    return found.select(*out, *([confidence.alias("confidence")] if confidence is not None else []))


def _unique_votes(fitted: NeighborModel, ready: DataFrame) -> DataFrame:
    """Equal input rows share an id: each is searched once, then joined back."""
    once = ready.select(ROW, "features").dropDuplicates([ROW])
    voted = fitted.transform(once).select(ROW, "prediction", "confidence")
    return ready.join(voted, ROW, "left")


def input_template(df: DataFrame, manifest: Mapping[str, Any], n: int = 10) -> DataFrame:
    """The first few rows, in order of their columns, with exactly the columns a trained run expects."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = normalized_names(manifest["features"])
    fields = [(n_, types.get(raw, "string")) for n_, raw in zip(names, manifest["features"])]
    aligned = align_schema(df, fields)
    return aligned.orderBy(*[col(c) for c in aligned.columns]).limit(n)

