"""The table cleaner: fitted on training rows only, applied as one projection.

``fit`` reads the table a fixed number of times whatever its width: one value-count shuffle
for all text columns, one wide aggregate and one quantile search for the numeric ones. What
it learns is a small JSON manifest, kept as a parameter, so the model saves and loads like
any Spark ML stage and also works on streams.
"""

from __future__ import annotations

import json
from difflib import SequenceMatcher
from math import ceil

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.dates import date_parts, parse_date, vote_orders
from tabwright.functions.numbers import clip, finite, log1p_clipped, missing_flag, parse_bool, parse_number, unbiased_skew
from tabwright.functions.text import apply_alias, flatten_nested, normalized, truncate
from tabwright.operators.infer import fixed_kinds, kind_rule, kind_stats, text_stats
from tabwright.operators.profile import HEAVY, per_column
from tabwright.operators.scale import col, exact_quantiles, local_frame, lookup
from tabwright.operators.schema import align_schema, normalize_names
from tabwright.operators.valuecounts import value_count_table
from tabwright.session import shared_path

OTHER = "__other__"
BOX = "_carried"
FUZZY_VALUES = 500       # columns with more distinct values are not merged
FUZZY_ANCHORS = 150      # spellings a value is compared with
FUZZY_LENGTH = 4         # shorter values must match exactly
FUZZY_RATIO = 0.93
INLINE_CATEGORIES = 5000  # longer dictionaries are joined instead of written into the plan


def _same_spelling(value: str, anchor: str) -> bool:
    if value.replace(" ", "") == anchor.replace(" ", ""):
        return True
    if min(len(value), len(anchor)) < FUZZY_LENGTH:
        return False
    matcher = SequenceMatcher(None, value, anchor)
    # the two quick ratios are upper bounds of the full one
    return all(r() >= FUZZY_RATIO for r in (matcher.real_quick_ratio, matcher.quick_ratio, matcher.ratio))


def _merge_spellings(group: pd.DataFrame) -> pd.DataFrame:
    anchors: list[str] = []
    home: dict[str, str] = {}
    for value in sorted(group["value"], key=lambda v: (len(v), v)):
        home[value] = next((a for a in anchors[:FUZZY_ANCHORS] if _same_spelling(value, a)), value)
        if home[value] == value:
            anchors.append(value)
    return pd.DataFrame({"column": group["column"].iloc[0], "value": list(home), "canonical": list(home.values())})


def fuzzy_map(values: DataFrame) -> DataFrame:
    """(column, value, canonical): near-equal spellings of a column share its shortest one.

    The merge is greedy and so sequential within a column, but only columns with 2 to 500
    distinct values enter it; the columns run in parallel. Other values stand for themselves.
    """
    values = values.where(F.col("value").isNotNull()).select("column", "value").distinct()
    sizes = values.groupBy("column").agg(F.count("*").alias("n"))
    sized = values.join(F.broadcast(sizes), "column")  # one row per column
    small = sized.where((F.col("n") > 1) & (F.col("n") <= FUZZY_VALUES)).select("column", "value")
    rest = sized.where((F.col("n") <= 1) | (F.col("n") > FUZZY_VALUES))
    merged = small.groupBy("column").applyInPandas(_merge_spellings, "column string, value string, canonical string")
    return merged.unionByName(rest.select("column", "value", F.col("value").alias("canonical")))


def rare_table(values: DataFrame, freq: float = 0.01, min_count: int = 20) -> DataFrame:
    """(column, value, n, rare) for (column, value, n): below the larger of two limits is rare."""
    filled = values.where(F.col("value").isNotNull())
    totals = filled.groupBy("column").agg(F.sum("n").alias("total"))
    limit = F.greatest(F.lit(min_count), F.ceil(F.lit(freq) * F.col("total")))
    return filled.join(F.broadcast(totals), "column").select("column", "value", "n", (F.col("n") < limit).alias("rare"))


class _CleanerParams(Params):
    numericRatio = Param(Params._dummy(), "numericRatio", "share of values that must read as numbers", TypeConverters.toFloat)
    datetimeRatio = Param(Params._dummy(), "datetimeRatio", "share of values that must read as dates", TypeConverters.toFloat)
    boolRatio = Param(Params._dummy(), "boolRatio", "share of values that must read as flags", TypeConverters.toFloat)
    rareFreq = Param(Params._dummy(), "rareFreq", "share of values below which a category is rare", TypeConverters.toFloat)
    rareMinCount = Param(Params._dummy(), "rareMinCount", "count below which a category is rare", TypeConverters.toInt)
    highCardinality = Param(Params._dummy(), "highCardinality", "distinct values above which a column may be dropped", TypeConverters.toInt)
    highCardinalityRatio = Param(Params._dummy(), "highCardinalityRatio", "distinct share above which it is", TypeConverters.toFloat)
    clipLow = Param(Params._dummy(), "clipLow", "lower clip quantile", TypeConverters.toFloat)
    clipHigh = Param(Params._dummy(), "clipHigh", "upper clip quantile", TypeConverters.toFloat)
    maxTextLength = Param(Params._dummy(), "maxTextLength", "characters of a category kept", TypeConverters.toInt)
    compose = Param(Params._dummy(), "compose", "apply Unicode compatibility composition", TypeConverters.toBoolean)
    carry = Param(Params._dummy(), "carry", "columns passed through untouched", TypeConverters.toListString)


class RobustCleaner(Estimator, _CleanerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns kinds, drops, clips, logs, categories and missing flags from training rows."""

    @keyword_only
    def __init__(
        self, *, numericRatio=None, datetimeRatio=None, boolRatio=None, rareFreq=None, rareMinCount=None,
        highCardinality=None, highCardinalityRatio=None, clipLow=None, clipHigh=None, maxTextLength=None, compose=None, carry=None,
    ):
        super().__init__()
        self._setDefault(
            numericRatio=0.9, datetimeRatio=0.9, boolRatio=0.98, rareFreq=0.01, rareMinCount=20,
            highCardinality=250, highCardinalityRatio=0.7, clipLow=0.005, clipHigh=0.995, maxTextLength=5000, compose=True, carry=[],
        )
        self._set(**self._input_kwargs)

    def _get(self, name):
        return self.getOrDefault(self.getParam(name))

    def _fit(self, dataset: DataFrame) -> RobustCleanerModel:
        flat = normalize_names(flatten_nested(dataset.drop(*self._get("carry"))))
        if not flat.columns:
            raise ValueError("the table has no columns")
        rows = flat.count()
        fixed, text = fixed_kinds(flat)
        kinds = dict(fixed)
        state: dict[str, dict] = {}
        vc, orders = None, {}
        if text:
            raw = value_count_table(flat, text)
            vc = normalized(raw, ["value"], lower=False, compose=self._get("compose")).persist()
            found = text_stats(vc, kind_stats(F.col("n")))
            rule = kind_rule(text, self._get("boolRatio"), self._get("datetimeRatio"), self._get("numericRatio"), 0.5)
            kinds.update({r["column"]: r["kind"] for r in found.select("column", rule.alias("kind")).collect()})
            for c in text:
                kinds.setdefault(c, "categorical")
        try:
            dates = [c for c in text if kinds[c] == "datetime"]
            orders = vote_orders(vc.where(F.col("column").isin(dates))) if dates else {}
            categories = [c for c in text if kinds[c] == "categorical"]
            if categories:
                state.update(self._fit_categories(vc, categories, rows))
        finally:
            if vc is not None:
                vc.unpersist()
        measured = [c for c in flat.columns if kinds[c] != "categorical"]
        if measured:
            state.update(self._fit_measured(flat, measured, kinds, rows, orders))
        manifest = {
            "rows": rows,
            "columns": [
                {"name": f.name, "type": f.dataType.simpleString(), "kind": kinds[f.name], **state[f.name]} for f in flat.schema.fields
            ],
        }
        model = RobustCleanerModel(
            manifest=json.dumps(manifest), compose=self._get("compose"), maxTextLength=self._get("maxTextLength"), carry=self._get("carry"),
        )
        if not model.output_columns():
            raise ValueError("no usable feature remains after cleaning")
        return model

    def _fit_categories(self, vc, columns, rows):
        cut = truncate(F.lower("value"), self._get("maxTextLength"))
        counts = (
            vc.where(F.col("column").isin(columns) & F.col("value").isNotNull())
            .groupBy("column", cut.alias("value")).agg(F.sum("n").alias("n")).persist()
        )
        try:
            seen = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct")).collect()}
            state, kept = {}, []
            for c in columns:
                filled, distinct = (seen[c]["filled"], seen[c]["distinct"]) if c in seen else (0, 0)
                if distinct <= 1:
                    state[c] = {"drop": "zero_variance"}
                elif distinct > self._get("highCardinality") and distinct / max(1, rows) > self._get("highCardinalityRatio"):
                    state[c] = {"drop": "high_cardinality"}
                else:
                    state[c] = {"missing": filled < rows}
                    kept.append(c)
            if kept:
                self._fit_spellings(counts.where(F.col("column").isin(kept)), kept, state)
        finally:
            counts.unpersist()
        return state

    def _fit_spellings(self, counts, columns, state):
        aliased = counts.groupBy("column", apply_alias(F.col("value")).alias("value")).agg(F.sum("n").alias("n"))
        moved = fuzzy_map(aliased).where("value <> canonical").collect()  # at most 500 per column
        for c in columns:
            state[c].update(spellings={}, rare=0, categories=[])
        for r in aliased.groupBy("column").count().where(F.col("count") > FUZZY_VALUES).collect():
            state[r["column"]]["unmerged"] = r["count"]
        for r in moved:
            state[r["column"]]["spellings"][r["value"]] = r["canonical"]
        spelled = aliased.sparkSession.createDataFrame([tuple(r) for r in moved], "column string, value string, canonical string")
        joined = aliased.join(F.broadcast(spelled), ["column", "value"], "left")
        merged = joined.groupBy("column", F.coalesce("canonical", "value").alias("value")).agg(F.sum("n").alias("n"))
        judged = rare_table(merged, self._get("rareFreq"), self._get("rareMinCount")).persist()
        try:
            totals = judged.groupBy("column").agg(F.count_if("rare").alias("rare"), F.count_if(~F.col("rare")).alias("kept"), F.coalesce(F.sum(F.when(F.col("rare"), F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("share")).collect()
            inline = [r["column"] for r in totals if r["kept"] <= INLINE_CATEGORIES]
            for r in totals:
                state[r["column"]].update(rare=r["rare"], rare_share=r["share"])
            for r in judged.where(~F.col("rare") & F.col("column").isin(inline)).select("column", "value").orderBy("value").collect():
                state[r["column"]]["categories"].append(r["value"])
            for c in columns:
                if c not in inline:
                    state[c]["dictionary"] = _written_dictionary(judged.where(~F.col("rare") & (F.col("column") == c)))
        finally:
            judged.unpersist()

    def _fit_measured(self, flat, columns, kinds, rows, orders):
        compose = self._get("compose")
        base = base_table(flat, {c: kinds[c] for c in columns}, compose, orders=orders)
        as_number = {c: F.unix_micros(col(c)).cast("double") if kinds[c] == "datetime" else col(c) for c in columns}
        stats = per_column(base, {
            c: {
                "n": F.count(v), "lo": F.min(v), "hi": F.max(v),
                "skew": unbiased_skew(v) if kinds[c] == "numeric" else F.lit(None).cast("double") + F.max(F.lit(0.0)),
            } for c, v in as_number.items()
        }, limit=HEAVY)
        found = {r["column"]: r for r in stats.collect()}
        state = {}
        for c in columns:
            r = found[c]
            if r["n"] == 0 or r["lo"] == r["hi"]:
                state[c] = {"drop": "zero_variance"}
                continue
            state[c] = {"missing": r["n"] < rows} | ({"order": orders[c]} if c in orders else {})
            if kinds[c] == "numeric" and r["n"] >= 20 and r["skew"] is not None and abs(r["skew"]) >= 2.0 and r["lo"] >= 0:
                state[c]["log"] = True
        clipped = [c for c in columns if kinds[c] == "numeric" and "drop" not in state[c] and found[c]["n"] >= 10]
        bounds = exact_quantiles(base, {c: [self._get("clipLow"), self._get("clipHigh")] for c in clipped}, rows=rows)
        for c, (low, high) in bounds.items():
            if low < high:
                state[c]["clip"] = [low, high]
        return state


def _written_dictionary(values: DataFrame) -> str:
    """A long category list as a table in the shared folder; returns its path. Saving the model copies it into the model."""
    path = shared_path(values.sparkSession, "categories")
    values.select("value").write.parquet(path)
    return path


def base_table(
    df: DataFrame, kinds: dict[str, str], compose: bool = False, max_length: int = 5000, carry: tuple[str, ...] = (), orders: dict[str, str] | None = None,
) -> DataFrame:
    """The columns in ``kinds`` converted to their kind; what does not convert is null. ``orders`` are the date orders of columns."""
    df = df.select(*carry, *[col(c) for c in kinds])
    text = [c for c, k in kinds.items() if isinstance(df.schema[c].dataType, (T.StringType, T.NullType)) or k == "categorical"]
    clean = normalized(df, text, lower=False, compose=compose)

    def convert(c: str) -> Column:
        v, kind = col(c), kinds[c]
        if kind == "categorical":
            return truncate(F.lower(v), max_length)
        if c not in text:
            return v.cast("timestamp") if kind == "datetime" else finite(v)
        return {"boolean": lambda: parse_bool(v, cleaned=True), "numeric": lambda: parse_number(v, cleaned=True), "datetime": lambda: parse_date(v, order=(orders or {}).get(c))}[kind]()

    return clean.select(*carry, *[convert(c).alias(c) for c in kinds])


class _ModelWriter(DefaultParamsWriter):
    """Writes the parameters, and long category lists beside them, so that a saved model needs no other folder."""

    def saveImpl(self, path: str) -> None:
        model, spark = self.instance, self.sparkSession
        state = model.state
        for i, c in enumerate(state["columns"]):
            if "dictionary" in c:
                spark.read.parquet(c["dictionary"]).write.parquet(f"{path}/categories/{i}")
                c["dictionary"] = f"categories/{i}"
        DefaultParamsWriter.saveMetadata(model.copy({model.manifest: json.dumps(state)}), path, spark)


class _ModelReader(DefaultParamsReader):
    def load(self, path: str) -> RobustCleanerModel:
        model = super().load(path)
        state = model.state
        for c in state["columns"]:
            if "dictionary" in c:
                c["dictionary"] = f"{path}/{c['dictionary']}"
        return model._set(manifest=json.dumps(state))


class RobustCleanerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Applies a fitted cleaner: aligns the schema, converts, clips, maps categories, flags gaps."""

    def write(self) -> _ModelWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> _ModelReader:
        return _ModelReader(cls)

    manifest = Param(Params._dummy(), "manifest", "fitted state as JSON", TypeConverters.toString)
    compose = Param(Params._dummy(), "compose", "apply Unicode compatibility composition", TypeConverters.toBoolean)
    maxTextLength = Param(Params._dummy(), "maxTextLength", "characters of a category kept", TypeConverters.toInt)
    carry = Param(Params._dummy(), "carry", "columns passed through untouched", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, manifest=None, compose=None, maxTextLength=None, carry=None):
        super().__init__()
        self._setDefault(manifest="{}", compose=True, maxTextLength=5000, carry=[])
        self._set(**self._input_kwargs)

    @property
    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.manifest))

    def kept(self) -> list[dict]:
        return [c for c in self.state["columns"] if "drop" not in c]

    def _outputs(self) -> list[tuple[str, str]]:
        out = []
        for c in self.kept():
            if c["kind"] == "datetime":
                out += [(f"{c['name']}__{p}", "numeric") for p in ("year", "month", "day", "weekday", "hour", "minute")]
            else:
                out.append((c["name"], "categorical" if c["kind"] == "categorical" else "numeric"))
            if c.get("missing"):
                out.append((f"{c['name']}__missing", "numeric"))
        return out

    def output_columns(self) -> list[str]:
        return [n for n, _ in self._outputs()]

    def columns_of_kind(self, kind: str) -> list[str]:
        return [n for n, k in self._outputs() if k == kind]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        compose, length = self.getOrDefault(self.compose), self.getOrDefault(self.maxTextLength)
        carry = [c for c in self.getOrDefault(self.carry) if c in dataset.columns]
        # one struct takes the carried columns past the renaming, whatever they are called
        boxed = dataset.select(*[col(c) for c in dataset.columns if c not in carry], *([F.struct(*[col(c) for c in carry]).alias(BOX)] if carry else []))
        fields = [(c["name"], c["type"]) for c in self.kept()]
        aligned = align_schema(flatten_nested(boxed, (BOX,)), fields, (BOX,) if carry else ())
        base = base_table(aligned, {c["name"]: c["kind"] for c in self.kept()}, compose, length, (BOX,) if carry else (), {c["name"]: c["order"] for c in self.kept() if "order" in c})
        for i, c in enumerate(self.kept()):
            if c["kind"] == "categorical":
                base = self._category(base, c, i)
        out = []
        for c in self.kept():
            v = col(c["name"])
            if c["kind"] == "datetime":
                out += [e.alias(f"{c['name']}__{p}") for p, e in date_parts(v).items()]
            else:
                if "clip" in c:
                    v = clip(v, *c["clip"])
                if c.get("log"):
                    v = log1p_clipped(v)
                out.append(v.alias(c["name"]))
            if c.get("missing"):
                out.append(missing_flag(v).alias(f"{c['name']}__missing"))
        return base.select(*[F.col(f"{BOX}.`{c}`").alias(c) for c in carry], *out)

    @staticmethod
    def _category(base: DataFrame, c: dict, i: int) -> DataFrame:
        name = c["name"]
        v = apply_alias(col(name))
        if c.get("spellings"):
            table = F.create_map(*[F.lit(x) for pair in c["spellings"].items() for x in pair])
            staged = base.withColumn(name, v)
            base, v = staged, F.coalesce(F.try_element_at(table, col(name)), col(name))
        if "dictionary" in c:
            known = base.sparkSession.read.parquet(c["dictionary"]).select(F.col("value").alias(f"_known{i}"))
            joined = lookup(base.withColumn(name, v), col(name), known, f"_known{i}")
            kept = F.col(f"_known{i}").isNotNull()
            return joined.withColumn(name, F.when(kept, col(name)).when(col(name).isNotNull(), OTHER)).drop(f"_known{i}")
        staged = base.withColumn(name, v)
        return staged.withColumn(name, F.when(col(name).isin(c.get("categories", [])), col(name)).when(col(name).isNotNull(), OTHER))

    def audit(self, spark) -> DataFrame:
        """(section, column, value) of everything the fit decided."""
        rows = [("rows", "", str(self.state["rows"])), ("columns", "", str(len(self.state["columns"])))]
        for c in self.state["columns"]:
            n = c["name"]
            rows.append(("kind", n, c["kind"]))
            if "drop" in c:
                rows += [("dropped", n, c["drop"])]
                continue
            if c.get("spellings"):
                rows.append(("merged_spellings", n, str(len(c["spellings"]))))
            if c.get("unmerged"):
                rows.append(("spellings_too_many_to_merge", n, str(c["unmerged"])))
            if "order" in c:
                rows.append(("date_order", n, c["order"]))
            if "dictionary" in c:
                rows.append(("categories_kept_as_table", n, ""))
            if c.get("rare"):
                rows.append(("rare_categories", n, str(c["rare"])))
            if c.get("missing"):
                rows.append(("missing_indicator", n, ""))
            if c.get("log"):
                rows.append(("log", n, ""))
            if "clip" in c:
                rows += [("clip_low", n, repr(c["clip"][0])), ("clip_high", n, repr(c["clip"][1]))]
        rows += [("output", n, str(i)) for i, n in enumerate(self.output_columns())]
        return local_frame(spark, rows, "section string, column string, value string")
