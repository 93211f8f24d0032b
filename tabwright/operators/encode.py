"""Imputation, scaling and encoding of cleaned tables into one feature vector."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.profile import num
from tabwright.operators.scale import col, exact_quantiles
from tabwright.operators.valuecounts import is_numeric, mode_of, value_count_table


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = exact_quantiles(df.select(*[num(c).alias(c) for c in columns]), {c: [0.5] for c in columns})
    return {c: v[0] for c, v in found.items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent text value per column, the smallest on a tie."""
    if not columns:
        return {}
    vc = value_count_table(df, columns)
    found = {r["column"]: r["mode"] for r in vc.groupBy("column").agg(mode_of(F.col("value"), F.col("n")).alias("mode")).collect()}
    return {c: found.get(c) for c in columns}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fill = medians(df, columns)
    return df.select(*[F.coalesce(num(c), F.lit(fill[c])).alias(c) if c in fill else col(c) for c in df.columns])


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fill = modes(df, columns)
    return df.select(*[F.coalesce(col(c), F.lit(fill[c])).alias(c) if c in fill else col(c) for c in df.columns])


def scale_factors(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(median, IQR) per column, an IQR of zero replaced by one."""
    q = exact_quantiles(df.select(*[num(c).alias(c) for c in columns]), {c: [0.25, 0.5, 0.75] for c in columns})
    return {c: (v[1], (v[2] - v[0]) or 1.0) if v[0] is not None else (0.0, 1.0) for c, v in q.items()}


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    factors = scale_factors(df, columns)
    return df.select(*[
        ((num(c) - F.lit(factors[c][0])) / F.lit(factors[c][1])).alias(c) if c in factors else col(c) for c in df.columns
    ])


class TablePreparer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation and robust scaling of numbers, most frequent value for text.

    ``prefix`` goes before the names of prepared columns, so that none can be called like a column that a model adds.
    """

    keep = Param(Params._dummy(), "keep", "columns passed through untouched", TypeConverters.toListString)
    prefix = Param(Params._dummy(), "prefix", "text before the names of prepared columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, keep=None, prefix=None):
        super().__init__()
        self._setDefault(keep=[], prefix="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TablePreparerModel:
        features = [f for f in dataset.schema.fields if f.name not in self.getOrDefault(self.keep)]
        numeric = [f.name for f in features if is_numeric(f.dataType)]
        text = [f.name for f in features if isinstance(f.dataType, T.StringType)]
        middle = {c: v if v is not None else 0.0 for c, v in medians(dataset, numeric).items()} if numeric else {}
        filled = dataset.select(*[F.coalesce(num(c), F.lit(middle[c])).alias(c) for c in numeric])
        state = {
            "medians": middle,
            "scales": scale_factors(filled, numeric) if numeric else {},
            "modes": {c: v if v is not None else "" for c, v in modes(dataset, text).items()},
            "prefix": self.getOrDefault(self.prefix),
        }
        return TablePreparerModel(state=json.dumps(state))


class TablePreparerModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state=None):
        super().__init__()
        self._setDefault(state="{}")
        self._set(**self._input_kwargs)

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.fitted
        name = s.get("prefix", "")
        out = []
        for c in dataset.columns:
            if c in s["medians"]:
                centre, width = s["scales"][c]
                out.append(((F.coalesce(num(c), F.lit(s["medians"][c])) - F.lit(centre)) / F.lit(width)).alias(name + c))
            elif c in s["modes"]:
                out.append(F.coalesce(col(c), F.lit(s["modes"][c])).alias(name + c))
            else:
                out.append(col(c))
        return dataset.select(*out)


def vector_stages(numeric: Sequence[str], text: Sequence[str], output: str = "features") -> list:
    """One-hot encoding, unknown values all zero, and assembly into one vector."""
    stages: list = []
    encoded = []
    if text:
        index = [f"{c}__index" for c in text]
        encoded = [f"{c}__onehot" for c in text]
        stages = [
            StringIndexer(inputCols=list(text), outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            # the slot that dropLast removes is the one for unknown values
            OneHotEncoder(inputCols=index, outputCols=encoded, dropLast=True),
        ]
    return [*stages, VectorAssembler(inputCols=[*numeric, *encoded], outputCol=output)]


def target_indexer(target: str, output: str) -> StringIndexer:
    """Class numbers in sorted order of the class names."""
    return StringIndexer(inputCol=target, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="skip")
