"""Exact model metrics over prediction tables of any length."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators.scale import RANK_ROWS, col, running_totals


def confusion(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return pred.groupBy(col(y).cast("string").alias("y"), col(p).cast("string").alias("p")).agg(F.count("*").alias("n"))


def classification_metrics(pred: DataFrame, y: str = "y", p: str = "p", positive: str = "1", digits: int | None = 4) -> DataFrame:
    """One row: accuracy, balanced_accuracy, f1, precision, recall.

    F1 is weighted by class size; precision and recall belong to the positive class when
    there are two classes, else they are weighted too. A zero denominator counts as 0.
    """
    table = confusion(pred, y, p)
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = table.select(F.inline(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
    )))
    per_class = sides.groupBy("c").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    support, tp = F.col("support"), F.col("tp")
    per_class = per_class.select(
        "c", "support", "tp",
        ratio(tp, F.col("predicted")).alias("prec"), ratio(tp, support).alias("rec"),
        ratio(2 * tp, support + F.col("predicted")).alias("f"),
    )
    weighted = lambda name: F.sum(F.col(name) * support) / F.sum(support)
    positive_only = lambda name: F.coalesce(F.max(F.when(F.col("c") == positive, F.col(name))), F.lit(0.0))
    binary = F.count_if(support > 0) == 2
    out = per_class.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(support > 0, F.col("rec"))).alias("balanced_accuracy"),
        weighted("f").alias("f1"),
        F.when(binary, positive_only("prec")).otherwise(weighted("prec")).alias("precision"),
        F.when(binary, positive_only("rec")).otherwise(weighted("rec")).alias("recall"),
    )
    return _rounded(out, digits)


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    return df if digits is None else df.select(*[F.round(c, digits).alias(c) for c in df.columns])


def roc_auc(pred: DataFrame, y: str = "y", score: str = "score", positive=1, digits: int | None = 4, rank_rows: int = RANK_ROWS) -> DataFrame:
    """One row (roc_auc): chance that a positive outranks a negative, ties counted half."""
    return _auc(pred, {"": (col(y) == F.lit(positive), col(score))}, digits, rank_rows)


def roc_auc_ovr(pred: DataFrame, y: str, scores: Mapping[str, Column], digits: int | None = 4, rank_rows: int = RANK_ROWS) -> DataFrame:
    """One row (roc_auc): mean over the classes of each class against the rest."""
    sides = {c: (col(y).cast("string") == F.lit(c), s) for c, s in scores.items()}
    return _auc(pred, sides, digits, rank_rows)


def _auc(pred, sides, digits, rank_rows):
    long = pred.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("side"), hit.alias("hit"), s.cast("double").alias("s")) for name, (hit, s) in sides.items()
    ]))).where("s IS NOT NULL AND hit IS NOT NULL")
    ties = long.groupBy("side", "s").agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    ranked = running_totals(ties, ["side", "s"], {"below": F.col("neg")}, rank_rows=rank_rows)
    pos, neg, below = (F.col(c).cast("double") for c in ("pos", "neg", "below"))
    per_side = ranked.groupBy("side").agg(
        F.sum(pos).alias("p"), F.sum(neg).alias("n"), F.min(below).alias("start"), F.sum(pos * (below + neg / 2)).alias("wins")
    )
    value = F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("wins") - F.col("start") * F.col("p")) / (F.col("p") * F.col("n")))
    out = per_side.agg(F.when(F.count(value) == F.count("*"), F.avg(value)).alias("roc_auc"))
    return _rounded(out, digits)


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "p", digits: int | None = 4) -> DataFrame:
    """One row: r2, mae, rmse, from one pass. A missing label or prediction is an error: leaving it out would flatter the rest."""
    a, b = col(y).cast("double"), col(p).cast("double")
    err = a - b
    whole = F.when(F.count_if(a.isNull() | b.isNull()) > 0, F.raise_error("rows without a label or a prediction"))
    out = pred.agg(
        F.coalesce(whole.cast("double"), F.sum(err * err)).alias("ss"), F.avg(F.abs(err)).alias("mae"), (F.var_pop(a) * F.count(a)).alias("total"), F.count(a).alias("n"),
    )
    return _rounded(out.select(
        F.when(F.col("total") > 0, 1 - F.col("ss") / F.col("total")).alias("r2"), "mae",
        F.sqrt(F.col("ss") / F.when(F.col("n") > 0, F.col("n"))).alias("rmse"),
    ), digits)
