"""Leaderboards of trained models. A board has one row per model, so it is always short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = {"classification": ["Balanced_Accuracy", "Accuracy"], "regression": ["R2_Score"]}
# metrics by preference; the flag tells whether higher is better
METRICS = {
    "classification": [("Balanced_Accuracy", True), ("Accuracy", True), ("F1_Score", True), ("ROC_AUC", True)],
    "regression": [("R2_Score", True), ("CV_R2_Mean", True), ("RMSE", False), ("MAE", False)],
}


def leaderboard(results: DataFrame, task: str) -> DataFrame:
    """The board with its ``rank``, best first; equal scores go by model name."""
    keys = [F.desc_nulls_last(c) for c in ORDER[task] if c in results.columns] + [F.asc("Model")]
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)))


def best_model(results: DataFrame, task: str, position: str | None = None) -> DataFrame:
    """(Model, score): the highest score; on a tie the earlier one by ``position`` or name."""
    metric = ORDER[task][0]
    order = F.col(position) if position else F.col("Model")
    best = results.where(F.col(metric).isNotNull()).agg(F.min(F.struct((-F.col(metric)).alias("s"), order.alias("o"), F.col("Model").alias("m"))).alias("b"))
    return best.select(F.col("b.m").alias("Model"), (-F.col("b.s")).alias("score"))


def best_summary(results: DataFrame, task: str) -> DataFrame:
    """One row about the top model: metric, score, runner-up, gap and a sentence of reason."""
    ranked = leaderboard(results, task)
    known = [(m, up) for m, up in METRICS[task] if m in results.columns]
    top = lambda e: F.max(F.when(F.col("rank") == 1, e))
    second = lambda e: F.max(F.when(F.col("rank") == 2, e))
    row = ranked.agg(
        F.count("*").alias("_models"), top(F.col("Model")).alias("best_model"), second(F.col("Model")).alias("runner_up_model"),
        *[f(F.col(m).cast("double")).alias(f"{p}{m}") for m, _ in known for p, f in (("_1", top), ("_2", second))],
    )
    metric, score, other, sign = F.lit("score"), F.lit(0.0), F.lit(None).cast("double"), F.lit(1.0)
    for m, up in reversed(known):
        has = F.col(f"_1{m}").isNotNull()
        metric = F.when(has, F.lit(m)).otherwise(metric)
        score = F.when(has, F.col(f"_1{m}")).otherwise(score)
        other = F.when(has, F.col(f"_2{m}")).otherwise(other)
        sign = F.when(has, F.lit(1.0 if up else -1.0)).otherwise(sign)
    row = row.select("_models", "best_model", metric.alias("best_metric"), score.alias("best_score"), "runner_up_model", ((score - other) * sign).alias("score_gap"))
    return row.select(
        "best_model", "best_metric", "best_score", "runner_up_model", "score_gap", _reason().alias("reason"),
    )


def _reason() -> Column:
    head = F.concat(F.col("best_model"), F.lit(" comes first: "), F.col("best_metric"), F.format_string(" %.4f", F.col("best_score")))
    return (
        F.when(F.col("_models") == 0, F.lit("There is no model to compare."))
        .when(F.col("score_gap").isNull(), F.concat(head, F.lit(", the only result.")))
        .otherwise(F.concat(
            head, F.lit("; "), F.col("runner_up_model"), F.lit(" is behind by "),
            F.format_string("%.4f", F.col("score_gap")), F.lit("."),
        ))
    )
