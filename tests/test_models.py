"""Penalties against closed forms, training runs, scoring and streams."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabwright.operators import models
from tabwright.plans import contract, runs, scoring
from tabwright.streaming.scoring import score_stream

LABEL = models.LABEL


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1.0, 5.0, 0.2]
    y = x @ [2.0, -1.0, 4.0] + 7 + rng.normal(size=200)
    df = spark.createDataFrame([(float(v), Vectors.dense(r)) for r, v in zip(x, y)], [LABEL, "features"]).persist()
    return x, y, df


def centred(x, y):
    return x - x.mean(axis=0), y - y.mean()


def test_ridge_is_the_closed_form(numbers):
    x, y, df = numbers
    a, b = centred(x, y)
    fitted = models.fit_one("Ridge", "regression", {"alpha": 10}, df, models.facts_of(df, "regression", 0))
    np.testing.assert_allclose(fitted.coefficients.toArray(), np.linalg.solve(a.T @ a + 10 * np.eye(3), a.T @ b), rtol=1e-5)


@pytest.mark.parametrize("name, setting", [("Lasso", {"alpha": 0.1}), ("ElasticNet", {"alpha": 0.1, "l1_ratio": 0.5})])
def test_penalised_gradient_vanishes(numbers, name, setting):
    x, y, df = numbers
    a, b = centred(x, y)
    w = models.fit_one(name, "regression", setting, df, models.facts_of(df, "regression", 0)).coefficients.toArray()
    l1 = setting["alpha"] * setting.get("l1_ratio", 1.0)
    l2 = setting["alpha"] - l1
    gradient = a.T @ (a @ w - b) / len(b) + l2 * w
    for g, v in zip(gradient, w):
        assert abs(g + l1 * np.sign(v)) < 1e-3 if v else abs(g) <= l1 + 1e-3


def test_logistic_gradient_vanishes(spark, numbers):
    x, y, _ = numbers
    c = (y > y.mean()).astype(float)
    df = spark.createDataFrame([(float(v), Vectors.dense(r)) for r, v in zip(x, c)], [LABEL, "features"])
    fitted = models.fit_one("LogisticRegression", "classification", {"C": 0.1, "class_weight": None}, df, models.Facts(200))
    w = fitted.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + fitted.intercept)))
    np.testing.assert_allclose(w + 0.1 * x.T @ (p - c), 0, atol=0.05)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 2, f"{LABEL} double")
    got = {r[LABEL]: r[models.WEIGHT] for r in models.class_weights(df, 2).collect()}
    assert got == {0.0: pytest.approx(8 / 12), 1.0: 2.0}


def test_grids_hold_every_setting():
    sizes = {m: len(models.combinations(g)) for m, g in models.GRIDS["classification"].items()}
    assert sizes == {"LogisticRegression": 8, "DecisionTree": 16, "KNeighbors": 8, "RandomForest": 24, "GradientBoosting": 12, "SVC": 6}


@pytest.fixture(scope="module")
def people(spark):
    rows = [(float(20 + i % 40), "abc"[i % 3], f"{1000 + i * 13 % 500} usd", "yes" if (i % 40 > 20) == (i % 7 > 0) else "no") for i in range(240)]
    return spark.createDataFrame(rows, "age double, city string, income string, bought string")


GRIDS = {
    "LogisticRegression": {"C": [1], "class_weight": [None]}, "DecisionTree": {"max_depth": [3], "min_samples_split": [2], "class_weight": ["balanced"]},
    "KNeighbors": {"n_neighbors": [3, 5], "weights": ["uniform", "distance"]},
}


@pytest.fixture(scope="module")
def trained(people):
    return models.train(people, "bought", "classification", cv=2, models=["DecisionTree", "KNeighbors", "Broken"], grids={**GRIDS, "Broken": {"a": [1]}})


def test_training_run(trained):
    board = trained.leaderboard.orderBy("rank").collect()
    assert {r["Model"] for r in board} == {"DecisionTree", "KNeighbors"}
    assert [f[:2] for f in trained.failures] == [("Broken", None)]
    assert [r["Model"] for r in trained.failure_table().collect()] == ["Broken"]
    assert all(r["ROC_AUC"] is not None for r in board)
    assert trained.manifest["classes"] == ["no", "yes"] and trained.manifest["cv_folds"] == 2
    assert "bought" not in trained.manifest["features"]


def test_scoring_after_reload(spark, people, trained, tmp_path):
    trained.save(str(tmp_path / "run"))
    again = models.load(spark, str(tmp_path / "run"))
    for name in trained.models:
        rows = scoring.score(again, people, name).collect()
        assert len(rows) == people.count() and {r["prediction"] for r in rows} <= {"yes", "no"}
        assert all(0.5 <= r["confidence"] <= 1.0 for r in rows)
    template = scoring.input_template(people, again.manifest)
    assert template.columns == again.manifest["features"] and template.count() == 10


def test_scoring_takes_other_columns(spark, trained):
    rows = spark.createDataFrame([(33.0, "elsewhere", 5)], "` AGE` double, City string, other int")
    got = scoring.score(trained, rows, "DecisionTree").first().asDict()
    assert got["other"] == 5 and got["prediction"] in ("yes", "no")


def test_scoring_a_stream(spark, people, trained, tmp_path):
    people.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "in"))
    for name in ("DecisionTree", "KNeighbors"):
        out = str(tmp_path / name)
        score_stream(trained, stream, out, str(tmp_path / f"check-{name}"), name).awaitTermination(120)
        assert spark.read.parquet(out).count() == people.count()


def test_regression_run_and_reports(spark, people, tmp_path):
    report, quality, run = runs.run_baseline(
        people, statement="what is the income", cv=2, max_rows=150, models=["Ridge", "Lasso"], grids={"Ridge": {"alpha": [1]}, "Lasso": {"alpha": [0.1]}},
        path=str(tmp_path / "r"),
    )
    row = report.first()
    assert (row["task"], row["target"], row["metric"]) == ("regression", "income", "R2_Score")
    assert {r["section"] for r in quality.collect()} >= {"rows", "columns", "duplicate_rows"}
    assert run.manifest["train_rows"] + run.manifest["test_rows"] <= 150
    assert spark.read.json(str(tmp_path / "r" / "report")).count() == 1


def test_staged_run_reports_the_failing_stage(spark, people):
    report, run = runs.run_stages(people, "classification of bought", prepared=True, select=True, cv=2, models=["DecisionTree"], grids=GRIDS)
    assert [r["status"] for r in report.collect()] == ["ok"] * 5 and run is not None
    bad, none = runs.run_stages(people.withColumn("code", F.repeat("city", 2)), "x", "code", "regression", prepared=True)
    rows = {r["stage"]: r for r in bad.collect()}
    assert rows["check"]["status"] == "error" and "are numbers" in rows["check"]["detail"] and none is None


def test_folds_below_two_are_rejected(people):
    with pytest.raises(ValueError, match="two folds"):
        models.train(people, "bought", "classification", cv=1)
    with pytest.raises(ValueError, match="unsupported task"):
        models.train(people, "bought", "clustering")


def test_a_bad_setting_loses_itself_only(people, tmp_path):
    grids = {"DecisionTree": {"max_depth": [3, 99], "min_samples_split": [2], "class_weight": [None]}}
    report, run = runs.run_stages(people, "classification of bought", prepared=True, cv=2, models=["DecisionTree", "Broken"], grids={**grids, "Broken": {"a": [1]}})
    assert [(name, "99" in (params or "")) for name, params, _ in run.failures] == [("DecisionTree", True), ("Broken", False)]
    assert run.leaderboard.first()["Model"] == "DecisionTree"
    assert [r["stage"] for r in report.where("status = 'failed'").collect()] == ["train", "train"]
    run.save(str(tmp_path / "run"))
    assert models.load(people.sparkSession, str(tmp_path / "run")).failures == run.failures
    with pytest.raises(ValueError, match="no model"):
        models.train(people, "bought", "classification", cv=2, models=["DecisionTree"], grids={"DecisionTree": {"max_depth": [99], "class_weight": [None]}})


def test_trained_manifest_knows_its_categories(people, trained):
    assert trained.manifest["categories"]["city"] == ["a", "b", "c"]
    assert contract.check_contract(people, trained.manifest).where("check = 'unseen_categories'").count() == 0
    moved = people.withColumn("city", F.when(F.col("age") > 40, "elsewhere").otherwise(F.col("city")))
    assert [r["subject"] for r in contract.check_contract(moved, trained.manifest).where("check = 'unseen_categories'").collect()] == ["city"]


def test_features_called_like_the_columns_of_models(spark, people, tmp_path):
    df = people.select(F.col("age").alias("features"), F.col("city").alias("prediction"), F.col("income").alias("probability"), F.col("age").alias("rawPrediction"), "bought")
    run = models.train(df, "bought", "classification", cv=2, models=["DecisionTree", "KNeighbors"], grids=GRIDS)
    assert not run.failures and run.leaderboard.count() == 2
    rows = df.drop("prediction")
    assert scoring.score(run, rows, "DecisionTree").where("prediction in ('yes', 'no')").count() == df.count()


def test_rows_of_few_feature_combinations_can_be_trained(spark):
    """Each of 40 combinations has hundreds of rows, so no row can be held out without its copies; whole combinations are."""
    df = spark.range(20_000).selectExpr("id % 8 AS a", "id % 5 AS b", "CAST(3 * (id % 8) + id % 5 + (id % 97) / 1000.0 AS double) AS y")
    run = models.train(df, "y", "regression", cv=2, models=["Ridge"], grids={"Ridge": {"alpha": [1]}})
    assert run.manifest["held_out_by"] == "features" and run.manifest["features"] == ["a", "b"]
    assert run.manifest["train_rows"] + run.manifest["test_rows"] == df.distinct().count() and run.manifest["test_rows"] > 0
    assert run.leaderboard.first()["R2_Score"] > 0.9


def test_rows_with_features_of_their_own_are_held_out_by_row(trained):
    assert trained.manifest["held_out_by"] == "rows"


def test_one_combination_of_features_cannot_be_split(spark):
    df = spark.range(200).selectExpr("'x' AS a", "id AS y")
    with pytest.raises(ValueError):
        models.train(df, "y", "regression", cv=2, models=["Ridge"], grids={"Ridge": {"alpha": [1]}})


def test_a_search_reads_its_table_once(spark):
    """Folds, settings and the refit share one pass over what the table is made from."""
    from pyspark.ml.feature import VectorAssembler

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.range(0, 3000, 1, 4).selectExpr("CAST(id % 50 AS double) AS x", "CAST(2 * (id % 50) + id % 7 AS double) AS _label", "CAST(id % 3 AS int) AS _fold")
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.mapInPandas(count, rows.schema)).select("features", models.LABEL, models.FOLD)
    found = models.grid_search("Ridge", "regression", {"alpha": [1, 1e6]}, ready, 3, 0)
    assert found.params == {"alpha": 1} and found.mean > 0.9
    assert seen.value == 3000 and not ready.storageLevel.useMemory
