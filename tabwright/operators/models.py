"""The model catalogue, grid search over stored folds, and the training run."""

from __future__ import annotations

import itertools
import json
import platform
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import pyspark
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.text import CATEGORY_ALIASES
from tabwright.operators.cleaner import RobustCleaner
from tabwright.operators.dedupe import dedupe, remove_overlap
from tabwright.operators.encode import TablePreparer, vector_stages
from tabwright.operators.knn import neighbors, vote
from tabwright.operators.metrics import classification_metrics, regression_metrics, roc_auc, roc_auc_ovr
from tabwright.operators.profile import effective_cv, prune_lists
from tabwright.operators.report import leaderboard
from tabwright.operators.scale import col, key_hash, local_frame
from tabwright.operators.schema import drop_null_target, numeric_target
from tabwright.operators.split import add_folds, split_random, split_stratified

MAX_CLASSES = 10_000
MAX_DEPTH = 30  # the deepest tree Spark grows; stands for "no limit"
HEAVY = ["RandomForest", "GradientBoosting", "SVC"]
ONE_PASS = ["LinearRegression", "Ridge", "Lasso", "ElasticNet"]  # one reading of the rows fits them
LABEL, ROW, FOLD, WEIGHT, CLASS = "_label", "_id", "_fold", "_weight", "_class"
FEATURE = "f__"  # before the names of prepared features

# The searched settings of each model.
GRIDS: dict[str, dict[str, dict[str, list]]] = {
    "classification": {
        "LogisticRegression": {"C": [0.01, 0.1, 1, 10], "class_weight": [None, "balanced"]},
        "DecisionTree": {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5], "class_weight": [None, "balanced"]},
        "KNeighbors": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
        "RandomForest": {"n_estimators": [100, 200], "max_depth": [None, 10, 20], "min_samples_split": [2, 5], "class_weight": [None, "balanced"]},
        "GradientBoosting": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5]},
        "SVC": {"C": [0.1, 1, 10], "class_weight": [None, "balanced"]},
    },
    "regression": {
        "LinearRegression": {"fit_intercept": [True, False]},
        "Ridge": {"alpha": [0.01, 0.1, 1, 10, 100]},
        "Lasso": {"alpha": [0.001, 0.01, 0.1, 1]},
        "ElasticNet": {"alpha": [0.01, 0.1, 1], "l1_ratio": [0.2, 0.5, 0.8]},
        "RandomForest": {"n_estimators": [100, 200], "max_depth": [None, 10, 20], "min_samples_split": [2, 5]},
        "GradientBoosting": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [3, 5]},
    },
}


def combinations(grid: Mapping[str, Sequence]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


@dataclass
class Facts:
    """What a penalty needs to know about its training rows."""

    rows: int
    spread: float = 1.0  # population standard deviation of a numeric target
    classes: int = 2


def linear_regression(alpha: float = 0.0, l1_ratio: float = 0.0, intercept: bool = True, facts: Facts | None = None, **cols) -> LinearRegression:
    """Least squares with the usual penalty ``alpha * (l1_ratio |w| + (1 - l1_ratio) / 2 w^2)``.

    Spark scales the target to unit spread before it adds the squared part, which therefore is
    multiplied by the target's population deviation here.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * (facts.spread if facts else 1.0)
    total = l1 + l2
    return LinearRegression(
        regParam=total, elasticNetParam=l1 / total if total else 0.0, fitIntercept=intercept, standardization=False,
        solver="normal", maxIter=1000, tol=1e-10, **cols,
    )


def estimator(name: str, task: str, p: Mapping[str, Any], facts: Facts, seed: int = 42):
    """The Spark ML estimator of a catalogue model for one setting."""
    cols = {"featuresCol": "features", "labelCol": LABEL}
    weight = {"weightCol": WEIGHT} if p.get("class_weight") == "balanced" else {}
    if task == "regression":
        if name == "LinearRegression":
            return linear_regression(intercept=p["fit_intercept"], **cols)
        if name == "Ridge":  # the sum of squares is not divided by the rows here
            return linear_regression(alpha=p["alpha"] / facts.rows, facts=facts, **cols)
        if name == "Lasso":
            return linear_regression(alpha=p["alpha"], l1_ratio=1.0, **cols)
        if name == "ElasticNet":
            return linear_regression(alpha=p["alpha"], l1_ratio=p["l1_ratio"], facts=facts, **cols)
    if name == "LogisticRegression":
        return LogisticRegression(regParam=1.0 / (p["C"] * facts.rows), elasticNetParam=0.0, standardization=False, maxIter=100, **cols, **weight)
    if name == "SVC":
        svc = LinearSVC(regParam=1.0 / (p["C"] * facts.rows), standardization=False, maxIter=100, **cols, **weight)
        return svc if facts.classes == 2 else OneVsRest(classifier=svc, **cols, **weight)
    tree = {"maxDepth": p.get("max_depth") or MAX_DEPTH, "seed": seed, **cols}
    if "min_samples_split" in p:
        tree["minInstancesPerNode"] = max(1, p["min_samples_split"] // 2)
    if name == "DecisionTree":
        return DecisionTreeClassifier(**tree, **weight)
    if name == "RandomForest":
        forest = RandomForestClassifier if task == "classification" else RandomForestRegressor
        return forest(numTrees=p["n_estimators"], **tree, **weight)
    if name == "GradientBoosting":
        boosted = GBTClassifier if task == "classification" else GBTRegressor
        gbt = boosted(maxIter=p["n_estimators"], stepSize=p["learning_rate"], **tree)
        return OneVsRest(classifier=gbt, **cols) if task == "classification" and facts.classes > 2 else gbt
    raise ValueError(f"unknown model: {name}")


def neighbor_table(df: DataFrame) -> DataFrame:
    """Rows as the neighbour search takes them; class numbers as text that sorts like the numbers."""
    return df.select(ROW, LABEL, class_name(F.col(LABEL)).alias(CLASS), vector_to_array("features").alias("_x"))


def class_name(number):
    return F.lpad(number.cast("int").cast("string"), 6, "0")


class NeighborModel:
    """k-NN as a model: its state is the training table."""

    def __init__(self, train: DataFrame, k: int, weights: str):
        self.train, self.k, self.weights = train, k, weights

    def transform(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_x", vector_to_array("features"))
        near = neighbors(self.train, rows, self.k, features="_x", id_col=ROW, label=CLASS)
        voted = vote(near, self.k, self.weights).select(
            F.col("id").alias("_vid"), F.col("prediction").cast("double").alias("prediction"), "confidence", "shares"
        )
        return df.join(voted, df[ROW] == voted["_vid"], "left").drop("_vid")

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        spec = json.dumps({"k": self.k, "weights": self.weights})
        local_frame(self.train.sparkSession, [(spec,)], "value string").write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark, path: str) -> NeighborModel:
        spec = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        return cls(spark.read.parquet(f"{path}/train"), spec["k"], spec["weights"])


def class_weights(df: DataFrame, classes: int) -> DataFrame:
    """The rows with a weight that gives every class the same total."""
    counts = {r[LABEL]: r["n"] for r in df.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}  # one row per class
    total = sum(counts.values())
    table = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, total / (classes * n))])
    return df.withColumn(WEIGHT, F.element_at(table, F.col(LABEL)))


def fit_one(name: str, task: str, params: Mapping[str, Any], train: DataFrame, facts: Facts):
    if name == "KNeighbors":
        return NeighborModel(neighbor_table(train), params["n_neighbors"], params["weights"])
    return estimator(name, task, params, facts).fit(train)


def quality(task: str, predicted: DataFrame) -> float:
    """The score a search maximises: balanced accuracy or R2."""
    if task == "classification":
        return classification_metrics(predicted, LABEL, "prediction", digits=None).first()["balanced_accuracy"]
    return regression_metrics(predicted, LABEL, "prediction", digits=None).first()["r2"]


class ScoreEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Balanced accuracy or R2 of a prediction, for Spark's own tuning classes."""

    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)

    def __init__(self, task: str = "classification"):
        super().__init__()
        self._set(task=task)

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(quality(self.getOrDefault(self.task), dataset))

    def isLargerBetter(self) -> bool:
        return True


def cross_validator(name: str, task: str, grid: Mapping[str, Sequence], facts: Facts, folds: int, fold_column: str = FOLD, parallelism: int = 4) -> CrossValidator:
    """Spark's cross-validator over a catalogue model's settings and stored folds, scored by ``ScoreEvaluator``.

    Penalties follow ``facts``, the whole table's, where ``grid_search`` takes those of each fold's training rows; neighbours, which are no
    Spark estimator, and a setting that may fail without ending the search need ``grid_search``.
    """
    settings = combinations(grid)
    base = estimator(name, task, settings[0], facts)
    maps = []
    for setting in settings:
        one = estimator(name, task, setting, facts)
        maps.append({base.getParam(p.name): one.getOrDefault(p) for p in one.params if one.isSet(p) and p.name not in ("featuresCol", "labelCol")})
    return CrossValidator(estimator=base, estimatorParamMaps=maps, evaluator=ScoreEvaluator(task), numFolds=folds, foldCol=fold_column, parallelism=parallelism)


def facts_of(df: DataFrame, task: str, classes: int) -> Facts:
    row = df.agg(F.count("*").alias("n"), F.stddev_pop(LABEL).alias("s")).first()
    return Facts(row["n"], row["s"] or 1.0, classes) if task == "regression" else Facts(row["n"], 1.0, classes)


@dataclass
class Search:
    params: dict[str, Any]
    model: Any
    mean: float
    std: float
    failures: list[tuple[dict[str, Any], str]] = field(default_factory=list)


def grid_search(name, task, grid, train: DataFrame, folds: int, classes: int, parallelism: int = 4) -> Search:
    """Every setting on every fold; the best mean score is refitted on all rows.

    A setting that fails on any fold, or whose refit fails, is left out with its reason; only if all fail is that an error.
    """
    level = train.storageLevel
    if level.useMemory or level.useDisk:
        return _grid_search(name, task, grid, train, folds, classes, parallelism)
    train = train.persist()  # once for all folds and the refit
    try:
        return _grid_search(name, task, grid, train, folds, classes, parallelism)
    finally:
        if name != "KNeighbors":  # whose model is the table
            train.unpersist()


def _grid_search(name, task, grid, train, folds, classes, parallelism):
    settings = combinations(grid)
    scores: list[list[float]] = [[] for _ in settings]
    reasons: dict[int, str] = {}
    for fold in range(folds):
        part = train.where(F.col(FOLD) != fold)
        held = train.where(F.col(FOLD) == fold)
        facts = facts_of(part, task, classes)
        if task == "classification":
            part = class_weights(part, classes)
        copied = name not in ONE_PASS
        if copied:
            part, held = part.persist(), held.persist()
        try:
            if name == "KNeighbors":
                found = _neighbor_scores(settings, part, held)
            else:
                def run(i, part=part, held=held, facts=facts):
                    if i in reasons:
                        return None
                    try:
                        return quality(task, fit_one(name, task, settings[i], part, facts).transform(held))
                    except Exception as error:  # the other settings go on
                        reasons[i] = str(error).split("\n")[0]

                with ThreadPool(min(parallelism, len(settings))) as pool:
                    found = pool.map(run, range(len(settings)))
        finally:
            if copied:
                part.unpersist()
                held.unpersist()
        for i, v in enumerate(found):
            scores[i].append(v)
    whole = class_weights(train, classes) if task == "classification" else train
    means = {i: sum(v) / len(v) for i, v in enumerate(scores) if i not in reasons}
    facts = facts_of(train, task, classes)
    for best in sorted(means, key=lambda i: (-means[i], i)):
        try:
            model = fit_one(name, task, settings[best], whole, facts)
        except Exception as error:
            reasons[best] = str(error).split("\n")[0]
            continue
        std = (sum((v - means[best]) ** 2 for v in scores[best]) / len(scores[best])) ** 0.5
        return Search(settings[best], model, means[best], std, [(settings[i], reasons[i]) for i in sorted(reasons)])
    raise ValueError("; ".join(dict.fromkeys(reasons[i] for i in sorted(reasons))))


def _neighbor_scores(settings, part, held):
    """All k and weightings share one neighbour search with the largest k."""
    top = max(p["n_neighbors"] for p in settings)
    asked = neighbor_table(held)
    near = neighbors(neighbor_table(part), asked, top, features="_x", id_col=ROW, label=CLASS).persist()
    try:
        out = []
        for p in settings:
            voted = vote(near, p["n_neighbors"], p["weights"]).withColumn("prediction", F.col("prediction").cast("double"))
            out.append(quality("classification", asked.join(voted, asked[ROW] == voted["id"], "left")))
        return out
    finally:
        near.unpersist()


def test_row(name: str, task: str, search: Search, test: DataFrame, classes: int) -> dict[str, Any]:
    """Metrics of a fitted model on the held-out rows, as a leaderboard row."""
    predicted = search.model.transform(test).persist()
    try:
        if task == "regression":
            m = regression_metrics(predicted, LABEL, "prediction").first()
            return {
                "Model": name, "R2_Score": m["r2"], "MAE": m["mae"], "RMSE": m["rmse"], "CV_R2_Mean": round(search.mean, 4),
                "CV_R2_Std": round(search.std, 4), "Best_Params": json.dumps(search.params),
            }
        m = classification_metrics(predicted, LABEL, "prediction", positive="1.0").first()
        return {
            "Model": name, "Accuracy": m["accuracy"], "Balanced_Accuracy": m["balanced_accuracy"], "F1_Score": m["f1"],
            "Precision": m["precision"], "Recall": m["recall"], "ROC_AUC": _auc_of(predicted, classes),
            "CV_Balanced_Accuracy_Mean": round(search.mean, 4), "CV_Balanced_Accuracy_Std": round(search.std, 4),
            "Best_Params": json.dumps(search.params),
        }
    finally:
        predicted.unpersist()


def _auc_of(predicted: DataFrame, classes: int) -> float | None:
    if "shares" in predicted.columns:
        share = lambda i: F.coalesce(F.try_element_at("shares", F.lit(f"{i:06d}")), F.lit(0.0))
        predicted = predicted.withColumn("probability", array_to_vector(F.array(*[share(i) for i in range(classes)])))
    scores = "probability" if "probability" in predicted.columns else "rawPrediction" if "rawPrediction" in predicted.columns else None
    if scores is None:
        return None
    rows = predicted.select(LABEL, vector_to_array(scores).alias("s"))
    if classes == 2:
        return roc_auc(rows.withColumn("s", F.get("s", F.lit(1))), LABEL, "s", positive=1.0).first()["roc_auc"]
    sides = {str(float(i)): F.get(F.col("s"), F.lit(i)) for i in range(classes)}
    return roc_auc_ovr(rows, LABEL, sides).first()["roc_auc"]


SCHEMAS = {
    "classification": (
        "Model string, Accuracy double, Balanced_Accuracy double, F1_Score double, Precision double, Recall double, ROC_AUC double, "
        "CV_Balanced_Accuracy_Mean double, CV_Balanced_Accuracy_Std double, Best_Params string"
    ),
    "regression": "Model string, R2_Score double, MAE double, RMSE double, CV_R2_Mean double, CV_R2_Std double, Best_Params string",
}


@dataclass
class Trained:
    """A training run: leaderboard, fitted models, fitted preprocessing and its manifest."""

    task: str
    leaderboard: DataFrame
    models: dict[str, Any]
    preprocessing: PipelineModel
    manifest: dict[str, Any]
    failures: list[tuple[str, str | None, str]] = field(default_factory=list)

    def failure_table(self) -> DataFrame:
        """(Model, Params, Reason) of models, and single settings (as JSON), that could not be trained."""
        return local_frame(self.leaderboard.sparkSession, self.failures, "Model string, Params string, Reason string")

    def best(self) -> str:
        return self.leaderboard.orderBy("rank").first()["Model"]

    def save(self, path: str) -> None:
        self.preprocessing.write().overwrite().save(f"{path}/preprocessing")
        for name, model in self.models.items():
            target = f"{path}/models/{name}"
            model.save(target) if isinstance(model, NeighborModel) else model.write().overwrite().save(target)
        spark = self.leaderboard.sparkSession
        self.leaderboard.write.mode("overwrite").parquet(f"{path}/leaderboard")
        self.failure_table().write.mode("overwrite").parquet(f"{path}/failures")
        local_frame(spark, [(json.dumps(self.manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest")


def load(spark, path: str) -> Trained:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    models: dict[str, Any] = {}
    for name in manifest["models"]:
        place = f"{path}/models/{name}"
        models[name] = NeighborModel.load(spark, place) if name == "KNeighbors" else DefaultParamsReader.loadParamsInstance(place, spark)
    board = spark.read.parquet(f"{path}/leaderboard")
    failures = [tuple(r) for r in spark.read.parquet(f"{path}/failures").collect()]  # one row per searched setting at most
    return Trained(manifest["task"], board, models, PipelineModel.load(f"{path}/preprocessing"), manifest, failures)


def labelled(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str]]:
    """Rows with a usable target as ``_label``, and the class names in sorted order."""
    rows = drop_null_target(df, target)
    if task == "regression":
        rows = numeric_target(rows, target)
        if not rows.take(1):
            raise ValueError("the regression target has no valid numeric value")
        return rows.withColumn(LABEL, col(target)), []
    found = rows.select(col(target).alias("v")).distinct().orderBy("v").limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    classes = [str(r["v"]) for r in found]
    table = F.create_map(*[x for i, r in enumerate(found) for x in (F.lit(r["v"]), F.lit(float(i)))])
    return rows.withColumn(LABEL, F.element_at(table, col(target))), classes


def known_words(column: Mapping[str, Any]) -> list[str]:
    """Values that a fitted text column takes as they are: its categories, and what is respelled as one of them."""
    kept = set(column["categories"])
    spelled = [v for v, canonical in column.get("spellings", {}).items() if canonical in kept]
    return sorted({*kept, *spelled, *(a for a, word in CATEGORY_ALIASES.items() if word in kept)})


def _kept_features(
    df: DataFrame, parted: DataFrame, target: str, task: str, drop: Sequence[str], select: Callable[[DataFrame, str, str], Sequence[str]] | None
) -> tuple[list[str], list[str], dict[str, list[str]]]:
    """Features left, those dropped and those pruned, judged by the training rows of a split."""
    train_rows = parted.where(~F.col("is_test"))
    dropped = [c for c in dict.fromkeys([*drop, *(select(train_rows.select(*[col(c) for c in df.columns]), target, task) if select else [])]) if c != target]
    features = [c for c in df.columns if c != target and c not in dropped]
    pruned: dict[str, list[str]] = {"high_missing": [], "constant": [], "high_cardinality": []}
    for r in prune_lists(train_rows.select(*[col(c) for c in features])).orderBy("reason", "column").collect():
        pruned[r["reason"]].append(r["column"])
    gone = {c for cs in pruned.values() for c in cs}
    features = [c for c in features if c not in gone]
    if not features:
        raise ValueError("all features were pruned or dropped")
    return features, dropped, pruned


def train(
    df: DataFrame, target: str, task: str, cv: int = 3, skip_heavy: bool = False, models: Sequence[str] | None = None,
    grids: Mapping[str, Mapping[str, Sequence]] | None = None, drop: Sequence[str] = (), session_id: str = "", seed: int = 42,
    select: Callable[[DataFrame, str, str], Sequence[str]] | None = None, parallelism: int = 4,
) -> Trained:
    """Split, prune, clean, encode, search and rank. Everything is fitted on training rows only.

    ``select`` may name features to drop; it sees the training rows alone. A model that fails
    is left out; only if all fail is that an error. Test rows whose features also occur in train are removed; if that
    leaves none, as with few combinations of features in many rows, a fifth of the combinations is held out with all its rows.
    """
    if task not in GRIDS:
        raise ValueError(f"unsupported task: {task}")
    if cv < 2:
        raise ValueError("cross-validation needs at least two folds")
    names = list(models) if models is not None else [m for m in GRIDS[task] if not (skip_heavy and m in HEAVY)]
    rows, classes = labelled(dedupe(df), target, task)
    key = list(df.columns)
    parted = split_stratified(rows, LABEL, key, 0.2, seed) if task == "classification" and len(classes) > 1 else split_random(rows, key, 0.2, seed)
    parted = parted.persist()
    features, dropped, pruned = _kept_features(df, parted, target, task, drop, select)
    test_rows = remove_overlap(parted.where("is_test"), parted.where(~F.col("is_test")), features)
    held_out_by = "rows"
    if not test_rows.take(1):
        # every combination of features also occurs in train: whole combinations are held out instead of rows
        held_out_by = "features"
        parted.unpersist()
        parted = split_random(rows, features, 0.2, seed).persist()
        features, dropped, pruned = _kept_features(df, parted, target, task, drop, select)
        test_rows = remove_overlap(parted.where("is_test"), parted.where(~F.col("is_test")), features)
        if not test_rows.take(1):
            raise ValueError("all test rows also occur in train")
    train_rows = parted.where(~F.col("is_test"))

    folds = effective_cv(train_rows, LABEL, cv, task)
    # the row number is the position of the key hash, so k-NN ties do not depend on partitioning
    row_id = F.conv(F.substring(key_hash(key, seed, "id"), 1, 15), 16, 10).cast("bigint").alias(ROW)
    keep = [LABEL, ROW, FOLD]
    folded = add_folds(train_rows, folds, key, LABEL if task == "classification" else None, seed).withColumnRenamed("fold", FOLD)
    folded = folded.select(row_id, LABEL, FOLD, *[col(c) for c in features])
    held = test_rows.select(row_id, LABEL, F.lit(-1).alias(FOLD), *[col(c) for c in features])

    cleaner = RobustCleaner(carry=keep).fit(folded)
    clean = cleaner.transform(folded)
    preparer = TablePreparer(keep=keep, prefix=FEATURE).fit(clean)
    numeric, words = ([FEATURE + c for c in cleaner.columns_of_kind(kind)] for kind in ("numeric", "categorical"))
    encoder = Pipeline(stages=vector_stages(numeric, words)).fit(preparer.transform(clean))
    preprocessing = PipelineModel([cleaner, preparer, *encoder.stages])
    ready = preprocessing.transform(folded).select(ROW, LABEL, FOLD, "features").persist()
    held_ready = preprocessing.transform(held).select(ROW, LABEL, "features").persist()
    parts = {"train_rows": ready.count(), "test_rows": held_ready.count()}
    parted.unpersist()

    board, fitted, failures = [], {}, []
    for name in names:
        try:
            grid = (grids or {}).get(name) or GRIDS[task][name]
            found = grid_search(name, task, grid, ready, folds, len(classes), parallelism)
            board.append(test_row(name, task, found, held_ready, len(classes)))
            fitted[name] = found.model
            failures += [(name, json.dumps(p), reason) for p, reason in found.failures]
        except Exception as error:  # one model must not end the run
            failures.append((name, None, str(error).split("\n")[0]))
    held_ready.unpersist()
    if not any(isinstance(m, NeighborModel) for m in fitted.values()):
        ready.unpersist()
    if not board:
        raise ValueError(f"no model could be trained: {failures}")
    columns = [part.strip().split(" ")[0] for part in SCHEMAS[task].split(",")]
    table = local_frame(df.sparkSession, [tuple(r[c] for c in columns) for r in board], SCHEMAS[task])
    manifest = {
        "session_id": session_id, "task": task, "target": target, "classes": classes, "features": features, "dropped_features": dropped,
        "pruned_features": pruned, "models": list(fitted), "cv_folds": folds, "skip_heavy": skip_heavy, "held_out_by": held_out_by, **parts,
        "feature_names": cleaner.output_columns(), "kinds": {c["name"]: c["kind"] for c in cleaner.state["columns"]},
        "categories": {c["name"]: known_words(c) for c in cleaner.kept() if c["kind"] == "categorical" and "dictionary" not in c},
        "rare_share": {c["name"]: c.get("rare_share", 0.0) for c in cleaner.kept() if c["kind"] == "categorical" and "dictionary" not in c},
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
    }
    return Trained(task, leaderboard(table, task), fitted, preprocessing, manifest, failures)
