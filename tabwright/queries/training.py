"""Model fits, searches and whole runs. Runs keep all rows; searched settings are a short list."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwright.operators import encode, models, split
from tabwright.operators.metrics import classification_metrics
from tabwright.plans import contract, runs, scoring
from tabwright.queries.base import LINE_KEY, add, on, scratch, sql_of, table, view
from tabwright.queries.selection import FOLD_HASH

# l_extendedprice explained by l_quantity alone has a closed form for every penalty
MOMENTS = """(SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) AS sxy,
                     var_pop(l_quantity) AS sxx, avg(l_quantity * l_extendedprice) AS exy, avg(l_quantity * l_quantity) AS exx FROM lineitem)"""


def _line(name, setting):
    def run(spark, folder):
        rows = table(spark, folder, "lineitem").select(F.col("l_extendedprice").alias(models.LABEL), "l_quantity")
        ready = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows).select("features", models.LABEL)
        fitted = models.fit_one(name, "regression", setting, ready, models.facts_of(ready, "regression", 0))
        return spark.createDataFrame([(round(float(fitted.coefficients[0]), 3), round(float(fitted.intercept), 2))], "slope double, intercept double")
    return run


def _line_sql(slope: str, intercept: str = "my - slope * mx") -> str:
    return f"SELECT round(slope, 3) AS slope, round({intercept}, 2) AS intercept FROM (SELECT *, {slope} AS slope FROM {MOMENTS})"


add("linear_regression", _line("LinearRegression", {"fit_intercept": True}), _line_sql("sxy / sxx"))
add("linear_regression_origin", _line("LinearRegression", {"fit_intercept": False}), _line_sql("exy / exx", "CAST(0 AS DOUBLE)"))
add("ridge_regression", _line("Ridge", {"alpha": 100}), _line_sql("sxy / (sxx + 100.0 / n)"))
add("lasso_regression", _line("Lasso", {"alpha": 1}), _line_sql("sign(sxy) * greatest(abs(sxy) - 1, 0) / sxx"))
add("elastic_net_regression", _line("ElasticNet", {"alpha": 1, "l1_ratio": 0.5}), _line_sql("sign(sxy) * greatest(abs(sxy) - 0.5, 0) / (sxx + 0.5)"))


def _prepared(df, target):
    rows, classes = models.labelled(df, target, "classification")
    features = rows.drop(target)
    filled = encode.TablePreparer(keep=[models.LABEL]).fit(features).transform(features)
    numeric = [c for c, t in filled.dtypes if t in ("double", "bigint", "int") and c != models.LABEL]
    text = [c for c, t in filled.dtypes if t == "string"]
    ready = filled
    for stage in encode.vector_stages(numeric, text):
        ready = (stage.fit(ready) if hasattr(stage, "fit") else stage).transform(ready)
    return ready.select(models.LABEL, "features"), classes


add("encode_features", on("doc_quality", lambda df: _prepared(df, "quality")[0].groupBy(F.size(vector_to_array("features")).alias("width")).agg(F.count("*").alias("n"))), f"""
    SELECT CAST(1 + count(DISTINCT lang) + count(DISTINCT source) AS INTEGER) AS width, count(*) AS n FROM {sql_of("doc_quality")}""")
add("encode_vectors", on("doc_quality", lambda df: _prepared(df, "quality")[0].select(F.posexplode(vector_to_array("features")).alias("place", "v")).groupBy(
    "place", F.round("v", 4).alias("value")).agg(F.count("*").alias("n"))), f"""
    WITH t AS {sql_of("doc_quality")},
    q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS m, quantile_cont(n_chars, 0.75) AS b,
                 (SELECT lang FROM t WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS l, (SELECT source FROM t WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS s FROM t),
    w AS (SELECT 'lang' AS f, lang AS word FROM t WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source FROM t WHERE source IS NOT NULL GROUP BY source),
    p AS (SELECT f, word, CAST(row_number() OVER (ORDER BY f, word) AS INTEGER) AS place FROM w)
    SELECT 0 AS place, round((coalesce(n_chars, m) - m) / (b - a), 4) AS value, count(*) AS n FROM t, q GROUP BY ALL
    UNION ALL SELECT place, CASE WHEN word = CASE f WHEN 'lang' THEN coalesce(lang, l) ELSE coalesce(source, s) END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, count(*) FROM t, q, p GROUP BY ALL"""
)
add("encode_target", on("lineitem", lambda df: models.labelled(df.select("l_returnflag", "l_quantity"), "l_returnflag", "classification")[0].groupBy(
    "l_returnflag", F.col(models.LABEL).alias("label")).agg(F.count("*").alias("n"))), """
    SELECT l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS label, count(*) AS n FROM lineitem GROUP BY l_returnflag""")


def _classifier(name, setting):
    def run(spark, folder):
        ready, classes = _prepared(view(spark, folder, "doc_quality"), "quality")
        ready = models.class_weights(ready, len(classes)).persist()
        fitted = models.fit_one(name, "classification", setting, ready, models.facts_of(ready, "classification", len(classes)))
        return classification_metrics(fitted.transform(ready), models.LABEL, "prediction", positive="1.0")
    return run


add("logistic_regression", _classifier("LogisticRegression", {"C": 1, "class_weight": "balanced"}))
add("decision_tree", _classifier("DecisionTree", {"max_depth": 5, "min_samples_split": 2, "class_weight": None}))
add("random_forest", _classifier("RandomForest", {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "class_weight": None}))
add("gradient_boosting", _classifier("GradientBoosting", {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}))
add("linear_svc", _classifier("SVC", {"C": 1, "class_weight": "balanced"}))

# a label that follows from the quantity, but for noise, and the tree of one split, which SQL can search
STEPS = """SELECT CAST(l_linenumber AS double) AS line, floor(l_quantity / 5) AS step, round(l_discount * 100) AS discount,
                  CASE WHEN l_quantity + l_partkey % 10 > 30 THEN 1.0 ELSE 0.0 END AS y FROM {lineitem}"""
STUMP_SQL = f"""
    WITH t AS ({STEPS.format(lineitem="lineitem")}),
    l AS (SELECT 'line' AS f, line AS x, y FROM t UNION ALL SELECT 'step', step, y FROM t UNION ALL SELECT 'discount', discount, y FROM t),
    v AS (SELECT f, x, count(*) AS n, sum(y) AS s FROM l GROUP BY f, x),
    c AS (SELECT f, (x + lead(x) OVER w) / 2 AS cut, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s
          FROM v WINDOW w AS (PARTITION BY f ORDER BY x)),
    best AS (SELECT f, cut, s1 / n1 > 0.5 AS low, (s - s1) / (n - n1) > 0.5 AS high FROM c WHERE cut IS NOT NULL
             ORDER BY s1 * (n1 - s1) / n1 + (s - s1) * (n - n1 - s + s1) / (n - n1) LIMIT 1)
    SELECT step, CAST(CASE WHEN CASE f WHEN 'line' THEN line WHEN 'step' THEN step ELSE discount END <= cut THEN low ELSE high END AS DOUBLE) AS prediction, count(*) AS n
    FROM t, best GROUP BY ALL"""


def _stump(name, setting):
    """Predictions of a tree with one split, by step."""
    def run(spark, folder):
        rows = spark.sql(STEPS, lineitem=table(spark, folder, "lineitem")).select(F.col("step").cast("double").alias("step"), "line", "discount", F.col("y").cast("double").alias(models.LABEL))
        ready = VectorAssembler(inputCols=["line", "step", "discount"], outputCol="features").transform(rows)
        fitted = models.fit_one(name, "classification", setting, ready, models.facts_of(ready, "classification", 2))
        return fitted.transform(ready).groupBy("step", "prediction").agg(F.count("*").alias("n"))
    return run


add("decision_tree_stump", _stump("DecisionTree", {"max_depth": 1, "min_samples_split": 2}), STUMP_SQL)
add("random_forest_stump", _stump("RandomForest", {"n_estimators": 1, "max_depth": 1, "min_samples_split": 2}), STUMP_SQL)
add("gradient_boosting_stump", _stump("GradientBoosting", {"n_estimators": 1, "learning_rate": 0.1, "max_depth": 1}), STUMP_SQL)

# one feature of two values: every class share is met, so the optimum is known
HALVES = "SELECT CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS b, CASE WHEN l_quantity + l_partkey % 10 > 30 THEN 1.0 ELSE 0.0 END AS y FROM {lineitem}"


def _halves(spark, folder, name, setting):
    rows = spark.sql(HALVES, lineitem=table(spark, folder, "lineitem")).select(F.col("b").cast("double").alias("b"), F.col("y").cast("double").alias(models.LABEL))
    ready = VectorAssembler(inputCols=["b"], outputCol="features").transform(rows).persist()
    return ready, models.fit_one(name, "classification", setting, ready, models.facts_of(ready, "classification", 2))


def _logistic(spark, folder):
    _, fitted = _halves(spark, folder, "LogisticRegression", {"C": 1e9, "class_weight": None})
    return spark.createDataFrame([(round(float(fitted.coefficients[0]), 2), round(float(fitted.intercept), 2))], "slope double, intercept double")


add("logistic_closed_form", _logistic, f"""
    WITH t AS ({HALVES.format(lineitem="lineitem")}), p AS (SELECT avg(y) FILTER (WHERE b = 0) AS p0, avg(y) FILTER (WHERE b = 1) AS p1 FROM t)
    SELECT round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 2) AS slope, round(ln(p0 / (1 - p0)), 2) AS intercept FROM p""")


def _majority(spark, folder):
    ready, fitted = _halves(spark, folder, "SVC", {"C": 10, "class_weight": None})
    return fitted.transform(ready).groupBy("b", "prediction").agg(F.count("*").alias("n"))


add("linear_svc_majority", _majority, f"""
    SELECT CAST(b AS DOUBLE) AS b, CAST(avg(y) > 0.5 AS DOUBLE) AS prediction, count(*) AS n FROM ({HALVES.format(lineitem="lineitem")}) GROUP BY b""")


def _ridge_search(spark, folder):
    rows = split.add_folds(table(spark, folder, "lineitem"), 3, LINE_KEY).select(F.col("l_extendedprice").alias(models.LABEL), "l_quantity", F.col("fold").alias(models.FOLD))
    ready = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows).select("features", models.LABEL, models.FOLD)
    found = models.grid_search("Ridge", "regression", {"alpha": [1, 1e6, 1e7]}, ready, 3, 0)
    return spark.createDataFrame([(float(found.params["alpha"]), round(found.mean, 6), round(found.std, 6))], "alpha double, cv_mean double, cv_std double")


add("ridge_grid_search", _ridge_search, f"""
    WITH f AS (SELECT l_quantity AS x, l_extendedprice AS y, CAST(rn > round(n / 3) AS INTEGER) + CAST(rn > round(n * 2 / 3) AS INTEGER) AS fold
               FROM (SELECT *, row_number() OVER (ORDER BY {FOLD_HASH}) AS rn, count(*) OVER () AS n FROM lineitem)),
    m AS (SELECT k, a, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) / (var_pop(x) + a / count(*)) AS slope FROM f, range(3) k(k), (SELECT unnest([1.0, 1e6, 1e7]::DOUBLE[]) AS a) WHERE fold <> k GROUP BY k, a),
    s AS (SELECT k, a, 1 - sum((y - my - slope * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f JOIN m ON fold = k GROUP BY k, a)
    SELECT a AS alpha, round(avg(r2), 6) AS cv_mean, round(stddev_pop(r2), 6) AS cv_std FROM s GROUP BY a ORDER BY avg(r2) DESC LIMIT 1""")


def _cross_validated(spark, folder):
    """Mean R2 of lines with and without an intercept over stored folds, by Spark's own cross-validator."""
    rows = split.add_folds(table(spark, folder, "lineitem"), 3, LINE_KEY).select(F.col("l_extendedprice").alias(models.LABEL), "l_quantity", F.col("fold").alias(models.FOLD))
    ready = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows).select("features", models.LABEL, models.FOLD).persist()
    fitted = models.cross_validator("LinearRegression", "regression", {"fit_intercept": [True, False]}, models.facts_of(ready, "regression", 0), 3).fit(ready)
    return spark.createDataFrame([(b, round(float(v), 6)) for b, v in zip((True, False), fitted.avgMetrics)], "fit_intercept boolean, cv_mean double")


add("line_cross_validator", _cross_validated, f"""
    WITH f AS (SELECT l_quantity AS x, l_extendedprice AS y, CAST(rn > round(n / 3) AS INTEGER) + CAST(rn > round(n * 2 / 3) AS INTEGER) AS fold
               FROM (SELECT *, row_number() OVER (ORDER BY {FOLD_HASH}) AS rn, count(*) OVER () AS n FROM lineitem)),
    m AS (SELECT k, b, CASE WHEN b THEN covar_pop(x, y) / var_pop(x) ELSE sum(x * y) / sum(x * x) END AS slope, CASE WHEN b THEN avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) ELSE 0 END AS base
          FROM f, range(3) k(k), (SELECT unnest([true, false]) AS b) WHERE fold <> k GROUP BY k, b),
    s AS (SELECT k, b, 1 - sum((y - base - slope * x) ** 2) / (var_pop(y) * count(*)) AS r2 FROM f JOIN m ON fold = k GROUP BY k, b)
    SELECT b AS fit_intercept, round(avg(r2), 6) AS cv_mean FROM s GROUP BY b""")

SHORT = {
    "LogisticRegression": {"C": [1], "class_weight": ["balanced"]},
    "DecisionTree": {"max_depth": [3, 5], "min_samples_split": [2], "class_weight": ["balanced"]},
    "Ridge": {"alpha": [1, 100]}, "Lasso": {"alpha": [0.1, 1]},
}


def _trained(spark, folder, names):
    return models.train(view(spark, folder, "doc_quality"), "quality", "classification", cv=2, models=names, grids=SHORT)


add("train_classifiers", lambda s, d: _trained(s, d, ["LogisticRegression", "DecisionTree"]).leaderboard)
add("train_regressors", on("line_sample", lambda df: models.train(df, "l_extendedprice", "regression", cv=2, models=["Ridge", "Lasso"], grids=SHORT).leaderboard))


def _score_saved(spark, folder):
    path = f"{scratch(spark)}/run"
    _trained(spark, folder, ["DecisionTree"]).save(path)
    return scoring.score(models.load(spark, path), view(spark, folder, "doc_quality"))


add("score_saved_run", _score_saved)


def _same_after_reload(spark, folder):
    """Scores of a run as it was trained and as it was loaded again, compared as counted rows."""
    rows, path = view(spark, folder, "doc_quality"), f"{scratch(spark)}/run"
    trained = _trained(spark, folder, ["DecisionTree"])
    trained.save(path)
    one, two = [scoring.score(run, rows).withColumn("confidence", F.round("confidence", 9)) for run in (trained, models.load(spark, path))]
    counted = [df.groupBy(*df.columns).agg(F.count("*").alias(f"n{i}")) for i, df in enumerate((one, two))]
    both = counted[0].join(counted[1], one.columns, "full")
    return both.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("rows"), F.bool_and(F.col("n0").eqNullSafe(F.col("n1"))).alias("same"))


add("score_after_reload", _same_after_reload, f"SELECT count(*) AS rows, true AS same FROM {sql_of('doc_quality')}")


def _drift(spark, folder):
    """A trained run's own manifest against its training rows and against rows with languages it has not seen."""
    rows = view(spark, folder, "doc_quality")
    manifest = _trained(spark, folder, ["DecisionTree"]).manifest
    moved = rows.withColumn("lang", F.when(F.col("n_chars") % 4 == 0, "klingon").otherwise(F.col("lang")))
    issues = [contract.check_contract(df, manifest).where("check = 'unseen_categories' and subject = 'lang'").select(F.lit(name).alias("rows"), "subject", F.round("value", 3).alias("share")) for name, df in (("same", rows), ("moved", moved))]
    return issues[0].unionByName(issues[1])


add("drift_of_trained_run", _drift, f"""
    SELECT 'moved' AS rows, 'lang' AS subject, round(avg(CASE WHEN n_chars % 4 = 0 THEN 1.0 ELSE 0.0 END), 3) AS share FROM {sql_of('doc_quality')} WHERE lang IS NOT NULL OR n_chars % 4 = 0""")
add("baseline_run", on("line_sample", lambda df: runs.run_baseline(
    df, "l_extendedprice", "regression", cv=2, max_rows=0, models=["Ridge"], grids=SHORT)[0].drop("best_params")))
add("staged_run", on("doc_quality", lambda df: runs.run_stages(
    df, "predict the quality class", "quality", "classification", prepared=True, cv=2, models=["DecisionTree"], grids=SHORT)[0]))
