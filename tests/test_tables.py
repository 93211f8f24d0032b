"""Fixture frames with known results: schema, cleaning, selection, contract, reports."""

import pytest
from pyspark.sql import functions as F

from tabwright.operators import cleaner, encode, infer, metrics, report, schema, select
from tabwright.operators import profile as prof
from tabwright.operators.scale import local_frame
from tabwright.operators.valuecounts import cols_of_kind
from tabwright.plans import ask, contract, prepare
from tabwright.sources import tables


def test_names_are_normalised_and_counted():
    names = [" Age ", "City\t", "event date", "A-b", "a_b", "​!!", "Ｎame"]
    assert schema.normalized_names(names) == ["age", "city", "event_date", "a_b", "a_b_1", "column", "name"]


def test_alignment_by_occurrence(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, ` A ` int, c int")
    assert schema.align_schema(df, [("a", "int"), ("a_1", "int"), ("z", "double")]).first().asDict() == {"a": 1, "a_1": 2, "z": None}


def test_messy_frame(spark):
    df = spark.createDataFrame(
        [(" 20 ", " New   York ", "$1,000", "2024-01-01"), ("N/A", "new york", "1e3", "01/02/24"), (" 30", "​Unknown", "-", "bad-date")],
        "` Age ` string, `City\t` string, income string, `event date` string",
    )
    model = cleaner.RobustCleaner(rareMinCount=1).fit(df)
    kinds = {c["name"]: c["kind"] for c in model.state["columns"]}
    assert kinds == {"age": "numeric", "city": "categorical", "income": "numeric", "event_date": "datetime"}
    rows = model.transform(df).collect()
    assert {"age", "event_date__year", "event_date__missing"} <= set(rows[0].asDict())
    assert "city" not in rows[0].asDict() and "income" not in rows[0].asDict()
    assert [r["age"] for r in rows] == [20.0, None, 30.0]
    assert [r["event_date__missing"] for r in rows] == [0, 0, 1]
    assert [r["age__missing"] for r in rows] == [0, 1, 0]


def test_transform_aligns_and_maps_unseen(spark):
    train = spark.createDataFrame([(20, "NY"), (25, "LA"), (30, "NY")], "Age long, City string")
    test = spark.createDataFrame([(35, "Chicago", "x")], "` age ` long, CITY string, `Extra Field` string")
    model = cleaner.RobustCleaner(rareMinCount=1).fit(train)
    assert model.transform(test).columns == model.output_columns()
    assert model.transform(test).first().asDict() == {"age": 35.0, "city": "__other__"}


def test_aliases_merge_spellings(spark):
    df = spark.createDataFrame([("NY", 1), ("new york", 2), ("LA", 3), ("los angeles", 4)], "City string, Value long")
    model = cleaner.RobustCleaner(rareMinCount=1).fit(df)
    assert {r["city"] for r in model.transform(df).collect()} == {"new york", "los angeles"}


def test_repeated_names_survive_transform(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "a int, ` A` double")
    got = cleaner.RobustCleaner().fit(df).transform(df).orderBy("a").collect()
    assert [(r["a"], r["a_1"]) for r in got] == [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]


def test_cleaner_saves_loads_and_carries(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i % 2}", float(i)) for i in range(50)], "id int, c string, v double")
    model = cleaner.RobustCleaner(rareMinCount=1, carry=["id"]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = cleaner.RobustCleanerModel.load(str(tmp_path / "m"))
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, model.transform(df).collect()))
    assert [r["id"] for r in model.transform(df).orderBy("id").collect()] == list(range(50))


def test_test_rows_do_not_change_the_fit(spark):
    train = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(100)], "v double, c string")
    model = cleaner.RobustCleaner(rareMinCount=1).fit(train)
    before = model.getOrDefault(model.manifest)
    model.transform(spark.createDataFrame([(1e9, "zzz")], "v double, c string")).collect()
    assert model.getOrDefault(model.manifest) == before
    assert model.transform(spark.createDataFrame([(1e9, "zzz")], "v double, c string")).first()["v"] == pytest.approx(98.505)


def test_no_usable_feature_is_an_error(spark):
    with pytest.raises(ValueError, match="no usable feature"):
        cleaner.RobustCleaner().fit(spark.createDataFrame([("x",)] * 5, "c string"))


def test_fuzzy_merge(spark):
    words = ["washington", "washingtons", "new  york", "newyork", "abc", "abd", "oslo"]
    df = spark.createDataFrame([("c", w, 1) for w in words], "column string, value string, n int")
    got = {r["value"]: r["canonical"] for r in cleaner.fuzzy_map(df).collect()}
    assert got == {"washington": "washington", "washingtons": "washington", "newyork": "newyork", "new  york": "newyork", "abc": "abc", "abd": "abd", "oslo": "oslo"}


def test_fuzzy_leaves_long_columns_alone(spark):
    df = spark.range(501).select(F.lit("c").alias("column"), F.concat(F.lit("value number "), "id").alias("value"), F.lit(1).alias("n"))
    assert cleaner.fuzzy_map(df).where("value <> canonical").count() == 0


def test_dedupe_then_null_target(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "A", 1.0), (2, "B", 0.0), (3, "C", None)], "f1 long, f2 string, target double")
    assert schema.drop_null_target(df.dropDuplicates(), "target").count() == 2
    with pytest.raises(ValueError):
        schema.drop_null_target(df.where("f1 = 3"), "target")


def test_numeric_target(spark):
    df = spark.createDataFrame([("A", "1,000"), ("B", "$2000"), ("C", "bad"), ("D", "3000")], "city string, target string")
    assert sorted(r["target"] for r in schema.numeric_target(df, "target").collect()) == [1000.0, 2000.0, 3000.0]


def test_shape_gate(spark):
    with pytest.raises(ValueError, match="9 rows"):
        tables.require_shape(spark.range(9).withColumn("b", F.lit(1)))
    with pytest.raises(ValueError, match="1 columns"):
        tables.require_shape(spark.range(20))


def test_json_safe_reaches_nested_values(spark):
    df = spark.sql("SELECT array(double('NaN'), 1.0) AS a, named_struct('x', double('inf')) AS s, map('k', double('-inf')) AS m, double('NaN') AS d")
    row = tables.json_safe(df).first()
    assert (row["a"], row["s"]["x"], row["m"]["k"], row["d"]) == ([None, 1.0], None, None, None)


def test_csv_types_survive_missing_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e\n1,1.5,True,x,\n N/A,NA,False,null,\n3,2,,y,\n".replace(" N/A", "N/A"))
    df = tables.read_table(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    assert [tuple(r)[:4] for r in df.collect()] == [(1, 1.5, True, "x"), (None, None, False, None), (3, 2.0, None, "y")]


def test_quartiles_match_linear_interpolation(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "v int")
    row = prof.describe_numeric(df).first()
    assert (row["count"], row["p25"], row["p50"], row["p75"]) == (4, 1.75, 2.5, 3.25)


def test_log_and_clip_gates(spark):
    df = spark.createDataFrame([(float(i), float(i - 50), 5.0) for i in range(19)], "a double, b double, c double")
    assert prof.log_columns(df).count() == 0
    assert {r["column"] for r in prof.clip_bounds(df).collect()} == {"a", "b"}
    assert prof.clip_bounds(df.limit(9)).count() == 0


def test_gates(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", None), (None, "3")], "y string, n string")
    assert prof.class_gate(df, "y").first().asDict() == {"classes": 2, "smallest": 1, "ok": False}
    assert prof.numeric_gate(df, "n").first()["valid_ratio"] == 0.5
    with pytest.raises(ValueError):
        prof.effective_cv(df, "y", 1, "classification")
    assert prof.effective_cv(df, "y", 5, "classification") == 2


def test_protected_columns_match_words(spark):
    df = spark.createDataFrame([(i, f"c{i}", i % 2, float(i)) for i in range(20)], "id long, city string, flag int, SalePrice double")
    assert schema.protected_columns(df) == ["flag", "SalePrice"]


def test_target_choice(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}", float(i * 7 % 101), "yn"[i % 2]) for i in range(60)], "id long, city string, price double, churned string")
    assert infer.choose_target(df, "What sets the price of a flat?") == {"target": "price", "task": "regression"}
    assert infer.choose_target(df, "classification of id") == {"target": "id", "task": "regression"}
    assert infer.choose_target(df, "predict city") == {"target": "city", "task": "classification"}
    assert infer.choose_target(df, "what will happen")["target"] == "price"
    assert infer.fallback_target(df) == {"target": "churned", "task": "classification"}
    with pytest.raises(ValueError):
        infer.validate_target(df, {"target": "nope", "task": "regression"})


def test_rich_types(spark):
    df = spark.createDataFrame(
        [("003", "$100", "75%", "1h 20min", "yes", "12kg", "1.5e-1", "2020-01-01", "5", "-"), ("104", "$1,200", "5%", "00:15:30", "No", "x", "2.0", "1 Jan 2020", "6", "NA")],
        "code string, cost string, share string, lasts string, flag string, mixed string, sci string, day string, count string, gone string",
    )
    got = {r["column"]: r["dtype"] for r in infer.recommend_types(df, "rich").collect()}
    assert got == {
        "code": "object", "cost": "float", "share": "float", "lasts": "object", "flag": "boolean", "mixed": "object", "sci": "float", "day": "date",
        "count": "integer", "gone": "object",
    }


def test_identifiers_stay_text(spark):
    df = spark.createDataFrame([(1, "555", "7")], "user_id long, phone string, width string")
    got = {r["column"]: r["dtype"] for r in infer.recommend_types(df, "rich").collect()}
    assert got == {"user_id": "object", "phone": "object", "width": "integer"}


def test_casts_need_enough_numbers(spark):
    df = spark.createDataFrame([("1.5", "a"), ("2.5", "2"), ("x", "3"), ("4", "b")], "a string, b string")
    got = infer.apply_casts(df, {"a": "int", "b": "integer", "absent": "float"})
    assert dict(got.dtypes) == {"a": "bigint", "b": "string"}
    assert [r["a"] for r in got.collect()] == [2, 2, None, 4]


def test_prepare(spark):
    rows = [(f"2024-01-{i + 1:02d}", f"{i + 1}h 5min", f"{i} kg", f"{i} items left", float(i), i % 2) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0]], "day string, lasts string, weight string, stock string, price double, flag int")
    out = prepare.prepare(df)
    assert set(out.columns) == {
        "day_day", "day_month", "day_weekday", "day_hour", "day_minute", "lasts_minutes", "weight_value", "stock_number", "stock_text", "price", "flag",
    }
    assert out.count() == 12


def test_written_sessions(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(12)], "a long, b double")
    assert prepare.prepare(df, str(tmp_path), "s9").count() == 12
    assert (tmp_path / "session_id=s9" / "raw").is_dir() and (tmp_path / "session_id=s9" / "processed").is_dir()


def test_one_class_is_never_selected_as_a_feature(spark):
    df = spark.createDataFrame([(10 * (i + 1), i % 2, i % 2) for i in range(20)], "leaky long, signal long, target long")
    got = {r["feature"]: r for r in select.rank_features(df, "target", "classification").collect()}
    assert "target" not in got
    assert not got["leaky"]["selected"] and got["signal"]["reason"] == "repeats_target"


def test_chi2_and_shift(spark):
    df = spark.createDataFrame([(-1.0, "a"), (0.0, "a"), (1.0, "b"), (2.0, "b")], "v double, y string")
    shifted = select.shift_nonneg(df, ["v"])
    assert [r["v"] for r in shifted.collect()] == [0.0, 1.0, 2.0, 3.0]
    assert select.chi2_scores(shifted, "y").first()["chi2"] == pytest.approx((1 - 3) ** 2 / 3 + (5 - 3) ** 2 / 3)


def test_pca_shares_sum_up(spark):
    df = spark.createDataFrame([(float(i), float(i * 2 + (-1) ** i), float(i % 5)) for i in range(40)], "a double, b double, c double")
    got = [r["ratio"] for r in select.pca_ratio(df, 5).orderBy("component").collect()]
    assert sum(got) == pytest.approx(1.0) and got == sorted(got, reverse=True)


def test_zero_iqr_divides_by_one(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 1.0, 9.0)], "x double")
    assert [r["x"] for r in encode.robust_scale(df, ["x"]).collect()] == [0.0, 0.0, 0.0, 0.0, 8.0]


def test_unseen_category_encodes_to_zeros(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "city string, num double")
    test = spark.createDataFrame([("C", 3.0)], "city string, num double")
    ready = {"train": train, "test": test}
    for stage in encode.vector_stages(["num"], ["city"]):
        fitted = stage.fit(ready["train"]) if hasattr(stage, "fit") else stage
        ready = {k: fitted.transform(v) for k, v in ready.items()}
    got = {k: v.select(vector_to_array("features").alias("f")).collect() for k, v in ready.items()}
    assert [r["f"] for r in got["test"]] == [[3.0, 0.0, 0.0]]
    assert sorted(r["f"] for r in got["train"]) == [[1.0, 1.0, 0.0], [2.0, 0.0, 1.0]]


MANIFEST = {
    "session_id": "s1", "task": "regression", "features": ["num", "cat"], "kinds": {"num": "numeric", "cat": "categorical"},
    "dropped_features": [], "pruned_features": {}, "versions": contract.runtime_versions(),
}


def contract_rows(spark, manifest, strict, **options):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (3.0, "A"), (4.0, "B")], "num double, cat string")
    issues = contract.check_contract(df, manifest, strict, **options)
    return contract.contract_valid(issues).first()["valid"], {(r["severity"], r["check"]) for r in issues.collect()}


def test_contract_holds(spark):
    assert contract_rows(spark, MANIFEST, False, session_id="s1")[0]
    assert contract_rows(spark, MANIFEST, True, session_id="s1")[0]


def test_contract_without_tracking(spark):
    bare = {k: MANIFEST[k] for k in ("features", "dropped_features", "pruned_features")}
    valid, issues = contract_rows(spark, bare, False)
    assert valid and ("warning", "missing_key") in issues
    assert not contract_rows(spark, bare, True)[0]


def test_contract_version_drift(spark):
    old = {**MANIFEST, "versions": {"pyspark": "1.0.0", "python": "2.7"}}
    valid, issues = contract_rows(spark, old, True)
    assert not valid and ("error", "version_mismatch") in issues
    assert contract_rows(spark, old, False)[0]
    assert not contract_rows(spark, MANIFEST, False, session_id="other")[0]


def test_contract_judges_values(spark):
    df = spark.createDataFrame([("1", "a", None), ("x", "z", None)], "num string, cat string, extra string")
    issues = contract.check_contract(df, {**MANIFEST, "features": ["num", "cat", "extra", "lost"], "categories": {"cat": ["a"]}}, True)
    got = {(r["check"], r["subject"]): r["value"] for r in issues.collect()}
    assert got[("values_not_of_kind", "num")] == 0.5 and got[("unseen_categories", "cat")] == 0.5
    assert ("all_null", "extra") in got and ("missing_column", "lost") in got


def test_best_summary(spark):
    board = spark.createDataFrame([("Lasso", 0.84, 1800.0), ("Ridge", 0.83, 1850.0)], "Model string, R2_Score double, RMSE double")
    row = report.best_summary(board, "regression").first()
    assert (row["best_model"], row["best_metric"]) == ("Lasso", "R2_Score") and row["score_gap"] == pytest.approx(0.01)
    board = spark.createDataFrame([("LogisticRegression", 0.86), ("DecisionTree", 0.81)], "Model string, Balanced_Accuracy double")
    row = report.best_summary(board, "classification").first()
    assert row["best_model"] == "LogisticRegression" and round(row["score_gap"], 3) == 0.05 and row["reason"]
    lower = spark.createDataFrame([("A", 3.0), ("B", 2.0)], "Model string, RMSE double")
    assert report.best_summary(lower, "regression").first()["score_gap"] == pytest.approx(-1.0)
    single = report.best_summary(board.limit(1), "classification").first()
    assert single["score_gap"] is None and "the only result" in single["reason"]


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.1)], "y int, score double")
    assert metrics.roc_auc(df).first()["roc_auc"] == 0.25
    assert metrics.roc_auc(df.where("y = 1")).first()["roc_auc"] is None


def test_metric_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, p int")
    row = metrics.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["balanced_accuracy"]) == (0.0, 0.0, 0.5)


def test_questions(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, c string")
    assert ask.ask(df, "SELECT sum(n) AS s FROM data").first()["s"] == 3
    answer = {(r["section"], r["name"]): r["value"] for r in ask.ask(df, "Please describe this dataset", targets=["c"]).collect()}
    assert answer[("rows", "")] == 2.0 and answer[("missing", "c")] == 50.0 and answer[("target:c", "null")] == 1.0


def test_kinds(spark):
    df = local_frame(spark, [(1, "a", True)], "n int, s string, b boolean")
    assert cols_of_kind(df, "numeric") == ["n"] and cols_of_kind(df, "text") == ["s", "b"]


def test_pca_imputes_nulls(spark):
    rows = [(float(i), float(i * i % 7), None if i else 3.0) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    full = spark.createDataFrame([(a, b, 3.0) for a, b, _ in rows], "a double, b double, c double")
    shares = [[r["ratio"] for r in select.pca_ratio(x, 3).orderBy("component").collect()] for x in (df, full)]
    assert shares[0] == pytest.approx(shares[1])


def test_ragged_vectors_raise(spark):
    df = spark.createDataFrame([(None,), ([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>")
    assert select.array_size(df, "v") == 2
    with pytest.raises(ValueError, match="2 to 3 elements"):
        select.array_size(df.union(spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")), "v")
