"""The paths for long tables give what the short ones give, and nothing depends on partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import cleaner, dedupe, knn, metrics, select, split
from tabwright.operators import profile as prof
from tabwright.operators import scale
from tabwright.sources import tables

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@pytest.fixture(scope="module")
def lines(spark, data):
    return spark.read.parquet(f"{data}/lineitem.parquet").persist()


@pytest.mark.parametrize("limit", [50, 500, 4000])
def test_narrowed_quantiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(1)
    n = 20_000
    cols = {"even": rng.normal(size=n), "ties": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 20, n)).astype(float), "long": rng.lognormal(3, 2, n)}
    rows = spark.createDataFrame([tuple(float(cols[c][i]) for c in cols) for i in range(n)], "even double, ties double, long double")
    rows = rows.unionByName(spark.createDataFrame([(None, None, 1.0)], "even double, ties double, long double"))
    probs = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]
    got = scale.exact_quantiles(rows, {c: probs for c in cols}, exact_rows=limit)
    for c in cols:
        values = np.append(cols[c], 1.0) if c == "long" else cols[c]
        np.testing.assert_allclose(got[c], np.quantile(values, probs), rtol=1e-9)


def test_quantiles_of_an_empty_column(spark):
    rows = spark.createDataFrame([(None, 1.0)] * 30, "a double, b double")
    assert scale.exact_quantiles(rows, {"a": [0.5], "b": [0.5]}, exact_rows=10) == {"a": [None], "b": [1.0]}
    assert scale.exact_quantiles(rows, {"a": [0.5], "b": [0.5]}) == {"a": [None], "b": [1.0]}


def test_running_totals_by_range(spark):
    values = list(range(300))
    random.Random(3).shuffle(values)
    rows = spark.createDataFrame([(v, v % 7) for v in values], "k int, n int").repartition(6)
    short = {r["k"]: r["t"] for r in scale.running_totals(rows, ["k"], {"t": F.col("n")}).collect()}
    long = {r["k"]: r["t"] for r in scale.running_totals(rows, ["k"], {"t": F.col("n")}, rank_rows=40).collect()}
    assert short == long == {k: sum(v % 7 for v in range(k)) for k in range(300)}


def test_splits_do_not_depend_on_partitioning(lines):
    def rows(df):
        return {(*[r[k] for k in KEY], r["x"]) for r in df.collect()}

    def apply(df):
        return [
            rows(split.split_random(df, KEY).withColumn("x", F.col("is_test"))),
            rows(split.split_stratified(df, "l_returnflag", KEY).withColumn("x", F.col("is_test"))),
            rows(split.add_folds(df, 3, KEY, "l_returnflag").withColumn("x", F.col("fold"))),
        ]

    assert apply(lines.repartition(1)) == apply(lines.repartition(8))


def test_bucket_cuts_equal_direct_ranks(lines, monkeypatch):
    def rows(df):
        return sorted(tuple(r[k] for k in (*KEY, "x")) for r in df.collect())

    def apply():
        return [
            rows(split.split_stratified(lines, "l_returnflag", KEY).withColumn("x", F.col("is_test"))),
            rows(split.add_folds(lines, 3, KEY, "l_returnflag").withColumn("x", F.col("fold"))),
            rows(split.add_folds(lines, 5, KEY).withColumn("x", F.col("fold"))),
            # copies share a hash, so a cut may not separate them
            rows(split.add_folds(lines, 4, ["l_linenumber"]).withColumn("x", F.col("fold"))),
        ]

    direct = apply()
    monkeypatch.setattr(scale, "RANK_ROWS", 0)
    assert apply() == direct


def test_split_sizes_are_exact_with_one_dominant_class(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 990, "a").otherwise("b").alias("y"))
    got = {r["y"]: r["n"] for r in split.split_stratified(rows, "y", ["id"]).where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 198, "b": 2}


@pytest.mark.parametrize("direct", [0, 1000])
def test_small_class_may_have_no_test_row(spark, monkeypatch, direct):
    monkeypatch.setattr(scale, "RANK_ROWS", direct)
    rows = spark.range(20).select("id", F.when(F.col("id") < 18, "a").otherwise("b").alias("y"))
    got = {r["y"]: r["n"] for r in split.split_stratified(rows, "y", ["id"]).groupBy("y").agg(F.count_if("is_test").alias("n")).collect()}
    assert got == {"a": 4, "b": 0}


def test_long_sample_equals_short_one(lines, monkeypatch):
    def keys(df):
        return {tuple(r) for r in df.select(*KEY).collect()}

    short = keys(tables.stable_sample(lines, KEY, 200))
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 10)
    assert keys(tables.stable_sample(lines, KEY, 200)) == short and len(short) == 200
    assert tables.stable_sample(lines, KEY, 10**6).count() == lines.count()


def test_sample_and_split_use_different_orders(lines):
    sample = tables.stable_sample(lines, KEY, 1000)
    share = split.split_random(sample, KEY).agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.1 < share < 0.3


def test_overlap_with_nulls_both_ways(spark):
    train = spark.createDataFrame([(1, None)], "a int, b int")
    test = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    for limit in (100, 0):
        assert [tuple(r) for r in dedupe.remove_overlap(test, train, ["a", "b"], max_rows=limit).collect()] == [(None, 1)]
        assert [tuple(r) for r in dedupe.overlap_rows(test, train, ["a", "b"], max_rows=limit).collect()] == [(1, None)]


def test_salted_overlap_keeps_copies(lines):
    test, train = lines.where("l_linenumber >= 4"), lines.where("l_linenumber < 4")
    cols = ["l_discount", "l_tax"]
    a = dedupe.remove_overlap(test, train, cols).count(), dedupe.overlap_rows(test, train, cols).count()
    b = dedupe.remove_overlap(test, train, cols, max_rows=0).count(), dedupe.overlap_rows(test, train, cols, max_rows=0).count()
    assert a == b and sum(a) == test.count()


def test_ranged_auc_and_codes(lines):
    pred = lines.selectExpr("l_orderkey % 2 AS y", "l_quantity + 3 * (l_orderkey % 2) AS score")
    assert metrics.roc_auc(pred, rank_rows=10).first() == metrics.roc_auc(pred).first()
    a = {tuple(r) for r in select.label_codes(lines, ["l_returnflag", "l_partkey"]).collect()}
    assert a == {tuple(r) for r in select.label_codes(lines, ["l_returnflag", "l_partkey"], rank_rows=20).collect()}


def test_cell_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[100:250] = x[100]  # a third of the rows are copies of one
    rows = spark.createDataFrame([(i, str(i % 3), [float(v) for v in x[i]]) for i in range(400)], "id bigint, label string, features array<double>")
    test, train = rows.where("id % 4 = 0"), rows.where("id % 4 <> 0")
    ids = np.array([i for i in range(400) if i % 4])
    want = {}
    for q in range(0, 400, 4):
        d = ((x[ids] - x[q]) ** 2).sum(axis=1)
        want[q] = [int(v) for v in ids[np.lexsort((ids, d))][:5]]
    for options in ({}, {"max_values": 3, "pivots": 8, "block_rows": 16}):
        near = knn.neighbors(train, test, 5, **options).orderBy("id", "rank").collect()
        got = {}
        for r in near:
            got.setdefault(r["id"], []).append(r["neighbor_id"])
        assert got == want


def test_matrix_correlations_equal_single_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cells = rng.normal(size=(500, 4)) * 10 + 1e6
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in r) for r in cells]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    one = {(r["x"], r["y"]): r["corr"] for r in prof.corr_matrix(df).collect()}
    monkeypatch.setattr(prof, "JVM_PAIRS", 0)
    two = {(r["x"], r["y"]): r["corr"] for r in prof.corr_matrix(df).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k] == pytest.approx(two[k], abs=1e-9)


def test_pairwise_correlation_skips_nulls_per_pair(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 3), (None, 4), (5, 9)], "a int, b int")
    assert {(r["x"], r["y"]): r["corr"] for r in prof.corr_matrix(df).collect()}[("a", "b")] == pytest.approx(0.924473451642)


def test_long_category_list_is_joined(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame([(f"word {i % 40} {'x' * (i % 40)}", i) for i in range(800)], "c string, v int")
    inline = cleaner.RobustCleaner(rareMinCount=1).fit(df)
    want = sorted(tuple(r) for r in inline.transform(df).collect())
    monkeypatch.setattr(cleaner, "INLINE_CATEGORIES", 3)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    joined = cleaner.RobustCleaner(rareMinCount=1).fit(df)
    assert any("dictionary" in c for c in joined.state["columns"])
    assert sorted(tuple(r) for r in joined.transform(df).collect()) == want
    unseen = spark.createDataFrame([("never met", 1), (None, 2)], "c string, v int")
    assert [r["c"] for r in joined.transform(unseen).orderBy("v").collect()] == ["__other__", None]


def test_saved_cleaner_holds_its_long_category_lists(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame([(f"word {i % 40} {'x' * (i % 40)}", i) for i in range(800)], "c string, v int")
    monkeypatch.setattr(cleaner, "INLINE_CATEGORIES", 3)
    model = cleaner.RobustCleaner(rareMinCount=1).fit(df)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    model.write().overwrite().save(path)
    loaded = cleaner.RobustCleanerModel.load(path)
    assert [c["dictionary"] for c in loaded.state["columns"] if "dictionary" in c] == [f"{path}/categories/0"]
    rows = df.unionByName(spark.createDataFrame([("never met", 1), (None, 2)], "c string, v int"))
    assert sorted(map(str, loaded.transform(rows).collect())) == sorted(map(str, model.transform(rows).collect()))
    again = str(tmp_path / "again")
    loaded.write().save(again)
    assert cleaner.RobustCleanerModel.load(again).transform(df).count() == 800
    assert model.audit(spark).where("section = 'categories_kept_as_table'").count() == 1


def test_audit_names_columns_with_too_many_spellings(spark):
    df = spark.createDataFrame([(f"w{i % 600:04d}xyz", i) for i in range(1800)], "c string, v int")
    rows = {r["section"]: r["value"] for r in cleaner.RobustCleaner(rareMinCount=1, rareFreq=0.0).fit(df).audit(spark).where("column = 'c'").collect()}
    assert rows["spellings_too_many_to_merge"] == "600"


def test_lookup_in_salted_copies(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else "a" if i % 2 else f"k{i}") for i in range(400)], "id int, k string")
    side = spark.createDataFrame([("a", 1), ("k6", 2), (None, 3), ("unused", 4)], "name string, code int")
    want = sorted((i, k, 1 if k == "a" else 2 if k == "k6" else None) for i, k in map(tuple, rows.collect()))
    for limit in (100, 2):
        found = scale.lookup(rows, F.col("k"), side, "name", max_rows=limit)
        assert found.columns == ["id", "k", "name", "code"]
        assert sorted(((r.id, r.k, r.code) for r in found.collect()), key=str) == sorted(want, key=str)


def test_knn_blocks_hold_many_cells():
    assert knn._packed([3, 5, 8, 9], [4, 5, 30, 2], 10) == {3: (0, 1), 5: (0, 1), 8: (1, 3), 9: (4, 1)}


def test_knn_sends_a_test_row_once_for_a_block(spark, monkeypatch):
    """Points alike in all directions visit every cell; what is sent follows the blocks, not the 50 cells."""
    rows = spark.range(600).selectExpr("id", "'a' AS label", "transform(sequence(1, 16), i -> CAST(xxhash64(id, i) % 1000 AS double)) AS features")
    sent = []
    monkeypatch.setattr(knn, "small_side", lambda df: sent.append(df.count()) or df)
    near = knn.neighbors(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), 3, max_values=16, pivots=50, block_rows=200)
    plain = knn.neighbors(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), 3)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, plain.collect()))
    assert sent == [3]  # three blocks of the 480 train rows, one chunk of test rows


def test_a_cut_among_equal_hashes_ranks_each_hash_once(spark, monkeypatch):
    plans = []
    small = scale.small_side
    monkeypatch.setattr(scale, "RANK_ROWS", 10)
    monkeypatch.setattr(scale, "small_side", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or small(df, *a))
    df = spark.range(3000).selectExpr("CAST(id % 3 AS string) AS v")
    part = scale.hash_part(df, scale.key_hash(["v"], 42, "sample"), [lambda n: F.least(n, F.lit(1500))])
    assert sorted(r["count"] for r in part.where("part = 0").groupBy("v").count().collect()) == [1000, 1000]
    cuts = plans[1]
    ranked = cuts.index("Window [")
    assert "count(1) AS _k" in cuts[ranked:]  # the window stands above the counts


def test_ranges_of_a_running_total_are_bounded(spark, monkeypatch):
    parts = []
    kept = scale.checkpointed
    monkeypatch.setattr(scale, "checkpointed", lambda df: parts.append(df.rdd.getNumPartitions()) or kept(df))
    totals = scale.running_totals(spark.range(5000).toDF("v"), ["v"], {"place": F.lit(1)}, rank_rows=10)
    assert totals.where("place <> v").count() == 0 and totals.count() == 5000
    assert max(parts) <= scale.RANGES


def test_brackets_of_a_column_share_sketches_and_counts(spark, monkeypatch):
    sketched = []
    sketch = F.kll_sketch_agg_double
    monkeypatch.setattr(scale.F, "kll_sketch_agg_double", lambda *a: sketched.append(a) or sketch(*a))
    monkeypatch.setattr(scale, "_narrow", lambda df, brackets, one=scale._narrow: one(df, brackets) and False)  # the first round only
    df = spark.range(20_000).selectExpr("CAST(pmod(xxhash64(id), 5000) AS double) / 8 - 100 AS a", "CASE WHEN id % 3 > 0 THEN CAST(id % 7 AS double) END AS b")
    probs = [i / 32 for i in range(1, 32)]
    got = scale.exact_quantiles(df, {"a": probs, "b": probs}, exact_rows=1000)
    assert len(sketched) == 2
    assert got == scale.exact_quantiles(df, {"a": probs, "b": probs})


def test_counts_at_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (-0.0, 0.0, 1.0, 2.0, 2.0, inf, None)], "c double")
    got = scale._counts_at(df, {("c", 0.0), ("c", 2.0), ("c", 1.5), ("c", inf)})
    assert got == {("c", 0.0): (0, 2), ("c", 1.5): (3, 3), ("c", 2.0): (3, 5), ("c", inf): (5, 6)}
