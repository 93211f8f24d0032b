"""Approximate neighbours: recall against the exact join, ties, gaps and the way back to the exact join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import knn, knn_approx


def frame(spark, x, first=0, labels="ab"):
    rows = [(first + i, labels[i % len(labels)], [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label string, features array<double>")


def recall(found, exact):
    want, got = {}, {}
    for r in exact.collect():
        want.setdefault(r.id, []).append(r.distance)
    for r in found.collect():
        got.setdefault(r.id, []).append(r.distance)
    hits = sum(sum(d <= max(ds) * (1 + 1e-12) for d in got.get(i, [])) for i, ds in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall_where_every_cell_is_visited(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 12))
    if kind == "clusters":
        x = x * 0.1 + rng.standard_normal((20, 12))[rng.integers(0, 20, 4000)]
    train, test = frame(spark, x[:3600]), frame(spark, x[3600:], 10_000)
    found, report = knn_approx.approx_neighbors(train, test, 5, recall=0.9, width=100, sample=60)
    assert report["tables"] > 0 and report["recall"] >= 0.9
    assert recall(found, knn.neighbors(train, test, 5)) >= 0.88
    assert found.groupBy("id").count().where("count <> 5").count() == 0


def test_rows_and_distances_are_real(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 4))
    found, _ = knn_approx.approx_neighbors(frame(spark, x[:250]), frame(spark, x[250:], 1000), 3, width=50)
    for r in found.collect():
        assert r.distance == pytest.approx(float(np.linalg.norm(x[r.neighbor_id] - x[r.id - 750])), rel=1e-9)
        assert r.label == "ab"[r.neighbor_id % 2]


def test_copies_ties_gaps_and_empty_tables(spark):
    rows = [(i, "a", [1.0, 1.0]) for i in range(500)] + [(600, "b", [2.0, 2.0]), (601, "b", None), (602, "b", [float("nan"), 1.0]), (None, "b", [1.0, 1.0])]
    train = spark.createDataFrame(rows, "id long, label string, features array<double>")
    test = spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, [None, 1.0])], "id long, features array<double>")
    found, report = knn_approx.approx_neighbors(train, test, 3, width=10)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append((r.neighbor_id, round(r.distance, 6)))
    assert got == {1: [(0, 0.0), (1, 0.0), (2, 0.0)], 2: [(600, 0.0), (0, 1.414214), (1, 1.414214)]} and report["recall"] == 1.0
    assert knn_approx.approx_neighbors(train, test.where("id > 2"), 3)[0].count() == 0
    with pytest.raises(ValueError, match="no train rows"):
        knn_approx.approx_neighbors(train.where("false"), test, 3)
    with pytest.raises(ValueError, match="elements"):
        knn_approx.approx_neighbors(train, spark.createDataFrame([(1, [1.0])], "id long, features array<double>"), 3)


def test_falls_back_to_the_exact_join(spark):
    x = np.random.default_rng(2).standard_normal((400, 30))
    train, test = frame(spark, x[:350]), frame(spark, x[350:], 1000)
    found, report = knn_approx.approx_neighbors(train, test, 4, recall=1.01, width=2, tables=1, most=1)
    assert report == {"tables": 0, "recall": 1.0}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn.neighbors(train, test, 4).collect()))


def test_a_vector_that_fills_a_third_of_both_tables(spark):
    x = np.random.default_rng(3).standard_normal((900, 6))
    x[::3] = 0.25
    train, test = frame(spark, x), frame(spark, x[:600], 5000)
    found, report = knn_approx.approx_neighbors(train, test, 4, recall=0.95, width=40)
    assert report["tables"] in (4, 8) and found.count() == 2400
    assert {r.neighbor_id for r in found.where("id % 3 = 2 and distance = 0").collect() if (r.id - 5000) % 3 == 0} <= {0, 3, 6, 9}
    assert recall(found, knn.neighbors(train, test, 4)) >= 0.93


def test_the_sample_is_answered_as_the_join_answers_it(spark):
    """Rows of a sample that travel to the train rows find what the join of blocks finds."""
    x = np.random.default_rng(3).standard_normal((900, 8))
    train = frame(spark, x[:800]).select("id", "label", F.lit(True).alias("train"), F.col("features").alias("x"))
    test = frame(spark, x[800:], 5000).select("id", "label", F.lit(False).alias("train"), F.col("features").alias("x"))
    planes = [knn_approx.Planes(x[:200], t, 42) for t in range(2)]
    keys = knn_approx._keyed(train, planes, 0, None).unionByName(knn_approx._keyed(test, planes, 0, None))
    borders = knn_approx._borders(keys, range(2), 20)
    asked = test.select("id", "x", F.xxhash64("id", F.lit(False)).alias("salt")).toPandas()
    sampled = knn_approx._sampled(train, asked, planes, 0, borders, 3)
    joined = knn_approx._compared(train, test, planes, borders, 3)
    rows = [sorted((r["id"], r["tid"], round(r["d2"], 9)) for r in knn_approx._merged(df, 3).collect()) for df in (sampled, joined)]
    assert rows[0] == rows[1] and len(rows[0]) == 300
