"""Components and correlations without a matrix of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import profile, select, subspace


def vectors(spark, x):
    return spark.createDataFrame([([float(v) for v in row],) for row in x], "x array<double>").repartition(3)


def ratios(x, k):
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    return (values / values.sum())[:k]


@pytest.mark.parametrize("shape", [(500, 40), (30, 3000), (4, 3)])
def test_ratios_of_many_features(spark, shape):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(shape) * np.linspace(5, 0.1, shape[1]) + 1e4
    got = subspace.component_ratios(vectors(spark, x), "x", shape[1], 3)
    assert got == pytest.approx(ratios(x, 3), abs=1e-6)


def test_ratios_of_columns_on_both_paths(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6))
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in names)).withColumn("c2", F.when(F.col("c2") < 1, F.col("c2")))
    square = [r.ratio for r in select.pca_ratio(df, 4, names).collect()]
    wide = [r.ratio for r in select.pca_ratio(df, 4, names, square=5).collect()]
    assert wide == pytest.approx(square, abs=1e-9)


def test_ratios_without_variance_or_rows(spark):
    assert subspace.component_ratios(vectors(spark, np.ones((5, 3))), "x", 3, 2) == [0.0, 0.0]
    with pytest.raises(ValueError, match="two rows"):
        subspace.component_ratios(vectors(spark, np.ones((1, 3))), "x", 3, 2)


def test_tiles_equal_single_correlations(spark):
    rng = np.random.default_rng(2)
    rows = []
    for row in rng.standard_normal((300, 7)) * 3 + 1e6:
        row[6] = row[0] * 2 + rng.standard_normal()
        rows.append([None if rng.random() < 0.1 else float(v) for v in row] + [5.5, None])
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    one = {(r.x, r.y): r["corr"] for r in df.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a in names[:7] for b in names[:7]]).select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}_{b}").alias("corr")) for a in names[:7] for b in names[:7]]))).collect()}
    for tile in (1, 2, 4, 9, 512):
        two = {(r.x, r.y): r["corr"] for r in subspace.tiled_corr(df, names, tile).collect()}
        assert set(two) == {(a, b) for a in names for b in names}
        assert all(two[k] == pytest.approx(v, abs=1e-9) for k, v in one.items())
        assert all(v is None for (a, b), v in two.items() if {a, b} & {"c7", "c8"})


def test_wide_table(spark):
    """Six hundred columns: 360,000 pairs, of which a task holds a tile."""
    d = 600
    df = spark.range(40).select(*[(F.rand(i) if i else F.col("id").cast("double")).alias(f"c{i}") for i in range(d)]).withColumn("c599", -F.col("c0"))
    found = profile.corr_matrix(df)
    assert found.count() == d * d
    assert found.where("x = 'c0' and y = 'c599'").first()["corr"] == pytest.approx(-1.0)
