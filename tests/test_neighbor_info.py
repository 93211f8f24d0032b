"""Nearest-neighbour mutual information against the formula, row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators import neighbor_info, select


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(rows, k=3):
    rows = [(y, v) for y, v in rows if y is not None and v is not None and math.isfinite(v)]
    size = {y: sum(z == y for z, _ in rows) for y, _ in rows}
    rows = [(y, v) for y, v in rows if size[y] > 1]
    if not rows:
        return None
    total = 0.0
    for i, (y, v) in enumerate(rows):
        own = min(k, size[y] - 1)
        r = sorted(abs(v - u) for j, (z, u) in enumerate(rows) if z == y and j != i)[own - 1]
        m = sum(v - r < u < v + r for _, u in rows) if r > 0 else sum(u == v for _, u in rows)
        total += psi(own) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


def table():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        y = rng.choice(["a", "a", "a", "b", "b", "c"])
        shift = {"a": 0, "b": 2, "c": 5}[y]
        rows.append((y, rng.gauss(shift, 1), float(rng.randint(0, 4) + shift), rng.choice([0.0, 1.0]), None if i % 7 else 1.0 * i))
    rows += [("single", 1.0, 1.0, 1.0, 1.0), ("pair", 50.0, 9.0, 1.0, 2.0), ("pair", 51.0, 9.0, 0.0, None), (None, 1.0, 1.0, 1.0, 1.0), ("a", math.nan, math.inf, -0.0, None)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"rank_rows": 50, "block": 9}])
@pytest.mark.parametrize("k", [1, 3, 4])
def test_against_the_formula(spark, k, limits):
    rows = table()
    df = spark.createDataFrame(rows, "y string, x double, t double, flag double, gaps double")
    got = {r.feature: r.mutual_info for r in neighbor_info.neighbor_mutual_info(df, "y", ["x", "t", "flag", "gaps"], k, **limits).collect()}
    for i, c in enumerate(["x", "t", "flag", "gaps"], 1):
        assert got[c] == pytest.approx(plain([(r[0], r[i]) for r in rows], k), abs=1e-9)


def test_no_class_with_two_values(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, None), ("b", None, 3.0)], "y string, x double, z double")
    assert {r.feature: r.mutual_info for r in neighbor_info.neighbor_mutual_info(df, "y", ["x", "z"]).collect()} == {"x": None, "z": None}
    with pytest.raises(ValueError, match="too short"):
        neighbor_info.neighbor_mutual_info(df, "y", ["x"], block=6)


def test_digamma(spark):
    rows = spark.range(1, 400).select("id", neighbor_info.digamma(F.col("id")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.id), abs=1e-11) for r in rows)


def test_select_classification(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xyz"), float(i % 9 - 4), i % 2 == 0, rng.choice(["lo", "hi", None]), i % 2) for i in range(120)] + [("x", 1.0, True, "lo", None)]
    df = spark.createDataFrame(rows, "word string, number double, flag boolean, level string, y int")
    out = select.select_classification(df, "y")
    scores = {r.feature: r for r in out["scores"].collect()}
    assert set(scores) == {"word", "number", "flag", "level"} and scores["flag"]["rank"] == 1
    codes = {v: i for i, v in enumerate(sorted(["lo", "hi", "nan"]))}
    assert scores["level"].mutual_info == pytest.approx(plain([(r[4], float(codes[r[3] or "nan"])) for r in rows]), abs=1e-9)
    assert scores["number"].chi2 is not None and out["matrix"].count() == 4


def test_ranges_run_side_by_side(spark, monkeypatch):
    """What one task would rank is dealt into ranges long before it is a million rows, and no text is sorted."""
    seen = []
    plain_totals = neighbor_info.running_totals
    monkeypatch.setattr(neighbor_info, "running_totals", lambda df, order, totals, **more: seen.append((df, more["rank_rows"])) or plain_totals(df, order, totals, **more))
    df = spark.range(400).select((F.col("id") % 2).cast("string").alias("y"), F.col("id").cast("double").alias("x"))
    neighbor_info.neighbor_mutual_info(df, "y", ["x"]).collect()
    assert len(seen) == 2
    assert all(rows <= 100_000 and "string" not in dict(df.dtypes).values() for df, rows in seen)
