"""Rows that share an id, columns with any name, vectors far from the origin, and long notice texts."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tabwright.llm import decontaminate, licenses, ngram_join, substring, vptree

CLASHES = ["_rows", "_id", "_gone", "_spans", "_k1", "_k2", "k1", "k2", "row", "spans", "rows", "gone", "first", "first.more"]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    """Ids 1 and 7 are copies, and another, unrelated row has id 7; ids 3 and 9 share a passage, and another row has id 9."""
    passage = prose(1, 60)
    texts = [
        (1, " ".join(prose(2, 80))), (7, " ".join(prose(2, 80))), (7, " ".join(prose(3, 120))), (3, " ".join([*prose(4, 90), *passage])), (9, " ".join([*prose(5, 90), *passage])),
        (9, " ".join(prose(6, 150))), (11, None), (12, ""), (None, " ".join(prose(2, 80))), (13, " ".join(prose(8, 40))), (13, " ".join(prose(8, 40))),
    ]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", 5, *["x"] * len(CLASHES)) for i, t in texts], f"doc_id long, text string, lang string, source string, n_chars int, {extra}")


def test_one_of_each_group_by_row(rows):
    kept = ngram_join.keep_one(rows)
    assert kept.columns == rows.columns
    got = sorted((r.doc_id or -1, (r.text or "")[:20]) for r in kept.collect())
    assert got == sorted((r.doc_id or -1, (r.text or "")[:20]) for k, r in enumerate(rows.collect()) if k not in (1, 10))


def test_passages_are_cut_by_row(rows):
    cut = substring.remove_passages(rows)
    assert cut.columns == rows.columns
    words = sorted((r.doc_id, len(r.text.split())) for r in cut.where("doc_id is not null and text <> ''").collect())
    assert words == [(1, 80), (3, 150), (7, 120), (9, 90), (9, 150), (13, 40), (13, 40)]
    assert cut.where("doc_id is null").count() == 1


def test_benchmark_windows_by_row(spark, rows):
    items = spark.createDataFrame([(1, " ".join(prose(3, 120)[10:30]))], "item_id long, text string")
    kept = decontaminate.drop_contaminated(rows, items)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 1
    assert kept.where("doc_id = 7").count() == 1


def plain_nearest(points, ids, q, k=10):
    far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
    far[q] = np.inf
    return sorted((float(d), int(i)) for d, i in zip(far, ids, strict=True))[:k]


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_factor_one_is_exact_anywhere(spark, offset):
    points = np.random.default_rng(5).normal(size=(3000, 8)) + offset
    df = spark.createDataFrame([(k, [float(x) for x in v], "c", 1) for k, v in enumerate(points)], "vec_id long, embedding array<double>, leaf string, row int")
    got = {}
    for r in vptree.nearest(df, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q in range(0, 3000, 100):
        assert sorted(got[q]) == plain_nearest(points, range(3000), q)


def test_rows_that_share_an_id_are_searched_each(spark):
    points = np.array([[0.0, 1.0], [5.0, 1.0], [0.0, 1.1], [5.0, 1.2], [9.0, 9.0]])
    ids = [100, 100, 1, 2, 100]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, points, strict=True)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.nearest(df, k=4, factor=1.0).collect())
    want = sorted((100, n + 1, i, d) for q in (0, 1, 4) for n, (d, i) in enumerate(plain_nearest(points, ids, q, 4)))
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_long_texts_of_notices(spark):
    notice = "Released under the MIT License. "
    filler = " ".join(prose(9, 300))
    texts = [(1, notice * 3200), (2, f"{filler} {notice}{filler}"), (3, None), (4, ""), (5, filler), (2, f"{filler} {notice}{filler}")]
    df = spark.createDataFrame([(*t, "mit", 7) for t in texts], "doc_id long, text string, license string, at int")
    start = time.time()
    got = sorted((r.doc_id, r["at"], r.containment) for r in licenses.scan(df).where("containment = 1").collect())
    assert got == [(1, 0, 1.0), (2, 300, 1.0), (2, 300, 1.0)]
    assert time.time() - start < 60
