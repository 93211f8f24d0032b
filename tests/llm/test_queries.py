"""The queries against their SQL, and the pipeline's stages against plain statements of what they do."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tabwright.llm.queries import ORACLE, QUERIES
from tools.check import compare, connect, tidy  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, data, name):
    import pandas as pd

    frame = QUERIES[name](spark, data)
    cursor = connect(data).execute(ORACLE[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    assert tidy(got[sorted(want.columns)]) == tidy(want)


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, data)
        if name != "best_fit_packing":
            assert after.columns == columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        before = after
    assert before.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
