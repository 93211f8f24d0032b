"""Joins of op13 don't depend on sizes that Spark estimates from compressed files and from rows before ``explode``."""

from __future__ import annotations

from tabwright.llm import spelling


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    plans = []
    stored = spelling.shared_table

    def noted(df):
        plans.append(plan(df))
        return stored(df)

    monkeypatch.setattr(spelling, "shared_table", noted)
    docs = spark.createDataFrame([(k, "variant " * 20 + "varient varient") for k in range(3)], "doc_id long, text string")
    out = spelling.spelling_variants(docs, thinned=None)
    assert {(r.word, r.root) for r in out.collect()} == {("variant", "variant"), ("varient", "variant")}
    plans.append(plan(out))
    assert len(plans) > 3 and not [p for p in plans if "Broadcast" in p]
    assert sum("SortMergeJoin" in p for p in plans) >= 3
