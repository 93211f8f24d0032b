"""Shuffles of op5's rounds over few links."""

from __future__ import annotations

import re

from tabwright.llm import common


def test_labels_of_few_edges_are_not_shuffled(spark, monkeypatch):
    plans = []
    checked = common.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checked(df)

    monkeypatch.setattr(common, "checkpointed", noted)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 200), (300, 200)], "a long, b long")
        roots = {r.node: r.root for r in common.components(edges).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert roots == {k: 0 for k in range(21)} | {100: 100, 200: 100, 300: 100}
    assert all(len(re.findall(r"Exchange hashpartitioning", plan)) <= 2 for plan in plans[2:])
