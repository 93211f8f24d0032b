"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the tables, the cores and the timed runs per
query (after one warm-up; the median counts). Results go to a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabwright.queries import QUERIES  # noqa: E402
from tabwright.session import local_session  # noqa: E402

HEADLINE = [
    "clean_text", "parse_number", "parse_date_dayfirst", "canonical_json", "missing_pct", "column_profiles", "distinct_counts", "value_counts",
    "describe_numeric", "describe_categorical", "corr_matrix", "histogram", "box_stats", "quality_snapshot", "clip_bounds", "dashboard",
    "dedupe", "duplicate_rows", "remove_overlap", "stable_sample", "recommend_types", "infer_kinds", "cleaner_transform", "split_random",
    "split_stratified", "folds_stratified", "label_encode", "chi2_scores", "mutual_info", "rank_by_corr", "classification_metrics", "roc_auc",
    "regression_metrics", "knn_uniform", "linear_regression", "ridge_regression",
]


def run_once(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    for name in names:
        run_once(spark, folder, name)
        times[name] = round(statistics.median(run_once(spark, folder, name) for _ in range(runs)), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
