"""Run queries against their SQL in DuckDB: python tools/check.py [sf folder] [name prefix ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from tabwright.queries import ORACLE, QUERIES  # noqa: E402
from tabwright.session import local_session  # noqa: E402


def tidy(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, values in one spelling, in sorted order."""
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def connect(folder: str):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def compare(spark, db, folder: str, name: str) -> tuple[str, float]:
    start = time.time()
    frame = QUERIES[name](spark, folder)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    took = time.time() - start
    if name not in ORACLE:
        return f"rows {len(got)}", took
    cursor = db.execute(ORACLE[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    types = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} {sorted(want.columns)}", took
    spelled = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    odd = [(c, t, types[c]) for c, t in frame.dtypes if spelled.get(t, t) != types[c]]
    a, b = tidy(got), tidy(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"DIFFER rows {len(a)}/{len(b)} {str(diff)[:600]}", took
    return (f"ok {len(a)}" + (f" TYPES {odd}" if odd else "")), took


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark, db = local_session(8), connect(folder)
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, took = compare(spark, db, folder, name)
        except Exception as error:
            status, took = f"ERROR {type(error).__name__} {str(error)[:500]}", 0.0
        print(f"@@ {name:28s} {took:6.2f}s {status}", flush=True)


if __name__ == "__main__":
    main()
