"""Every query runs; those with SQL give the rows DuckDB gives."""

import pytest

from tabwright.queries import ORACLE, QUERIES
from tools.check import compare, connect

SLOW = {"train_classifiers", "train_regressors", "score_saved_run", "baseline_run", "staged_run", "linear_svc", "gradient_boosting", "profile_lineitem"}


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, data, db, name):
    status, _ = compare(spark, db, data, name)
    assert status.startswith("ok" if name in ORACLE else "rows"), status
    assert "TYPES" not in status, status


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
