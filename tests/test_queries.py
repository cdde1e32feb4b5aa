"""Every query with SQL against DuckDB on the smallest tables; skipped where these are not there."""

from pathlib import Path

import duckdb
import pytest

from armarium.plans.queries import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else repr(float(v)) if "float" in type(v).__name__ else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(SF)).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plans_stay_in_the_jvm(spark):
    for name in ("fragment_score", "work_identity", "weights_canonical", "token_histogram"):
        plan = QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
