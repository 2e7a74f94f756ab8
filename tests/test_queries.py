"""Every query against its SQL in another engine, on the smallest tables."""

import os

import duckdb
import pytest

from linkspark.plans import linkage  # noqa: F401  (its queries register themselves)
from linkspark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def same(got, want) -> None:
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        missing = a[c].isna() & b[c].isna()
        number = a[c].dtype.kind == b[c].dtype.kind == "f"
        equal = ((a[c] - b[c]).abs() <= 1e-9 * b[c].abs().clip(lower=1)) if number else a[c].astype(str) == b[c].astype(str)
        assert (equal | missing).all(), c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, db):
    same(QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
