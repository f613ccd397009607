"""Every registered query against its DuckDB oracle on the driver tables."""
import pytest

from cadenza.plans.registry import load_all
from conftest import SF_SMALL
from cadenza.plans.oracle import compare, con_for

REG = load_all()
WITH_SQL = sorted(n for n, q in REG.items() if q.sql)
NO_SQL = sorted(n for n, q in REG.items() if not q.sql)


@pytest.fixture(scope="module")
def con():
    return con_for(SF_SMALL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, SF_SMALL, REG[name])
    assert r["ok"], r
    assert not r["unsafe"], r  # no Cartesian / nested-loop join, no row-at-a-time Python UDF


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(spark, con, name):
    r = compare(spark, con, SF_SMALL, REG[name])
    assert r["rows"] >= 0 and not r["unsafe"], r
