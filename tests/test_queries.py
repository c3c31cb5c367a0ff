"""Every coverage query against its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from fieldmesh.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return f"{v + 0.0:.8g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df, r = QUERIES[name](spark, DIR), duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    place = [r.columns.index(c) for c in cols]
    got = Counter(tuple(norm(x[c]) for c in cols) for x in df.collect())
    assert got == Counter(tuple(norm(x[i]) for i in place) for x in r.fetchall())


def test_range_join_plans_as_an_equi_join(spark):
    from fieldmesh.operators.links import link_join
    from fieldmesh.plans import fixtures as fx

    plan = link_join(fx.towers(spark, DIR), fx.rx(spark, DIR), fx.RADIUS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
