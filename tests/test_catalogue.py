"""Every query of the catalogue that SQL can say, against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sigloom.harness import TABLES
from sigloom.plans.catalogue import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_change_set():
    """The queries of a change set show its tables one by one; here it is made once for all of them."""
    from sigloom.plans import q_reading

    make, held = q_reading._change_set, {}

    def once(m):
        if m.sf_dir not in held:
            held[m.sf_dir] = make(m)
        return held[m.sf_dir]

    q_reading._change_set = once
    yield
    q_reading._change_set = make


def shown(value) -> str:
    """Numbers alike whatever their type, as one side may have nulls among them and so floats."""
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "None"
    return f"{value:.6f}" if isinstance(value, (int, float, np.integer, np.floating)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, ROOT).toPandas()
    want = oracle.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(map(shown, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, ROOT).columns
