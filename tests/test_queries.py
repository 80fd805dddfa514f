"""Every query with comparison SQL gives the same rows as DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import SMALL
from tidecast.plans import catalog

import __spark_entry__ as entry_module


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if type(v).__name__ in ("Timestamp", "datetime", "date"):
        return str(v)[:10]
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return repr(float(v) + 0.0)
    return str(v)


def table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_fitted_models_run(spark, name):
    """Queries that plain SQL cannot repeat: they run on the given tables and give rows without missing keys."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = df.collect()
    keys = [c for c in ("series_id", "ds", "fold", "feature", "model", "config", "trial", "target") if c in df.columns]
    assert rows and all(r[c] is not None for r in rows for c in keys)


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
