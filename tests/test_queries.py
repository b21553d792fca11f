"""Every registered query runs at sf0.001; SQL oracles agree with Spark."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import catalog  # noqa: F401  (registers every query)
from quarry.plans.registry import ORACLES, QUERIES
from quarry.sources.tables import TEST_TABLES

from .conftest import SF001


def _norm(v):
    import datetime as dt

    import numpy as np
    import pandas as pd
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or v is pd.NaT or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else (repr(int(v)) if v.is_integer() else repr(round(v, 6)))
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return v.date().isoformat() if (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0) \
            else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return repr(v)


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return cols, len(rows), hashlib.md5("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "clicked_or_not" in df.columns and "registration_id" in df.columns
    # the schema is planned from the data (sparse columns dropped): stable across calls
    assert entry.entry(spark).schema == df.schema


def test_every_query_has_a_name_and_oracles_are_a_subset():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(QUERIES) >= 56 and set(QUERIES) == set(ORACLES)
    assert set(o) <= set(q) and set(QUERIES) <= set(q)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF001).toPandas()
    exp = duck.sql(ORACLES[name]).df()
    assert _digest(got) == _digest(exp)
