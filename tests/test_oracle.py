"""Every registered query equals its DuckDB oracle at sf0.01 (the driver's correctness gate)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from salesengine.plans import registry
from salesengine.sources.warehouse import TABLE_NAMES
from tests.conftest import SF01

KEYS = sorted(registry.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "hour") and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        v = v.date()
    if hasattr(v, "item") and not hasattr(v, "isoformat"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2 ** 53:
            return int(v)
        return float(f"{v:.15g}")
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    got = registry.QUERIES[key](spark, SF01).toPandas()
    want = con.execute(registry.ORACLE[key]).fetchdf()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["ProductName", "TotalSales"]
    assert df.count() >= 0
