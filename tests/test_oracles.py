"""Every registered engine query against its SQL on the smallest tables; those without SQL must run."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from loomtrace.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, bool):
            return v
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    plain_rows = [
        tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)
    ]
    return sorted(plain_rows, key=lambda r: [str(round(x, 3)) if isinstance(x, float) else str(x) for x in r])


def test_every_query_has_sql_but_folds_and_samples():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {
        "bootstrap_ci", "cooldown_simulation", "paragraph_signatures"
    }


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (
                isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=1e-6)
            ), (x, y)
