"""Every query of the library that has an SQL twin gives what DuckDB gives for it, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from millrace.plans import registry

SLOW = ()
NAMES = [n for n in registry.queries() if n in registry.oracle_sql()]


def rows(df: pd.DataFrame):
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return "NULL"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, pd.Timestamp):
            return str(x.to_pydatetime())
        try:
            return str(int(x)) if float(x) == int(x) else str(x)
        except (TypeError, ValueError, OverflowError):
            return str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf, duck, name):
    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(duck.execute(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
