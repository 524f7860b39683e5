"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from callscope.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        if isinstance(x, bool | str):
            return x
        if isinstance(x, int | float):
            return round(float(x), 5)
        return str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = canonical(registry.QUERIES[name](spark, SF).toPandas())
    if name in registry.ORACLE_SQL:
        assert got == canonical(duck.sql(registry.ORACLE_SQL[name]).df())


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
