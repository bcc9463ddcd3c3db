"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from quernel.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value) + 0.0:.6f}"
    except (TypeError, ValueError):
        return str(value)


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fair_share_keeps_the_budget(spark):
    from quernel.operators.budget import fair_share

    got = fair_share(spark.createDataFrame([(1, 0, 10), (1, 1, 90), (1, 2, 90)], "k long, i long, s long"), ["k"], "i", "s", 100).collect()
    assert [(r["i"], r["granted"]) for r in sorted(got, key=lambda r: r["i"])] == [(0, 10), (1, 45), (2, 45)]
