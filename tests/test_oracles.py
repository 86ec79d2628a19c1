"""Every query with an SQL twin, compared on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from seqlens.plans import catalog

SF = "/root/testdata/sf0.001"


def _rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if hasattr(v, "tolist") and not isinstance(v, (bytes, str)):
            v = v.tolist()
        if v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            v = round(v, 6)
            return int(v) if v == int(v) else v
        return v

    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in row]) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
