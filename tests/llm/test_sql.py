"""Every training-data query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from psephos.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in DATA.iterdir():
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def _cell(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if hasattr(v, "dtype") or isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _rows(frame):
    return sorted(tuple(map(_cell, row)) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    ours, theirs = queries.queries()[name](spark, str(DATA)).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours)
    assert _rows(ours) == _rows(theirs)
