"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vectrine.plans.queries import QUERIES, SQL  # the entry's imports have registered them all


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    def cell(x):
        if x is None or pd.isna(x):
            return ""
        if isinstance(x, (bool, str)):
            return str(x)
        try:
            f = float(x)
        except (TypeError, ValueError):
            return str(x)
        return f"{round(f, 6) + 0.0:g}" if math.isfinite(f) else str(f)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_idx", "theta"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
