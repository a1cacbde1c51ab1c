"""The registered queries on the smallest tables, against their SQL where there is any."""

from pathlib import Path

import duckdb
import pytest

from vectrine.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(SQL[name]).df()
    tidy = lambda d: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and tidy(got) == tidy(want)
