"""Every registered panel query equals its SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from panelith.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    cell = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns, sorted(columns)) == plain(want.fetchall(), columns, sorted(columns))
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["time", "SMB", "HML"] and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
