"""Every query of the search engine against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from siftline import queries

DIR = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.skipif(not Path(DIR).exists(), reason="the tables are elsewhere")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, result.fetchall())
