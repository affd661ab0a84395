"""Every catalogue query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import pytest

from heddle.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def key(row):
    return repr(tuple("~" if x is None else round(x, 3) if isinstance(x, float) else x for x in row))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(key, df.select(*cols).collect()))
    c = duck.execute(SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    assert got == sorted(key([r[i] for i in at]) for r in c.fetchall())
