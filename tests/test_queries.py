import glob
import os

import duckdb
import pytest

from framewright.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.all_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.all_queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    cursor = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({registry.all_sql()[name]})")
    theirs = [tuple(map(plain, r)) for r in cursor.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)
