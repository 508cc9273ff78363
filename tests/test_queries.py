import glob
import os

import duckdb
import pytest

from framequarry import plans


def plain(v):
    if v is None or v != v:
        return ""
    return round(float(v), 5) if isinstance(v, float) else int(v) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def db(sf):
    out = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        out.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return out


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, db, name):
    want = db.execute(plans.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    rows = sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=str)
    df = plans.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == rows


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
