"""Every query of the engine runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

from tidemark import queries as engine

SF = "/root/testdata/sf0.001"
NAMES = sorted(engine.oracle_sql())


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(round(float(v), 4)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    got = engine.queries()[name](spark, SF).toPandas()
    want = con.execute(engine.oracle_sql()[name]).fetchdf()
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(engine.queries()) == set(engine.oracle_sql())
