"""The order of alignments where rows are dealt to several ranges, whose borders come from a sample."""

import duckdb
import pytest

from tidemark import queries as engine
from tidemark.operators import selection as L

from tests.test_entry import SF


@pytest.fixture
def many_ranges(spark):
    """As on large tables: ranges are not put together to a single one."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def test_places_are_those_of_one_order(spark, many_ranges):
    want = duckdb.sql(engine.oracle_sql()["sort_alignments"].replace("from lineitem", f"from '{SF}/lineitem.parquet'")).fetchall()
    assert len(want) == 6000 and len({r[3] for r in want}) == 6000
    for _ in range(3):
        got = engine.queries()["sort_alignments"](spark, SF)
        assert sorted(map(tuple, got.select("contig_name", "pos", "read_id", "place").collect())) == sorted(want)


def test_reads_are_dealt_to_ranges_and_sorted_once(spark, many_ranges):
    """What the query gives has no sampled exchange left in it: whoever reads it twice reads the same ranges."""
    text = engine.queries()["sort_alignments"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "monotonically_increasing_id" not in text


def test_unnamed_reads_are_last_at_their_position(spark):
    rows = [(None, "a", 4), (7, "a", 4), (2, "a", None), (None, None, 1), (5, None, 1), (9, "a", 5)]
    made = spark.createDataFrame(rows, "read_id long, contig_name string, pos int")
    assert [tuple(r) for r in L.sort_alignments(made).collect()] == [(7, "a", 4), (None, "a", 4), (9, "a", 5), (2, "a", None), (5, None, 1), (None, None, 1)]
