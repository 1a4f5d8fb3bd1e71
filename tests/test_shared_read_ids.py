"""Different reads that share a read_id, as a few do on large tables: every query on reads still agrees with its SQL."""

import os

import duckdb
import pytest

from tidemark import queries as engine
from tests.test_entry import SF, rows

NAMES = ["all_samples", "drop_ghosts", "filter_reads", "filter_report", "gene_interval_stats", "insertions", "mean_read_lengths", "mismatches", "signal_coverage_reduced", "signal_deletions",
         "signal_mate_on_another_contig", "signal_non_inward_pairs", "signal_primary_reads", "signal_primary_reads_minus_only", "circular_events", "inspect_window", "microdiversity"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables, with reads of other parts that have the read_id of one there."""
    folder, con = tmp_path_factory.mktemp("shared"), duckdb.connect()
    for f in os.listdir(SF):
        more = ""
        if f == "lineitem.parquet":  # a million parts more are the same remainder
            more = f" union all select * exclude (k) replace (l_partkey + 1000000 * k as l_partkey, (l_discount + k / 100.0) as l_discount) from read_parquet('{SF}/{f}'), range(1, 3) r(k) where l_orderkey % 3 = 0"
        con.execute(f"copy (select * from read_parquet('{SF}/{f}'){more}) to '{folder}/{f}' (format parquet)")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, tables, name):
    folder, con = tables
    got = engine.queries()[name](spark, folder).toPandas()
    assert rows(got) == rows(con.execute(engine.oracle_sql()[name]).fetchdf())
