"""P-values as short texts where their digits lie on a half, or next to one."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries as engine
from tidemark.functions import text as T


def test_digits_on_a_half(spark):
    values = {1 / 1600: "62e-5", 1 / 3636.363636363637: "27e-5", 0.000635: "64e-5", 0.000035: "35e-6", 1.0: "10e-1", 3.45e-300: "34e-301", 0.0: "0", None: None}
    made = spark.createDataFrame([(v,) for v in values], "p double")
    assert {r.p: r.text for r in made.select("p", T.compact_pvalue(F.col("p")).alias("text")).collect()} == values


@pytest.mark.parametrize("prices", ["select i / 100 from range(100, 200000, 100) t(i)", "select 1 / (concat(k, '.5e', e)::double * (1 + j * 1.2e-16::double)) from range(10, 100) a(k), range(-60, 20) b(e), range(-3, 4) c(j)"], ids=["whole prices", "halves"])
def test_query_agrees_with_sql(spark, tmp_path, prices):
    con = duckdb.connect()
    con.execute(f"create table orders as select row_number() over () as o_orderkey, x::double as o_totalprice from ({prices}) t(x)")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    want = con.execute(engine.oracle_sql()["compact_pvalue"]).fetchall()
    got = engine.queries()["compact_pvalue"](spark, str(tmp_path)).select("o_orderkey", "p").collect()
    assert len(want) > 1000 and sorted(map(tuple, got)) == sorted(want)
