"""The stored pyramid: equal to bins made from base runs, and pruned by a window."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.operators import levels as L
from tidemark.operators import query as Q
from tidemark.operators import views as V

PAIR = ["sample_name", "contig_name"]


@pytest.fixture(scope="module")
def runs(spark):
    rng, rows = random.Random(2), []
    for sample in ("s1", "s2"):
        for contig, n in (("long", 300_000), ("short", 950), ("other", 70_000)):
            at = 1
            while at < n:
                wide = rng.randint(1, n // 40)
                if rng.random() < 0.8:
                    rows.append((sample, contig, at, min(n, at + wide - 1), rng.randint(1, 9)))
                at += wide
    return spark.createDataFrame(rows, "sample_name string, contig_name string, start long, `end` long, value long")


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("long", 300_000), ("short", 950), ("other", 70_000)], "contig_name string, contig_length long")


@pytest.fixture(scope="module")
def path(spark, runs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("levels") / "depth")
    L.append_levels(runs.filter("sample_name = 's1'"), path)
    L.append_levels(runs.filter("sample_name = 's2'"), path)
    L.append_levels(runs.filter("sample_name = 's2'"), path)  # once more: nothing changes
    return path


def rows(df):
    return sorted((r.sample_name, r.contig_name, r.start, r.end, round(r.value, 6)) for r in df.select(*PAIR, "start", "end", "value").collect())


@pytest.mark.parametrize("size", [1, 100, 1000, 10_000])
def test_levels_equal_bins_of_base_runs(spark, runs, contigs, path, size):
    for start, end in ((1, 300_000), (65_500, 65_600), (131_073, 200_001)):
        got = rows(L.window(spark, path, contigs, start, end, size=size))
        want = V.inspect({"x": runs}, contigs, None, None, start, end, zoom=0 if size == 1 else size)
        assert got == rows(K.rle(want, PAIR, "value") if size == 1 else want)


def test_peaks_and_the_choice_of_a_level(spark, runs, contigs, path):
    got = {(r.sample_name, r.contig_name, (r.start - 1) // 1000): r.value for r in L.window(spark, path, contigs, 1, 300_000, size=1000, peaks=True).collect()}
    cells = runs.withColumn("pos", F.explode(F.sequence("start", "end")))
    assert got == {(r.sample_name, r.contig_name, r.bin): r.value for r in Q.zoom_sparse(cells, PAIR, 1000).collect()}
    wide = L.window(spark, path, contigs, 1, 300_000, most=500)  # 300 bins of 1,000
    assert {r.end - r.start + 1 for r in wide.collect()} == {1000}


def test_a_window_reads_its_own_folders(spark, contigs, path):
    """Partition filters in the plan, and files of the one level, bucket and chunks."""
    narrow = L.window(spark, path, contigs, 140_000, 140_500, names=["long"], samples=["s1"])
    with contextlib.redirect_stdout(io.StringIO()) as said:
        narrow.explain("formatted")
    filters = re.search(r"PartitionFilters: \[(.*)\]", said.getvalue())[1]
    assert all(f"{c}#" in filters for c in L.FOLDERS) and "EqualTo(contig_name,long)" in said.getvalue()
    narrow.collect()
    read = lambda df: int(re.search(r"number of files read: (\d+)", metrics(df))[1])
    every = spark.read.schema(L.SCHEMA).parquet(path).select(F.input_file_name().alias("f")).distinct().count()
    wide = L.window(spark, path, contigs, 1, 300_000, most=500)
    assert read(narrow) == 1 and every > 30
    assert read(wide) <= 6  # three contigs of two samples, one level


def metrics(df):
    """The scans of a plan that ran, with their numbers of files."""
    df.collect()
    found = []

    def walk(node):
        own = node.metrics()
        if own.contains("numFiles"):
            found.append(f"number of files read: {own.apply('numFiles').value()}")
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return "; ".join(found)


def test_empty_runs(spark, runs, contigs, tmp_path):
    L.append_levels(runs.filter("sample_name = 's1'"), f"{tmp_path}/x")
    assert L.window(spark, f"{tmp_path}/x", contigs, 1, 1000, names=["nothing"]).count() == 0
    assert L.window(spark, f"{tmp_path}/x", contigs, 400_000, 500_000).count() == 0


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    """A table that is overwritten is read anew, in a session that has answered from it before."""
    from tidemark import queries

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    total = lambda: sum(r.n_reads for r in queries.queries()["sample_totals"](spark, str(tmp_path)).collect())
    for t in ("lineitem", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert total() == total() > 1000
    lines.limit(10).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert 0 < total() <= 10
