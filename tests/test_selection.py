"""Kernels over chunk borders, and the selection of reads, bins and features, on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import genome as G
from tidemark.operators import kernels as K
from tidemark.operators import selection as L


def spans(seed, n, most, longest):
    rng = np.random.default_rng(seed)
    start = rng.integers(1, most, n)
    return [("c%d" % (i % 2), int(s), int(s + rng.integers(0, longest)), i) for i, s in enumerate(start)]


def test_sweep_and_rle_over_chunk_borders(spark):
    rows = spans(1, 200, 300, 150) + [("c2", 1, 1000, 0), ("c2", 1, 1000, 1), ("c3", 16, 16, 0)]
    df = spark.createDataFrame(rows, "k string, start long, end long, id long")
    got = K.rle(K.sweep(df, ["k"], {"value": F.lit(1)}, chunk=16), ["k"], "value", chunk=16).collect()
    depth = {}
    for k, s, e, _ in rows:
        for p in range(s, e + 1):
            depth[k, p] = depth.get((k, p), 0) + 1
    want, last = [], None
    for k, p in sorted(depth):
        if last is not None and last[0] == k and last[2] + 1 == p and last[3] == depth[k, p]:
            last[2] = p
        else:
            last = [k, p, p, depth[k, p]]
            want.append(last)
    assert sorted((r.k, r.start, r.end, r.value) for r in got) == sorted(map(tuple, want))


def test_best_over_brute_force(spark):
    rows = spans(2, 300, 5000, 900) + [("c0", 1, 1_000_000, 999), ("c1", 7, 7, 1000)]
    df = spark.createDataFrame(rows, "k string, start long, end long, id long")
    points = [("c%d" % (i % 3), int(p)) for i, p in enumerate(np.random.default_rng(3).integers(1, 6500, 400))] + [("c0", 1_000_000), ("c0", 1_000_001)]
    got = K.best_over(spark.createDataFrame(points, "k string, pos long"), df, ["k"], F.struct("start", "id"))
    want = {}
    for k, p in points:
        over = [(s, i) for c, s, e, i in rows if c == k and s <= p <= e]
        if over:
            want[k, p] = max(over)
    assert {(r.k, r.pos): (r.best.start, r.best.id) for r in got.collect()} == want
    assert K.best_over(spark.createDataFrame(points, "k string, pos long"), df.limit(0), ["k"], F.col("id")).count() == 0


def test_hits_of_other_bins_do_not_count(spark):
    hits = spark.createDataFrame([("a", "b", 1, 10, 5, 14, 90.0), ("b", "a", 8, 12, 3, 7, 95.0), ("a", "x", 1, 10, 1, 10, 99.0)], "contig_1 string, contig_2 string, p1 int, p2 int, p1x int, p2x int, pident double")
    members = spark.createDataFrame([("m", "a", 100), ("m", "b", 12), ("n", "x", 100)], "mag_name string, contig_name string, contig_length int")
    got = sorted((r.contig_name, r.start, r.end, r.hits, r.pident, r.partner) for r in G.mag_hit_features(hits, members).collect())
    assert got == [("a", 1, 2, 1, 90.0, "b"), ("a", 3, 7, 2, 95.0, "b"), ("a", 8, 10, 1, 90.0, "b"), ("b", 5, 7, 1, 90.0, "a"), ("b", 8, 12, 2, 95.0, "a")]


def test_selection(spark):
    contigs = spark.createDataFrame([("k1", ["old1", "k2"]), ("k2", None)], "contig_name string, aliases array<string>")
    reads = spark.createDataFrame([(1, "k1"), (2, "old1"), (3, "k2"), (4, "k2.13"), (5, "k9"), (6, None)], "read_id int, contig_name string")
    assert {r.read_id: r.contig_name for r in L.resolve_contigs(reads, contigs).collect()} == {1: "k1", 2: "k1", 3: "k2", 4: "k2"}
    segments = spark.createDataFrame([([(7, 9), (1, 3)], 1, 9), ([], 2, 5), (None, 2, 5)], "s array<struct<start:int,end:int>>, start int, end int")
    out = segments.select(L.normalize_segments(F.col("s"), F.col("start"), F.col("end"), F.lit(10)).alias("x")).collect()
    assert [[tuple(s) for s in r.x] for r in out] == [[(11, 13), (17, 19)], [(12, 15)], [(12, 15)]]
    table = {"runs": spark.createDataFrame([("mine", 1)], "feature string, v int")}
    for name in ("primary_reads", "unknown"):
        with pytest.raises(ValueError):
            L.remove_feature(table, name, ["primary_reads"])
    assert L.remove_feature(table, "mine", ["primary_reads"])["runs"].count() == 0
    ordered = L.sort_alignments(spark.createDataFrame([(3, "b", 1), (1, "a", 5), (2, "a", 4), (4, None, None)], "read_id int, contig_name string, pos int"))
    assert [r.read_id for r in ordered.collect()] == [2, 1, 3, 4]


def test_nearest_gene_and_union_over_chunk_borders(spark):
    rng = np.random.default_rng(5)
    genes = [("c%d" % (i % 2), int(s), int(s + rng.integers(0, 40))) for i, s in enumerate(rng.integers(1, 900, 25))]
    points = [(i, "c%d" % (i % 3), int(p)) for i, p in enumerate(rng.integers(1, 1200, 200))]
    g, p = spark.createDataFrame(genes, "contig_name string, start long, end long"), spark.createDataFrame(points, "point_id long, contig_name string, pos long")
    want = {i: min(max(s - x, x - e, 0) for k, s, e in genes if k == c) for i, c, x in points if c != "c2"}
    assert {r.point_id: r.distance for r in G.nearest_distance(p, g, chunk=32).collect()} == want
    covered = {(k, x) for k, s, e in genes for x in range(s, e + 1)}
    union = K.interval_union(g, ["contig_name"]).collect()
    assert {(r.contig_name, x) for r in union for x in range(r.start, r.end + 1)} == covered
    assert all((r.contig_name, r.start - 1) not in covered and (r.contig_name, r.end + 1) not in covered for r in union)
