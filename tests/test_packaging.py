"""Packaging, smoothing and circular reads against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import packaging as P
from tidemark.operators import smoothing as W

KEY = "sample_name string, contig_name string, kind string"
AREA = KEY + ", contig_length long, circular boolean, start long, `end` long, center long, spc long, peaks long, tau double"


def area(kind, center, circular=False, contig="c", n=10_000):
    return ("s", contig, kind, n, circular, center, center, center, 30, 1, 1.0)


def no_repeats(spark):
    return P.repeat_regions(spark.createDataFrame([], "contig_name string, p1 long, p2 long, p1x long, p2x long, is_direct boolean"))


def test_areas_merge_and_wrap(spark):
    points = [("s", c, "reads_starts", p, n, 10) for c in ("line", "ring") for p, n in ((5, 3), (15, 9), (500, 4), (515, 4), (996, 7))]
    candidates = spark.createDataFrame(points, KEY + ", pos long, n long, depth long")
    contigs = spark.createDataFrame([("line", 1000, False), ("ring", 1000, True)], "contig_name string, contig_length long, circular boolean")
    got = {(r.contig_name, r.start, r.end, r.center, r.spc, r.peaks) for r in P.peak_areas(candidates, contigs).collect()}
    assert got == {("line", 5, 15, 15, 12, 2), ("line", 500, 515, 500, 8, 2), ("line", 996, 996, 996, 7, 1), ("ring", 996, 15, 15, 19, 3), ("ring", 500, 515, 500, 8, 2)}


def test_poisson_tail(spark):
    tail = lambda mean, k: P.poisson_tail(F.lit(float(mean)), F.lit(k))
    row = spark.range(1).select(tail(5, 10).alias("a"), tail(5, 2).alias("b"), tail(4000, 4000).alias("c"), tail(1_000_000, 1_000_000).alias("d"), tail(3, 0).alias("e")).first()
    assert row.a == pytest.approx(0.0318281, abs=1e-6) and row.b == pytest.approx(0.9595723, abs=1e-6) and row.e == 1.0
    at_mean = lambda n: 0.5 + 1 / (3 * math.sqrt(2 * math.pi * n))  # noqa: E731 - the known expansion for an observation at the mean
    assert row.c == pytest.approx(at_mean(4000), abs=1e-6) and row.d == pytest.approx(at_mean(1_000_000), abs=1e-6)


@pytest.mark.parametrize(("areas", "want"), [
    ([("reads_starts", 100)], "PAC"), ([("reads_starts", 100), ("reads_ends", 101)], "COS"), ([("reads_starts", 100), ("reads_ends", 112)], "COS_5'"), ([("reads_starts", 112), ("reads_ends", 100)], "COS_3'"),
    ([("reads_starts", 100), ("reads_ends", 700)], "DTR_short_5'"), ([("reads_starts", 100), ("reads_ends", 1101)], "DTR_outlier_5'"), ([("reads_starts", 100), ("reads_starts", 900)], "Unknown_packaging"),
])
def test_mechanisms(spark, areas, want):
    rows = spark.createDataFrame([area(k, c) for k, c in areas], AREA)
    assert P.classify_packaging(P.dedupe_dtr_areas(rows, no_repeats(spark))).first().mechanism == want


def test_circular_distance_and_repeats(spark):
    rows = spark.createDataFrame([area("reads_starts", 9_990, True), area("reads_ends", 5, True)], AREA)
    got = P.classify_packaging(P.dedupe_dtr_areas(rows, no_repeats(spark))).first()
    assert (got.mechanism, got.distance) == ("COS_5'", 15)
    repeats = P.repeat_regions(spark.createDataFrame([("c", 1, 500, 9_501, 10_000, True)], "contig_name string, p1 long, p2 long, p1x long, p2x long, is_direct boolean"))
    twice = spark.createDataFrame([area("reads_starts", 40), area("reads_starts", 9_541)], AREA)
    got = P.classify_packaging(P.dedupe_dtr_areas(twice, repeats)).first()
    assert (got.mechanism, got.duplication) == ("PAC", "DTR")


def test_dtr_clips_need_both_copies(spark):
    repeats = P.repeat_regions(spark.createDataFrame([("c", 1, 100, 901, 1000, True)], "contig_name string, p1 long, p2 long, p1x long, p2x long, is_direct boolean"))
    points = spark.createDataFrame([("s", "c", "reads_starts", p) for p in (10, 910, 20, 950, 400)], KEY + ", pos long")
    assert sorted(r.pos for r in P.confirm_dtr_clips(points, repeats).collect()) == [10, 400, 910]


def test_clipping_test(spark):
    rows = spark.createDataFrame([(*area("reads_starts", c), n) for c, n in ((10, 0), (50, 3), (90, 9), (95, 30))], AREA + ", clips long")
    ratio = spark.createDataFrame([("s", "c", 0.2)], "sample_name string, contig_name string, clipped_ratio double")
    assert {(r.center, r.clip_ok) for r in P.clipping_test(rows, ratio).collect()} == {(10, True), (50, True), (90, True), (95, False)}


@pytest.mark.parametrize("seed", range(3))
def test_smoothing_agrees_with_one_walk(spark, seed):
    rng, runs, at = random.Random(seed), [], 1
    for _ in range(300):
        at += rng.choice([0, 0, 0, 0, 3])
        size = rng.randint(1, 5)
        runs.append((at, at + size - 1, rng.choice([0, 1, 2, 3, 5, 8, 10, 11, 12, 14, 20])))
        at += size
    frame = spark.createDataFrame([("k", s, e, v) for s, e, v in runs], "name string, start long, `end` long, value long")

    def plain(fits, value):
        out, group = [], []
        for run in runs:
            vs = [r[2] for r in [*group, run]]
            if group and (group[-1][1] + 1 != run[0] or not fits(min(vs), max(vs))):
                out.append(group)
                group = []
            group = [*group, run]
        out.append(group)
        return [(g[0][0], g[-1][1], pytest.approx(value(g))) for g in out]

    rows = lambda df: [(r.start, r.end, r.value) for r in df.orderBy("start").collect()]
    for chunk in (W.CHUNK, 40, 7):
        assert rows(W.smooth_runs(frame, ["name"], 50, chunk)) == plain(lambda lo, hi: hi - lo <= 0.5 * max(1.0, lo), lambda g: int((min(r[2] for r in g) + max(r[2] for r in g)) / 2))
        assert rows(W.adaptive_rle(frame, ["name"], 0.5, chunk)) == plain(lambda lo, hi: hi - lo <= 0.5 * lo, lambda g: sum(r[2] * (r[1] - r[0] + 1) for r in g) / sum(r[1] - r[0] + 1 for r in g))


def test_smoothing_of_a_million_alike_runs(spark):
    """One walk over 16 chunks: no task sees more than a chunk, and what is open goes on over all of them."""
    n = 1_000_000
    frame = spark.range(n, numPartitions=8).select(F.lit("k").alias("name"), (F.col("id") + 1).alias("start"), (F.col("id") + 1).alias("end"), (100 + F.col("id") % 7 + F.when(F.col("id") == 700_000, 500).otherwise(0)).alias("value"))
    got = [(r.start, r.end, r.value) for r in W.smooth_runs(frame, ["name"], 50).orderBy("start").collect()]
    assert got == [(1, 700_000, 103.0), (700_001, 700_001, 100 + 700_000 % 7 + 500), (700_002, n, 103.0)]
    rising = frame.select("name", "start", "end", F.col("start").alias("value"))  # each value is a new largest
    got = W.adaptive_rle(rising, ["name"], 0.5).orderBy("start").limit(30).collect()
    at, want = 1, []
    while at <= n:
        last = min(n, int(at * 1.5))
        want.append((at, last, (at + last) / 2))
        at = last + 1
    assert [(r.start, r.end, r.value) for r in got] == want[:30]


def test_terminase_distances_on_circles(spark):
    """Against all pairs of a terminus and a gene."""
    rng = random.Random(3)
    contigs = [("a", 1000, True), ("b", 1000, False), ("c", 1000, True)]
    genes = [(c, s, s + rng.randint(0, 60)) for c in "ab" for s in (rng.randint(1, 900) for _ in range(3))]
    centers = [("s", c, "reads_starts", rng.randint(1, 1000)) for c in "abc" for _ in range(4)]
    want = {}
    for _, c, _, p in centers:
        for g, s, e in genes:
            if g == c:
                d = max(s - p, p - e, 0)
                want[c] = min(want.get(c, 10**9), min(d, 1000 - d) if d and c == "a" else d)
    areas = spark.createDataFrame(centers, KEY + ", center long")
    out = P.terminase_distances(areas, spark.createDataFrame(genes, "contig_name string, start long, `end` long"), spark.createDataFrame(contigs, "contig_name string, contig_length long, circular boolean"))
    assert {r.contig_name: r.terminase_distance for r in out.collect()} == want and set(want) == {"a", "b"}
    assert {r.terminase_percentage for r in out.collect()} == {int(v / 10 + 0.5) for v in want.values()}
