"""Kernels against brute force by base."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import kernels as K


def by_base(rows, value="value"):
    return {(r.k, p): r[value] for r in rows for p in range(r.start, r.end + 1)}


def test_sweep_and_rle(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), s, s + rng.randrange(60), rng.choice([1, 1, 2, -1])) for s in (rng.randrange(1, 300) for _ in range(200))]
    want = Counter()
    for k, s, e, w in rows:
        for p in range(s, e + 1):
            want[k, p] += w
    want = {k: v for k, v in want.items() if v}
    df = spark.createDataFrame(rows, "k string, start long, end long, w long")
    runs = K.sweep(df, ["k"], {"value": F.col("w")}, chunk=32)
    assert by_base(runs.collect()) == want
    merged = K.rle(runs, ["k"], "value").collect()
    assert by_base(merged) == want
    spans = sorted((r.k, r.start, r.end, r.value) for r in merged)
    assert all(not (a[0] == b[0] and a[2] + 1 == b[1] and a[3] == b[3]) for a, b in zip(spans, spans[1:]))


def test_overlap_join_has_each_pair_once(spark):
    rng = random.Random(5)
    make = lambda n: [(i, s, s + rng.randrange(50)) for i, s in enumerate(rng.randrange(1, 400) for _ in range(n))]
    a, b = make(60), make(60)
    want = sorted((i, j) for i, s, e in a for j, t, f in b if s <= f and t <= e)
    left = spark.createDataFrame([("c", *x) for x in a], "k string, i int, start long, end long")
    right = spark.createDataFrame([("c", *x) for x in b], "k string, j int, start long, end long")
    assert sorted((r.i, r.j) for r in K.overlap_join(left, right, ["k"], 16).collect()) == want


def test_interval_union(spark):
    df = spark.createDataFrame([("c", 1, 5), ("c", 3, 4), ("c", 6, 8), ("c", 12, 13)], "k string, start long, end long")
    assert sorted((r.start, r.end) for r in K.interval_union(df, ["k"]).collect()) == [(1, 8), (12, 13)]


def test_wrap_circular(spark):
    df = spark.createDataFrame([(9, 13, 10, True, 1), (1, 10, 10, True, 1), (1, 25, 10, True, 1), (9, 13, 10, False, 1)], "start long, end long, contig_length long, circular boolean, weight long")
    got = sorted((r.start, r.end, r.weight, r.circular) for r in K.wrap_circular(df).collect())
    assert got == sorted([(9, 10, 1, True), (1, 3, 1, True), (1, 10, 1, True), (1, 10, 2, True), (1, 5, 1, True), (9, 10, 1, False)])


def test_upper_median_and_islands(spark):
    df = spark.createDataFrame([("a", v, 1) for v in (4, 1, 3, 2)] + [("b", v, 1) for v in (5, 1, 3)], "k string, v int, n int")
    assert dict(K.weighted_upper_median(df, ["k"], "v", "n", "m").collect()) == {"a": 3, "b": 3}
    points = spark.createDataFrame([("a", p) for p in (100, 110, 140)], "k string, p int")
    assert len({r.island for r in K.islands(points, ["k"], "p", 20).collect()}) == 2
