"""Viewer windows on small fixtures."""

from pyspark.sql import functions as F

from tidemark.operators import query as Q
from tidemark.operators import views as V

RULES = [{"key": "product", "mode": "exact", "value": "tail", "color": "#111111"}, {"key": "product", "mode": "has", "value": "a", "color": "#222222"}]


def test_samples_dots_translations_report(spark):
    make = spark.createDataFrame
    runs = make([("s1", "c1", 1, 5, 4), ("s1", "c1", 6, 9, 7), ("s2", "c1", 1, 9, -2), ("s1", "c2", 1, 9, 9)], "sample_name string, contig_name string, start long, `end` long, value long")
    assert {(r.sample_name, r.low, r.high) for r in V.all_samples(runs, "c1").collect()} == {("s1", 0, 7), ("s2", -2, 0)}
    annotations = make([(1, "c1", 10, 20), (2, "c2", 4, 7), (3, "c2", 50, 60)], "annotation_id long, contig_name string, start long, `end` long")
    qualifiers = make([(1, "product", "tail"), (2, "product", "capsid"), (3, "product", "x")], "annotation_id long, key string, value string")
    members = make([("m", "c1", 100, 0), ("m", "c2", 80, 100)], "mag_name string, contig_name string, contig_length long, offset long")
    assert {tuple(r) for r in V.mag_dots(annotations, qualifiers, members, RULES).collect()} == {("m", 1, 15, "#111111"), ("m", 2, 105, "#222222")}
    proteins = make([(1, "MK"), (3, "ML")], "annotation_id long, protein string")
    assert [r.protein for r in V.translations(annotations, proteins, 1, 30).collect()] == ["MK"]
    report = V.summary_report(members.select("contig_name", "contig_length"), {"depth": runs.groupBy("sample_name", "contig_name").agg(F.sum("value").alias("v"))}, members, "c2")
    assert [r.contig_name for r in report["members"].collect()] == ["c1", "c2"] and report["depth"].count() == 1 and [r.contig_length for r in report["subject"].collect()] == [80]
    assert V.inspect({"depth": runs}, members, ["c1"], ["s1"], 4, 7).orderBy("start").select("start", "end", "value").collect() == [(4, 5, 4.0), (6, 7, 7.0)]


def test_slice_with_anchors(spark):
    rows = [("s", "c", 2, 2.0), ("s", "c", 6, 3.0), ("s", "c", 10, 4.0), ("t", "c", 3, 5.0), ("t", "c", 8, 5.0), ("t", "c", 10, 1.0), ("u", "c", 1, 9.0)]
    events = spark.createDataFrame(rows, "sample_name string, contig_name string, pos long, value double")
    got = Q.slice_with_anchors(events, ["sample_name", "contig_name"], 5, 8).orderBy("sample_name", "pos").collect()
    by = lambda s: [(r.pos, r.value) for r in got if r.sample_name == s]
    assert by("s") == [(1, 0.0), (2, 2.0), (3, 0.0), (5, 0.0), (6, 3.0), (7, 0.0), (9, 0.0), (10, 4.0), (11, 0.0)]
    assert by("t") == [(2, 0.0), (3, 5.0), (8, 5.0), (9, 0.0)]  # equal values that stand alone: one plateau
    assert by("u") == [(1, 9.0), (2, 0.0)]
