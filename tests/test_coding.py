"""Transcript parents, and values of coding-region helpers."""

from pyspark.sql import functions as F

from tidemark.operators import coding as D

SEGMENTS = "array<struct<start:long,end:long>>"


def test_cds_parent(spark):
    rows = [
        (1, "c", "mRNA", 1, "L", None, [(1, 50), (80, 120)]), (2, "c", "CDS", 1, "L", None, [(10, 50), (80, 90)]), (3, "c", "CDS", -1, "L", None, [(10, 20)]), (4, "c", "CDS", 1, "L", None, [(40, 85)]),
        (5, "c", "mRNA", 1, None, "g", [(1, 99)]), (6, "c", "mRNA", 1, None, "g", [(1, 98)]), (7, "c", "CDS", 1, None, "g", [(5, 9)]), (8, "c", "CDS", 1, None, None, [(5, 9)]),
    ]
    features = spark.createDataFrame(rows, f"annotation_id long, contig_name string, type string, strand int, locus_tag string, gene string, segments {SEGMENTS}")
    assert [tuple(r) for r in D.resolve_cds_parent(features).collect()] == [(2, 1)]


def test_gff_children(spark):
    schema = "row_no long, contig_name string, type string, start long, `end` long, strand int, attributes map<string,string>"
    rows = [
        (1, "c", "mRNA", 1, 90, 1, {"ID": "t1", "product": "p"}), (2, "c", "exon", 50, 90, 1, {"Parent": "t0,t1"}), (3, "c", "exon", 1, 30, 1, {"Parent": "t1"}), (4, "c", "CDS", 5, 30, -1, {"ID": "x", "Parent": "g, t1", "product": "q", "phase": "0"}),
        (5, "c", "CDS", 5, 9, 1, {"Parent": "none"}), (6, "c", "gene", 1, 99, 1, {"ID": "g"}), (7, "c", "CDS", 50, 60, 1, {"Parent": "t1", "phase": "2"}), (8, "c", "transcript", 1, 9, 1, {"ID": "t2", "Parent": "g"}),
        (9, "c", "CDS", 2, 3, 1, {"Parent": "t2"}), (10, "c", "mRNA", 1, 5, 1, {"ID": "t1"}), (11, "c", "CDS", 7, 8, 1, {"Parent": "g"}), (12, "c", "CDS", 1, 2, 1, None),
    ]
    got = {(r.row_no, r.type, r.start, r.end, r.strand, tuple(map(tuple, r.segments)), r.parent_no, tuple(sorted((r.attributes or {}).items()))) for r in D.fold_gff(spark.createDataFrame(rows, schema)).collect()}
    at = lambda n: tuple(sorted((rows[n - 1][6] or {}).items()))
    assert got == {
        (1, "mRNA", 1, 90, 1, ((1, 30), (50, 90)), None, at(1)), (1, "CDS", 5, 60, -1, ((5, 30), (50, 60)), 1, (("ID", "t1"), ("Parent", "g, t1"), ("phase", "0"), ("product", "p"))),
        (5, "CDS", 5, 9, 1, (), None, at(5)), (6, "gene", 1, 99, 1, (), None, at(6)), (8, "transcript", 1, 9, 1, (), None, at(8)), (8, "CDS", 2, 3, 1, (), 8, (("ID", "t2"), ("Parent", "g"))),
        (10, "mRNA", 1, 5, 1, (), None, at(10)), (11, "CDS", 7, 8, 1, (), None, at(11)), (12, "CDS", 1, 2, 1, (), None, ()),
    }


def test_gff_children_in_one_pass(spark):
    """The rows are read for IDs, for parents and once to be folded, not again for each kind of output row."""
    rows = spark.createDataFrame([(1, "c", "mRNA", 1, 90, 1, {"ID": "t"}), (2, "c", "CDS", 1, 9, 1, {"Parent": "t"})], "row_no long, contig_name string, type string, start long, `end` long, strand int, attributes map<string,string>")
    assert D.fold_gff(rows)._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3


def test_top_features(spark):
    """Chains of 40 levels, circles, missing parents and lists of parents."""
    rows = [(i, {"ID": f"n{i}", **({"Parent": f"n{i - 1}"} if i else {})}) for i in range(40)]
    rows += [(100, {"ID": "a", "Parent": "b"}), (101, {"ID": "b", "Parent": "a"}), (102, {"Parent": "b"}), (103, {"Parent": "nobody"}), (104, {"Parent": "nobody,n3,n5"}), (105, {"ID": "s", "Parent": "s"}), (106, None)]
    frame = spark.createDataFrame([(n, "x", a) for n, a in rows], "row_no long, type string, attributes map<string,string>")
    got = {r.row_no: (r.top_no, r.level) for r in D.top_features(frame).collect()}
    assert {n: got[n] for n in range(40)} == {n: (0, n) for n in range(40)}
    assert {n: got[n] for n in range(100, 107)} == {100: (None, None), 101: (None, None), 102: (None, None), 103: (103, 0), 104: (0, 4), 105: (None, None), 106: (106, 0)}


def test_dn_ds_and_offsets(spark):
    segments = F.array(F.struct(F.lit(10).alias("start"), F.lit(19).alias("end")), F.struct(F.lit(30).alias("start"), F.lit(35).alias("end")))
    at = lambda pos, strand: D.spliced_offset(F.lit(pos), segments, F.lit(strand))
    row = spark.range(1).select(at(10, 1).alias("a"), at(31, 1).alias("b"), at(35, -1).alias("c"), at(25, 1).alias("d"), D.dn_ds(F.lit(2.0), F.lit(4.0), F.lit(30), F.lit(60)).alias("e"), D.dn_ds(F.lit(2.0), F.lit(0.0), F.lit(30), F.lit(60)).alias("f")).first()
    assert tuple(row) == (0, 11, 0, None, 0.25, 0.0)
