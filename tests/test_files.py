"""Sources, sinks, streaming ingest and dataset changes on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import maintenance as N
from tidemark.sources import files as X
from tidemark.streaming import ingest as I

GENBANK = """LOCUS       phage1   1200 bp    DNA     linear   PHG 01-JAN-2020
FEATURES             Location/Qualifiers
     source          1..1200
                     /organism="a phage"
     CDS             complement(join(10..30,50..90))
                     /gene="abc"
                     /product="tail
                     fiber"
     CDS             100..400
                     /product="capsid"
                     /product="second"
                     /pseudo
ORIGIN
        1 acgtacgt
//
LOCUS       phage2   20 bp    DNA
FEATURES             Location/Qualifiers
     tRNA            3..9
                     /locus_tag="t1"
ORIGIN
//
"""


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_sam(spark, tmp_path):
    head = "@SQ\tSN:c1\tLN:100\n@SQ\tSN:c2\tLN:50\n@CO\tcircular=true\n"
    line = "r1\t99\tc1\t5\t60\t5M\t=\t20\t30\tACGTA\t*\tNM:i:1\tMD:Z:2A2\n"
    put(tmp_path, "s1_with_MD.sam", head + line + "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    put(tmp_path, "s2.sam", "@SQ\tSN:c1\tLN:90\n")
    got = X.read_alignments(spark, str(tmp_path)).collect()
    assert [(r.sample_name, r.contig_name, r.pos, r.mate_contig, r.mate_pos, r.md, r.nm) for r in got] == [("s1", "c1", 4, "c1", 19, "2A2", 1)]
    heads = X.read_headers(spark, str(tmp_path))
    assert [tuple(r) for r in X.contigs_from_headers(heads).collect()] == [("c1", 100, 2), ("c2", 50, 1)]
    assert {tuple(r) for r in X.sample_circularity(heads).collect()} == {("s1", True), ("s2", False)}


def test_fasta_and_bins(spark, tmp_path):
    put(tmp_path, "binA.fa", ">c1 first\nACGT\nAC\n>empty\n>c2\nGG\n")
    assert {tuple(r) for r in X.read_fasta(spark, str(tmp_path)).collect()} == {("c1", "ACGTAC"), ("c2", "GG")}
    assert {tuple(r) for r in X.mag_manifest(spark, str(tmp_path)).collect()} == {("binA", "c1", 6), ("binA", "c2", 2)}
    assert [tuple(r) for r in X.chunks_of_files(spark, str(tmp_path), 4).orderBy("contig_name", "chunk_idx").collect()] == [("c1", 0, "ACGT"), ("c1", 1, "AC"), ("c2", 0, "GG")]


def test_gff3(spark, tmp_path):
    text = "##sequence-region c1 1 900\nc1\tx\tgene\t1\t950\t.\t+\t.\tID=g\nc1\tx\tCDS\t5\t20\t.\t-\t0\tID=a;Product=tail%3B fiber;ID=b;\nc2\tx\tCDS\t7\t70\t.\t.\t0\tlocus-tag=L\n##FASTA\n>c1\nACGT\n"
    path = put(tmp_path, "a.gff3", text)
    got = {(r.contig_name, r.start, r.end, r.strand, tuple(sorted(r.attributes.items()))) for r in X.read_gff3(spark, path).collect()}
    assert got == {("c1", 5, 20, -1, (("ID", "a"), ("product", "tail; fiber"))), ("c2", 7, 70, 1, (("locus_tag", "L"),))}
    assert {tuple(r) for r in X.gff3_contigs(spark, path).collect()} == {("c1", 900), ("c2", 70)}


def test_genbank(spark, tmp_path):
    rows = X.read_genbank(spark, put(tmp_path, "a.gbk", GENBANK)).collect()
    got = {(r.contig_name, r.contig_length, r.type, r.start, r.end, r.strand, len(r.segments), r.attributes.get("product")) for r in rows}
    assert got == {("phage1", 8, "CDS", 10, 90, -1, 2, "tail fiber"), ("phage1", 8, "CDS", 100, 400, 1, 1, "capsid"), ("phage2", 20, "tRNA", 3, 9, 1, 1, None)}
    path = str(tmp_path / "a.gbk")
    assert {(r.contig_name, r.contig_length, r.alias, tuple((r.qualifiers or {}).items())) for r in X.genbank_contigs(spark, path).collect()} == {("phage1", 8, None, (("organism", "a phage"),)), ("phage2", 20, None, ())}
    assert [tuple(r) for r in X.genbank_sequences(spark, path, 5).orderBy("chunk_idx").collect()] == [("phage1", 0, "acgta"), ("phage1", 1, "cgt")]


@pytest.mark.parametrize(("place", "segments"), [
    ("467", [(467, 467, 1)]), ("340..565", [(340, 565, 1)]), ("<345..>500", [(345, 500, 1)]), ("<1", [(1, 1, 1)]),
    ("join(12..78,134..202)", [(12, 78, 1), (134, 202, 1)]), ("complement(34..126)", [(34, 126, -1)]), ("complement(join(2691..4571,4918..5163))", [(2691, 4571, -1), (4918, 5163, -1)]),
    ("join(complement(4918..5163),complement(2691..4571))", [(4918, 5163, -1), (2691, 4571, -1)]), ("order(1..5,complement(order(7,9..11)),20)", [(1, 5, 1), (7, 7, -1), (9, 11, -1), (20, 20, 1)]),
    ("complement(complement(3..9))", [(3, 9, 1)]), ("join(1..100,J00194.1:100..202)", [(1, 100, 1)]), ("123^124", []), ("102.110", []), ("join(one-of(3,5)..9,20..30)", [(20, 30, 1)]), ("join(12..one-of(15,19),20..30)", [(20, 30, 1)]), ("", []), ("join(1..4,gap(10),20..22)", [(1, 4, 1), (20, 22, 1)]),
])
def test_genbank_locations(spark, place, segments):
    assert [tuple(s) for s in spark.range(1).select(X.location_segments(F.lit(place)).alias("s")).first().s] == segments


def test_blast_metadata_and_features(spark, tmp_path):
    hits = put(tmp_path, "h.tsv", "a\ta\t100\t9\t0\t0\t1\t9\t1\t9\na\tb\t90\t9\t0\t0\t1\t9\t20\t12\n" + "short\tline\n")
    assert [(r.contig_1, r.contig_2, r.is_direct) for r in X.read_blast6(spark, hits).collect()] == [("a", "b", False)]
    meta = put(tmp_path, "m.csv", "Sample,depth,temp,site\ns1,1,2.5,x\ns2,,3,\n")
    assert X.read_metadata_csv(spark, meta, "Sample").dtypes == [("Sample", "string"), ("depth", "bigint"), ("temp", "double"), ("site", "string")]
    feature = put(tmp_path, "f.csv", "Contig,Sample,First_position,Last_position,Value\nc1,s1,1,5,2.5\nc1,,7,9,1\n")
    assert [tuple(r) for r in X.read_custom_feature(spark, feature).collect()] == [("c1", "s1", 1, 5, 2.5), ("c1", None, 7, 9, 1.0)]
    other = put(tmp_path, "g.csv", "product,score\ntail,1\n")
    assert set(X.read_enrichment(spark, [meta, other]).columns) == {"Sample", "depth", "temp", "site", "product", "score"}


def reads(spark, sample, n):
    row = (1, "q", 0, 3, 60, "5M", None, None, 0, "ACGTA", "5", 0)
    names = ["flag", "qname_", "x", "pos", "mapq", "cigar", "mate_contig", "mate_pos", "tlen", "seq", "md", "nm"]
    types = "flag int, qname_ string, x int, pos int, mapq int, cigar string, mate_contig string, mate_pos int, tlen int, seq string, md string, nm int"
    assert len(row) == len(names)
    one = spark.createDataFrame([row], types).drop("qname_", "x").withColumn("flag", F.lit(0))
    return spark.range(n).withColumnRenamed("id", "read_id").join(one).select(F.lit(sample).alias("sample_name"), F.lit("c1").alias("contig_name"), "read_id", F.lit("q").alias("qname"), "flag", "pos", "mapq", "cigar", "mate_contig", "mate_pos", "tlen", "seq", "md", "nm")


def state(spark, dataset):
    """All tables of a dataset but for the batch numbers."""
    return {n: sorted(tuple(r) for r in I.table(spark, dataset, n).drop("batch").collect()) for n in I.SCHEMAS} | {
        "alignments": sorted((r.sample_name, r.read_id) for r in spark.read.parquet(f"{dataset}/alignments").collect())}


def sample(spark, name, *contigs):
    """One read on each of these contigs."""
    rows = reads(spark, name, len(contigs))
    return rows.withColumn("contig_name", F.element_at(F.array(*map(F.lit, contigs)), (F.col("read_id") % len(contigs) + 1).cast("int")))


def test_streaming_ingest(spark, tmp_path):
    """Two ingests are one recomputation, a batch that runs twice changes nothing, and one that breaks a rule adds nothing."""
    contigs = spark.createDataFrame([(f"c{i}", 100 * i) for i in range(1, 6)], "contig_name string, contig_length long")
    members = spark.createDataFrame([("m1", "c1"), ("m1", "c2"), ("m2", "c3")], "mag_name string, contig_name string")
    where = [str(tmp_path / x) for x in ("incoming", "dataset", "checkpoint")]
    first, second, third = sample(spark, "s1", "c1", "c2", "c3"), sample(spark, "s2", "c2", "c5"), sample(spark, "s3", "c1", "c1")
    first.coalesce(1).write.parquet(where[0])
    I.ingest(spark, *where, contigs, members).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(where[0])
    third.coalesce(1).write.mode("append").parquet(where[0])
    I.ingest(spark, *where, contigs, members).awaitTermination()
    I.ingest(spark, *where, contigs, members).awaitTermination()  # nothing new
    now = state(spark, where[1])
    assert dict(r[:2] for r in now["contig_counts"]) == {"c1": 2, "c2": 2, "c3": 1, "c5": 1} and dict(r[:2] for r in now["bin_counts"]) == {"m1": 3, "m2": 1}
    whole = str(tmp_path / "whole")
    I.add_batch(first.unionByName(second).unionByName(third), 0, whole, contigs, members)
    assert state(spark, whole) == now
    I.add_batch(first.unionByName(second).unionByName(third), 0, whole, contigs, members)  # as after a failure
    assert state(spark, whole) == now
    for bad, own, says in ((sample(spark, "s1", "c4"), members, "sample exists: s1"), (sample(spark, "s9", "c9"), members, "unknown contig: c9"),
                           (sample(spark, "s9", "c4"), members.unionByName(spark.createDataFrame([("m2", "c4")], members.schema)), "new contig in a bin: c4")):
        with pytest.raises(ValueError, match=says):
            I.add_batch(bad, 7, whole, contigs, own)
    assert state(spark, whole) == now
    sample(spark, "s1", "c4").coalesce(1).write.mode("append").parquet(where[0])
    with pytest.raises(Exception, match="sample exists: s1"):
        I.ingest(spark, *where, contigs, members).awaitTermination()
    assert state(spark, where[1]) == now


def test_check_new(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    known = frame([("s1",)], "sample_name string")
    members = frame([("m1", "c1")], "mag_name string, contig_name string")
    got = I.check_new(frame([("s1",), ("s2",)], "sample_name string"), known, frame([("m1", "c1"), ("m1", "c9"), ("m2", "c5")], "mag_name string, contig_name string"), members)
    assert {tuple(r) for r in got.collect()} == {("sample exists", "s1"), ("new contig in a bin", "c9")}


def test_maintenance(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    new = spark.createDataFrame([("a", 7), ("z", 8)], "name string, y int")
    out, unknown = N.add_metadata(table, new, "name")
    assert {tuple(r) for r in out.collect()} == {("a", 1, 7), ("b", 2, None)} and [r.name for r in unknown.collect()] == ["z"]
    with pytest.raises(ValueError):
        N.add_metadata(table, new.withColumnRenamed("y", "x"), "name")
    assert N.drop_metadata(out, "y", ["name", "x"]).columns == ["name", "x"]
    with pytest.raises(ValueError):
        N.drop_metadata(out, "x", ["name", "x"])
    tables = {"t": table, "u": spark.createDataFrame([("s1", 1)], "sample_name string, n int")}
    assert N.remove(tables, "name", "a")["t"].count() == 1 and set(N.purge_mapping(tables)) == {"t"}
    assert [r.name for r in N.names(tables, "name").collect()] == ["a", "b"]


def test_removal_cascades(spark):
    """Rows go with what they hang on, over several tables; refusals and circles are told."""
    make = spark.createDataFrame
    tables = {
        "contigs": make([("c1",), ("c2",), ("c3",)], "contig_name string"), "samples": make([("s1", 9), ("s2", 5)], "sample_name string, n_mapped long"),
        "packaging": make([(1, "s1", "c1"), (2, "s1", "c2"), (3, "s2", "c1")], "packaging_id int, sample_name string, contig_name string"),
        "termini": make([(1, 10), (1, 20), (2, 30), (3, 40)], "packaging_id int, pos int"), "hits": make([("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "c2")], "contig_1 string, contig_2 string"),
        "read_counts": make([("s1", "c1", 4), ("s1", "c2", 5), ("s2", "c1", 5)], "sample_name string, contig_name string, read_count long"),
        "contig_counts": make([("c1", 2), ("c2", 1)], "contig_name string, n_samples long"), "notes": make([("x",)], "note string"),
    }
    left = lambda out, name: sorted(tuple(r) for r in out[name].collect())
    out = N.remove_contigs(tables, make([("c1",)], "contig_name string"))
    assert left(out, "termini") == [(2, 30)] and left(out, "hits") == [("c2", "c3"), ("c3", "c2")] and left(out, "samples") == [("s1", 5), ("s2", 0)]
    assert left(out, "contig_counts") == [("c2", 1)] and left(out, "notes") == [("x",)] and left(out, "contigs") == [("c2",), ("c3",)]
    out = N.remove_samples(tables, make([("s1",)], "sample_name string"))
    assert left(out, "termini") == [(3, 40)] and left(out, "contig_counts") == [("c1", 1), ("c2", 0)] and left(out, "samples") == [("s2", 5)] and len(left(out, "hits")) == 4
    binned = tables | {"bins": make([("m1",), ("m2",)], "mag_name string"), "members": make([("m1", "c1"), ("m1", "c2"), ("m2", "c3")], "mag_name string, contig_name string"), "bin_counts": make([("m1", 2)], "mag_name string, n_samples long")}
    out = N.remove_bins(binned, make([("m1",)], "mag_name string"))
    assert left(out, "contigs") == [("c3",)] and left(out, "read_counts") == left(out, "bin_counts") == left(out, "hits") == [] and left(out, "members") == [("m2", "c3")]
    with pytest.raises(ValueError, match="in bin mode: c1"):
        N.remove_contigs(binned, make([("c1",)], "contig_name string"))
    with pytest.raises(ValueError, match="unknown contig: c7"):
        N.remove_contigs(tables, make([("c7",)], "contig_name string"))
    with pytest.raises(ValueError, match="not a dataset of bins"):
        N.remove_bins(tables, make([("m1",)], "mag_name string"))
