"""CIGAR, MD and sequence functions on hand-made reads."""

import random
import re
import time

from pyspark.sql import functions as F

from tidemark.functions import cigar as C
from tidemark.functions import sequence as Q
from tidemark.functions import text as T
from tidemark.operators import genome as G
from tidemark.operators import query as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_offsets_and_mismatches(spark):
    ops = C.parse_cigar(F.col("cigar"))
    assert one(spark, C.ref_span(ops), cigar="3M2D3M") == 8
    assert one(spark, C.query_length(ops), cigar="2S3M2I3M") == 10
    places = C.cigar_offsets(ops, F.lit(10))
    found = one(spark, C.md_mismatches(places, F.col("md"), F.col("seq")), cigar="4M6N4M", md="5A2", seq="ACGTACGT")
    assert [(m.ref_pos, m.ref_base, m.base) for m in found] == [(21, "A", "C")]
    found = one(spark, C.md_mismatches(places, F.col("md"), F.col("seq")), cigar="3M3D3M", md="3^ACG1T1", seq="ACGTAC")
    assert [(m.ref_pos, m.base) for m in found] == [(17, "A")]


def test_many_operations_and_mismatches(spark):
    """Against a plain walk; and the time of ten times the operations is not far from ten times the time."""
    rng, rows = random.Random(5), []
    for n in (1, 2, 3, 5, 8, 40, 300):
        ops = [(rng.randint(1, 9), rng.choice("MMMDINSP=X")) for _ in range(n)]
        wide = sum(k for k, o in ops if o in "M=X")
        md, at = [], 0
        while at < wide + 2:  # two columns more than there are
            k = rng.randint(0, 4)
            md.append(f"{k}" + rng.choice(["A", "C", "^ACG", "T"]))
            at += k + (md[-1][-4:-3] != "^")
        rows.append(("".join(f"{k}{o}" for k, o in ops), "".join(md) + "0", "".join(rng.choice("ACGT") for _ in range(sum(k for k, o in ops if o in "MIS=X"))), n))
    df = spark.createDataFrame(rows, "cigar string, md string, seq string, n int")
    ops = C.parse_cigar(F.col("cigar"))
    out = df.withColumn("places", C.cigar_offsets(ops, F.lit(100))).withColumn("mm", C.md_mismatches(F.col("places"), F.col("md"), F.col("seq")))
    for r in out.collect():
        at, query, columns, places = 100, 0, [], []
        for k, o in ((int(k), o) for k, o in re.findall(r"(\d+)(\D)", r.cigar)):
            places.append((o, k, at, query, len(columns)))
            columns += [(at + i, query + i) for i in range(k)] if o in "M=X" else []
            at, query = at + k * (o in "MDN=X"), query + k * (o in "MIS=X")
        assert [tuple(p) for p in r.places] == places
        found, k = [], 0
        for t in re.findall(r"\d+|\^[A-Z]+|[A-Z]", r.md):
            if t.isalpha() and k < len(columns):
                found.append((columns[k][0], t, r.seq[columns[k][1]]))
            k += int(t) if t.isdigit() else t[0] != "^"
        assert [tuple(m) for m in r.mm] == found

    def took(n):
        k = (F.col("id") * 0 + n).cast("int")
        long = spark.range(4).select(F.repeat(F.lit("1M1I"), k).alias("cigar"), F.repeat(F.lit("A"), k).alias("md"), F.repeat(F.lit("AC"), k).alias("seq")).withColumn("places", C.cigar_offsets(C.parse_cigar(F.col("cigar")), F.lit(0)))
        began = time.time()
        assert long.select(F.size(C.md_mismatches(F.col("places"), F.col("md"), F.col("seq"))).alias("n")).agg(F.sum("n")).first()[0] == 4 * n
        return time.time() - began

    took(1000)
    assert took(20_000) < 15 * took(2000) + 1


def test_windows_take_time_in_proportion(spark):
    """Twice the bases take at most about twice the time, in windows, statistics and chunks."""
    def took(n):
        seqs = spark.range(1).select(F.lit("c").alias("contig_name"), F.repeat(F.lit("ACGTN"), (F.col("id") * 0 + n // 5).cast("int")).alias("seq"))
        began = time.time()
        assert G.gc_windows(seqs, 500).agg(F.count("*"), F.min("gc"), F.max("gc")).first()[0] == n // 500
        assert G.chunked(seqs).count() == -(-n // 65_536)
        return time.time() - began

    took(1_000_000)
    assert took(32_000_000) < 2 * took(16_000_000) + 2
    odd = spark.createDataFrame([("a", "ACGTA"), ("b", ""), ("c", None), ("d", "AC")], "contig_name string, seq string")
    assert sorted(map(tuple, G.windows(odd, 2).collect())) == [("a", 0, "AC"), ("a", 1, "GT"), ("a", 2, "A"), ("d", 0, "AC")]


def test_edges(spark):
    def event(cigar, md, side):
        return one(spark, C.boundary_event(F.col("cigar"), F.col("md"), side), cigar=cigar, md=md)

    assert event("5M", "5", "start") == 0 and event("5M", "0C4", "start") is None
    assert event("3S5M", "5", "start") == 3 and event("7S5M", "5", "start") is None
    assert event("5M2S", "5", "end") == 2 and event("5M", "4C0", "end") is None


def test_sequences(spark):
    assert one(spark, Q.revcomp(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, Q.translate(F.lit("ATGGCCTAANNA"))) == "MA*X"
    s = one(spark, Q.sn_sites(F.lit("ATGGCC")))
    assert (s.s, s.n) == (3, 15)
    assert one(spark, Q.gc_percent(F.lit("NNNN"))) == 50 and one(spark, Q.gc_skew(F.lit("AATT"))) == 0


def test_texts(spark):
    assert one(spark, T.token_eq(F.lit("a^b"), "b")) and not one(spark, T.token_eq(F.lit("ab"), "b"))
    assert one(spark, T.gff_unescape(T.gff_escape(F.lit("a;b=c%3B,d")))) == "a;b=c%3B,d"
    assert one(spark, T.compact_pvalue(F.lit(0.000035))) == "35e-6"


def test_fold_left_to_right_with_skips(spark):
    make = lambda *x: spark.createDataFrame([(a,) for a in x], "a int")
    got = V.combine([make(1, 2), make(3), None, make(2, 3)], ["OR", "OR", "AND"])
    assert sorted(r.a for r in got.collect()) == [2, 3]
    assert V.predicate(F.col("a"), "number", ">", "x") is None
