"""Registered queries that write whole derived tables in a file format to the shared folder and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, oracle, shared_path
from ..sources import files as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SQL["sam_scan"] = f"""with raw as materialized ({oracle('reads')})
select sample_name, contig_name, qname, flag, pos, mapq, cigar, mate_contig, mate_pos, tlen, seq, md, nm from raw where flag & 4 = 0"""


def sam_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "sam")
    rows = derived(spark, d, "reads").withColumn("sample_name", F.col("sample_name"))
    X.write_sam(rows, path)
    return X.read_alignments(spark, path).select("sample_name", "contig_name", "qname", "flag", "pos", "mapq", "cigar", "mate_contig", "mate_pos", "tlen", "seq", "md", "nm")


SQL["fasta_scan"] = f"with sequences as ({oracle('sequences')}) select contig_name, md5(seq) as seq_md5, length(seq)::bigint as contig_length from sequences"


def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "fasta")
    X.write_fasta(derived(spark, d, "sequences"), path)
    return X.read_fasta(spark, path).select("contig_name", F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("contig_length"))


SQL["gff3_scan"] = f"""with a as ({oracle('annotations')}) select contig_name, "start", "end", strand, type, annotation_id::varchar as id, product, locus_tag from a"""


def gff3_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "gff3")
    pairs = F.map_filter(F.create_map(F.lit("ID"), F.col("annotation_id").cast("string"), F.lit("Product"), F.col("product"), F.lit("locus-tag"), F.col("locus_tag")), lambda _, v: v.isNotNull())
    X.write_gff3(derived(spark, d, "annotations").withColumn("attributes", pairs), path)
    at = lambda k: F.element_at("attributes", F.lit(k))
    return X.read_gff3(spark, path).select("contig_name", "start", "end", "strand", "type", at("ID").alias("id"), at("product").alias("product"), at("locus_tag").alias("locus_tag"))


#: How the location of an annotation is written, by its id: each form with the segments that it has.
FORMS = """case annotation_id % 6 when 0 then concat(s, '..', e) when 1 then concat('complement(', s, '..', e, ')') when 2 then concat('join(', s, ',', n, '..', e, ')')
  when 3 then concat('complement(order(<', s, '..', s, ',', n, '..>', e, '))') when 4 then concat('join(complement(', s, '..', e, '),X9.1:5..7,', n, ')') else concat('join(', s, '^', n, ',', n, '..', e, ')') end"""
SQL["genbank_scan"] = f"""with a as ({oracle('annotations')}), k as (select *, annotation_id % 6 as f from a),
g as (select contig_name, annotation_id::varchar as id, type, locus_tag, case when f in (1, 3) then -1 else 1 end as strand, f, "start" as s, "end" + 10 as n, "end" + 19 as e from k)
select contig_name, id, type, locus_tag, strand, (case when f = 5 then n else s end)::bigint as "start", (case when f = 4 then greatest(n, e) else e end)::bigint as "end",
  case f when 2 then s || '-' || s || ':1;' || n || '-' || e || ':1' when 3 then s || '-' || s || ':-1;' || n || '-' || e || ':-1' when 4 then s || '-' || e || ':-1;' || n || '-' || n || ':1'
    when 5 then n || '-' || e || ':1' when 1 then s || '-' || e || ':-1' else s || '-' || e || ':1' end as segments, 12::bigint as contig_length, 'strain ' || contig_name as strain from g"""


def genbank_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every annotation as a GenBank feature, in six forms of location, with a source and bases, written and read back."""
    path = shared_path(spark, "genbank")
    rows = derived(spark, d, "annotations").select("*", F.col("start").cast("string").alias("s"), (F.col("end") + 19).cast("string").alias("e"), (F.col("end") + 10).cast("string").alias("n"))
    line = F.format_string("     %-16s%s\n                     /ID=\"%s\"", "type", F.expr(FORMS), F.col("annotation_id").cast("string"))
    line = F.concat(line, F.coalesce(F.concat(F.lit("\n                     /locus_tag=\""), "locus_tag", F.lit("\"")), F.lit("")))
    features = rows.groupBy("contig_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("f"))
    head = F.format_string("LOCUS       %s 12 bp    DNA     linear\nVERSION     %s.1\nFEATURES             Location/Qualifiers\n     source          1..12\n                     /strain=\"strain %s\"\n", "contig_name", "contig_name", "contig_name")
    features.select(F.concat(head, "f", F.lit("\nORIGIN\n        1 acgtacgtac gt\n//")).alias("value")).write.text(path)
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    told = X.genbank_contigs(spark, path).filter(F.col("alias") == F.concat("contig_name", F.lit(".1"))).select("contig_name", F.try_element_at("qualifiers", F.lit("strain")).alias("strain"))
    segments = F.array_join(F.transform("segments", lambda x: F.format_string("%s-%s:%s", x.start.cast("string"), x.end.cast("string"), x.strand.cast("string"))), ";")
    out = X.read_genbank(spark, path).join(told, "contig_name")
    return out.select("contig_name", at("ID").alias("id"), "type", at("locus_tag").alias("locus_tag"), F.col("strand").cast("int").alias("strand"), "start", "end", segments.alias("segments"), "contig_length", "strain")


SQL["blast6_scan"] = f"""with h as ({oracle('repeats')}) select contig_name as contig_1, contig_name as contig_2, p1, p2, p1x, p2x, pident, (p2 >= p1) = (p2x >= p1x) as is_direct from h where not (p1 = p1x and p2 = p2x)"""


def blast6_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "blast6")
    zero = lambda n: F.lit("0").alias(n)
    text = lambda c: F.col(c).cast("string").alias(c)
    derived(spark, d, "repeats").select(F.col("contig_name").alias("q"), F.col("contig_name").alias("s"), text("pident"), zero("length"), zero("mismatch"), zero("gaps"), text("p1"), text("p2"), text("p1x"), text("p2x")).write.csv(path, sep="\t")
    return X.read_blast6(spark, path)


SQL["runs_tsv"] = "select concat('ctg', l_partkey % 20) as contig, concat(l_returnflag, l_linestatus) as sample, 'quantity' as feature, l_orderkey::varchar as position_start, (l_orderkey + l_linenumber)::varchar as position_end, printf('%.4f', l_discount) as \"value\" from lineitem"


def runs_tsv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "runs")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("ctg"), (F.col("l_partkey") % 20).cast("string")).alias("contig_name"), F.concat("l_returnflag", "l_linestatus").alias("sample_name"), F.lit("quantity").alias("feature"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("end"), F.col("l_discount").alias("value"))
    X.write_runs_tsv(rows, path)
    return spark.read.csv(path, sep="\t", header=True)


SQL["metadata_scan"] = "select c_custkey::varchar as customer, c_name, c_nationkey::bigint as c_nationkey, c_acctbal from customer"


def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "metadata")
    spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("customer"), "c_name", "c_nationkey", "c_acctbal").write.csv(path, header=True)
    return X.read_metadata_csv(spark, path, "customer")


SQL["dataset_round_trip"] = f"with raw as materialized ({oracle('reads')}) select sample_name, contig_name, count(*)::bigint as n, sum(pos)::bigint as pos_sum from raw group by all"


def dataset_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "dataset")
    X.write_dataset({"alignments": derived(spark, d, "reads"), "contigs": derived(spark, d, "contigs")}, path)
    return spark.read.parquet(f"{path}/alignments").groupBy("sample_name", "contig_name").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


QUERIES |= {f.__name__: f for f in (sam_scan, fasta_scan, gff3_scan, genbank_scan, blast6_scan, runs_tsv, metadata_scan, dataset_round_trip)}
