"""New alignment files of a folder, added to a dataset sample by sample with Structured Streaming.

A dataset is a folder of tables: alignments, samples and read_counts (with RPKM and TPM) by sample, contigs and members (of
bins) as they came, and how many samples have a contig (contig_counts) or a bin (bin_counts), by buckets of their names.

A batch is checked before anything is written, and fails as a whole if it breaks a rule. What depends on a sample alone is
written to that sample's folder; counts over samples are made anew for the buckets that the batch touches, from read_counts, and
replace just these. Each write overwrites folders by what is in them, never adds to numbers, and files of one batch are fixed by
the checkpoint: a batch that runs again after a failure leaves the dataset as if it had run once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import read_counts, rpkm_tpm, sample_totals
from ..operators.signals import PAIR, prepare

BUCKETS = 64
SCHEMAS = {
    "samples": "n_mapped long, n_reads long, batch long, sample_name string",
    "contigs": "contig_name string, contig_length long, batch long",
    "members": "mag_name string, contig_name string, batch long",
    "read_counts": "contig_name string, read_count long, rpkm double, tpm double, sample_name string, bucket int",
    "contig_counts": "contig_name string, n_samples long, bucket int",
    "bin_counts": "mag_name string, n_samples long, bucket int",
}


def check_new(samples: DataFrame, known_samples: DataFrame, contigs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Reasons against adding: names of samples that are there already, and new contigs of bins that are there already."""
    bad = samples.join(known_samples.select("sample_name"), "sample_name", "left_semi").select(F.lit("sample exists").alias("problem"), F.col("sample_name").alias("name"))
    if members is None:
        return bad
    new = contigs.filter("mag_name is not null").join(members.select("mag_name", "contig_name"), ["mag_name", "contig_name"], "left_anti")
    grown = new.join(members.select("mag_name").distinct(), "mag_name", "left_semi")
    return bad.unionByName(grown.select(F.lit("new contig in a bin").alias("problem"), F.col("contig_name").alias("name")))


def table(spark: SparkSession, dataset: str, name: str) -> DataFrame:
    """A table of the dataset; without rows, if nothing has written it yet."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{dataset}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def _replace(df: DataFrame, path: str, *folders: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def recount(spark: SparkSession, dataset: str, contigs: DataFrame) -> None:
    """Write the numbers of samples of some contigs, and of bins that have any of them, anew: for whole buckets, from
    read_counts."""
    touched = contigs.select(_bucket("contig_name").alias("bucket")).distinct()
    present = table(spark, dataset, "read_counts").filter("read_count > 0")
    own = present.join(touched, "bucket", "left_semi").groupBy("contig_name", "bucket").agg(F.count_distinct("sample_name").alias("n_samples"))
    _replace(own, f"{dataset}/contig_counts", "bucket")
    members = table(spark, dataset, "members").select("mag_name", "contig_name", _bucket("mag_name").alias("mag_bucket"))
    bins = members.join(members.join(contigs, "contig_name", "left_semi").select("mag_bucket").distinct(), "mag_bucket", "left_semi")
    counts = present.join(bins, "contig_name").groupBy("mag_name", F.col("mag_bucket").alias("bucket")).agg(F.count_distinct("sample_name").alias("n_samples"))
    _replace(counts, f"{dataset}/bin_counts", "bucket")


def add_batch(batch: DataFrame, batch_id: int, dataset: str, contigs: DataFrame, members: DataFrame | None = None) -> None:
    """Check a batch of alignments against the dataset and add it. contigs: contig_name, contig_length of the references that
    the files were mapped to; members: mag_name, contig_name. Names that are known keep what the dataset has of them."""
    spark = batch.sparkSession
    earlier = lambda name: table(spark, dataset, name).filter(F.col("batch") != batch_id)  # noqa: E731  what this batch wrote, if it runs again, is no conflict
    batch = batch.persist()
    try:
        known_bins = earlier("members")
        problems = check_new(batch.select("sample_name").distinct(), earlier("samples"), (members if members is not None else known_bins), known_bins).union(
            batch.select("contig_name").distinct().join(contigs.select("contig_name").unionByName(earlier("contigs").select("contig_name")), "contig_name", "left_anti")
            .filter("contig_name is not null").select(F.lit("unknown contig"), "contig_name")
        ).orderBy("problem", "name").limit(5).collect()
        if problems:
            raise ValueError("nothing was added: " + "; ".join(f"{p.problem}: {p.name}" for p in problems))
        for name, rows in (("contigs", contigs), ("members", members)):
            if rows is not None:
                keys = ["contig_name"] if name == "contigs" else ["mag_name", "contig_name"]
                columns = [c.split()[0] for c in SCHEMAS[name].split(", ")[:2]]
                _replace(rows.select(*columns).dropDuplicates(keys).join(earlier(name), keys, "left_anti").withColumn("batch", F.lit(batch_id)), f"{dataset}/{name}", "batch")
        _replace(batch, f"{dataset}/alignments", "sample_name")
        reads = prepare(batch)
        totals = sample_totals(reads)
        _replace(totals.withColumn("batch", F.lit(batch_id).cast("long")), f"{dataset}/samples", "sample_name")
        counts = read_counts(reads)
        _replace(rpkm_tpm(counts, table(spark, dataset, "contigs"), totals).withColumn("bucket", _bucket("contig_name")), f"{dataset}/read_counts", "sample_name", "bucket")
        recount(spark, dataset, counts.select("contig_name").distinct())
    finally:
        batch.unpersist()


def ingest(spark: SparkSession, incoming: str, dataset: str, checkpoint: str, contigs: DataFrame, members: DataFrame | None = None, files_per_batch: int = 64):
    """Start a query that adds all alignment tables waiting under `incoming` (Parquet) to the dataset, and ends. A sample arrives
    whole, in one file; one that the dataset has already, or a new contig for a bin that it has, fails the query."""
    schema = spark.read.parquet(incoming).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    add = lambda batch, batch_id: add_batch(batch, batch_id, dataset, contigs, members)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
