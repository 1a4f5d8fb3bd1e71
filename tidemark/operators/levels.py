"""A stored pyramid of a signal: base runs and bins of growing size, in a layout that a window prunes.

A row is a run (level 1) or a bin (levels 100, 1,000 and 10,000 bases) of one sample and contig with the sum of its values, the
bases that have one, and the largest. Each level is rolled up from the rows of the level below, so base runs are read once.
Folders are sample, level, bucket (a hash of the contig) and chunk (CHUNK bins along the contig), rows inside are in order of
contig and place: a window of some contigs and samples reads the folders of its own level, buckets and chunks, and in them the
row groups of its contigs. Samples are appended; rows of a sample that is appended again with the same runs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import rle
from .query import region, zoom_size
from .signals import PAIR

CHUNK, BUCKETS, SIZES = 65_536, 64, (100, 1_000, 10_000)
SCHEMA = "contig_name string, start long, `end` long, total double, covered long, peak double, sample_name string, level int, bucket int, chunk long"
FOLDERS = ["sample_name", "level", "bucket", "chunk"]


def bucket_of(contig: Column) -> Column:
    return F.pmod(F.xxhash64(contig), F.lit(BUCKETS)).cast("int")


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """Runs cut at multiples of size, with the number of the cell (from 0) that each piece is in."""
    first, last = F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size)
    cells = rows.withColumn("cell", F.explode(F.sequence(first, last)))
    return cells.withColumns({"start": F.greatest("start", F.col("cell") * size + 1), "end": F.least("end", (F.col("cell") + 1) * size)})


def base_level(runs: DataFrame) -> DataFrame:
    """Runs cut at chunk borders, as rows of level 1."""
    value = F.col("value").cast("double")
    rows = _cut(runs.select(*PAIR, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), value.alias("value")).filter("start <= end"), CHUNK)
    n = F.col("end") - F.col("start") + 1
    return rows.select(*PAIR, "start", "end", (F.col("value") * n).alias("total"), n.alias("covered"), F.col("value").alias("peak"), F.lit(1).alias("level"))


def roll_up(below: DataFrame, size: int, runs: bool = False) -> DataFrame:
    """Bins of size from rows of the level below: smaller bins lie inside them; runs (level 1) are cut at their borders."""
    if runs:
        n = F.col("end") - F.col("start") + 1
        each = _cut(below, size).withColumns({"total": F.col("peak") * n, "covered": n})
    else:
        each = below.withColumn("cell", F.floor((F.col("start") - 1) / size))
    sums = each.groupBy(*PAIR, "cell").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"), F.max("peak").alias("peak"))
    return sums.select(*PAIR, (F.col("cell") * size + 1).alias("start"), ((F.col("cell") + 1) * size).alias("end"), "total", "covered", "peak", F.lit(size).alias("level"))


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _write(rows: DataFrame, path: str) -> None:
    placed = rows.withColumns({"bucket": bucket_of(F.col("contig_name")), "chunk": F.floor((F.col("start") - 1) / (F.col("level").cast("long") * CHUNK))})
    # Spark makes tasks of even size, splitting a folder that has very many rows
    together = placed.hint("rebalance", *FOLDERS).sortWithinPartitions(*FOLDERS, "contig_name", "start")
    together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS).parquet(path)


def append_levels(runs: DataFrame, path: str) -> None:
    """Add the runs (pair, start, end, value; no overlaps) of some samples, level by level, each from the one just written."""
    spark, names = runs.sparkSession, runs.select("sample_name").distinct()
    _write(base_level(runs), path)
    for below, size in zip((1, *SIZES), SIZES):
        rows = read_levels(spark, path).filter(F.col("level") == below).join(names, "sample_name", "left_semi")
        _write(roll_up(rows, size, runs=below == 1), path)


def window(spark: SparkSession, path: str, contigs: DataFrame, start: int, end: int, names: list[str] | None = None, samples: list[str] | None = None,
           size: int | None = None, most: int = 10_000, peaks: bool = False) -> DataFrame:
    """pair, start, end, value in a window: base runs, or the bins that touch it, whichever level gives at most `most` rows a
    pair (size asks for one). A bin's value is its mean over its bases inside the contig, or with peaks its largest."""
    size = size or zoom_size(start, end, most, SIZES) or 1
    at = lambda x: (x - 1) // (size * CHUNK)
    rows = read_levels(spark, path).filter((F.col("level") == size) & F.col("chunk").between(at(start), at(end)))
    if names is not None:
        rows = rows.filter(F.col("bucket").isin(*[bucket_of(F.lit(n)) for n in names]) & F.col("contig_name").isin(names))
    if samples is not None:
        rows = rows.filter(F.col("sample_name").isin(samples))
    if size == 1:  # pieces of a run that a chunk's border cuts are one again
        own = region(rows.select(*PAIR, "start", "end", F.col("peak").alias("value")), start, end)
        return rle(own, PAIR, "value").select(*PAIR, "start", "end", "value")
    own = rows.filter((F.col("end") >= start) & (F.col("start") <= end))
    if peaks:
        return own.select(*PAIR, "start", "end", F.col("peak").alias("value"))
    width = F.least(F.lit(size), F.col("contig_length") - F.col("start") + 1)
    return own.join(contigs.select("contig_name", "contig_length"), "contig_name").select(*PAIR, "start", "end", (F.col("total") / width).alias("value"))
