"""Which reads, contigs, bins and pairs take part, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .query import PAIRS, expand_contigs
from .signals import PAIR

#: What a row of each family of predicates stands for.
FAMILIES = {
    "mag": "mag", "contig": "contig", "annotation": "annotation", "annotation_qualifier": "annotation", "contig_qualifier": "contig", "sample": "sample",
    "mag_coverage": "mag_pair", "mag_abundance": "mag_pair", "mag_variants": "mag_pair",
    "coverage": "pair", "abundance": "pair", "misassembly": "pair", "microdiversity": "pair", "side_misassembly": "pair", "topology": "pair",
}


def resolve_contigs(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reads on known contigs, under the contig's own name: by name, else by alias, else without a version suffix (".1").
    contigs: contig_name, aliases (an array, or null). A name that several contigs claim goes to the smallest of them."""
    claims = contigs.select("contig_name", F.explode(F.array_union(F.array("contig_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    known = claims.groupBy("alias").agg(F.min(F.struct(F.col("alias") != F.col("contig_name"), "contig_name")).contig_name.alias("resolved"))
    bare = F.regexp_replace("contig_name", r"\.\d+$", "")
    found = reads.select("contig_name").distinct().join(known.withColumnsRenamed({"alias": "contig_name", "resolved": "by_name"}), "contig_name", "left")
    found = found.withColumn("bare", bare).join(known.withColumnsRenamed({"alias": "bare", "resolved": "by_bare"}), "bare", "left")
    names = found.select("contig_name", F.coalesce("by_name", "by_bare").alias("resolved")).filter("resolved is not null")
    return reads.join(names, "contig_name").withColumn("contig_name", F.col("resolved")).select(*reads.columns)


def present_mags(table: DataFrame, mag_coverage: DataFrame, members: DataFrame, aligned: float = 50.0, depth: float = 0.0) -> DataFrame:
    """Rows of pairs without those of contigs whose bin fails a gate in that sample. Contigs are not judged by themselves."""
    failed = mag_coverage.filter((F.col("aligned_fraction") < aligned) | (F.col("coverage_mean") < depth)).select("mag_name", "sample_name")
    dropped = failed.join(members.select("mag_name", "contig_name"), "mag_name").select(*PAIR).distinct()
    return table.join(dropped, PAIR, "left_anti")


def family_pairs(family: str, rows: DataFrame, coverage: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The (contig, sample) pairs that the rows of a family stand for. Contigs, and what lies on them, stand for all samples
    they are in, or for a null sample; samples for all their contigs; bins for their members."""
    kind = FAMILIES[family]
    if kind == "pair":
        return rows.select(*PAIRS)
    if kind == "sample":
        return coverage.join(rows.select("sample_name").distinct(), "sample_name", "left_semi").select(*PAIRS)
    if kind == "mag":
        return expand_contigs(members.join(rows.select("mag_name").distinct(), "mag_name", "left_semi"), coverage)
    if kind == "mag_pair":
        own = members.select("mag_name", "contig_name").join(rows.select("mag_name", "sample_name").distinct(), "mag_name")
        return coverage.join(own.select(*PAIRS), PAIRS, "left_semi").select(*PAIRS)
    return expand_contigs(rows, coverage)


def mag_region(members: DataFrame, start: int, end: int) -> DataFrame:
    """The parts of a bin's window on its contigs, in contig coordinates. members: contig_length and offset."""
    first, last = F.greatest(F.lit(1), F.lit(start) - F.col("offset")), F.least(F.col("contig_length"), F.lit(end) - F.col("offset"))
    return members.select("mag_name", "contig_name", first.alias("start"), last.alias("end")).filter("start <= end")


def order_members(members: DataFrame, metric: DataFrame, column: str, ascending: bool = True, sample: str | None = None) -> DataFrame:
    """Members of each bin with place, their order by a metric of the contig, or of the contig in one sample (0 where it has
    none); ties go by name."""
    if sample is not None:
        metric = metric.filter(F.col("sample_name") == sample)
    rows = members.join(metric.select("contig_name", F.col(column).alias("__by")), "contig_name", "left")
    by = F.coalesce("__by", F.lit(0)) if sample is not None else F.col("__by")
    order = Window.partitionBy("mag_name").orderBy(by.asc_nulls_last() if ascending else by.desc_nulls_last(), "contig_name")
    return rows.withColumn("place", F.row_number().over(order)).drop("__by")


def sort_alignments(reads: DataFrame) -> DataFrame:
    """Reads by contig and position, unmapped ones last, dealt to ranges so that files in order are in order together."""
    keys = [F.col("contig_name").asc_nulls_last(), F.col("pos").asc_nulls_last(), F.col("read_id").asc_nulls_last()]
    return reads.repartitionByRange(*keys).sortWithinPartitions(*keys)


def normalize_segments(segments: Column, start: Column, end: Column, offset: Column) -> Column:
    """Segments in order, moved by an offset; the whole feature where there are none."""
    moved = F.array_sort(F.transform(segments, lambda s: F.struct((s.start + offset).alias("start"), (s.end + offset).alias("end"))))
    return F.when(F.coalesce(F.size(segments), F.lit(0)) > 0, moved).otherwise(F.array(F.struct((start + offset).alias("start"), (end + offset).alias("end"))))


def remove_feature(tables: dict[str, DataFrame], feature: str, built_in: list[str]) -> dict[str, DataFrame]:
    """All tables without the rows of a feature that users added; built-in and unknown ones are refused."""
    if feature in built_in:
        raise ValueError(f"{feature} is built in")
    own = {n: df for n, df in tables.items() if "feature" in df.columns}
    if all(df.filter(F.col("feature") == feature).isEmpty() for df in own.values()):
        raise ValueError(f"{feature} is unknown")
    return {n: df.filter(F.col("feature") != feature) if n in own else df for n, df in tables.items()}
