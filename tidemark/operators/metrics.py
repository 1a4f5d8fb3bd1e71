"""Metrics of (contig, sample) pairs, from runs and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from .kernels import weighted_upper_median
from .signals import PAIR


def with_gaps(runs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Runs with value and len, and one row of value 0 for all bases of the contig that no run covers."""
    own = runs.select(*PAIR, "value", (F.col("end") - F.col("start") + 1).alias("len"))
    covered = own.groupBy(*PAIR).agg(F.sum("len").alias("covered"))
    empty = covered.join(contigs.select("contig_name", "contig_length"), "contig_name")
    rest = empty.select(*PAIR, F.lit(0).cast("long").alias("value"), (F.col("contig_length") - F.col("covered")).alias("len")).filter("len > 0")
    return own.unionByName(rest)


def _trimmed(histogram: DataFrame, lo, hi) -> DataFrame:
    """Mean of the sorted bases lo (counted from 0) to hi (not included) of each key, from depth counts with n, upto and all."""
    inside = F.greatest(F.lit(0), F.least("upto", hi) - F.greatest(F.col("upto") - F.col("n"), lo))
    return histogram.groupBy(*PAIR).agg((F.sum(inside * F.col("value")) / F.sum(inside)).alias("coverage_trimmed"))


def _depth_metrics(bases: DataFrame, steps: DataFrame, last, parts) -> DataFrame:
    """Measures of bases (pair, value, len). steps: pair, steps, parts; last: end of the trimmed bases by `all`; parts: what
    the number of bases is lessened by for the roughness."""
    sums = bases.groupBy(*PAIR).agg(
        F.sum("len").alias("n"), F.sum(F.when(F.col("value") > 0, F.col("len")).otherwise(0)).alias("covered"),
        F.sum(F.col("value") * F.col("len")).alias("s1"), F.sum(F.col("value") * F.col("value") * F.col("len")).alias("s2"),
    )
    order, all_ = Window.partitionBy(*PAIR).orderBy("value"), Window.partitionBy(*PAIR)
    histogram = bases.groupBy(*PAIR, "value").agg(F.sum("len").alias("n")).withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(all_)})
    trimmed = _trimmed(histogram, F.floor(F.col("all") * 0.05), last)
    median = weighted_upper_median(bases, PAIR, "value", "len", "coverage_median")
    out = sums.join(median, PAIR).join(trimmed, PAIR).join(steps, PAIR)
    mean = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean))
    return out.select(
        *PAIR, F.col("n").alias("contig_length"), (100.0 * F.col("covered") / F.col("n")).alias("aligned_fraction"),
        (100 * (1 - F.exp(-0.883 * mean))).alias("expected_fraction"), mean.alias("coverage_mean"), "coverage_median", "coverage_trimmed",
        F.when(mean > 0, spread / mean).otherwise(0.0).alias("coverage_cv"),
        F.when((mean > 0) & (F.col("n") > parts), F.sqrt(F.col("steps") / (F.col("n") - parts)) / mean).otherwise(0.0).alias("coverage_roughness"),
    )


def coverage_metrics(runs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Aligned and expected percent, mean, upper median, 5 % trimmed mean, variation and roughness of the depth, all
    weighted by run length; bases without a run count as 0. contigs: contig_name, contig_length."""
    return _depth_metrics(with_gaps(runs, contigs), roughness_sum(runs, contigs), F.col("all") - F.floor(F.col("all") * 0.05), F.lit(1))


def mag_coverage(runs: DataFrame, members: DataFrame) -> DataFrame:
    """The same of whole bins: all bases of all members, those without reads too. Steps from one contig to the next are not
    counted in the roughness. members: mag_name, contig_name, contig_length."""
    own = members.select("mag_name", "contig_name", "contig_length")
    whole = own.groupBy("mag_name").agg(F.sum("contig_length").alias("contig_length")).withColumnRenamed("mag_name", "contig_name")
    moved = runs.join(own.select("mag_name", "contig_name"), "contig_name").drop("contig_name").withColumnRenamed("mag_name", "contig_name")
    steps = roughness_sum(runs, own).join(own.select("mag_name", "contig_name"), "contig_name").groupBy("sample_name", F.col("mag_name").alias("contig_name")).agg(F.sum("steps").alias("steps"), F.count("*").alias("parts"))
    out = _depth_metrics(with_gaps(moved, whole), steps, F.ceil(F.col("all") * 0.95), F.col("parts"))
    return out.withColumnsRenamed({"contig_name": "mag_name", "contig_length": "mag_length"})


def roughness_sum(runs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sum of squared differences of neighbouring bases. They differ at run edges only: a run adds its value at its first base
    and takes it off after its last one, and what is left at a base is its difference from the one before."""
    edge = lambda pos, value: F.struct(pos.cast("long").alias("pos"), value.alias("d"))
    edges = runs.select(*PAIR, F.explode(F.array(edge(F.col("start"), F.col("value")), edge(F.col("end") + 1, -F.col("value")))).alias("e"))
    steps = edges.groupBy(*PAIR, "e.pos").agg(F.sum("e.d").alias("d")).join(contigs.select("contig_name", "contig_length"), "contig_name")
    inside = F.col("pos").between(2, F.col("contig_length"))
    return steps.groupBy(*PAIR).agg(F.sum(F.when(inside, F.col("d") * F.col("d")).otherwise(0)).alias("steps"))


def present_pairs(coverage: DataFrame, aligned: float = 50.0, depth: float = 0.0) -> DataFrame:
    """Pairs that pass both gates; every other table is joined to these by left_semi."""
    return coverage.filter((F.col("aligned_fraction") >= aligned) & (F.col("coverage_mean") >= depth)).select(*PAIR)


def read_counts(reads: DataFrame) -> DataFrame:
    return reads.filter("klass = 'primary'").groupBy(*PAIR).agg(F.count("*").alias("read_count"))


def rpkm_tpm(counts: DataFrame, contigs: DataFrame, samples: DataFrame) -> DataFrame:
    """RPKM = reads * 1e9 / (length * mapped reads of the sample); TPM = its share in the sample * 1e6; 0 where undefined."""
    rows = counts.join(contigs.select("contig_name", "contig_length"), "contig_name").join(samples.select("sample_name", "n_mapped"), "sample_name")
    below = F.col("contig_length") * F.col("n_mapped")
    rows = rows.withColumn("rpkm", F.when(below > 0, F.col("read_count") * 1e9 / below).otherwise(0.0))
    total = F.sum("rpkm").over(Window.partitionBy("sample_name"))
    return rows.withColumn("tpm", F.when(total > 0, F.col("rpkm") / total * 1e6).otherwise(0.0)).select(*PAIR, "read_count", "rpkm", "tpm")


def sample_totals(reads: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """By sample: mapped primary reads (on kept contigs), and those with the unmapped ones."""
    rows = reads if kept is None else reads.join(kept.select(*PAIR), PAIR, "left_semi").unionByName(reads.filter("klass = 'unmapped'"))
    return rows.groupBy("sample_name").agg(
        F.count_if(F.col("klass") == "primary").alias("n_mapped"), F.count_if(F.col("klass").isin("primary", "unmapped")).alias("n_reads")
    )


def sequencing_type(reads: DataFrame, first: int = 100) -> DataFrame:
    """By sample, from its first mapped reads: long if one is above 1000 bases, paired-short if one is paired, else single-short;
    the first read that decides counts."""
    own = reads.filter("klass <> 'unmapped'").select("sample_name", "read_id", F.when(F.col("qlen") > 1000, "long").when(F.col("paired"), "paired-short").alias("says"))
    rows = own.withColumn("k", F.row_number().over(Window.partitionBy("sample_name").orderBy("read_id"))).filter(F.col("k") <= first)
    return rows.groupBy("sample_name").agg(F.coalesce(F.min_by("says", F.when(F.col("says").isNotNull(), F.col("k"))), F.lit("single-short")).alias("sequencing_type"))


def missing_md_samples(reads: DataFrame, first: int = 10) -> DataFrame:
    """Samples whose first primary reads all lack MD."""
    rows = reads.filter("klass = 'primary'").withColumn("k", F.row_number().over(Window.partitionBy("sample_name").orderBy("read_id"))).filter(F.col("k") <= first)
    return rows.groupBy("sample_name").agg(F.bool_and(F.coalesce(F.col("md"), F.lit("")) == "").alias("none")).filter("none").select("sample_name")


def sample_counts(coverage: DataFrame, by: str) -> DataFrame:
    return coverage.groupBy(by).agg(F.count_distinct("sample_name").alias("n_samples"))


def variant_burden(positions: DataFrame, threshold: float) -> DataFrame:
    """Positions (kind, pos, prevalence, median_len) at or above the threshold: their numbers by kind, and the bases they
    stand for (1 for a mismatch, else the median length)."""
    rows = positions.filter(F.col("prevalence") >= threshold)
    kinds = ("mismatch", "deletion", "insertion", "clipping")
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds]
    bases = F.sum(F.when(F.col("kind") == "mismatch", 1).otherwise(F.col("median_len")))
    return rows.groupBy(*PAIR).agg(*counts, bases.cast("long").alias("bases"))


def per_100kbp(metrics: DataFrame, contigs: DataFrame, columns: list[str]) -> DataFrame:
    rows = metrics.join(contigs.select("contig_name", "contig_length"), "contig_name")
    return rows.select(*PAIR, *[(F.col(c) * 100_000.0 / F.col("contig_length")).alias(f"{c}_per_100kbp") for c in columns])


def paired_clip_span(clips: DataFrame, threshold: float) -> DataFrame:
    """By pair: the distances of neighbouring clip events right then left, both at or above the threshold."""
    order = Window.partitionBy(*PAIR).orderBy("pos", F.when(F.col("side") == "right", 0).otherwise(1))
    rows = clips.withColumns({"next_side": F.lead("side").over(order), "next_pos": F.lead("pos").over(order), "next_prevalence": F.lead("prevalence").over(order)})
    both = rows.filter((F.col("side") == "right") & (F.col("next_side") == "left") & (F.col("prevalence") >= threshold) & (F.col("next_prevalence") >= threshold))
    return both.groupBy(*PAIR).agg(F.sum(F.col("next_pos") - F.col("pos")).cast("long").alias("span"))


def side_misassembly(clips: DataFrame, contigs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """By pair: the strongest left clip that reaches out of the contig's start, and the right one at its end, with how far from
    the end it is (expansion) and how long (collapse); ties go to the largest position. clips: median_len, prevalence."""
    rows = clips.filter(F.col("prevalence") >= threshold).join(contigs.select("contig_name", "contig_length"), "contig_name")
    left = (F.col("side") == "left") & (F.col("median_len") > F.col("pos") - 1)
    right = (F.col("side") == "right") & (F.col("median_len") > F.col("contig_length") - F.col("pos"))
    best = lambda cond: F.max(F.when(cond, F.struct("prevalence", "pos", "median_len")))
    out = rows.groupBy(*PAIR, "contig_length").agg(best(left).alias("l"), best(right).alias("r")).filter("l is not null or r is not null")
    return out.select(
        *PAIR, F.col("l.pos").alias("left_pos"), F.col("l.prevalence").alias("left_prevalence"), F.col("l.median_len").alias("start_collapse_bp"), (F.col("l.pos") - 1).alias("start_expansion_bp"),
        F.col("r.pos").alias("right_pos"), F.col("r.prevalence").alias("right_prevalence"), F.col("r.median_len").alias("end_collapse_bp"), (F.col("contig_length") - F.col("r.pos")).alias("end_expansion_bp"),
    )


def edge_depth(runs: DataFrame, contigs: DataFrame) -> DataFrame:
    """By pair with depth: the depth of the contig's first and last base."""
    rows = runs.join(contigs.select("contig_name", "contig_length"), "contig_name")
    over = lambda at: F.max(F.when((F.col("start") <= at) & (F.col("end") >= at), F.col("value")))
    return rows.groupBy(*PAIR).agg(F.coalesce(over(F.lit(1)), F.lit(0)).alias("first_depth"), F.coalesce(over(F.col("contig_length")), F.lit(0)).alias("last_depth"))


def contig_ends(reads: DataFrame, contigs: DataFrame, circular: bool = False, overlap: int = 20, window: int = 1000) -> DataFrame:
    """By pair, what the primary reads near the contig's ends tell: mates on another contig, unmapped mates that would lie
    beyond an end, pairs (counted at their first read) that join the ends, and how the sizes of these differ from those of
    proper pairs. On circular contigs, also reads over the origin. Linear contigs: only pairs that don't face each other
    join the ends, over what their template leaves of the contig."""
    rows = reads.filter("klass = 'primary'").join(contigs.select("contig_name", "contig_length"), "contig_name")
    n, pos, mate, tlen = F.col("contig_length"), F.col("pos"), F.col("mate_pos"), F.abs("tlen")
    right_from = F.greatest(n - window, F.lit(0))
    left, right = pos < window, pos >= right_from
    paired, same, mate_mapped = F.col("paired"), F.col("contig_name") == F.col("mate_contig"), ~F.col("mate_unmapped")
    proper = paired & C.proper_pair(F.col("contig_name"), F.col("mate_contig"), F.col("reverse"), F.col("mate_reverse"), tlen)
    facing_away = paired & same & mate_mapped & ~proper
    joins = paired & F.col("first") & (left & (mate >= right_from) | right & (mate < window)) & ((C.has_flag(2) | same & mate_mapped) if circular else facing_away)
    size = tlen if circular else F.abs(n - tlen)
    past = (F.col("end") > n) & (F.col("start") <= n) if circular else F.lit(False)
    shorter = F.least(F.col("end") - n, n - pos)
    return rows.groupBy(*PAIR).agg(
        F.count_if(paired & (left | right) & ~same & mate_mapped).alias("misjoint_mates"),
        F.count_if(paired & ~mate_mapped & (right & ~F.col("reverse") | left & F.col("reverse"))).alias("unmapped_mates"),
        F.count_if(past).alias("past_reads"), F.coalesce(F.max(F.when(past, shorter)) >= overlap, F.lit(False)).alias("confirmed"),
        F.floor(F.percentile(F.when(past, shorter), 0.5)).alias("median_overlap"), F.count_if(joins).alias("circularising_inserts"),
        F.round(F.percentile(F.when(joins, size), 0.5) - F.percentile(F.when(proper & F.col("first"), tlen), 0.5)).cast("long").alias("insert_size_deviation"),
    )


def topology(ends: DataFrame, edges: DataFrame, circular: bool) -> DataFrame:
    """By pair: reads over the origin, if one has enough bases on both sides, their percent of the depth there, the median of
    their shorter side, and pairs that join the ends. ends: contig_ends(), edges: edge_depth(). Without confirmation, counts
    are 0 on circular contigs and null on linear ones."""
    rows = ends.join(edges, PAIR, "left")
    sure, none = F.col("confirmed") & (F.col("past_reads") > 0), F.lit(0 if circular else None).cast("long")
    depth = (F.coalesce("first_depth", F.lit(0)) + F.coalesce("last_depth", F.lit(0))) / 2
    return rows.select(
        *PAIR, F.when(sure, F.col("past_reads")).otherwise(none).alias("circularising_reads"),
        F.when(sure & (depth > 0), F.round(100 * F.col("past_reads") / depth).cast("long")).otherwise(none).alias("circularising_prevalence"),
        F.when(sure, F.col("median_overlap")).alias("median_overlap"), F.when(F.col("circularising_inserts") > 0, F.col("circularising_inserts")).alias("circularising_inserts"), "insert_size_deviation",
    )


def _only_pairs(df: DataFrame, coverage: DataFrame, samples: DataFrame, counts: dict[str, str]) -> DataFrame:
    """df with counts of mates by their new names, and each of them per 1000 of the mean depth; null but for paired samples."""
    rows = df.join(samples.select("sample_name", "sequencing_type"), "sample_name").join(coverage.select(*PAIR, "coverage_mean"), PAIR, "left")
    is_paired, mean = F.col("sequencing_type") == "paired-short", F.col("coverage_mean")
    out = {}
    for name, raw in counts.items():
        number = F.coalesce(F.col(raw), F.lit(0))
        out[name] = F.when(is_paired, number)
        out[f"normalized_{name}"] = F.when(is_paired, F.when(mean > 0, number * 1000.0 / mean).otherwise(0.0))
    return rows.withColumns(out).drop("sequencing_type", "coverage_mean")


def explicit_side(side: DataFrame, ends: DataFrame, edges: DataFrame, coverage: DataFrame, samples: DataFrame) -> DataFrame:
    """The view of side_misassembly: nothing is null but what single reads can't tell."""
    rows = side.join(ends.select(*PAIR, "misjoint_mates"), PAIR, "full").join(edges, PAIR, "left")
    zero = [c for c in ("left_prevalence", "start_collapse_bp", "start_expansion_bp", "right_prevalence", "end_collapse_bp", "end_expansion_bp", "first_depth", "last_depth")]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).drop("left_pos", "right_pos")
    return _only_pairs(rows, coverage, samples, {"end_misjoint_mates": "misjoint_mates"}).drop("misjoint_mates")


def explicit_topology(top: DataFrame, coverage: DataFrame, samples: DataFrame) -> DataFrame:
    """The view of topology: pairs are null where the sample has none, and given per 1000 of the mean depth too."""
    rows = _only_pairs(top.withColumnRenamed("circularising_inserts", "__n"), coverage, samples, {"circularising_inserts": "__n"}).drop("__n")
    return rows.withColumn("insert_size_deviation", F.when(F.col("circularising_inserts").isNotNull(), F.coalesce("insert_size_deviation", F.lit(0))))


def filter_reads(reads: DataFrame, identity: float, aligned: float) -> DataFrame:
    """Reads with (length - edits) and (length - soft-clipped) of at least these percents of their length."""
    clipped = C.span(F.col("ops"), "S")
    return reads.filter(((F.col("qlen") - F.col("nm")) * 100 >= identity * F.col("qlen")) & ((F.col("qlen") - clipped) * 100 >= aligned * F.col("qlen")))


def filter_report(reads: DataFrame, identity: float, aligned: float) -> DataFrame:
    """By sample, how many reads each filter leaves out."""
    clipped = C.span(F.col("ops"), "S")
    low = (F.col("qlen") - F.col("nm")) * 100 < identity * F.col("qlen")
    short = (F.col("qlen") - clipped) * 100 < aligned * F.col("qlen")
    return reads.groupBy("sample_name").agg(F.count("*").alias("n"), F.count_if(low).alias("low_identity"), F.count_if(short).alias("low_aligned"), F.count_if(low | short).alias("excluded"))
