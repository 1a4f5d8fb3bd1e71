"""Reads that were mapped on doubled contigs, brought back to the circle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import circ_dist, wrapped_tlen
from .signals import PAIR

GROUP = ["sample_name", "qname"]


def contained_on_circle(start: Column, size: Column, outer_start: Column, outer_size: Column, length: Column) -> Column:
    """If an interval lies inside another one on a circle."""
    return (outer_size >= length) | (F.pmod(start - outer_start, length) + size <= outer_size)


def normalize_circular(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """pos and mate_pos moved below the contig's length; tlen of pairs on one contig is the shortest way, positive for the left read.

    Contigs without a length stay as they are. A mate's position moves by its own contig's length.
    """
    own = contigs.select("contig_name", F.col("contig_length").alias("__n"))
    mate = contigs.select(F.col("contig_name").alias("mate_contig"), F.col("contig_length").alias("__m"))
    rows = reads.join(own, "contig_name", "left").join(mate, "mate_contig", "left")
    moved = lambda pos, n: F.when(F.col(pos) >= F.col(n), F.col(pos) - F.col(n)).otherwise(F.col(pos))
    paired = (F.col("flag").bitwiseAND(1) != 0) & (F.col("flag").bitwiseAND(8) == 0)
    rows = rows.withColumns({"pos": moved("pos", "__n"), "mate_pos": F.when(paired, moved("mate_pos", "__m")).otherwise(F.col("mate_pos"))})
    direct = F.abs(F.col("pos") - F.col("mate_pos"))
    short = F.least(direct, F.col("__n") - direct)
    same = paired & F.col("__n").isNotNull() & (F.col("contig_name") == F.col("mate_contig"))
    return rows.withColumn("tlen", F.when(same, F.when(F.col("pos") <= F.col("mate_pos"), short).otherwise(-short)).otherwise(F.col("tlen"))).drop("__n", "__m").select(*reads.columns)


def drop_ghosts(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Reads without ghosts: other alignments of a name that lie inside one of its primary ones on the circle, and
    supplementary ones at a place of the circle that an earlier one has. Where only ghosts were beside them, primary
    alignments get mapping quality 60. reads: output of prepare(), with read_id in file order (ties by mapq).
    """
    rows = reads.join(contigs.select("contig_name", F.col("contig_length").alias("__n")), "contig_name", "left").withColumn("__size", F.col("end") - F.col("start") + 1)
    keys = [*GROUP, "contig_name"]
    primary = rows.filter("klass = 'primary'").select(*[F.col(c).alias(f"p_{c}") for c in keys], F.col("pos").alias("p_pos"), F.col("__size").alias("p_size"))
    extra = rows.filter("klass in ('secondary', 'supplementary')")
    inside = contained_on_circle(F.col("pos"), F.col("__size"), F.col("p_pos"), F.col("p_size"), F.col("__n"))
    same = [F.col(c) == F.col(f"p_{c}") for c in keys]
    left = extra.join(primary, [*same, inside], "left_anti")  # alignments that share a read_id are judged one by one
    first = F.row_number().over(Window.partitionBy(*GROUP, "contig_name", "klass", F.pmod("pos", "__n")).orderBy("read_id", "mapq"))
    kept = left.withColumn("__k", first).filter("klass = 'secondary' or __n is null or __k = 1").drop("__k")
    marks = extra.groupBy(*GROUP).agg(F.count("*").alias("__had")).join(kept.groupBy(*GROUP).agg(F.count("*").alias("__has")), GROUP, "left")
    only_ghosts = marks.filter("__has is null").select(*GROUP, F.lit(True).alias("__fix"))
    main = rows.filter("klass not in ('secondary', 'supplementary')").join(only_ghosts, GROUP, "left")
    main = main.withColumn("mapq", F.when(F.col("__fix") & (F.col("klass") == "primary"), 60).otherwise(F.col("mapq")))
    return main.select(*reads.columns).unionByName(kept.select(*reads.columns))


def template_lengths(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """By pair of sample and contig, of reads whose mate is on the same contig: their number, the sum of their template lengths (on
    circles, from a read's start forward to its mate's), and the sum of how far apart the two starts are, the shorter way."""
    rows = reads.filter("paired and not mate_unmapped and contig_name = mate_contig").join(contigs.select("contig_name", "contig_length", "circular"), "contig_name")
    at, mate, n = F.col("pos") % F.col("contig_length"), F.col("mate_pos") % F.col("contig_length"), F.col("contig_length")
    apart = F.when(F.col("circular"), circ_dist(at, mate, n)).otherwise(F.abs(F.col("pos") - F.col("mate_pos")))
    return rows.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.sum(wrapped_tlen(F.col("pos"), F.col("mate_pos"), n, F.col("circular"), F.col("tlen"))).alias("template_sum"), F.sum(apart).alias("apart_sum")
    )
