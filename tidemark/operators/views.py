"""What a viewer asks for: windows of signals, genes and bins as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rule_color
from .genome import to_mag_coords
from .query import region, zoom_dense, zoom_size
from .signals import PAIR


def stitch_mag(runs: DataFrame, members: DataFrame) -> DataFrame:
    """Runs of a bin's contigs in the bin's coordinates; a contig without runs in a sample is one run of 0.

    members: mag_name, contig_name, contig_length, offset. runs: pair, start, end, value.
    """
    moved = to_mag_coords(runs.select(*PAIR, "start", "end", "value"), members, "start", "end")
    seen = moved.select("mag_name", "sample_name").distinct().join(members, "mag_name")
    absent = seen.join(runs.select(*PAIR).distinct(), PAIR, "left_anti")
    zeros = absent.select("mag_name", *PAIR, (F.col("offset") + 1).alias("start"), (F.col("offset") + F.col("contig_length")).alias("end"), F.lit(0).cast(dict(runs.dtypes)["value"]).alias("value"))
    return moved.select(*zeros.columns).unionByName(zeros)


def all_samples(runs: DataFrame, contig: str) -> DataFrame:
    """One contig's runs in all samples with the value range of each sample, 0 included."""
    own = runs.filter(F.col("contig_name") == contig)
    span = own.groupBy("sample_name").agg(F.least(F.min("value"), F.lit(0)).alias("low"), F.greatest(F.max("value"), F.lit(0)).alias("high"))
    return own.join(span, "sample_name")


def inspect(signals: dict[str, DataFrame], contigs: DataFrame, names: list[str] | None, samples: list[str] | None, start: int, end: int, zoom: int | None = None) -> DataFrame:
    """Runs of several features in a window, for some contigs and samples or all: feature, pair, start, end, value.

    zoom: bin size, 0 for none; by default bases up to 10,000 of them, else the smallest bins that give as few.
    """
    size = zoom_size(start, end) if zoom is None else (zoom or None)
    out = None
    for feature, runs in signals.items():
        own = runs if names is None else runs.filter(F.col("contig_name").isin(names))
        own = own if samples is None else own.filter(F.col("sample_name").isin(samples))
        if size:  # whole bins, also those that the window cuts
            bins = zoom_dense(region(own, (start - 1) // size * size + 1, ((end - 1) // size + 1) * size), PAIR, contigs, size)
            own = bins.select(*PAIR, (F.col("bin") * size + 1).alias("start"), ((F.col("bin") + 1) * size).alias("end"), "value")
        else:
            own = region(own, start, end)
        own = own.select(F.lit(feature).alias("feature"), *PAIR, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("double").alias("value"))
        out = own if out is None else out.unionByName(own)
    return out


def visible_members(members: DataFrame, start: int, end: int) -> DataFrame:
    """Parts of a bin's contigs inside a window of it: seen_start, seen_end in the bin, is_cut if the window ends them."""
    lo, hi = F.col("offset") + 1, F.col("offset") + F.col("contig_length")
    rows = members.filter((hi >= start) & (lo <= end))
    return rows.withColumns({"seen_start": F.greatest(lo, F.lit(start)), "seen_end": F.least(hi, F.lit(end)), "is_cut": (lo < start) | (hi > end)})


def pivoted(qualifiers: DataFrame) -> DataFrame:
    """annotation_id with a map of its qualifiers; several values of a key are joined by ^ in order."""
    joined = qualifiers.groupBy("annotation_id", "key").agg(F.array_join(F.array_sort(F.collect_list("value")), "^").alias("value"))
    return joined.groupBy("annotation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("qualifiers"))


def gene_map(annotations: DataFrame, qualifiers: DataFrame, start: int, end: int, rules: list[dict], types: list[str] | None = None, main_only: bool = False) -> DataFrame:
    """Annotations that overlap a window with their qualifiers and the colour of the first rule that fits; of some types, or main
    isoforms only, if asked."""
    own = annotations.filter((F.col("end") >= start) & (F.col("start") <= end))
    if types is not None:
        own = own.filter(F.col("type").isin(types))
    if main_only:
        own = own.filter("main_isoform")
    rows = own.join(pivoted(qualifiers.join(own.select("annotation_id"), "annotation_id", "left_semi")), "annotation_id", "left")
    return rows.withColumn("color", rule_color(F.col("qualifiers"), rules))


def translations(cds: DataFrame, proteins: DataFrame, start: int, end: int) -> DataFrame:
    """Proteins of the coding regions that overlap a window."""
    return cds.filter((F.col("end") >= start) & (F.col("start") <= end)).join(proteins, "annotation_id")


def mag_dots(annotations: DataFrame, qualifiers: DataFrame, members: DataFrame, rules: list[dict], most: int | None = None) -> DataFrame:
    """Midpoints, in the bin, of annotations that a rule fits, with its colour; the first rule wins. most: only so many of each
    bin, in order of place and id."""
    rows = annotations.join(pivoted(qualifiers), "annotation_id").withColumn("color", rule_color(F.col("qualifiers"), rules)).filter("color is not null")
    dots = to_mag_coords(rows.withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2)), members, "mid").select("mag_name", "annotation_id", "mid", "color")
    if most is None:
        return dots
    order = Window.partitionBy("mag_name").orderBy("mid", "annotation_id")
    return dots.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= most).drop("__k")


def summary_report(contigs: DataFrame, metrics: dict[str, DataFrame], members: DataFrame, contig: str) -> dict[str, DataFrame]:
    """The tables of a contig's report: itself, each metric by sample, the bin that holds it and the bin's members."""
    here = F.col("contig_name") == contig
    mags = members.filter(here).select("mag_name").distinct()
    return {"subject": contigs.filter(here), **{n: m.filter(here).orderBy("sample_name") for n, m in metrics.items()}, "mag": mags, "members": members.join(mags, "mag_name", "left_semi").orderBy("offset")}
