"""Sequence windows, repeats, annotations and bins (MAGs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..driver import written
from ..functions import sequence as S
from .kernels import CHUNK, best_over, interval_union, overlap_join, sweep


def windows(sequences: DataFrame, size: int) -> DataFrame:
    """contig_name, window (from 0) and seq for each `size` bases; the last may be shorter. sequences: contig_name, seq."""
    return sequences.select("contig_name", F.posexplode(S.pieces(F.col("seq"), size)).alias("window", "seq"))


def gc_windows(sequences: DataFrame, size: int = 500) -> DataFrame:
    return windows(sequences, size).select("contig_name", "window", S.gc_percent(F.col("seq")).alias("gc"))


def skew_windows(sequences: DataFrame, size: int = 1000) -> DataFrame:
    return windows(sequences, size).select("contig_name", "window", S.gc_skew(F.col("seq")).alias("skew"))


def gc_stats(gc: DataFrame, skew: DataFrame) -> DataFrame:
    """Mean and spread of GC, amplitude of the skew and the percent of windows above 0."""
    a = gc.groupBy("contig_name").agg(F.avg("gc").alias("gc_mean"), F.stddev_pop("gc").alias("gc_sd"))
    b = skew.groupBy("contig_name").agg((F.max("skew") - F.min("skew")).alias("skew_amplitude"), (100.0 * F.count_if(F.col("skew") > 0) / F.count("*")).alias("positive_skew_pct"))
    return a.join(b, "contig_name")


def chunked(sequences: DataFrame, size: int = 65_536) -> DataFrame:
    """contig_name, chunk_idx, seq: no row holds a whole chromosome."""
    return windows(sequences, size).withColumnRenamed("window", "chunk_idx")


def nucleotides(chunks: DataFrame, start: int, end: int, size: int = 65_536) -> DataFrame:
    """The bases start to end of each contig from its chunks; only chunks in the window are read."""
    own = chunks.filter(F.col("chunk_idx").between((start - 1) // size, (end - 1) // size))
    first = F.greatest(F.lit(1), F.lit(start) - F.col("chunk_idx") * size)
    last = F.least(F.lit(size), F.lit(end) - F.col("chunk_idx") * size)
    part = F.substring(F.col("seq"), first.cast("int"), (last - first + 1).cast("int"))
    parts = own.groupBy("contig_name").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", part.alias("part")))).alias("p"))
    return parts.select("contig_name", F.array_join(F.transform("p", lambda x: x.part), "").alias("seq"))


def duplication_pct(repeats: DataFrame, contigs: DataFrame) -> DataFrame:
    """Percent of each contig that lies in a copy of some repeat; contigs without repeats have 0. Copies may be given in
    either direction."""
    copy = lambda a, b: F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))
    both = repeats.select("contig_name", F.explode(F.array(copy("p1", "p2"), copy("p1x", "p2x"))).alias("c")).select("contig_name", "c.*")
    bases = interval_union(both, ["contig_name"]).groupBy("contig_name").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    return contigs.join(bases, "contig_name", "left").select("contig_name", (100.0 * F.coalesce("bases", F.lit(0)) / F.col("contig_length")).alias("duplication_pct"))


def repeat_count_runs(repeats: DataFrame) -> DataFrame:
    """Runs of how many first copies, direct and inverted, lie over each base."""
    rows = repeats.select("contig_name", F.least("p1", "p2").alias("start"), F.greatest("p1", "p2").alias("end"), F.col("is_direct").cast("int").alias("d"))
    return sweep(rows, ["contig_name"], {"direct": F.col("d"), "inverted": 1 - F.col("d")})


def repeat_identity_segments(repeats: DataFrame) -> DataFrame:
    """Segments between breakpoints with the best identity over them and where its partner starts; ties go to the smallest."""
    rows = repeats.select("contig_name", F.least("p1", "p2").alias("start"), F.greatest("p1", "p2").alias("end"), "pident", F.least("p1x", "p2x").alias("partner"))
    marks = rows.select("contig_name", F.explode(F.array("start", F.col("end") + 1)).alias("pos")).distinct()
    after = F.lead("pos").over(Window.partitionBy("contig_name").orderBy("pos"))
    segments = marks.select("contig_name", "pos", (after - 1).alias("end")).filter("end is not null")
    # the intervals over a segment's first base are those over all of it
    best = best_over(segments, rows, ["contig_name"], F.struct("pident", (-F.col("partner")).alias("p")))
    return segments.join(best, ["contig_name", "pos"]).select("contig_name", F.col("pos").alias("start"), "end", "best.pident", (-F.col("best.p")).alias("partner"))


def terminal_repeats(repeats: DataFrame, contigs: DataFrame, edge: int = 100, identity: float = 90.0) -> DataFrame:
    """Repeats of which one copy is near the start and the other near the end."""
    rows = repeats.join(contigs.select("contig_name", "contig_length"), "contig_name")
    lo = F.least("p1", "p2", "p1x", "p2x")
    hi = F.greatest("p1", "p2", "p1x", "p2x")
    return rows.filter((lo <= edge) & (hi > F.col("contig_length") - edge) & (F.col("pident") >= identity)).drop("contig_length")


def oriented_hits(hits: DataFrame) -> DataFrame:
    """Hits with the smaller contig first, coordinates swapped along."""
    swap = F.col("contig_1") > F.col("contig_2")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return hits.select(
        pick("contig_1", "contig_2").alias("contig_1"), pick("contig_2", "contig_1").alias("contig_2"), pick("p1", "p1x").alias("p1"), pick("p2", "p2x").alias("p2"),
        pick("p1x", "p1").alias("p1x"), pick("p2x", "p2").alias("p2x"), "pident",
    )


def canonical_hits(hits: DataFrame) -> DataFrame:
    """Oriented hits, each once."""
    return oriented_hits(hits).dropDuplicates(["contig_1", "contig_2", "p1", "p2", "p1x", "p2x"])


def symmetric_hits(hits: DataFrame) -> DataFrame:
    """Hits in both directions."""
    return hits.unionByName(hits.select(F.col("contig_2").alias("contig_1"), F.col("contig_1").alias("contig_2"), F.col("p1x").alias("p1"), F.col("p2x").alias("p2"), F.col("p1").alias("p1x"), F.col("p2").alias("p2x"), "pident"))


def mag_hit_features(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Runs of how many hits to other contigs of its bin lie over each base, with the best identity and the partner that has it
    (the smallest name of several). hits: contig_1, contig_2, p1, p2, p1x, p2x, pident; members: mag_name, contig_name, contig_length."""
    # in a file of its own, so that Spark sees how small it is; the ends that hits lie between are looked up by it before anything is shuffled
    own = written(members.select("mag_name", "contig_name", "contig_length"), "members")
    of = lambda i: own.select("mag_name", F.col("contig_name").alias(f"contig_{i}"), F.col("contig_length").alias(f"n_{i}"))
    inside = oriented_hits(hits).join(of(1), "contig_1").join(of(2), ["mag_name", "contig_2"])
    each = inside.groupBy("mag_name", "contig_1", "contig_2", "p1", "p2", "p1x", "p2x", "n_1", "n_2").agg(F.max("pident").alias("pident"))
    side = lambda a, b, p, q, n: F.struct(F.col(a).alias("contig_name"), F.col(b).alias("partner"), F.greatest(F.least(p, q), F.lit(1)).alias("start"), F.least(F.greatest(p, q), F.col(n)).alias("end"))
    both = each.select("mag_name", "pident", F.explode(F.array(side("contig_1", "contig_2", "p1", "p2", "n_1"), side("contig_2", "contig_1", "p1x", "p2x", "n_2"))).alias("x"))
    both = both.select("mag_name", "pident", "x.*").filter("start <= end")
    # of equal identities the smallest partner counts: names are compared by a rank that falls
    ranks = own.select("mag_name", F.col("contig_name").alias("partner"), (-F.row_number().over(Window.partitionBy("mag_name").orderBy("contig_name"))).alias("rank"))
    # hits at one place are one row from here on
    both = both.join(ranks, ["mag_name", "partner"]).groupBy("contig_name", "start", "end").agg(F.count("*").alias("n"), F.max(F.struct("pident", "rank", "partner")).alias("top"))
    both = written(both, "hit-places")
    counts = sweep(both, ["contig_name"], {"hits": F.col("n")})
    # a run has one number of hits, but hits may end and start at once inside it: cut it where any hit starts or ends
    edges = both.select("contig_name", F.explode(F.array("start", F.col("end") + 1)).alias("pos")).union(counts.select("contig_name", "start")).distinct()
    after = F.lead("pos").over(Window.partitionBy("contig_name").orderBy("pos"))
    pieces = edges.withColumn("end", after - 1).filter("end is not null")
    best = best_over(pieces, both, ["contig_name"], F.col("top"))
    depth = best_over(pieces, counts, ["contig_name"], F.col("hits")).withColumnRenamed("best", "hits")
    rows = pieces.join(best, ["contig_name", "pos"]).join(depth, ["contig_name", "pos"])
    return rows.select("contig_name", F.col("pos").alias("start"), "end", "hits", F.col("best.pident").alias("pident"), F.col("best.partner").alias("partner"))


def mag_offsets(members: DataFrame, order_by: Column | None = None) -> DataFrame:
    """mag_name, contig_name, contig_length, offset: bases before each contig, longest first unless told otherwise."""
    order = Window.partitionBy("mag_name").orderBy(order_by if order_by is not None else F.col("contig_length").desc(), "contig_name")
    before = F.sum("contig_length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return members.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


def mag_attributes(members: DataFrame) -> DataFrame:
    """Length, contigs and N50: the first contig, longest first, at which (total + 1) // 2 bases are reached."""
    order, all_ = Window.partitionBy("mag_name").orderBy(F.col("contig_length").desc(), "contig_name"), Window.partitionBy("mag_name")
    rows = members.withColumns({"upto": F.sum("contig_length").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("contig_length").over(all_)})
    return rows.groupBy("mag_name").agg(
        F.sum("contig_length").alias("mag_length"), F.count("*").alias("n_contigs"),
        F.max(F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), F.col("contig_length"))).alias("n50"),
    )


def weighted_means(values: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """Means by bin weighted with contig length; nulls count neither above nor below."""
    rows = members.join(values, "contig_name", "left")
    mean = lambda c: F.sum(F.col(c) * F.col("contig_length")) / F.sum(F.when(F.col(c).isNotNull(), F.col("contig_length")))
    return rows.groupBy("mag_name").agg(*[mean(c).alias(c) for c in columns])


def to_mag_coords(df: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """Positions shifted by the contig's offset in its bin."""
    rows = df.join(members.select("mag_name", "contig_name", "offset"), "contig_name")
    return rows.withColumns({c: F.col(c) + F.col("offset") for c in columns}).drop("offset")


def covering_latest(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """For each point, of the intervals over it the one that starts last (then the largest id): point_id, id."""
    best = best_over(points, intervals.select(*keys, "start", "end", "id"), keys, F.struct("start", "id"))
    return points.join(best, [*keys, "pos"]).select("point_id", F.col("best.id").alias("id"))


def nearest_distance(points: DataFrame, genes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """point_id and the distance to the closest gene of its contig; 0 inside one. The furthest end of the genes that start
    before a point, and the first start after it, decide. Both are found once for each different position, inside chunks; what
    lies before and after a chunk comes from a table that has a row for each chunk."""
    ends = genes.groupBy("contig_name", F.col("start").cast("long").alias("pos")).agg(F.max(F.col("end").cast("long")).alias("gene_end"))
    asked = points.select("contig_name", F.col("pos").cast("long").alias("pos")).distinct().withColumn("gene_end", F.lit(None).cast("long"))
    marks = asked.unionByName(ends).groupBy("contig_name", "pos").agg(F.max("gene_end").alias("gene_end")).withColumn("chunk", F.floor(F.col("pos") / chunk))
    starts = F.when(F.col("gene_end").isNotNull(), F.col("pos"))
    # a frame that looks back costs a step a row; one that looks ahead would start anew at each row, so those are turned round
    before = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda keys, *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    contig, piece = ["contig_name"], ["contig_name", "chunk"]
    table = marks.groupBy(*piece).agg(F.max("gene_end").alias("e"), F.min(starts).alias("s")).select(
        *piece, F.max("e").over(before(contig, "chunk")).alias("e_before"), F.min("s").over(before(contig, F.col("chunk").desc())).alias("s_after"),
    )
    rows = marks.withColumns({"e": F.max("gene_end").over(upto(piece, "pos")), "s": F.min(starts).over(upto(piece, F.col("pos").desc()))})
    rows = rows.join(table, piece).withColumns({"e": F.greatest("e", "e_before"), "s": F.coalesce("s", "s_after")}).filter("e is not null or s is not null")
    near = rows.select("contig_name", "pos", F.when(F.col("e") >= F.col("pos"), 0).otherwise(F.least(F.col("pos") - F.col("e"), F.col("s") - F.col("pos"))).alias("distance"))
    return points.select("contig_name", F.col("pos").cast("long").alias("pos"), "point_id").join(near, ["contig_name", "pos"]).select("point_id", "distance")


def circular_distance(points: DataFrame, genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """point_id and the distance to the closest gene of its contig. On a circular contig a gene that is d away is length - d
    away the other way round, so the gene that is furthest counts too: it starts last, or ends first."""
    ends = genes.groupBy("contig_name").agg(F.max("start").alias("last_start"), F.min("end").alias("first_end"))
    near = nearest_distance(points, genes)
    rows = points.select("point_id", "contig_name", "pos").join(near, "point_id").join(ends, "contig_name").join(contigs.select("contig_name", "contig_length", "circular"), "contig_name")
    far = F.greatest(F.col("last_start") - F.col("pos"), F.col("pos") - F.col("first_end"))
    around = F.when(F.col("circular") & (F.col("distance") > 0), F.least(F.col("distance"), F.col("contig_length") - far)).otherwise(F.col("distance"))
    return rows.select("point_id", around.alias("distance"))


def interval_stats(genes: DataFrame, runs: DataFrame, keys: list[str], bucket: int = 1000) -> DataFrame:
    """By gene and sample: covered bases, sum and length-weighted mean of a signal. genes: id, keys, start, end."""
    from .kernels import overlap_length

    met = overlap_join(genes.select("id", *keys, "start", "end"), runs, keys, bucket).withColumn("n", overlap_length())
    gene = F.max(F.col("end") - F.col("start") + 1)
    return met.groupBy("id", "sample_name").agg(
        F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)).alias("covered"), F.sum(F.col("n") * F.col("value")).alias("total"),
        (F.sum(F.col("n") * F.col("value")) / gene).alias("mean"),
    )


def annotated_types(annotations: DataFrame) -> DataFrame:
    """Types with their number and rank by it."""
    counts = annotations.groupBy("type").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "type")))


def main_isoform(annotations: DataFrame) -> DataFrame:
    """annotations with main_isoform: the first of each locus (by start, then id); rows without a locus are their own."""
    k = F.row_number().over(Window.partitionBy("contig_name", "type", "locus_tag").orderBy("start", "annotation_id"))
    return annotations.withColumn("main_isoform", F.col("locus_tag").isNull() | (k == 1))


def has_isoforms(annotations: DataFrame) -> DataFrame:
    """By contig, if a locus has several rows of one type."""
    per = annotations.filter("locus_tag is not null").groupBy("contig_name", "type", "locus_tag").agg(F.count("*").alias("n"))
    return per.groupBy("contig_name").agg(F.bool_or(F.col("n") > 1).alias("has_isoforms"))


def gene_names(cds: DataFrame, prefix: str = "tm") -> DataFrame:
    k = F.row_number().over(Window.partitionBy("contig_name").orderBy("start", "annotation_id"))
    return cds.withColumn("gene", F.concat_ws("_", "contig_name", F.lit(prefix), k.cast("string")))


def enrich_annotations(annotations: DataFrame, rows: DataFrame, match_by: list[str], values: list[str], policy: str = "first", prefix: str = "") -> DataFrame:
    """annotations with values from rows that agree on match_by, as columns named prefix + value. Of several values: "first" and
    "force" keep the smallest, "multiple" joins them by ^ in order. Where annotations have the column, "force" replaces what
    they have by what rows have, "multiple" puts it in front, and "first" keeps it. A ^ inside a value becomes _, blanks count
    as missing."""
    clean = lambda c: F.nullif(F.trim(F.replace(F.col(c).cast("string"), F.lit("^"), F.lit("_"))), F.lit(""))
    least = lambda c: F.min(clean(c))
    each = {"first": least, "force": least, "multiple": lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(clean(c))), "^"), F.lit(""))}[policy]
    table = rows.groupBy(*match_by).agg(*[each(c).alias(f"__{c}") for c in values])
    out = annotations.join(table, match_by, "left")
    for c in values:
        new, name = F.col(f"__{c}"), prefix + c
        if name in annotations.columns:
            old = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
            new = {"first": F.coalesce(old, new), "force": F.coalesce(new, old), "multiple": F.nullif(F.concat_ws("^", old, new), F.lit(""))}[policy]
        out = out.withColumn(name, new)
    return out.drop(*[f"__{c}" for c in values])


def cds_annotations(cds: DataFrame, qualifiers: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each CDS with a column for each key; several values are joined by ^."""
    wide = qualifiers.groupBy("annotation_id").pivot("key", keys).agg(F.array_join(F.array_sort(F.collect_list("value")), "^"))
    wide = wide.select("annotation_id", *[F.nullif(F.col(f"`{k}`"), F.lit("")).alias(k) for k in keys])
    return cds.join(wide, "annotation_id", "left")
