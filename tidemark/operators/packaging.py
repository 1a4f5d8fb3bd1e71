"""Packaging termini: where clean read ends pile up, and the mechanism that their number and places tell of.

Candidates are a few positions a pair, found before any window; all tables here are by sample, contig and side (kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import circ_dist
from .genome import circular_distance
from .kernels import islands, overlap_join
from .signals import PAIR, depth_at

SIDE = [*PAIR, "kind"]


def terminus_candidates(termini: DataFrame, reduced: DataFrame, kept: DataFrame | None = None, least: int = 10, share: float = 0.1) -> DataFrame:
    """Positions with at least `least` clean ends and at least floor(share * depth of clean reads); kept: pairs to look at."""
    rows = termini if kept is None else termini.join(kept, PAIR, "left_semi")
    return depth_at(rows.filter(F.col("n") >= least), reduced).filter(F.col("n") >= F.floor(F.col("depth") * share))


def peak_areas(candidates: DataFrame, contigs: DataFrame, gap: int = 20) -> DataFrame:
    """Candidates by gap at most from each other as areas: start, end, center (most ends, the first of ties), spc, peaks, tau.

    contigs: contig_name, contig_length, circular. On a circular contig an area at its end and one at its start that are by
    gap at most apart become one, with start above end. tau is the count at the center over its depth.
    """
    rows = islands(candidates, SIDE, "pos", gap)
    best = F.max_by(F.struct("pos", "n", "depth"), F.struct("n", -F.col("pos")))
    areas = rows.groupBy(*SIDE, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), best.alias("top"), F.sum("n").alias("spc"), F.count("*").alias("peaks"))
    all_ = Window.partitionBy(*SIDE)
    areas = areas.join(contigs.select("contig_name", "contig_length", "circular"), "contig_name").withColumns({"lo": F.min("start").over(all_), "hi": F.max("end").over(all_), "areas": F.count("*").over(all_)})
    joins = F.col("circular") & (F.col("areas") > 1) & (F.col("lo") + F.col("contig_length") - F.col("hi") <= gap)
    is_first, is_last = F.col("start") == F.col("lo"), F.col("end") == F.col("hi")
    rows = areas.withColumns({"wraps": joins & (is_first | is_last), "ring": F.when(joins & is_last, F.lit(1).cast("long")).otherwise(F.col("island")), "late": joins & is_last})
    return rows.groupBy(*SIDE, "ring", "contig_length", "circular").agg(
        F.coalesce(F.max(F.when(F.col("late"), F.col("start"))), F.min("start")).alias("start"),
        F.coalesce(F.max(F.when(F.col("wraps") & ~F.col("late"), F.col("end"))), F.max("end")).alias("end"),
        F.max_by("top", F.struct(F.col("top.n"), -F.col("top.pos"))).alias("top"), F.sum("spc").alias("spc"), F.sum("peaks").alias("peaks"),
    ).select(*SIDE, "contig_length", "circular", "start", "end", F.col("top.pos").alias("center"), "spc", "peaks", (F.col("top.n") / F.col("top.depth")).alias("tau"))


def parts(areas: DataFrame, reach: int = 0) -> DataFrame:
    """Areas widened by reach, those over the origin as two intervals; area_start and center tell them apart."""
    lo, hi, n = F.col("start") - reach, F.col("end") + reach, F.col("contig_length")
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    whole = F.array(span(F.greatest(lo, F.lit(1)), F.least(hi, n)))
    over = F.array(span(F.greatest(lo, F.lit(1)), n), span(F.lit(1), F.least(hi, n)))
    edge = F.array(span(F.greatest(lo, F.lit(1)), F.least(hi, n)), span(lo + n, F.when(lo < 1, n).otherwise(F.lit(0))), span(F.lit(1), hi - n))
    pieces = F.when(F.col("start") > F.col("end"), over).when(F.col("circular"), edge).otherwise(whole)
    return areas.select(*SIDE, "center", F.explode(pieces).alias("p")).select(*SIDE, "center", "p.start", "p.end").filter("start <= end")


def log_factorial(k: Column) -> Column:
    """ln k!: a sum up to 100, Stirling's series beyond, where it is exact to a double."""
    k = k.cast("double")
    plain = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(100.0)), F.lit(1.0)).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    series = k * F.log(k) - k + F.log(2 * F.pi() * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)
    return F.when(k < 1, 0.0).when(k <= 100, plain).otherwise(series)


def poisson_tail(mean: Column, observed: Column) -> Column:
    """P(X >= observed) for a Poisson variable, in log space so that large means do not vanish.

    The shorter of the upper tail and the lower sum is added up, over ten standard deviations and 1,000 terms more: what
    lies beyond adds nothing to a double.
    """
    terms = F.sequence(F.lit(1), (F.sqrt(mean) * 10 + 1000).cast("int"))

    def total(first: Column, factor) -> Column:
        step = lambda a, i: F.struct((a.t * factor(i)).alias("t"), (a.s + a.t * factor(i)).alias("s"))
        return F.aggregate(terms, F.struct(first.alias("t"), first.alias("s")), step).s

    mass = lambda k: F.exp(k * F.log(mean) - mean - log_factorial(k))
    upper = total(mass(observed), lambda i: mean / (observed + i))
    lower = total(mass(observed - 1), lambda i: F.greatest(observed - i, F.lit(0)) / mean)
    return F.when(observed <= 0, 1.0).when(observed > mean, F.least(upper, F.lit(1.0))).otherwise(F.greatest(1 - lower, F.lit(0.0)))


def poisson_test(areas: DataFrame, termini: DataFrame, reduced: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Areas with expected, p_value (times the areas of the side) and significant: more ends than the depth of the area lets expect.

    The rate is all ends of the side over all depth of the pair; no ends or no depth: p 1 and passing.
    """
    ends = termini.groupBy(*SIDE).agg(F.sum("n").alias("all_ends"))
    size = F.col("end") - F.col("start") + 1
    depth = reduced.groupBy(*PAIR).agg(F.sum(F.col("value") * size).alias("all_depth"))
    inside = overlap_join(parts(areas), reduced.select(*PAIR, "start", "end", "value"), PAIR, 4096)
    local = inside.groupBy(*SIDE, "center").agg(F.sum(F.col("value") * (F.least("end", "r_end") - F.greatest("start", "r_start") + 1)).alias("area_depth"))
    rows = areas.join(local, [*SIDE, "center"], "left").join(ends, SIDE, "left").join(depth, PAIR, "left").fillna(0, ["area_depth", "all_ends", "all_depth"])
    rows = rows.withColumn("areas", F.count("*").over(Window.partitionBy(*SIDE)))
    unknown = (F.col("all_ends") == 0) | (F.col("all_depth") == 0)
    rows = rows.withColumn("expected", F.when(~unknown, F.col("area_depth") * F.col("all_ends") / F.col("all_depth")))
    p = F.when(unknown, 1.0).when(F.col("expected") <= 0, 1.0).otherwise(F.least(F.lit(1.0), poisson_tail(F.col("expected"), F.col("spc")) * F.col("areas")))
    return rows.withColumn("p_value", p).withColumn("significant", unknown | (F.col("expected") > 0) & (F.col("p_value") <= alpha)).drop("areas", "area_depth", "all_ends", "all_depth")


def area_clippings(areas: DataFrame, clips: DataFrame, depth: DataFrame, reach: int = 20, least: int = 10, share: float = 0.1, length: int = 5) -> DataFrame:
    """Areas with clips: the number of clips of `length` bases or more within reach, at positions with enough of them.

    clips: pair, side, pos, len (one row a clip). Starts meet left clips, ends meet right ones.
    """
    sums = clips.filter(F.col("len") >= length).withColumn("kind", F.when(F.col("side") == "left", "reads_starts").otherwise("reads_ends")).groupBy(*SIDE, "pos").agg(F.count("*").alias("n"))
    strong = depth_at(sums.filter(F.col("n") >= least), depth).filter(F.col("n") >= F.floor(F.col("depth") * share))
    points = strong.select(*SIDE, F.col("pos").alias("start"), F.col("pos").alias("end"), F.col("n").alias("clip_n"))
    met = overlap_join(parts(areas, reach), points, SIDE, 4096).dropDuplicates([*SIDE, "center", "r_start"])
    total = met.groupBy(*SIDE, "center").agg(F.sum("clip_n").alias("clips"))
    return areas.join(total, [*SIDE, "center"], "left").fillna(0, ["clips"])


def clipping_test(areas: DataFrame, ratio: DataFrame) -> DataFrame:
    """Areas with clip_ok: false where clips are more than the pair's clipped ratio lets expect, at z above 1.6448536."""
    rows = areas.join(ratio.select(*PAIR, "clipped_ratio"), PAIR, "left").withColumn("expected_clips", F.coalesce("clipped_ratio", F.lit(0.0)) * F.col("spc"))
    z = (F.col("clips") - F.col("expected_clips")) / F.sqrt("expected_clips")
    return rows.withColumn("clip_ok", (F.col("clips") <= F.col("expected_clips")) | (F.col("expected_clips") > 0) & (z <= 1.6448536)).drop("clipped_ratio")


def area_median_clip(areas: DataFrame, termini: DataFrame) -> DataFrame:
    """Areas with median_clip: the median over their positions of the event lengths there; 0 for none."""
    points = termini.select(*SIDE, F.col("pos").alias("start"), F.col("pos").alias("end"), "event")
    found = overlap_join(parts(areas), points, SIDE, 4096).groupBy(*SIDE, "center").agg(F.percentile("event", F.lit(0.5)).alias("median_clip"))
    return areas.join(found, [*SIDE, "center"], "left").fillna(0.0, ["median_clip"])


def repeat_regions(terminal: DataFrame) -> DataFrame:
    """contig_name and regions: the few terminal repeats of a contig, each with the bounds of both copies, first one first."""
    lo, hi = lambda a, b: F.least(a, b).cast("long"), lambda a, b: F.greatest(a, b).cast("long")
    swapped = lo("p1", "p2") > lo("p1x", "p2x")
    pick = lambda f, own, other: F.when(swapped, f(*other)).otherwise(f(*own))
    own, other = ("p1", "p2"), ("p1x", "p2x")
    region = F.struct(pick(lo, own, other).alias("first_start"), pick(hi, own, other).alias("first_end"), pick(lo, other, own).alias("second_start"), pick(hi, other, own).alias("second_end"), F.col("is_direct").alias("is_direct"))
    return terminal.select("contig_name", region.alias("r")).groupBy("contig_name").agg(F.array_sort(F.collect_set("r")).alias("regions"))


def in_first(r: Column, pos: Column) -> Column:
    return pos.between(r.first_start, r.first_end)


def in_second(r: Column, pos: Column) -> Column:
    return pos.between(r.second_start, r.second_end)


def to_first_copy(regions: Column, pos: Column) -> Column:
    """A position in the second copy of a direct repeat, moved to the first; others as they are."""
    hit = F.get(F.filter(regions, lambda r: r.is_direct & in_second(r, pos)), F.lit(0))
    return F.coalesce(pos - hit.second_start + hit.first_start, pos)


def confirm_dtr_clips(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Clip positions (SIDE, pos) without those in one copy of a direct repeat whose equivalent in the other has no clip.

    Both directions look at the same points, so the order does not matter. Points outside all copies stay.
    """
    rows = points.join(regions, "contig_name", "left")
    pos = F.col("pos")
    direct = F.filter(F.coalesce("regions", F.expr("cast(array() as array<struct<first_start:bigint,first_end:bigint,second_start:bigint,second_end:bigint,is_direct:boolean>>)")), lambda r: r.is_direct & (in_first(r, pos) | in_second(r, pos)))
    rows = rows.withColumn("partner", F.get(F.transform(direct, lambda r: F.when(in_first(r, pos), pos - r.first_start + r.second_start).otherwise(pos - r.second_start + r.first_start)), F.lit(0))).drop("regions")
    free = rows.filter("partner is null")
    paired = rows.filter("partner is not null").join(points.select(*SIDE, F.col("pos").alias("partner")).distinct(), [*SIDE, "partner"], "left_semi")
    return free.unionByName(paired).drop("partner")


def dedupe_dtr_areas(areas: DataFrame, regions: DataFrame, gap: int = 20) -> DataFrame:
    """Areas without those that lie, once moved to the first copy of a direct repeat, by gap at most from one kept earlier.

    The few areas of a side are walked in order of place inside one row. in_repeat: DTR, ITR or null.
    """
    rows = areas.join(regions, "contig_name", "left")
    inside = F.get(F.filter("regions", lambda r: in_first(r, F.col("center")) | in_second(r, F.col("center"))), F.lit(0))
    rows = rows.withColumns({"place": F.coalesce(to_first_copy(F.col("regions"), F.col("center")), F.col("center")), "in_repeat": F.when(inside.is_direct, "DTR").when(~inside.is_direct, "ITR")})
    order = F.array_sort(F.collect_list(F.struct("place", "center")))
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(k.place - x.place) <= gap)
    walk = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    kept = rows.groupBy(*SIDE).agg(order.alias("all")).select(*SIDE, F.explode(walk).alias("k")).select(*SIDE, "k.center")
    return rows.join(kept, [*SIDE, "center"], "left_semi")


def classify_packaging(unique: DataFrame, gap: int = 20) -> DataFrame:
    """The mechanism of each pair with areas, with the distance of its only start and end and the duplication it lies in.

    One start and one end: ITR by the repeat's length if they are by gap at most apart and in different copies of an inverted
    repeat, COS by gap at most apart, else DTR by distance; short to 1,000 bases, long to a tenth of the contig, outlier
    beyond; _3' if the end comes first on the shorter way, else _5', none for blunt ends. One alone: PAC.
    """
    start, end = F.col("kind") == "reads_starts", F.col("kind") == "reads_ends"
    repeat = lambda name: F.coalesce(F.bool_and(F.coalesce(F.col("in_repeat") == name, F.lit(False))), F.lit(False))
    rows = unique.groupBy(*PAIR, "contig_length", "circular").agg(
        F.count_if(start).alias("starts"), F.count_if(end).alias("ends"), F.min(F.when(start, F.col("center"))).alias("a"), F.min(F.when(end, F.col("center"))).alias("b"),
        F.first("regions", ignorenulls=True).alias("regions"), F.when(repeat("DTR"), "DTR").when(repeat("ITR"), "ITR").alias("duplication"),
    )
    a, b, n = F.col("a"), F.col("b"), F.col("contig_length")
    one = (F.col("starts") == 1) & (F.col("ends") == 1)
    rows = rows.withColumn("distance", F.when(one, F.when(F.col("circular"), circ_dist(a, b, n)).otherwise(F.abs(b - a))))
    gone = F.col("distance")
    size = lambda x: F.when(x <= 1000, "short").when(x <= F.floor(n * 0.1), "long").otherwise("outlier")
    side = F.when(F.when(F.col("circular"), F.pmod(b - a, n) != gone).otherwise(b < a), "_3'").otherwise("_5'")
    copy = F.get(F.filter("regions", lambda r: ~r.is_direct & (in_first(r, a) & in_second(r, b) | in_second(r, a) & in_first(r, b))), F.lit(0))
    name = (
        F.when(one & (gone <= gap) & copy.isNotNull(), F.concat(F.lit("ITR_"), size(copy.first_end - copy.first_start + 1), side))
        .when(one & (gone < 2), "COS").when(one & (gone <= gap), F.concat(F.lit("COS"), side)).when(one, F.concat(F.lit("DTR_"), size(gone), side))
        .when(F.col("starts") + F.col("ends") == 1, "PAC").otherwise("Unknown_packaging")
    )
    return rows.withColumn("mechanism", name).drop("regions", "a", "b")


def explicit_mechanisms(areas: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a pair: its mechanism, the centers of its start and end areas in order as comma lists, and all peaks."""
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("center")))), lambda x: x.cast("string")), ",")
    found = areas.groupBy(*PAIR).agg(listed("reads_starts").alias("start_centers"), listed("reads_ends").alias("end_centers"), F.sum("peaks").alias("total_peaks"))
    return pairs.select(*PAIR, "mechanism", "distance", "duplication").join(found, PAIR)


def terminase_distances(areas: DataFrame, genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """By pair, how near the terminus that is nearest to one lies to a terminase gene, in bases and in whole percent of the
    contig. genes: contig_name, start, end of those whose product names a terminase."""
    points = areas.select(*PAIR, F.col("center").alias("pos")).distinct().withColumn("point_id", F.struct(*PAIR, "pos"))
    near = circular_distance(points, genes.select("contig_name", "start", "end"), contigs)
    best = near.groupBy("point_id.sample_name", "point_id.contig_name").agg(F.min("distance").alias("terminase_distance"))
    percent = F.round(F.col("terminase_distance") / F.col("contig_length") * 100).cast("int")
    return best.join(contigs.select("contig_name", "contig_length"), "contig_name").select(*PAIR, "terminase_distance", F.when(F.col("contig_length") > 0, percent).alias("terminase_percentage"))


def termini_view(areas: DataFrame, mechanisms: DataFrame, terminase: DataFrame) -> DataFrame:
    """Every area of the pairs that have a mechanism, with what its pair has: mechanism, duplication and terminase columns."""
    own = mechanisms.select(*PAIR, "mechanism", "duplication").join(terminase, PAIR, "left")
    return areas.join(own, PAIR)
