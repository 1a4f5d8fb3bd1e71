"""Interval and run kernels that the signal, repeat and report operators share.

Positions are 1-based and inclusive. Long contigs are cut into chunks, so that no window holds a whole chromosome.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def sweep(intervals: DataFrame, keys: list[str], weights: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Sums of weights over overlapping intervals as runs: keys, start, end and a column for each weight.

    Intervals are cut at chunk borders; each piece adds its weights at its start and takes them off after its end, unless
    that is the chunk's. Events are summed by position first (map-side too), and running sums stay inside a chunk: one pass
    over the input, and no chunk needs another. Runs end at chunk borders; runs where all sums are 0 are left out.
    """
    names = list(weights)
    rows = intervals.filter("start <= end").select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *[w.alias(n) for n, w in weights.items()])
    cut = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("end") / chunk))))
    first, after = F.col("chunk") * chunk, (F.col("chunk") + 1) * chunk
    event = lambda at, sign: F.struct(at.alias("pos"), *[(sign * F.col(n)).alias(n) for n in names])
    events = F.array_compact(F.array(event(F.greatest("start", first), 1), F.when(F.col("end") + 1 < after, event(F.col("end") + 1, -1))))
    points = cut.select(*keys, "chunk", F.explode(events).alias("e")).select(*keys, "chunk", "e.*").groupBy(*keys, "chunk", "pos").agg(*[F.sum(n).alias(n) for n in names])
    inside = Window.partitionBy(*keys, "chunk").orderBy("pos")
    runs = points.select(
        *keys, F.col("pos").alias("start"), (F.coalesce(F.lead("pos").over(inside), after) - 1).alias("end"), *[F.sum(n).over(inside).alias(n) for n in names],
    )
    return runs.filter(reduce(Column.__or__, [F.col(n) != 0 for n in names]))


def rle(runs: DataFrame, keys: list[str], *values: str, chunk: int = CHUNK) -> DataFrame:
    """Join runs that touch and have equal values. Runs are compared inside chunks; a chunk's first run meets the last one
    before it by a table that has a row for each chunk."""
    # runs that start in a chunk, with where their island starts, as far as the chunk knows
    rows = runs.select(*keys, "start", "end", *values).withColumn("chunk", F.floor(F.col("start") / chunk))
    order = Window.partitionBy(*keys, "chunk").orderBy("start")
    equal = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.{v}").eqNullSafe(F.col(f"{b}.{v}") if b else F.col(v)) for v in values])
    own = rows.withColumn("before", F.lag(F.struct("end", *values)).over(order))
    new = F.col("before").isNotNull() & ~(equal("before", "") & (F.col("before.end") + 1 == F.col("start")))
    own = own.withColumn("since", F.max(F.when(new, F.col("start"))).over(order))
    edges = own.groupBy(*keys, "chunk").agg(
        F.min_by(F.struct("start", *values), "start").alias("first"), F.max_by(F.struct("end", *values), "start").alias("last"), F.max("since").alias("since")
    )
    across = Window.partitionBy(*keys).orderBy("chunk")
    edges = edges.withColumn("before", F.lag("last").over(across))
    opens = F.col("before").isNull() | ~(equal("before", "first") & (F.col("before.end") + 1 == F.col("first.start")))
    edges = edges.withColumn("opened", F.when(opens, F.col("first.start")))
    # the island that a chunk's first run belongs to: opened here, or the latest one that an earlier chunk opened
    earlier = F.last(F.coalesce("since", "opened"), ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = edges.select(*keys, "chunk", F.coalesce("opened", earlier).alias("carried"))
    met = own.join(carried, [*keys, "chunk"]).withColumn("island", F.coalesce("since", "carried"))
    return met.groupBy(*keys, "island", *values).agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end", *values)


def interval_union(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals joined where they overlap or touch: the runs that anything covers."""
    covered = sweep(intervals, keys, {"n": F.lit(1)}).withColumn("n", F.lit(True))
    return rle(covered, keys, "n").drop("n")


def islands(points: DataFrame, keys: list[str], pos: str, gap: int) -> DataFrame:
    """points with island, a number for points that follow each other by gap at most."""
    order = Window.partitionBy(*keys).orderBy(pos)
    new = F.coalesce(F.col(pos) - F.lag(pos).over(order) > gap, F.lit(True)).cast("int")
    return points.withColumn("island", new).withColumn("island", F.sum("island").over(order))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, how: str = "inner") -> DataFrame:
    """Pairs of a left and a right interval that overlap; right's interval comes back as r_start and r_end.

    Both sides are dealt to the buckets they touch and joined there by equality. A pair that shares several buckets is kept
    in the first only, so no distinct is needed. Columns other than keys, start and end must differ in name.
    """
    if how != "inner":
        raise ValueError("overlap_join is an inner join; use a left join on its result")
    cells = lambda: F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))
    a = left.filter("start <= end").withColumn("__cell", cells())
    b = right.filter("start <= end").withColumn("__cell", cells()).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    met = a.join(b, [*keys, "__cell"]).filter("start <= r_end and r_start <= end")
    return met.filter(F.floor(F.greatest("start", "r_start") / bucket) == F.col("__cell")).drop("__cell")


def _size(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def nodes_over(start: Column, end: Column, levels: int = 40) -> Column:
    """The fewest aligned blocks of 1, 2, 4, ... positions that make up an interval, as array<struct<level, node>>: at most two
    of each size, so a long interval takes a few dozen."""
    def at(k: Column) -> Column:
        size = _size(k)
        lo, hi = F.floor((start + size - 1) / size), F.floor((end + 1) / size)
        take = lambda when, node: F.when((lo < hi) & when, F.struct(k.alias("level"), node.alias("node")))
        return F.array(take(lo % 2 == 1, lo), take(hi % 2 == 1, hi - 1))

    top = F.least(F.lit(levels), F.floor(F.log2(end - start + 1)).cast("int") + 1)
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), at)))


def best_over(points: DataFrame, intervals: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, pos and best: the largest value of the intervals over each different position of points, where there is one.

    An interval goes to the few blocks that make it up, and each block keeps its largest value; a position looks into the
    blocks that hold it, one of each size that occurs. No pair of a position and an interval is made.
    """
    rows = intervals.filter("start <= end").select(*keys, F.explode(nodes_over(F.col("start").cast("long"), F.col("end").cast("long"))).alias("n"), value.alias("value"))
    blocks = rows.groupBy(*keys, "n.level", "n.node").agg(F.max("value").alias("value"))
    top = F.floor(F.log2(F.max(F.col("end") - F.col("start") + 1))).cast("int")  # no block is larger than the longest interval
    levels = intervals.filter("start <= end").agg(F.coalesce(top, F.lit(0)).alias("top"))
    asked = points.select(*keys, F.col("pos").cast("long").alias("pos")).distinct().crossJoin(levels)  # one row
    asked = asked.withColumn("level", F.explode(F.sequence(F.lit(0), "top"))).withColumn("node", F.floor(F.col("pos") / _size(F.col("level"))))
    return asked.join(blocks, [*keys, "level", "node"]).groupBy(*keys, "pos").agg(F.max("value").alias("best"))


def overlap_length() -> Column:
    """Bases that a pair from overlap_join shares."""
    return F.least("end", "r_end") - F.greatest("start", "r_start") + 1


def weighted_upper_median(runs: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """The element at n // 2 of the sorted values, each taken weight times, from a histogram and not from bases."""
    counts = runs.groupBy(*keys, value).agg(F.sum(weight).alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    all_ = Window.partitionBy(*keys)
    marked = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(all_)})
    return marked.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min(value).alias(out))


def wrap_circular(intervals: DataFrame, length: str = "contig_length", circular: str = "circular", weight: str = "weight") -> DataFrame:
    """Intervals on circular contigs cut at the origin: full laps become one interval with their number as weight, the rest
    goes to the end and on from base 1. Linear ones are clipped to the contig. One that spans the contig exactly is one lap."""
    size, n = F.col("end") - F.col("start") + 1, F.col(length)
    laps = F.floor(size / n)
    first = F.pmod(F.col("start") - 1, n) + 1
    rest = size - laps * n
    part = lambda s, e, w: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), w.cast("long").alias("weight"))
    w = F.col(weight)
    pieces = F.array(
        part(F.lit(1), n, laps * w),
        part(first, F.least(first + rest - 1, n), w),
        part(F.lit(1), first + rest - 1 - n, w),
    )
    linear = F.array(part(F.greatest("start", F.lit(1)), F.least("end", n), w))
    cut = intervals.withColumn("__p", F.explode(F.when(F.col(circular), pieces).otherwise(linear)))
    cut = cut.withColumns({"start": F.col("__p.start"), "end": F.col("__p.end"), weight: F.col("__p.weight")}).drop("__p")
    return cut.filter(f"start <= end and {weight} <> 0")
