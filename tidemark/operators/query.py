"""Filter expressions, set folds, orderings, profiles, views and matrices over metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_eq

PAIRS = ["contig_name", "sample_name"]


def predicate(col: Column, kind: str, op: str, value) -> Column | None:
    """The condition of one filter row, or None where a number can't be read (such a row is skipped).
    kind: number, text, tokens (values joined by ^) or bool."""
    if kind == "bool":
        wanted = str(value).lower() in ("yes", "true", "1")
        return (col == wanted) if op == "=" else (col != wanted)
    if kind == "number":
        try:
            x = float(value)
        except (TypeError, ValueError):
            return None
        return {"=": col == x, "!=": col != x, ">": col > x, "<": col < x}[op]
    if op == "has":
        return F.contains(col, F.lit(str(value)))
    if op == "has not":
        return ~F.contains(col, F.lit(str(value)))
    same = token_eq(col, str(value)) if kind == "tokens" else col == str(value)
    return same if op == "=" else ~same


def combine(parts: list[DataFrame | None], connectors: list[str]) -> DataFrame:
    """AND is intersect, OR is union without repeats, strictly left to right. connectors[i] stands before parts[i + 1]; a
    skipped part (None) takes no part, and the connector before the next one counts."""
    out = None
    for i, part in enumerate(parts):
        if part is None:
            continue
        out = part.distinct() if out is None else out.intersect(part) if connectors[i - 1] == "AND" else out.union(part).distinct()
    if out is None:
        raise ValueError("every predicate was skipped")
    return out


def filter_pairs(sections: list[tuple[list[DataFrame | None], list[str]]], connectors: list[str]) -> DataFrame:
    """Sections of predicates, each folded by its own connectors, folded in turn."""
    return combine([combine(parts, own) for parts, own in sections], connectors)


def expand_contigs(contigs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Contigs that match, with all samples they are in; without any, the sample is null."""
    return contigs.select("contig_name").distinct().join(coverage.select(*PAIRS).distinct(), "contig_name", "left").select(*PAIRS)


def filter_counts(pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Pairs, contigs and samples, and (bin, sample) pairs where membership is given, in one row."""
    base = pairs.agg(F.count("*").alias("n_pairs"), F.count_distinct("contig_name").alias("n_contigs"), F.count_distinct("sample_name").alias("n_samples"))
    if members is None:
        return base
    bins = pairs.join(members.select("contig_name", "mag_name"), "contig_name").agg(F.count_distinct("mag_name", "sample_name").alias("n_mag_samples"))
    return base.crossJoin(bins)  # one row each


def search_names(names: DataFrame, column: str, text: str, pinned: str | None = None, limit: int = 100) -> DataFrame:
    """Names that hold the text, in any case; the pinned one first."""
    hit, first = F.col(column).ilike(f"%{text}%"), []
    if pinned is not None:
        hit, first = hit | (F.col(column) == pinned), [(F.col(column) == pinned).desc()]
    return names.filter(hit).select(column).distinct().orderBy(*first, column).limit(limit)


def order_samples(samples: DataFrame, metric: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Samples by a metric, those without a value last, then by name."""
    rows = samples.select("sample_name").join(metric.select("sample_name", column), "sample_name", "left")
    c = F.col(column)
    return rows.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "sample_name")


def top_samples(samples: DataFrame, metric: DataFrame, column: str, n: int, ascending: bool = True) -> DataFrame:
    return order_samples(samples, metric, column, ascending).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 50, log: bool = False) -> DataFrame:
    """Equal bins between the least and the largest value, as many as values at most; the last bin is closed. A constant
    column is one bin of half a unit to each side. log: bins of log10, of values above 0."""
    x = F.log10(F.col(column)) if log else F.col(column).cast("double")
    rows = df.filter(F.col(column) > 0 if log else F.col(column).isNotNull()).select(x.alias("x"))
    s = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.least(F.lit(bins), F.count("*")).alias("n"))
    flat = F.col("lo") == F.col("hi")
    s = s.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), F.when(flat, 1).otherwise(F.col("n")).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.col("n")
    placed = rows.crossJoin(F.broadcast(s)).select(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("n") - 1).alias("bin"))  # s is one row
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def null_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n_values"), F.count("*").alias("n_rows"))


def column_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, kind (number, text or bool) of all columns; from schemas, without a scan."""
    kind = lambda t: "bool" if t == "boolean" else "number" if t.split("(")[0] in ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal") else "text"
    rows = [(name, c, kind(t)) for name, df in tables.items() for c, t in df.dtypes]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, column_name string, kind string")


def metric_matrix(metric: DataFrame, entities: DataFrame, entity: str, value: str, samples: list[str]) -> DataFrame:
    """entities x samples; missing is 0. The list of samples makes one pass of the pivot."""
    wide = metric.groupBy(entity).pivot("sample_name", samples).agg(F.first(value))
    rows = entities.select(entity).distinct().join(wide, entity, "left")
    return rows.select(entity, *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in samples])


def dense_grid(metric: DataFrame, entities: DataFrame, samples: DataFrame, entity: str, value: str) -> DataFrame:
    """The long form of the matrix: every entity with every sample. Both sides are name lists, and the output is their product."""
    grid = entities.select(entity).distinct().crossJoin(samples.select("sample_name").distinct())
    return grid.join(metric.select(entity, "sample_name", value), [entity, "sample_name"], "left").select(entity, "sample_name", F.coalesce(value, F.lit(0)).alias(value))


def zoom_dense(runs: DataFrame, keys: list[str], contigs: DataFrame, size: int) -> DataFrame:
    """Mean of a signal in bins of `size` bases; the last bin is divided by its own length."""
    cells = runs.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("end") - 1) / size))))
    n = F.least(F.col("end"), (F.col("bin") + 1) * size) - F.greatest(F.col("start"), F.col("bin") * size + 1) + 1
    sums = cells.groupBy(*keys, "bin").agg(F.sum(F.col("value") * n).alias("total"))
    width = F.least(F.lit(size), F.col("contig_length") - F.col("bin") * size)
    return sums.join(contigs.select("contig_name", "contig_length"), "contig_name").select(*keys, "bin", (F.col("total") / width).alias("value"))


def zoom_sparse(events: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Largest value in bins of `size` bases; bins without events are absent."""
    return events.groupBy(*keys, F.floor((F.col("pos") - 1) / size).alias("bin")).agg(F.max("value").alias("value"))


def zoom_size(start: int, end: int, most: int = 10_000, levels: tuple[int, ...] = (100, 1_000, 10_000)) -> int | None:
    """None: base runs are few enough; else the smallest bin with at most `most` bins in the window."""
    width = end - start + 1
    return None if width <= most else next((s for s in levels if width / s <= most), levels[-1])


def region(runs: DataFrame, start: int, end: int) -> DataFrame:
    """Runs that touch the window, cut to it."""
    own = runs.filter((F.col("end") >= start) & (F.col("start") <= end))
    return own.withColumns({"start": F.greatest("start", F.lit(start)), "end": F.least("end", F.lit(end))})


def slice_with_anchors(events: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Events from the last one up to start to the first one from end on, with zeros beside gaps and at both ends.

    A gap between two equal values gets no zeros if both stand alone: they are the ends of one plateau. Bounds come from
    one aggregate; the window sorts only what is left between them.
    """
    at, value = F.col("pos"), F.col("value")
    bounds = events.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(at <= start, at)), F.min(at)).alias("lo"), F.coalesce(F.min(F.when(at >= end, at)), F.max(at)).alias("hi")
    )
    own = events.select(*keys, "pos", value.cast("double").alias("value")).join(bounds, keys).filter(at.between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(*keys).orderBy("pos")
    near = own.withColumns({"p1": F.lag("pos").over(order), "p2": F.lag("pos", 2).over(order), "v1": F.lag("value").over(order), "n1": F.lead("pos").over(order)})
    p1, dense = F.col("p1"), lambda a, b: F.coalesce(b == a + 1, F.lit(False))
    zeros = F.coalesce((at > p1 + 1) & ((value != F.col("v1")) | dense(F.col("p2"), p1) | dense(at, F.col("n1"))), F.lit(False))
    zero = lambda when, pos: F.when(when, F.struct(pos.alias("pos"), F.lit(0.0).alias("value")))
    points = F.array(
        zero(zeros & (at > p1 + 2), p1 + 1), zero(zeros | (p1.isNull() & (at > 1)), at - 1), F.struct("pos", "value"), zero(F.col("n1").isNull(), at + 1),
    )
    return near.select(*keys, F.inline(F.array_compact(points)))


def bars_filter(runs: DataFrame, coverage: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Runs whose value reaches ratio times the pair's mean depth."""
    return runs.join(coverage.select(*keys, "coverage_mean"), keys).filter(F.col("value") >= ratio * F.col("coverage_mean")).drop("coverage_mean")


def min_frequency(df: DataFrame, least: float) -> DataFrame:
    return df.withColumn("value", F.when(F.col("value") < least, 0.0).otherwise(F.col("value")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Tables with differing columns under one another."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
