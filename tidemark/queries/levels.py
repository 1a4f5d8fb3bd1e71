"""Registered queries on stored layouts: the pyramid of a signal, joined runs, and their twins that count bases one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, fingerprint, oracle, shared_path
from ..operators import levels as L
from ..operators import signals as S
from .dataset import depth_runs
from .signals import depth_src, runs_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PATHS: dict[tuple[str, str, str], str] = {}


def pyramid(spark: SparkSession, d: str) -> str:
    """The folder of the depth's pyramid, built once for the files as they are, a few samples after the others."""
    key = (spark.sparkContext.applicationId, d, fingerprint(spark, d, ("lineitem",)))
    if key not in _PATHS:
        path, runs = shared_path(spark, "levels"), depth_runs(spark, d)
        L.append_levels(runs.filter("sample_name < 'N'"), path)
        L.append_levels(runs.filter("sample_name >= 'N'"), path)
        _PATHS[key] = path
    return _PATHS[key]


DEPTH = runs_sql(depth_src("klass = 'primary'"), last=f", c as ({oracle('contigs')})")


def _bins(size: int, where: str, what: str = "mean") -> str:
    value = "max(value)::double" if what == "peak" else f"sum(value)::double / least({size}, any_value(contig_length) - ((p - 1) // {size}) * {size})"
    return f"""select sample_name, contig_name, ((p - 1) // {size}) * {size} + 1 as "start", ((p - 1) // {size} + 1) * {size} as "end", round({value}, 6) as value
from depth join c using (contig_name) where {where} group by sample_name, contig_name, (p - 1) // {size}"""


SQL["pyramid_bins"] = DEPTH + "\nselect 100 as size, * from (" + _bins(100, "true") + ") union all select 1000, * from (" + _bins(1000, "true") + ") union all select 10000, * from (" + _bins(10_000, "true") + ")"


def pyramid_bins(spark: SparkSession, d: str) -> DataFrame:
    """All stored bins of all levels as means."""
    path, contigs = pyramid(spark, d), derived(spark, d, "contigs")
    parts = [L.window(spark, path, contigs, 1, 10_000_000, size=s).select(F.lit(s).alias("size"), *S.PAIR, "start", "end", F.round("value", 6).alias("value")) for s in L.SIZES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL["pyramid_peaks"] = DEPTH + "\n" + _bins(100, "true", "peak")


def pyramid_peaks(spark: SparkSession, d: str) -> DataFrame:
    return L.window(spark, pyramid(spark, d), derived(spark, d, "contigs"), 1, 10_000_000, size=100, peaks=True).withColumn("value", F.round("value", 6))


SQL["region_runs"] = DEPTH + """, w as (select *, p - row_number() over (partition by sample_name, contig_name, value order by p) as g from depth where contig_name in ('ctg3', 'ctg7') and p between 300 and 700)
select sample_name, contig_name, min(p) as "start", max(p) as "end", value::double as value from w group by sample_name, contig_name, value, g"""


def region_runs(spark: SparkSession, d: str) -> DataFrame:
    """Base runs of two contigs in a window, from the folders that hold it."""
    return L.window(spark, pyramid(spark, d), derived(spark, d, "contigs"), 300, 700, names=["ctg3", "ctg7"])


QUERIES |= {f.__name__: f for f in (pyramid_bins, pyramid_peaks, region_runs)}
