"""Queries on which reads, contigs, bins and pairs take part, and in what order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, oracle, written
from ..operators import genome as G
from ..operators import metrics as M
from ..operators import query as V
from ..operators import selection as L
from ..operators import views as W
from .dataset import BINS, RULES, bins, mag_coverage
from .dataset import SQL as DATASET_SQL
from .genome import base, metric, rounded, t
from .signals import ALL_CLIPS, COVERAGE, DEPTH, PAIR, PRELUDE, SIDE, SIDE_COLUMNS, coverage, depth_runs, fresh_reads, side_misassembly, topology, topology_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# names as alignment files give them: as they are, with a version, by an alias, or unknown
SQL["resolve_contigs"] = f"""
with {base('reads')},
named as (select read_id, contig_name as own, case read_id % 5 when 0 then contig_name || '.2' when 1 then 'alias_' || substr(contig_name, 4) when 2 then 'other' || contig_name else contig_name end as given from reads)
select read_id, own as contig_name from named where given not like 'other%'"""


def resolve_contigs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("read_id") % 5
    name = F.col("contig_name")
    given = F.when(k == 0, F.concat(name, F.lit(".2"))).when(k == 1, F.concat(F.lit("alias_"), F.substring(name, 4, 9))).when(k == 2, F.concat(F.lit("other"), name)).otherwise(name)
    contigs = derived(spark, d, "contigs").select("contig_name", F.array(F.concat(F.lit("alias_"), F.substring("contig_name", 4, 9))).alias("aliases"))
    return L.resolve_contigs(fresh_reads(spark, d).select("read_id", given.alias("contig_name")), contigs)


SQL["present_mags"] = f"""
with {PRELUDE}, {BINS}, mc as ({DATASET_SQL["mag_coverage"]}),
counts as (select sample_name, contig_name, count(*)::bigint as read_count from reads where klass = 'primary' group by all)
select counts.* from counts join bins using (contig_name)
where not exists (select 1 from mc where mc.mag_name = bins.mag_name and mc.sample_name = counts.sample_name and (mc.aligned_fraction < 89 or mc.coverage_mean < 8.8))"""


def present_mags(spark: SparkSession, d: str) -> DataFrame:
    return L.present_mags(M.read_counts(fresh_reads(spark, d)), mag_coverage(spark, d), bins(spark, d), 89.0, 8.8)


# --- filter expressions over all kinds of entities -------------------------------------------------------------------

PAIRS_SQL = """
pairs as materialized (select distinct concat('ctg', (l_partkey % 20)::varchar) as contig_name, concat(l_returnflag, l_linestatus) as sample_name from lineitem),
metric as materialized (select concat('ctg', (l_partkey % 20)::varchar) as contig_name, concat(l_returnflag, l_linestatus) as sample_name, sum(cast(l_quantity as bigint)) as value from lineitem group by all),
whole as materialized (select contig_name, contig_length, contig_name like '%1' as circular from contigs union all select 'ctg99', 1100, true),
of_samples as materialized (select contig_name, sample_name from (select distinct contig_name from whole) left join pairs using (contig_name))"""

FAMILY_SQL = f"""
with contigs as ({oracle('contigs')}), {BINS}, {base('annotations')}, {base('qualifiers')}, {PAIRS_SQL},
mag_metric as (select mag_name, sample_name, sum(value) as value from metric join bins using (contig_name) group by all),
a1 as (select o.* from of_samples o join whole using (contig_name) where circular),
a2 as (select o.* from of_samples o join whole using (contig_name) where not contains(contig_name, '7')),
a3 as (select o.* from of_samples o where contig_name in (select contig_name from annotations where type = 'tRNA' and "start" < 400)),
a4 as (select o.* from of_samples o where contig_name in (select contig_name from annotations join qualifiers using (annotation_id) where key = 'product' and list_contains(string_split(value, '^'), '5-LOW'))),
b1 as (select * from pairs where contains(sample_name, 'F')),
b2 as (select p.* from pairs p join metric using (contig_name, sample_name) where value <> 0),
c1 as (select o.* from of_samples o join bins using (contig_name) where mag_name = 'bin2'),
c2 as (select p.* from pairs p join bins using (contig_name) join mag_metric using (mag_name, sample_name) where value > (select avg(value) from mag_metric)),
s1 as (((select * from a1 union select * from a2) intersect select * from a3) intersect select * from a4),
s2 as (select * from b1 intersect select * from b2),
s3 as (select * from c1 union select * from c2)
"""


def families(spark: SparkSession, d: str) -> list[tuple[list[DataFrame | None], list[str]]]:
    """Three sections of predicates, one of each kind of entity and of value."""
    cov = metric(spark, d)
    members = bins(spark, d)
    whole = derived(spark, d, "contigs").unionByName(spark.sql("select 'ctg99' as contig_name, 1100L as contig_length"))
    whole = whole.withColumn("circular", F.col("contig_name").endswith("1") | (F.col("contig_name") == "ctg99"))
    notes = derived(spark, d, "annotations")
    tags = notes.join(derived(spark, d, "qualifiers"), "annotation_id")
    by_mag = cov.join(members.select("mag_name", "contig_name"), "contig_name").groupBy("mag_name", "sample_name").agg(F.sum("value").alias("value"))
    mean = by_mag.agg(F.avg("value")).first()[0]

    def part(family: str, rows: DataFrame, *conditions) -> DataFrame | None:
        if any(c is None for c in conditions):
            return None
        for c in conditions:
            rows = rows.filter(c)
        return L.family_pairs(family, rows, cov, members)

    p = lambda column, *how: V.predicate(F.col(column), *how)
    one = [
        part("contig", whole, p("circular", "bool", "=", "yes")), part("contig", whole, p("contig_name", "text", "has not", "7")), part("contig", whole, p("contig_length", "number", ">", "many")),
        part("annotation", notes, p("type", "text", "=", "tRNA"), p("start", "number", "<", "400")), part("annotation_qualifier", tags.filter("key = 'product'"), p("value", "tokens", "=", "5-LOW")),
    ]
    two = [part("sample", cov.select("sample_name").distinct(), p("sample_name", "text", "has", "F")), part("coverage", cov, p("value", "number", "!=", "0"))]
    three = [part("mag", members, p("mag_name", "text", "=", "bin2")), part("mag_coverage", by_mag, p("value", "number", ">", str(mean)))]
    return [(one, ["OR", "AND", "AND", "AND"]), (two, ["AND"]), (three, ["OR"])]


SQL["filter_families"] = f"{FAMILY_SQL} (select * from s1 union select * from s2) intersect select * from s3"


def filter_families(spark: SparkSession, d: str) -> DataFrame:
    return V.filter_pairs(families(spark, d), ["OR", "AND"])


SQL["filter_without_coverage"] = f"{FAMILY_SQL} (select * from a1 union select * from a2)"


def filter_without_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The first two predicates of contigs: one contig has no sample, which comes back as null."""
    parts, _ = families(spark, d)[0]
    return V.combine(parts[:2], ["OR"])


SQL["filter_counts_by_bin"] = f"""{FAMILY_SQL}, kept as (select * from c1 union select * from c2)
select (select count(*) from kept)::bigint as n_pairs, (select count(distinct contig_name) from kept)::bigint as n_contigs, (select count(distinct sample_name) from kept)::bigint as n_samples,
  (select count(*) from (select distinct mag_name, sample_name from kept join bins using (contig_name) where sample_name is not null))::bigint as n_mag_samples"""


def filter_counts_by_bin(spark: SparkSession, d: str) -> DataFrame:
    parts, how = families(spark, d)[2]
    return V.filter_counts(V.combine(parts, how), bins(spark, d))


# --- bins ------------------------------------------------------------------------------------------------------------

SQL["mag_region"] = f"""with contigs as ({oracle('contigs')}), {BINS}, p as (select mag_name, contig_name, unnest(range(1, contig_length + 1)) as pos, "offset" from placed)
select mag_name, contig_name, min(pos)::bigint as "start", max(pos)::bigint as "end" from p where pos + "offset" between 1500 and 4000 group by all"""


def mag_region(spark: SparkSession, d: str) -> DataFrame:
    out = L.mag_region(bins(spark, d), 1500, 4000)
    return out.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


SQL["order_members"] = f"""with contigs as ({oracle('contigs')}), {BINS}, {PAIRS_SQL}
select mag_name, contig_name, (row_number() over (partition by mag_name order by coalesce(value, 0) desc, contig_name))::int as place from bins left join (select * from metric where sample_name = 'NF' and value > 3000) using (contig_name)"""


def order_members(spark: SparkSession, d: str) -> DataFrame:
    return L.order_members(bins(spark, d), metric(spark, d).filter("value > 3000"), "value", False, "NF").select("mag_name", "contig_name", "place")


SQL["mag_hit_features"] = f"""with contigs as ({oracle('contigs')}), {BINS}, {base('hits')},
sym as (select distinct contig_1, contig_2, p1, p2, p1x, p2x, 80 + p1 % 20 as pident from (select * from hits where contig_1 < contig_2 union all select contig_2, contig_1, p1x, p2x, p1, p2, pident from hits where contig_1 > contig_2)),
two_way as (select contig_1 as contig_name, contig_2 as partner, least(p1, p2) as s, greatest(p1, p2) as e, pident from sym union all select contig_2, contig_1, least(p1x, p2x), greatest(p1x, p2x), pident from sym),
own as (select b.* from two_way b join bins x using (contig_name) join bins y on y.contig_name = b.partner and y.mag_name = x.mag_name),
bases as (select contig_name, partner, pident, unnest(range(s, e + 1)) as p from own)
select contig_name, p as pos, count(*)::bigint as hits, max(pident)::bigint as pident, min(partner) filter (pident = best) as partner
from (select *, max(pident) over (partition by contig_name, p) as best from bases) where p % 10 = 0 group by all"""


def mag_hit_features(spark: SparkSession, d: str) -> DataFrame:
    """Compared at the bases whose number ends in 0; the runs cover all."""
    hits = G.oriented_hits(derived(spark, d, "hits")).withColumn("pident", 80 + F.col("p1") % 20)
    runs = G.mag_hit_features(hits, bins(spark, d))
    every = runs.withColumn("pos", F.explode(F.sequence(F.ceil(F.col("start") / 10), F.floor(F.col("end") / 10)))).filter("pos * 10 between start and end")
    return every.select("contig_name", (F.col("pos") * 10).alias("pos"), F.col("hits").cast("long").alias("hits"), "pident", "partner")


# --- order, segments, features -----------------------------------------------------------------------------------------

SQL["sort_alignments"] = f"with {base('reads')} select contig_name, pos, read_id, (row_number() over (order by contig_name, pos, read_id))::bigint as place from reads"


def sort_alignments(spark: SparkSession, d: str) -> DataFrame:
    """place: the number of reads in earlier ranges and before it in its own. Borders of ranges come from a sample, which is drawn
    anew whenever rows are dealt: they are dealt once and written, so that sizes and places are of the same ranges."""
    rows = L.sort_alignments(fresh_reads(spark, d).select("contig_name", "pos", "read_id")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33))
    rows = written(rows, "sorted-reads")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row for each range
    before, total = [], 0
    for r in sorted(sizes):
        before.append((r.part, total))
        total += r.n
    bases = spark.createDataFrame(before, "part int, base long")
    return rows.join(F.broadcast(bases), "part").select("contig_name", "pos", "read_id", (F.col("base") + F.col("at") + 1).alias("place"))


SQL["normalize_segments"] = f"""with {base('annotations')}, s as (select annotation_id, unnest(case when strand = 1 then [[("end" - 9)::bigint, "end"::bigint], ["start"::bigint, ("start" + 4)::bigint]] else [["start"::bigint, "end"::bigint]] end) as x from annotations)
select annotation_id, string_agg(concat(x[1] + 100, '-', x[2] + 100), ',' order by x[1], x[2]) as segments from s group by all"""


def normalize_segments(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    two = F.array(pair(F.col("end") - 9, F.col("end")), pair(F.col("start"), F.col("start") + 4))
    rows = derived(spark, d, "annotations").withColumn("segments", F.when(F.col("strand") == 1, two))
    out = L.normalize_segments(F.col("segments"), F.col("start"), F.col("end"), F.lit(100))
    return rows.select("annotation_id", F.array_join(F.transform(out, lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string"))), ",").alias("segments"))


SQL["remove_feature"] = "select concat('ctg', (l_partkey % 20)::varchar) as contig_name, concat('user', (l_linenumber % 3)::varchar) as feature, count(*)::bigint as n from lineitem where l_linenumber % 3 <> 1 group by all"


def remove_feature(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select(F.concat(F.lit("ctg"), (F.col("l_partkey") % 20).cast("string")).alias("contig_name"), F.concat(F.lit("user"), (F.col("l_linenumber") % 3).cast("string")).alias("feature"))
    left = L.remove_feature({"runs": rows, "contigs": derived(spark, d, "contigs")}, "user1", ["primary_reads"])
    return left["runs"].groupBy("contig_name", "feature").agg(F.count("*").alias("n"))


# --- views of contig ends ------------------------------------------------------------------------------------------------

def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Sequencing types, with one sample taken as single reads."""
    kinds = M.sequencing_type(fresh_reads(spark, d))
    return kinds.withColumn("sequencing_type", F.when(F.col("sample_name") == "AF", "single-short").otherwise(F.col("sequencing_type")))


TYPES_SQL = "kinds as (select distinct sample_name, sample_name <> 'AF' as is_paired from reads)"

SQL["explicit_side"] = f"""
with {PRELUDE}, {DEPTH}, {ALL_CLIPS}, {SIDE}, {COVERAGE}, {TYPES_SQL},
mates as (select sample_name, contig_name, count(*) filter (paired and not mate_unmapped and contig_name <> mate_contig and (pos < 100 or pos >= contig_length - 100)) as k from reads join short_contigs using (contig_name) where klass = 'primary' group by all),
fd as (select sample_name, contig_name, depth as first_depth from cov where pos = 1), ld as (select sample_name, contig_name, depth as last_depth from cov where pos = 960)
select sample_name, contig_name, round(coalesce(left_prevalence, 0), 6) as left_prevalence, coalesce(start_collapse_bp, 0)::double as start_collapse_bp, coalesce(start_expansion_bp, 0)::double as start_expansion_bp,
  round(coalesce(right_prevalence, 0), 6) as right_prevalence, coalesce(end_collapse_bp, 0)::double as end_collapse_bp, coalesce(end_expansion_bp, 0)::double as end_expansion_bp,
  coalesce(first_depth, 0)::double as first_depth, coalesce(last_depth, 0)::double as last_depth, (case when is_paired then k end)::double as end_misjoint_mates,
  round(case when is_paired then case when coverage_mean > 0 then k * 1000.0 / coverage_mean else 0 end end, 4) as normalized_end_misjoint_mates
from mates left join sides using (sample_name, contig_name) left join fd using (sample_name, contig_name) left join ld using (sample_name, contig_name) left join covm using (sample_name, contig_name) join kinds using (sample_name)"""


def explicit_side(spark: SparkSession, d: str) -> DataFrame:
    contigs = derived(spark, d, "short_contigs")
    out = M.explicit_side(side_misassembly(spark, d), M.contig_ends(fresh_reads(spark, d), contigs, window=100), M.edge_depth(depth_runs(spark, d), contigs), coverage(spark, d), _samples(spark, d))
    out = out.withColumns({c: F.col(c).cast("double") for c in (*SIDE_COLUMNS, "first_depth", "last_depth", "end_misjoint_mates") if c in out.columns})
    return rounded(rounded(out, "left_prevalence", "right_prevalence"), "normalized_end_misjoint_mates", digits=4)


SQL["explicit_topology"] = f"""
with {PRELUDE}, {DEPTH}, {COVERAGE}, {TYPES_SQL}, top as ({topology_sql(True, 100)})
select sample_name, contig_name, circularising_reads, circularising_prevalence, median_overlap, (case when is_paired then coalesce(circularising_inserts, 0) end)::double as circularising_inserts,
  (case when is_paired then coalesce(insert_size_deviation, 0) end)::double as insert_size_deviation,
  round(case when is_paired then case when coverage_mean > 0 then coalesce(circularising_inserts, 0) * 1000.0 / coverage_mean else 0 end end, 4) as normalized_circularising_inserts
from top left join covm using (sample_name, contig_name) join kinds using (sample_name)"""


def explicit_topology(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.explicit_topology(topology(spark, d, True, 100), coverage(spark, d), _samples(spark, d)), "normalized_circularising_inserts", digits=4)


# --- annotations -----------------------------------------------------------------------------------------------------------

SQL["enrich_force"] = f"""with {base('annotations')}, v as (select concat('loc', c_custkey::varchar) as locus_tag, case when c_custkey % 3 = 0 then '  ' when c_custkey % 3 = 1 then 'a^' || c_mktsegment else c_mktsegment end as product from customer),
w as (select locus_tag, min(replace(trim(product), '^', '_')) as product from v where trim(product) <> '' group by all)
select annotation_id, coalesce(w.product, annotations.product) as product from annotations left join w using (locus_tag)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("a^"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return t(spark, d, "customer").select(F.concat(F.lit("loc"), F.col("c_custkey").cast("string")).alias("locus_tag"), name.alias("product"))


def enrich_force(spark: SparkSession, d: str) -> DataFrame:
    return G.enrich_annotations(derived(spark, d, "annotations"), _segments(spark, d), ["locus_tag"], ["product"], "force").select("annotation_id", "product")


SQL["enrich_multiple"] = f"""with {base('annotations')}, v as (select concat('loc', (c_custkey % 50)::varchar) as locus_tag, c_mktsegment as segment from customer),
w as (select locus_tag, string_agg(distinct segment, '^' order by segment) as segment from v group by all)
select annotation_id, segment as x_segment from annotations left join w using (locus_tag)"""


def enrich_multiple(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "customer").select(F.concat(F.lit("loc"), (F.col("c_custkey") % 50).cast("string")).alias("locus_tag"), F.col("c_mktsegment").alias("segment"))
    return G.enrich_annotations(derived(spark, d, "annotations"), rows, ["locus_tag"], ["segment"], "multiple", "x_").select("annotation_id", "x_segment")


SQL["gene_map_main"] = f"""with {base('annotations')},
m as (select *, locus_tag is null or row_number() over (partition by contig_name, type, locus_tag order by "start", annotation_id) = 1 as main_isoform from annotations)
select annotation_id, contig_name, type from m where main_isoform and type in ('CDS', 'tRNA') and "end" >= 300 and "start" <= 700"""


def gene_map_main(spark: SparkSession, d: str) -> DataFrame:
    notes = G.main_isoform(derived(spark, d, "annotations")).drop("product")
    return W.gene_map(notes, derived(spark, d, "qualifiers"), 300, 700, RULES, ["CDS", "tRNA"], True).select("annotation_id", "contig_name", "type")


QUERIES |= {f.__name__: f for f in (
    enrich_force, enrich_multiple, gene_map_main, resolve_contigs, present_mags, filter_families, filter_without_coverage, filter_counts_by_bin, mag_region, order_members, mag_hit_features,
    sort_alignments, normalize_segments, remove_feature, explicit_side, explicit_topology,
)}
