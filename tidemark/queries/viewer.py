"""Registered queries on slices, reports and filters that a viewer asks for, and on changes to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, oracle
from ..functions import sequence as Q
from ..operators import coding as D
from ..operators import maintenance as N
from ..operators import metrics as M
from ..operators import query as V
from ..operators import signals as S
from ..operators import views as W
from .dataset import BINS, PIVOT, RULES, bins, depth_runs
from .genome import CODE_TABLE, CODONS_SQL, base, t
from .signals import DEPTH, MISMATCH, PRELUDE, depth_src, fresh_reads, longs, runs_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RUNS = f"""runs as materialized ({runs_sql(depth_src("klass = 'primary'"))})"""
MEANS = """m as (select sample_name, contig_name, sum(value * ("end" - "start" + 1)) / any_value(contig_length) as coverage_mean, 100.0 * sum("end" - "start" + 1) / any_value(contig_length) as aligned from runs join contigs using (contig_name) group by all)"""

SQL["all_samples"] = f"""with {RUNS}, span as (select sample_name, least(min(value), 0)::bigint as low, greatest(max(value), 0)::bigint as high from runs where contig_name = 'ctg3' group by all)
select sample_name, contig_name, "start", "end", value, low, high from runs join span using (sample_name) where contig_name = 'ctg3'"""


def all_samples(spark: SparkSession, d: str) -> DataFrame:
    return longs(W.all_samples(depth_runs(spark, d), "ctg3"), "start", "end", "low", "high")


SQL["mag_dots"] = f"""with contigs as ({oracle('contigs')}), {BINS}, a as ({oracle('annotations')}), quals as ({oracle('qualifiers')}), {PIVOT},
w as (select annotation_id, max(value) filter (key = 'function') as f, max(value) filter (key = 'product') as p from q group by all),
c as (select a.*, case when f = 'F' then '#aa0000' when lower(p) like '%urgent%' then '#00aa00' end as color from a join w using (annotation_id))
select mag_name, annotation_id, ("start" + "end") // 2 + "offset" as mid, color from c join placed using (contig_name) where color is not null"""


def mag_dots(spark: SparkSession, d: str) -> DataFrame:
    return longs(W.mag_dots(derived(spark, d, "annotations").drop("product"), derived(spark, d, "qualifiers"), bins(spark, d), RULES), "mid")


SQL["translations"] = f"""with {base('sequences')}, {CODE_TABLE}, {CODONS_SQL}, p as (select contig_name, string_agg(coalesce(amino, 'X'), '' order by i) as protein from cod left join code on codon = c group by all),
c as (select substr(contig_name, 4)::bigint as annotation_id, contig_name, 1 + substr(contig_name, 4)::bigint * 37 % 5000 as "start", length(seq) as n from sequences where length(seq) >= 3)
select annotation_id, "start", "start" + n - 1 as "end", protein from c join p using (contig_name) where "start" + n - 1 >= 2000 and "start" <= 3000"""


def translations(spark: SparkSession, d: str) -> DataFrame:
    """Each sequence is a coding region that starts at a place by its number; those over a window."""
    q = derived(spark, d, "sequences").filter("length(seq) >= 3").withColumn("annotation_id", F.substring("contig_name", 4, 30).cast("long"))
    cds = q.withColumn("start", 1 + F.col("annotation_id") * 37 % 5000).select("annotation_id", "start", (F.col("start") + F.length("seq") - 1).alias("end"))
    return W.translations(cds, q.select("annotation_id", Q.translate(F.col("seq")).alias("protein")), 2000, 3000)


SQL["summary_report"] = f"""with {PRELUDE}, {BINS}
select 'subject' as section, contig_name as name, contig_length as value from contigs where contig_name = 'ctg3'
union all select 'reads', sample_name, count(*)::bigint from reads where klass = 'primary' and contig_name = 'ctg3' group by all
union all select 'mag', mag_name, null from bins where contig_name = 'ctg3'
union all select 'members', contig_name, "offset" from placed where mag_name in (select mag_name from bins where contig_name = 'ctg3')"""


def summary_report(spark: SparkSession, d: str) -> DataFrame:
    """One contig's report as rows: the contig, its reads by sample, its bin and that bin's members."""
    report = W.summary_report(derived(spark, d, "contigs"), {"reads": M.read_counts(fresh_reads(spark, d))}, bins(spark, d), "ctg3")
    part = lambda section, name, value: report[section].select(F.lit(section).alias("section"), F.col(name).alias("name"), value.cast("long").alias("value"))
    rows = part("subject", "contig_name", F.col("contig_length")).unionByName(part("reads", "sample_name", F.col("read_count")))
    return rows.unionByName(part("mag", "mag_name", F.lit(None))).unionByName(part("members", "contig_name", F.col("offset"))).withColumn("value", F.col("value").cast("double"))


SQL["summary_report"] = f"select section, name, value::double as value from ({SQL['summary_report']})"

SQL["slice_with_anchors"] = f"""with {PRELUDE}, {MISMATCH}, e as (select sample_name, contig_name, pos, n::double as value from mmc),
b as (select sample_name, contig_name, coalesce(max(pos) filter (pos <= 300), min(pos)) as lo, coalesce(min(pos) filter (pos >= 400), max(pos)) as hi from e group by all),
o as (select e.*, lag(pos) over w as p1, lag(pos, 2) over w as p2, lag(value) over w as v1, lead(pos) over w as n1 from e join b using (sample_name, contig_name) where pos between lo and hi window w as (partition by sample_name, contig_name order by pos)),
g as (select *, p1 is not null and pos > p1 + 1 and not (value = v1 and p2 is distinct from p1 - 1 and n1 is distinct from pos + 1) as zeros from o)
select sample_name, contig_name, pos, value from g
union all select distinct sample_name, contig_name, pos, 0 from (select sample_name, contig_name, p1 + 1 as pos from g where zeros union all select sample_name, contig_name, pos - 1 from g where zeros or p1 is null and pos > 1
  union all select sample_name, contig_name, pos + 1 from g where n1 is null)"""


def slice_with_anchors(spark: SparkSession, d: str) -> DataFrame:
    events = S.mismatches(fresh_reads(spark, d)).select(*S.PAIR, "pos", F.col("n").alias("value"))
    return longs(V.slice_with_anchors(events, S.PAIR, 300, 400), "pos")


SQL["min_frequency"] = f"""with {PRELUDE}, {DEPTH}, {MISMATCH} select sample_name, contig_name, pos, round(case when n / depth < 0.5 then 0 else n / depth end, 6) as value from mmc join cov using (sample_name, contig_name, pos)"""


def min_frequency(spark: SparkSession, d: str) -> DataFrame:
    r = fresh_reads(spark, d)
    shares = S.depth_at(S.mismatches(r), depth_runs(spark, d)).select(*S.PAIR, "pos", (F.col("n") / F.col("depth")).alias("value"))
    return longs(V.min_frequency(shares, 0.5).withColumn("value", F.round("value", 6)), "pos")


SQL["bars_filter"] = f"""with contigs as ({oracle('contigs')}), {RUNS}, {MEANS} select sample_name, contig_name, "start", "end", value from runs join m using (sample_name, contig_name) where value >= 1.5 * coverage_mean"""


def bars_filter(spark: SparkSession, d: str) -> DataFrame:
    runs = depth_runs(spark, d)
    return longs(V.bars_filter(runs, M.coverage_metrics(runs, derived(spark, d, "contigs")), S.PAIR, 1.5), "start", "end")


SQL["present_pairs"] = f"""with contigs as ({oracle('contigs')}), {RUNS}, {MEANS} select sample_name, contig_name from m where aligned >= 50 and coverage_mean >= 2"""


def present_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.present_pairs(M.coverage_metrics(depth_runs(spark, d), derived(spark, d, "contigs")), 50.0, 2.0)


SQL["cds_parents"] = f"""with a as materialized ({oracle('annotations')}),
met as (select c.annotation_id, r.annotation_id as parent_id from a c join a r on c.type = 'CDS' and r.type = 'mRNA' and c.contig_name = r.contig_name and c.strand = r.strand and c.locus_tag = r.locus_tag and r."start" - 150 <= c."start" and c."end" <= r."end" + 150)
select annotation_id, min(parent_id) as parent_id from met group by annotation_id having count(*) = 1"""


def cds_parents(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts reach 150 bases further at both ends, as the derived regions of a locus are all of one length."""
    more = F.when(F.col("type") == "mRNA", 150).otherwise(0)
    segment = F.struct((F.col("start") - more).alias("start"), (F.col("end") + more).alias("end"))
    return D.resolve_cds_parent(derived(spark, d, "annotations").withColumns({"gene": F.lit(None).cast("string"), "segments": F.array(segment)}))


SQL["remove_sample"] = f"with {PRELUDE} select contig_name, count(distinct sample_name)::bigint as n_samples, count(*)::bigint as n_reads from reads where klass <> 'unmapped' and sample_name <> 'AF' group by all"


def remove_sample(spark: SparkSession, d: str) -> DataFrame:
    """Samples and reads of each contig, counted anew after one sample is removed from all tables."""
    left = N.remove({"reads": fresh_reads(spark, d).filter("klass <> 'unmapped'")}, "sample_name", "AF")["reads"]
    pairs = left.groupBy(*S.PAIR).agg(F.count("*").alias("n"))
    return pairs.groupBy("contig_name").agg(F.count("*").alias("n_samples"), F.sum("n").alias("n_reads"))


SQL["add_metadata"] = f"""with c as ({oracle('contigs')}), r as (select concat('ctg', (p_partkey % 23)::varchar) as contig_name, max(p_brand) as brand from part group by all)
select contig_name, contig_length::double as contig_length, brand, true as known from c left join r using (contig_name)
union all select contig_name, null, null, false from r where contig_name not in (select contig_name from c)"""


def add_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").groupBy(F.concat(F.lit("ctg"), (F.col("p_partkey") % 23).cast("string")).alias("contig_name")).agg(F.max("p_brand").alias("brand"))
    table, unknown = N.add_metadata(derived(spark, d, "contigs"), rows, "contig_name")
    out = table.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)), allowMissingColumns=True)
    return out.withColumn("contig_length", F.col("contig_length").cast("double"))


SQL["expand_contigs"] = """with c as (select distinct concat('ctg', (p_partkey % 25)::varchar) as contig_name from part),
p as (select distinct concat('ctg', (l_partkey % 20)::varchar) as contig_name, concat(l_returnflag, l_linestatus) as sample_name from lineitem)
select contig_name, sample_name from c left join p using (contig_name)"""


def expand_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Contigs that match, with the samples they are in, or null."""
    contigs = t(spark, d, "part").select(F.concat(F.lit("ctg"), (F.col("p_partkey") % 25).cast("string")).alias("contig_name"))
    pairs = t(spark, d, "lineitem").select(F.concat(F.lit("ctg"), (F.col("l_partkey") % 20).cast("string")).alias("contig_name"), F.concat("l_returnflag", "l_linestatus").alias("sample_name"))
    return V.expand_contigs(contigs, pairs)


DATASET = f"""with {PRELUDE}, {BINS}, a as ({oracle('annotations')}), quals as ({oracle('qualifiers')}), reps as ({oracle('repeats')}),
rc as (select sample_name, contig_name, count(*)::bigint as read_count from reads where klass = 'primary' group by all)"""
_LEFT = """select 'annotations' as part, 'rows' as name, count(*)::bigint as n from a where contig_name not in (select contig_name from gone)
union all select 'qualifiers', 'rows', count(*) from quals where annotation_id in (select annotation_id from a where contig_name not in (select contig_name from gone))
union all select 'repeats', 'rows', count(*) from reps where contig_name not in (select contig_name from gone)
union all select 'samples', sample_name, sum(case when contig_name in (select contig_name from gone) then 0 else read_count end)::bigint from rc group by sample_name
union all select 'contig_counts', contig_name, count(distinct sample_name) from rc where contig_name not in (select contig_name from gone) group by contig_name"""


def dataset_tables(spark: SparkSession, d: str, with_bins: bool) -> dict[str, DataFrame]:
    counts = M.read_counts(fresh_reads(spark, d))
    out = {
        "contigs": derived(spark, d, "contigs"), "annotations": derived(spark, d, "annotations"), "qualifiers": derived(spark, d, "qualifiers"), "repeats": derived(spark, d, "repeats"),
        "read_counts": counts, "samples": counts.groupBy("sample_name").agg(F.sum("read_count").alias("n_mapped")), "contig_counts": M.sample_counts(counts, "contig_name"),
    }
    if with_bins:
        members = bins(spark, d).select("mag_name", "contig_name")
        out |= {"bins": members.select("mag_name").distinct(), "members": members, "bin_counts": M.sample_counts(counts.join(members, "contig_name"), "mag_name")}
    return out


def what_is_left(tables: dict[str, DataFrame]) -> DataFrame:
    rows = lambda name: tables[name].agg(F.lit(name).alias("part"), F.lit("rows").alias("name"), F.count("*").alias("n"))
    each = lambda name, key, value: tables[name].select(F.lit(name).alias("part"), F.col(key).alias("name"), F.col(value).cast("long").alias("n"))
    parts = [rows("annotations"), rows("qualifiers"), rows("repeats"), each("samples", "sample_name", "n_mapped"), each("contig_counts", "contig_name", "n_samples")]
    parts += [each("bin_counts", "mag_name", "n_samples")] if "bin_counts" in tables else []
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL["remove_contigs"] = DATASET + f", gone as (select 'ctg3' as contig_name union all select 'ctg11') {_LEFT}"


def remove_contigs(spark: SparkSession, d: str) -> DataFrame:
    """What hangs on two contigs goes, and mapped reads and sample counts are made anew."""
    names = derived(spark, d, "contigs").filter("contig_name in ('ctg3', 'ctg11')")
    return what_is_left(N.remove_contigs(dataset_tables(spark, d, False), names))


SQL["remove_bin"] = DATASET + f""", one as (select min(mag_name) as mag_name from bins), gone as (select contig_name from bins where mag_name in (select mag_name from one)) {_LEFT}
union all select 'bin_counts', mag_name, count(distinct sample_name) from rc join bins using (contig_name) where mag_name not in (select mag_name from one) group by mag_name"""


def remove_bin(spark: SparkSession, d: str) -> DataFrame:
    """The first bin goes with its contigs and all that hangs on them."""
    tables = dataset_tables(spark, d, True)
    return what_is_left(N.remove_bins(tables, tables["bins"].agg(F.min("mag_name").alias("mag_name"))))


SQL["removal_problems"] = f"with contigs as ({oracle('contigs')}), q as (select distinct concat('ctg', cast(l_partkey % 23 as varchar)) as contig_name from lineitem) select contig_name, case when contig_name in (select contig_name from contigs) then 'in bin mode' else 'unknown contig' end as problem from q"


def removal_problems(spark: SparkSession, d: str) -> DataFrame:
    """Names that can't be removed by themselves from a dataset of bins."""
    asked = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("ctg"), (F.col("l_partkey") % 23).cast("string")).alias("contig_name")).distinct()
    return N.removal_problems(dataset_tables(spark, d, True), asked)


QUERIES |= {f.__name__: f for f in (all_samples, mag_dots, translations, summary_report, slice_with_anchors, min_frequency, bars_filter, present_pairs, cds_parents, remove_sample, add_metadata, expand_contigs)}
QUERIES |= {f.__name__: f for f in (remove_contigs, remove_bin, removal_problems)}
