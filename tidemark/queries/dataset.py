"""Registered queries on circular reads, smoothing, bins, viewer windows and dataset changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, oracle, stored
from ..operators import circular as C
from ..operators import genome as G
from ..operators import kernels as K
from ..operators import maintenance as N
from ..operators import metrics as M
from ..operators import signals as S
from ..operators import smoothing as W
from ..operators import views as V
from ..sources.files import metrics_wide
from .genome import rounded
from .signals import PRELUDE, depth_src, fresh_reads, positions, runs_sql
from .signals import SQL as SIGNAL_SQL
from .signals import depth_runs as chunk_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HALF = 480  # length of the contigs that the derived reads were mapped on twice

BINS = """bins as (select concat('bin', (substr(contig_name, 4)::int % 4)::varchar) as mag_name, contig_name, contig_length from contigs),
placed as (select *, coalesce(sum(contig_length) over (partition by mag_name order by contig_length desc, contig_name rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from bins)"""


def bins(spark: SparkSession, d: str) -> DataFrame:
    return G.mag_offsets(derived(spark, d, "contigs").select(F.concat(F.lit("bin"), (F.substring("contig_name", 4, 9).cast("int") % 4).cast("string")).alias("mag_name"), "contig_name", "contig_length"))


def half_contigs(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "contigs").withColumn("contig_length", F.lit(HALF).cast("long"))


def depth_runs(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "joined-depth-runs", lambda: K.rle(chunk_runs(spark, d), S.PAIR, "value").select(*S.PAIR, "start", "end", F.col("value").cast("long").alias("value")))


CIRCLES = f"circles as (select contig_name, {HALF // 20}::bigint as n, substr(contig_name, 4)::int % 2 = 0 as circular from ({oracle('contigs')}))"


def circles(spark: SparkSession, d: str) -> DataFrame:
    """Contigs shorter than many reads, every other one circular."""
    return derived(spark, d, "contigs").select("contig_name", F.lit(HALF // 20).cast("long").alias("contig_length"), (F.substring("contig_name", 4, 9).cast("int") % 2 == 0).alias("circular"))


def near_reads(spark: SparkSession, d: str) -> DataFrame:
    """Primary reads moved onto these contigs, so that many run past the end, some by several laps."""
    move = lambda c: F.pmod(c - 1, F.lit(HALF // 20)) + 1
    r = S.mapped(fresh_reads(spark, d)).withColumn("back", F.col("start") - move(F.col("start")))
    back = F.col("back")
    ops = F.transform("places", lambda o: F.struct(o.op.alias("op"), o.len.alias("len"), (o.ref_start - back).cast("int").alias("ref_start"), o.query_start.alias("query_start"), o.mcol_start.alias("mcol_start")))
    return r.withColumns({"places": ops, "end": F.col("end") - back, "start": F.col("start") - back}).drop("back")


NEAR = f"""near as (select r.*, s - ((s - 1) % {HALF // 20} + 1) as back, n, circular from reads r join circles using (contig_name) where klass = 'primary' and e >= s)"""
SQL["circular_depth"] = f"""with {PRELUDE}, {CIRCLES}, {NEAR},
src as (select sample_name, contig_name, n, circular, s - back as s, e - back as e, 1 as w from near union all
  select sample_name, contig_name, n, circular, o.ref_start + 1 - back, o.ref_start + o.len - back, -1 from near join ops o using (read_no) where o.op = 'N'),
bases as (select sample_name, contig_name, n, circular, w, unnest(range(s, e + 1)) as p from src where s <= e),
depth as (select sample_name, contig_name, case when circular then (p - 1) % n + 1 else p end as p, sum(w)::bigint as value from bases where circular or p <= n group by all having sum(w) <> 0),
marked as (select *, p - row_number() over (partition by sample_name, contig_name, value order by p) as g from depth)
select sample_name, contig_name, min(p)::bigint as "start", max(p)::bigint as "end", value from marked group by sample_name, contig_name, value, g"""


def circular_depth(spark: SparkSession, d: str) -> DataFrame:
    out = K.rle(S.depth(near_reads(spark, d), circles(spark, d)), S.PAIR, "value")
    return out.select(*S.PAIR, *[F.col(c).cast("long").alias(c) for c in ("start", "end", "value")])


SQL["circular_events"] = f"""with {PRELUDE}, {CIRCLES}, {NEAR},
x as (select sample_name, contig_name, 'deletion' as kind, o.ref_start + 1 - back as pos, n, circular from near join ops o using (read_no) where o.op = 'D'
  union all select sample_name, contig_name, 'insertion', o.ref_start - back, n, circular from near join ops o using (read_no) where o.op = 'I'
  union all select sample_name, contig_name, 'clip', s - back, n, circular from near where kinds[1] in ('S', 'H'))
select sample_name, contig_name, kind, (case when circular then (pos - 1) % n + 1 else pos end)::bigint as pos, count(*)::bigint as n from x where circular or pos between 0 and n group by all"""


def circular_events(spark: SparkSession, d: str) -> DataFrame:
    """Deletions, insertions and clips counted on the circle."""
    r = near_reads(spark, d)
    kinds = {"deletion": S.deletion_events(r), "insertion": S.insertion_events(r), "clip": S.clip_events(r).filter("side = 'left'")}
    rows = None
    for kind, events in kinds.items():
        own = events.select(*S.PAIR, F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"))
        rows = own if rows is None else rows.unionByName(own)
    return S.on_circle(rows, circles(spark, d), "pos").groupBy(*S.PAIR, "kind", "pos").agg(F.count("*").alias("n"))


SQL["normalize_circular"] = f"""with raw as materialized ({oracle('reads')}), c as (select contig_name from ({oracle('contigs')})), known as (select raw.*, a.contig_name is not null as k, b.contig_name is not null as m from raw left join c a using (contig_name) left join c b on b.contig_name = raw.mate_contig),
moved as (select read_id, sample_name, contig_name, mate_contig, flag, tlen, k, case when k and pos >= {HALF} then pos - {HALF} else pos end as pos, case when m and flag & 8 = 0 and mate_pos >= {HALF} then mate_pos - {HALF} else mate_pos end as mate_pos from known)
select read_id, sample_name, contig_name, pos::bigint as pos, mate_pos::bigint as mate_pos, (case when k and flag & 8 = 0 and contig_name = mate_contig then least(abs(pos - mate_pos), {HALF} - abs(pos - mate_pos)) * case when pos <= mate_pos then 1 else -1 end else tlen end)::bigint as tlen from moved"""


def normalize_circular(spark: SparkSession, d: str) -> DataFrame:
    out = C.normalize_circular(derived(spark, d, "reads"), half_contigs(spark, d))
    return out.select("read_id", "sample_name", "contig_name", *[F.col(c).cast("long").alias(c) for c in ("pos", "mate_pos", "tlen")])


SQL["drop_ghosts"] = f"""with {PRELUDE}, r as (select *, e - s + 1 as size, ((pos % {HALF}) + {HALF}) % {HALF} as place from reads),
inside as (select distinct x.read_no from r x join r p using (sample_name, qname, contig_name) where x.klass in ('secondary', 'supplementary') and p.klass = 'primary' and (p.size >= {HALF} or ((x.pos - p.pos) % {HALF} + {HALF}) % {HALF} + x.size <= p.size)),
kept as (select *, row_number() over (partition by sample_name, qname, contig_name, klass, place order by read_id, mapq) as k from r where klass in ('secondary', 'supplementary') and read_no not in (select read_no from inside)),
good as (select * from kept where klass = 'secondary' or k = 1),
fix as (select distinct sample_name, qname from r where klass in ('secondary', 'supplementary') except select sample_name, qname from good)
select read_id, (case when klass = 'primary' and f.qname is not null then 60 else mapq end)::bigint as mapq from r left join fix f using (sample_name, qname) where klass not in ('secondary', 'supplementary') union all select read_id, mapq::bigint from good"""


def drop_ghosts(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_ghosts(fresh_reads(spark, d), half_contigs(spark, d)).select("read_id", F.col("mapq").cast("long").alias("mapq"))


def _greedy(fits: str, value: str) -> str:
    """One walk over the runs of each pair, a step a run."""
    fit = fits.format(lo="least(w.lo, n.value)", hi="greatest(w.hi, n.value)")
    return f"""with recursive runs as materialized ({runs_sql(depth_src("klass = 'primary'"))}),
n as materialized (select sample_name, contig_name, "start", "end", value::double as value, row_number() over (partition by sample_name, contig_name order by "start") as k from runs),
walk as (
  select sample_name, contig_name, k, 1 as id, "start" as s, "end" as e, value as lo, value as hi, value * ("end" - "start" + 1) as total from n where k = 1
  union all
  select n.sample_name, n.contig_name, n.k, w.id + case when joins then 0 else 1 end, case when joins then w.s else n."start" end, n."end",
    case when joins then least(w.lo, n.value) else n.value end, case when joins then greatest(w.hi, n.value) else n.value end,
    case when joins then w.total else 0 end + n.value * (n."end" - n."start" + 1)
  from walk w join n on n.sample_name = w.sample_name and n.contig_name = w.contig_name and n.k = w.k + 1, lateral (select w.e + 1 = n."start" and {fit} as joins)),
closed as (select sample_name, contig_name, id, arg_max(s, k) as "start", max(e) as "end", arg_max(lo, k) as lo, arg_max(hi, k) as hi, arg_max(total, k) as total from walk group by sample_name, contig_name, id)
select sample_name, contig_name, "start", "end", {value} as value from closed"""


SQL["smooth_runs"] = _greedy("{hi} - {lo} <= 0.5 * greatest(1.0, {lo})", "trunc((lo + hi) / 2)")
SQL["adaptive_rle"] = _greedy("{hi} - {lo} <= 0.5 * {lo}", 'round(total / ("end" - "start" + 1), 6)')


def smooth_runs(spark: SparkSession, d: str) -> DataFrame:
    return W.smooth_runs(depth_runs(spark, d), S.PAIR, 50, chunk=256)  # contigs here are short: chunks of a few hundred bases


def adaptive_rle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(W.adaptive_rle(depth_runs(spark, d), S.PAIR, 0.5), "value")


DEPTH_RUNS = runs_sql(depth_src("klass = 'primary'")).rstrip()
SQL["stitch_mag"] = DEPTH_RUNS.replace("select sample_name, contig_name, min(p)", "runs as (select sample_name, contig_name, min(p)").rstrip().replace("), runs as", ", runs as") + f"""), {BINS}
select mag_name, sample_name, contig_name, "start" + "offset" as "start", "end" + "offset" as "end", "value" from runs join placed using (contig_name)
union all select mag_name, sample_name, contig_name, "offset" + 1, "offset" + contig_length, 0 from (select distinct sample_name, mag_name from runs join placed using (contig_name)) join placed using (mag_name)
where (sample_name, contig_name) not in (select (sample_name, contig_name) from runs)"""
SQL["stitch_mag"] = SQL["stitch_mag"].replace(")\nruns as", "),\nruns as")


def stitch_mag(spark: SparkSession, d: str) -> DataFrame:
    return V.stitch_mag(depth_runs(spark, d), bins(spark, d))


def inspect_window(spark: SparkSession, d: str) -> DataFrame:
    """Two features of all contigs and samples, in bins of 100 bases."""
    r = fresh_reads(spark, d)
    deletions = K.rle(S.signal(r, "deletions"), S.PAIR, "value")
    out = V.inspect({"primary_reads": depth_runs(spark, d), "deletions": deletions}, derived(spark, d, "contigs"), None, None, 201, 800, 100)
    return rounded(out, "value")


def inspect_sql(source: str, feature: str) -> str:
    return runs_sql(source, last=f"""select '{feature}' as feature, sample_name, contig_name, ((p - 1) // 100 * 100 + 1)::bigint as "start", ((p - 1) // 100 * 100 + 100)::bigint as "end", round(sum(value) / 100.0, 6) as "value" from depth where p between 201 and 800 group by sample_name, contig_name, (p - 1) // 100""")


SQL["inspect_window"] = f"""select * from ({inspect_sql(depth_src("klass = 'primary'"), 'primary_reads')}) union all select * from ({inspect_sql("select r.sample_name, r.contig_name, o.ref_start + 1 as s, o.ref_start + o.len as e, 1 as w from reads r join ops o using (read_no) where o.op = 'D' and klass = 'primary'", 'deletions')})"""

SQL["mag_burden"] = SIGNAL_SQL["microdiversity"].replace("select * from burden", "") + f""", {BINS}, size as (select mag_name, sum(contig_length) as size from bins group by all)
select mag_name, sample_name, round(sum(mismatch_count) * 100000.0 / any_value(size), 4) as mismatch_count_per_100kbp, round(sum(bases) * 100000.0 / any_value(size), 4) as bases_per_100kbp from burden join bins using (contig_name) join size using (mag_name) group by mag_name, sample_name"""


def mag_burden(spark: SparkSession, d: str) -> DataFrame:
    counts = M.variant_burden(positions(spark, d), 0.1)
    return rounded(N.mag_burden(counts, bins(spark, d), ["mismatch_count", "bases"]), "mismatch_count_per_100kbp", "bases_per_100kbp", digits=4)


SQL["mag_rpkm_tpm"] = f"""with {PRELUDE}, {BINS}, k as (select sample_name, contig_name, count(*) as n from reads where klass = 'primary' group by all), t as (select sample_name, sum(n) as total from k group by all),
m as (select mag_name, sample_name, sum(n * 1e9 / (contig_length * total)) as rpkm from k join t using (sample_name) join bins using (contig_name) group by all) select mag_name, sample_name, round(rpkm, 4) as rpkm, round(rpkm / sum(rpkm) over (partition by sample_name) * 1e6, 4) as tpm from m"""


def mag_rpkm_tpm(spark: SparkSession, d: str) -> DataFrame:
    counts = M.read_counts(fresh_reads(spark, d))
    totals = counts.groupBy("sample_name").agg(F.sum("read_count").alias("n_mapped"))
    return rounded(N.mag_rpkm_tpm(M.rpkm_tpm(counts, derived(spark, d, "contigs"), totals), bins(spark, d)), "rpkm", "tpm", digits=4)


SQL["visible_members"] = f"""with contigs as ({oracle('contigs')}), {BINS} select mag_name, contig_name, contig_length, "offset", greatest("offset" + 1, 1500)::bigint as seen_start, least("offset" + contig_length, 4000)::bigint as seen_end, "offset" + 1 < 1500 or "offset" + contig_length > 4000 as is_cut from placed where "offset" + contig_length >= 1500 and "offset" + 1 <= 4000"""


def visible_members(spark: SparkSession, d: str) -> DataFrame:
    out = V.visible_members(bins(spark, d), 1500, 4000)
    return out.withColumns({c: F.col(c).cast("long") for c in ("seen_start", "seen_end")})


RULES = [{"key": "function", "mode": "exact", "value": "F", "color": "#aa0000"}, {"key": "product", "mode": "has", "value": "urgent", "color": "#00aa00"}]
PIVOT = """q as (select annotation_id, key, string_agg(value, '^' order by value) as value from quals group by all)"""
SQL["gene_map"] = f"""with a as ({oracle('annotations')}), quals as ({oracle('qualifiers')}), {PIVOT}, w as (select annotation_id, max(value) filter (key = 'function') as f, max(value) filter (key = 'product') as p from q group by all)
select annotation_id, contig_name, "start", "end", p as product, case when f = 'F' then '#aa0000' when lower(p) like '%urgent%' then '#00aa00' end as color from a left join w using (annotation_id) where "end" >= 300 and "start" <= 700"""


def gene_map(spark: SparkSession, d: str) -> DataFrame:
    out = V.gene_map(derived(spark, d, "annotations").drop("product"), derived(spark, d, "qualifiers"), 300, 700, RULES)
    return out.select("annotation_id", "contig_name", "start", "end", F.try_element_at("qualifiers", F.lit("product")).alias("product"), "color")


SQL["check_feature"] = """with f as (select concat('ctg', l_partkey % 22) as contig_name, case when l_linenumber > 1 then concat(l_returnflag, l_linestatus) end as sample_name, l_orderkey::bigint as first_position, (l_orderkey + l_quantity)::bigint as last_position, l_linenumber from lineitem),
o as (select *, max(last_position) over (partition by contig_name, sample_name order by first_position, last_position rows between unbounded preceding and 1 preceding) as reach from f)
select case when substr(contig_name, 4)::int >= 20 then 'unknown contig' when last_position > 5000 then 'outside the contig' when first_position <= reach then 'overlaps' end as problem, count(*)::bigint as n from o group by 1"""


def check_feature(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = lines.select(F.concat(F.lit("ctg"), (F.col("l_partkey") % 22).cast("string")).alias("contig_name"), F.when(F.col("l_linenumber") > 1, F.concat("l_returnflag", "l_linestatus")).alias("sample_name"),
                        F.col("l_orderkey").alias("first_position"), (F.col("l_orderkey") + F.col("l_quantity")).cast("long").alias("last_position"))
    contigs = derived(spark, d, "contigs").withColumn("contig_length", F.lit(5000))
    samples = lines.select(F.concat("l_returnflag", "l_linestatus").alias("sample_name")).distinct()
    pairs = rows.filter("sample_name is not null").select(*S.PAIR).distinct()
    return N.check_feature(rows, contigs, samples, pairs).groupBy("problem").agg(F.count("*").alias("n"))


SQL["metrics_wide"] = f"""with {PRELUDE}, s as (select distinct sample_name from raw), t as (select sample_name, count(*)::bigint as n from reads where klass = 'primary' group by all), u as (select sample_name, count(*)::bigint as n from reads where klass = 'unmapped' group by all)
select sample_name, t.n as mapped_n, coalesce(u.n, 0)::bigint as unmapped_n from s left join t using (sample_name) left join u using (sample_name)"""


def metrics_wide_report(spark: SparkSession, d: str) -> DataFrame:
    r = fresh_reads(spark, d)
    count = lambda k: r.filter(F.col("klass") == k).groupBy("sample_name").agg(F.count("*").alias("n"))
    return metrics_wide(r.select("sample_name").distinct(), {"mapped": count("primary"), "unmapped": count("unmapped")}).fillna(0, ["unmapped_n"])


SQL["mag_coverage"] = runs_sql(depth_src("klass = 'primary'"), last=f""", {BINS},
present as (select distinct sample_name, mag_name from depth join bins using (contig_name)), own as (select distinct sample_name, contig_name, true as has from depth),
every as (select sample_name, mag_name, contig_name, unnest(range(1, contig_length + 1)) as p from present join bins using (mag_name)),
b as (select e.*, coalesce(value, 0) as v, coalesce(has, false) as has from every e left join depth using (sample_name, contig_name, p) left join own using (sample_name, contig_name)),
w as (select *, case when has then v - lag(v) over (partition by sample_name, contig_name order by p) end as step from b),
a as (select sample_name, mag_name, count(*) as n, avg(v) as m, stddev_pop(v) as sd, count(*) filter (v > 0) as covered, list_sort(list(v)) as l, sum(step * step) as steps, count(distinct contig_name) filter (has) as parts from w group by all)
select sample_name, mag_name, n::bigint as mag_length, round(100.0 * covered / n, 4) as aligned_fraction, round(m, 4) as coverage_mean, l[n // 2 + 1]::bigint as coverage_median, round(list_avg(l[floor(n * 0.05)::bigint + 1:ceil(n * 0.95)::bigint]), 4) as coverage_trimmed, round(sd / m, 4) as coverage_cv, round(sqrt(steps / (n - parts)) / m, 4) as coverage_roughness from a""")


def mag_coverage(spark: SparkSession, d: str) -> DataFrame:
    out = M.mag_coverage(depth_runs(spark, d), bins(spark, d)).drop("expected_fraction")
    return rounded(out, "aligned_fraction", "coverage_mean", "coverage_trimmed", "coverage_cv", "coverage_roughness", digits=4)


QUERIES |= {f.__name__: f for f in (circular_depth, circular_events, normalize_circular, drop_ghosts, smooth_runs, adaptive_rle, stitch_mag, inspect_window, mag_burden, mag_rpkm_tpm, mag_coverage, visible_members, gene_map, check_feature)} | {"metrics_wide": metrics_wide_report}
