"""Registered queries on read signals and pair metrics, with DuckDB twins that count bases one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, if_stored, oracle, stored
from ..functions import cigar as C
from ..operators import kernels as K
from ..operators import metrics as M
from ..operators import signals as S

PAIR = S.PAIR

#: Reads are told apart by a number of their own: on large tables, read_id has the same value for a few different reads.
PRELUDE = f"""
raw as materialized (select row_number() over () as read_no, * from ({oracle('reads')})),
contigs as ({oracle('contigs')}),
short_contigs as ({oracle('short_contigs')}),
listed as materialized (
  select *, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1) as lens, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) as kinds from raw),
flat as (select read_no, pos, unnest(range(1, len(lens) + 1)) as i, unnest(lens)::int as len, unnest(kinds) as op from listed),
ops as materialized (
  select *, pos + coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then len else 0 end) over w, 0)::bigint as ref_start,
    coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then len else 0 end) over w, 0)::bigint as query_start,
    coalesce(sum(case when op in ('M', '=', 'X') then len else 0 end) over w, 0)::bigint as mcol_start
  from flat window w as (partition by read_no order by i rows between unbounded preceding and 1 preceding)),
spans as (select read_no, sum(case when op in ('M', 'D', 'N', '=', 'X') then len else 0 end)::bigint as span,
  sum(case when op in ('M', 'I', 'S', '=', 'X') then len else 0 end)::bigint as qlen, sum(case when op = 'S' then len else 0 end)::bigint as sclen from ops group by read_no),
reads as materialized (
  select r.*, qlen, sclen, case when flag & 4 <> 0 then 'unmapped' when flag & 256 <> 0 then 'secondary' when flag & 2048 <> 0 then 'supplementary' else 'primary' end as klass,
    flag & 16 <> 0 as reverse, flag & 32 <> 0 as mate_reverse, flag & 8 <> 0 as mate_unmapped, flag & 64 <> 0 as first, flag & 1 <> 0 as paired,
    (pos + 1)::bigint as s, (pos + span)::bigint as e from listed r join spans using (read_no)),
edges as (
  select *, case when not regexp_matches(cigar, '^[0-9]+[SHI]') and regexp_matches(md, '^0*[1-9]') then 0
      when kinds[1] in ('S', 'H', 'I') and lens[1]::int < 5 and kinds[2] not in ('S', 'H', 'I') and regexp_matches(md, '^0*[1-9]') then lens[1]::int end as begin_event,
    case when not regexp_matches(cigar, '[SHI]$') and try_cast(regexp_extract(md, '([0-9]+)$', 1) as int) > 0 then 0
      when kinds[-1] in ('S', 'H', 'I') and lens[-1]::int < 5 and kinds[-2] not in ('S', 'H', 'I') and try_cast(regexp_extract(md, '([0-9]+)$', 1) as int) > 0 then lens[-1]::int end as finish_event
  from reads where klass = 'primary')
"""


def runs_sql(source: str, keys: str = "sample_name, contig_name", last: str = "") -> str:
    """Runs from rows (keys, s, e, w) by way of every base."""
    return f"""
with {PRELUDE},
src as ({source}),
bases as (select {keys}, unnest(range(s, e + 1)) as p, w from src where s <= e),
depth as materialized (select {keys}, p, sum(w)::bigint as value from bases group by all having sum(w) <> 0){last or f''',
marked as (select *, p - row_number() over (partition by {keys}, value order by p) as g from depth)
select {keys}, min(p) as "start", max(p) as "end", value from marked group by {keys}, value, g'''}
"""


def depth_src(where: str) -> str:
    return f"""select sample_name, contig_name, s, e, 1 as w from reads where {where}
    union all select r.sample_name, r.contig_name, o.ref_start + 1, o.ref_start + o.len, -1 from reads r join ops o using (read_no) where o.op = 'N' and {where}"""


def op_src(kind: str) -> str:
    return f"select r.sample_name, r.contig_name, o.ref_start + 1 as s, o.ref_start + o.len as e, 1 as w from reads r join ops o using (read_no) where o.op = '{kind}' and klass = 'primary'"


def plain_src(where: str) -> str:
    return f"select sample_name, contig_name, s, e, 1 as w from reads where klass = 'primary' and {where}"


SIGNALS = {
    "primary_reads": depth_src("klass = 'primary'"),
    "primary_reads_plus_only": depth_src("klass = 'primary' and not reverse"),
    "primary_reads_minus_only": depth_src("klass = 'primary' and reverse"),
    "secondary_reads": depth_src("klass = 'secondary'"),
    "supplementary_reads": depth_src("klass = 'supplementary'"),
    "mate_not_mapped": plain_src("paired and mate_unmapped"),
    "mate_on_another_contig": plain_src("paired and not mate_unmapped and contig_name <> mate_contig"),
    "non_inward_pairs": plain_src("paired and not mate_unmapped and contig_name = mate_contig and not (reverse <> mate_reverse and abs(tlen) > 0 and abs(tlen) < 10000)"),
    "splicings": op_src("N"),
    "deletions": op_src("D"),
    "coverage_reduced": "select sample_name, contig_name, s, e, 1 as w from edges where case when reverse then finish_event else begin_event end is not null",
}
MEANS = {"mapq": ("klass = 'primary'", "mapq"), "read_lengths": ("klass = 'primary'", "qlen"), "insert_sizes": ("klass = 'primary' and first and tlen > 0", "tlen")}
#: How the SQL rounds to six digits, if not by round(): that takes a mean on a half up or down, as the double nearest to it falls.
HALVES_UP = {"read_lengths": "(sum(x) * 2000000 + count(*)) // (count(*) * 2) / 1e6"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared reads, parsed once in a session: for queries that need the operations of all."""
    return stored(spark, sf_dir, "prepared-reads", lambda: S.prepare(derived(spark, sf_dir, "reads")))


def fresh_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without making the stored table: where no query has, they are prepared as they are asked for, and only the columns
    and reads that are needed are parsed, which takes less than to write and read all."""
    made = if_stored(spark, sf_dir, "prepared-reads")
    return S.prepare(derived(spark, sf_dir, "reads")) if made is None else made


def depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the depth of primary reads, swept once in a session."""
    return stored(spark, sf_dir, "depth-runs", lambda: S.depth_of(derived(spark, sf_dir, "reads")))


for _name, _src in SIGNALS.items():
    query(f"signal_{_name}", runs_sql(_src))(lambda spark, d, n=_name: K.rle(S.signal(fresh_reads(spark, d), n), PAIR, "value").select(*PAIR, "start", "end", F.col("value").cast("long").alias("value")))

for _name, (_where, _what) in MEANS.items():
    query(f"mean_{_name}", f"""
with {PRELUDE},
bases as (select sample_name, contig_name, unnest(range(s, e + 1)) as p, {_what} as x from reads where {_where}),
depth as (select sample_name, contig_name, p, {HALVES_UP.get(_name, "round(sum(x) / count(*), 6)")} as value from bases group by all),
marked as (select *, p - row_number() over (partition by sample_name, contig_name, value order by p) as g from depth)
select sample_name, contig_name, min(p) as "start", max(p) as "end", value from marked group by sample_name, contig_name, value, g
""")(lambda spark, d, n=_name: K.rle(S.mean_signal(fresh_reads(spark, d), n).withColumn("value", F.round("value", 6)), PAIR, "value"))

STATS = "count(*)::bigint as n, round(avg(len), 6) as mean_len, list_sort(list(len))[count(*) // 2 + 1]::bigint as median_len, round(stddev_pop(len), 6) as std_len"
CLIPS = """clips as materialized (
  select sample_name, contig_name, 'left' as side, s as pos, lens[1]::int as len, right(substr(seq, 1, lens[1]::int), 20) as sequence from reads where klass = 'primary' and kinds[1] in ('S', 'H')
  union all select sample_name, contig_name, 'right', e, lens[-1]::int, left(right(seq, lens[-1]::int), 20) from reads where klass = 'primary' and len(kinds) > 1 and kinds[-1] in ('S', 'H'))"""
DEPTH = f"""dsrc as ({depth_src("klass = 'primary'")}),
dbases as (select sample_name, contig_name, unnest(range(s, e + 1)) as pos, w from dsrc where s <= e),
cov as materialized (select sample_name, contig_name, pos, sum(w)::bigint as depth from dbases group by all having sum(w) <> 0)"""
MISMATCH = """md_tokens as (select read_no, seq, unnest(range(1, len(t) + 1)) as i, unnest(t) as t from (select read_no, seq, regexp_extract_all(md, '([0-9]+|\\^[A-Z]+|[A-Z])', 1) as t from reads where klass = 'primary')),
md_placed as (select *, coalesce(sum(case when regexp_matches(t, '^[0-9]+$') then t::int when t[1] = '^' then 0 else 1 end) over (partition by read_no order by i rows between unbounded preceding and 1 preceding), 0)::bigint as k
  from md_tokens),
mm as materialized (select r.sample_name, r.contig_name, o.ref_start + p.k - o.mcol_start + 1 as pos, substr(r.seq, (o.query_start + p.k - o.mcol_start + 1)::int, 1) as base
  from md_placed p join ops o on o.read_no = p.read_no and o.op in ('M', '=', 'X') and p.k >= o.mcol_start and p.k < o.mcol_start + o.len join reads r on r.read_no = p.read_no
  where regexp_matches(p.t, '^[A-Z]$')),
mmc as materialized (select sample_name, contig_name, pos, count(*)::bigint as n, count(*) filter (base = 'A')::bigint as n_a, count(*) filter (base = 'C')::bigint as n_c,
  count(*) filter (base = 'G')::bigint as n_g, count(*) filter (base = 'T')::bigint as n_t from mm group by all)"""


def stored_termini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean read ends by position, counted once in a session."""
    return stored(spark, sf_dir, "read-termini", lambda: S.read_termini(reads(spark, sf_dir)))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


query("insertions", f"with {PRELUDE} select sample_name, contig_name, ref_start as pos, {STATS} from reads r join ops o using (read_no) where op = 'I' and klass = 'primary' group by all")(
    lambda spark, d: longs(rounded(S.insertions(fresh_reads(spark, d)), "mean_len", "std_len"), "pos", "median_len"))
query("deletion_lengths", f"with {PRELUDE} select sample_name, contig_name, ref_start + 1 as pos, {STATS} from reads r join ops o using (read_no) where op = 'D' and klass = 'primary' group by all")(
    lambda spark, d: longs(rounded(S.deletion_lengths(fresh_reads(spark, d)), "mean_len", "std_len"), "pos", "median_len"))
query("clippings", f"with {PRELUDE}, {CLIPS} select sample_name, contig_name, side, pos, {STATS} from clips group by all")(
    lambda spark, d: longs(rounded(S.clippings(fresh_reads(spark, d)), "mean_len", "std_len"), "pos", "median_len"))
query("mismatches", f"with {PRELUDE}, {MISMATCH} select * from mmc")(lambda spark, d: longs(S.mismatches(fresh_reads(spark, d)), "pos"))
query("dominant_base", f"""with {PRELUDE}, {DEPTH}, {MISMATCH},
best as (select *, list_max([{{'n': n_a, 'base': 'A'}}, {{'n': n_c, 'base': 'C'}}, {{'n': n_g, 'base': 'G'}}, {{'n': n_t, 'base': 'T'}}]) as b from mmc)
select sample_name, contig_name, pos, b.base as base, b.n as n, round(b.n / depth, 6) as prevalence from best join cov using (sample_name, contig_name, pos) where b.n > 0 and b.n * 100 >= depth * 10.0""")(
    lambda spark, d: (lambda r: longs(rounded(S.dominant_base(S.mismatches(r), depth_runs(spark, d)), "prevalence"), "pos"))(fresh_reads(spark, d)))
query("dominant_clip_sequence", f"""with {PRELUDE}, {DEPTH}, {CLIPS},
c as (select sample_name, contig_name, side, pos, sequence, count(*)::bigint as k from clips where sequence <> '' group by all),
b as (select *, row_number() over (partition by sample_name, contig_name, side, pos order by k desc, sequence desc) as r from c)
select sample_name, contig_name, side, pos, sequence, k as n, round(k / depth, 6) as prevalence from b join cov using (sample_name, contig_name, pos) where r = 1 and k * 100 >= depth * 10.0""")(
    lambda spark, d: (lambda r: longs(rounded(S.dominant_sequence(S.clip_events(r), depth_runs(spark, d), ("side",)), "prevalence"), "pos"))(fresh_reads(spark, d)))
query("significant_clips", f"""with {PRELUDE}, {DEPTH}, {CLIPS}, c as (select sample_name, contig_name, side, pos, count(*)::bigint as n from clips group by all)
select sample_name, contig_name, side, pos, n, depth, round(n / depth, 6) as prevalence from c join cov using (sample_name, contig_name, pos) where n >= 2 and n * 100 >= depth * 10.0""")(
    lambda spark, d: (lambda r: longs(rounded(S.significant_events(S.clippings(r).select(*PAIR, "side", "pos", "n"), depth_runs(spark, d)), "prevalence"), "pos", "depth"))(fresh_reads(spark, d)))
query("read_termini", f"""with {PRELUDE}, t as (
  select sample_name, contig_name, 'reads_starts' as kind, s as pos, begin_event as ev from edges where not reverse and begin_event is not null
  union all select sample_name, contig_name, 'reads_ends', e, finish_event from edges where reverse and finish_event is not null)
select sample_name, contig_name, kind, pos, count(*)::bigint as n, list_sort(list(ev))[count(*) // 2 + 1]::int as event from t group by all""")(
    lambda spark, d: longs(S.read_termini(reads(spark, d)), "pos"))
query("clipped_ratio", f"""with {PRELUDE}, c as (select sample_name, contig_name, count(*)::bigint as n_primary, sum(case when case when reverse then finish_event else begin_event end is not null then 1 else 0 end)::bigint as n_clean from edges where e >= s group by all)
select *, round(case when n_clean = 0 then 1.0 else greatest(0.0, (n_primary - n_clean) / n_clean) end, 6) as clipped_ratio from c""")(
    lambda spark, d: rounded(S.clipped_ratio(reads(spark, d)), "clipped_ratio"))

COVERAGE = f"""every as (select p.sample_name, p.contig_name, c.contig_length, unnest(range(1, c.contig_length + 1)) as pos from (select distinct sample_name, contig_name from cov) p join contigs c using (contig_name)),
base_depth as materialized (select e.*, coalesce(depth, 0) as d from every e left join cov using (sample_name, contig_name, pos)),
ranked as (select *, row_number() over (partition by sample_name, contig_name order by d, pos) as r, lag(d) over (partition by sample_name, contig_name order by pos) as before from base_depth),
covm as materialized (select sample_name, contig_name, contig_length, 100.0 * count(*) filter (d > 0) / contig_length as aligned_fraction, avg(d) as coverage_mean,
  max(case when r = contig_length // 2 + 1 then d end) as coverage_median,
  avg(case when r > floor(contig_length * 0.05) and r <= contig_length - floor(contig_length * 0.05) then d end) as coverage_trimmed,
  stddev_pop(d) / avg(d) as coverage_cv, sqrt(sum((d - before) * (d - before)) / (contig_length - 1)) / avg(d) as coverage_roughness
  from ranked group by sample_name, contig_name, contig_length)"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage_metrics(depth_runs(spark, d), derived(spark, d, "contigs"))


query("coverage_metrics", f"""with {PRELUDE}, {DEPTH}, {COVERAGE}
select sample_name, contig_name, contig_length, round(aligned_fraction, 6) as aligned_fraction, round(100 * (1 - exp(-0.883 * coverage_mean)), 6) as expected_fraction, round(coverage_mean, 6) as coverage_mean,
 coverage_median::bigint as coverage_median, round(coverage_trimmed, 6) as coverage_trimmed, round(coverage_cv, 6) as coverage_cv, round(coverage_roughness, 6) as coverage_roughness from covm""")(
    lambda spark, d: rounded(coverage(spark, d), "aligned_fraction", "expected_fraction", "coverage_mean", "coverage_trimmed", "coverage_cv", "coverage_roughness").withColumn("coverage_median", F.col("coverage_median").cast("long")))


@query("abundance", f"""with {PRELUDE}, {DEPTH}, {COVERAGE},
present as (select sample_name, contig_name from covm where aligned_fraction >= 50),
counts as (select sample_name, contig_name, count(*)::bigint as read_count from reads where klass = 'primary' group by all),
own as (select * from counts join present using (sample_name, contig_name)),
totals as (select sample_name, sum(read_count)::bigint as n_mapped from own group by all),
r as (select sample_name, contig_name, read_count, read_count * 1e9 / (contig_length * n_mapped) as rpkm from own join totals using (sample_name) join contigs using (contig_name))
select sample_name, contig_name, read_count, round(rpkm, 4) as rpkm, round(rpkm / sum(rpkm) over (partition by sample_name) * 1e6, 4) as tpm from r""")
def abundance(spark: SparkSession, d: str) -> DataFrame:
    """Alignments to depth, presence, RPKM and TPM: the flagship."""
    r = fresh_reads(spark, d)
    contigs = derived(spark, d, "contigs")
    present = M.present_pairs(M.coverage_metrics(depth_runs(spark, d), contigs))
    counts = M.read_counts(r).join(present, PAIR, "left_semi")
    totals = counts.groupBy("sample_name").agg(F.sum("read_count").alias("n_mapped"))
    return rounded(M.rpkm_tpm(counts, contigs, totals), "rpkm", "tpm", digits=4).orderBy(F.col("tpm").desc(), *PAIR)


query("sample_totals", f"with {PRELUDE} select sample_name, count(*) filter (klass = 'primary')::bigint as n_mapped, count(*) filter (klass in ('primary', 'unmapped'))::bigint as n_reads from reads group by all")(
    lambda spark, d: M.sample_totals(fresh_reads(spark, d)))
query("sequencing_type", f"""with {PRELUDE}, o as (select sample_name, case when qlen > 1000 then 'long' when paired then 'paired-short' end as says, row_number() over (partition by sample_name order by read_id) as k from reads where klass <> 'unmapped')
select sample_name, coalesce(arg_min(says, k) filter (says is not null), 'single-short') as sequencing_type from o where k <= 100 group by all""")(
    lambda spark, d: M.sequencing_type(fresh_reads(spark, d)))
query("missing_md_samples", f"""with {PRELUDE}, o as (select sample_name, case when sample_name <> 'RF' then md end as md, row_number() over (partition by sample_name order by read_id) as k from reads where klass = 'primary')
select sample_name from o where k <= 10 group by all having bool_and(coalesce(md, '') = '')""")(lambda spark, d: M.missing_md_samples(fresh_reads(spark, d).withColumn("md", F.when(F.col("sample_name") != "RF", F.col("md")))))
query("contig_sample_counts", f"with {PRELUDE} select contig_name, count(distinct sample_name)::bigint as n_samples from reads where klass = 'primary' group by all")(
    lambda spark, d: M.sample_counts(M.read_counts(fresh_reads(spark, d)), "contig_name"))
query("filter_reads", f"with {PRELUDE} select read_id, sample_name, contig_name from reads where klass <> 'unmapped' and (qlen - nm) * 100 >= 90 * qlen and (qlen - sclen) * 100 >= 92 * qlen")(
    lambda spark, d: M.filter_reads(fresh_reads(spark, d).filter("klass <> 'unmapped'"), 90, 92).select("read_id", *PAIR))
query("filter_report", f"""with {PRELUDE} select sample_name, count(*)::bigint as n, count(*) filter ((qlen - nm) * 100 < 90 * qlen)::bigint as low_identity, count(*) filter ((qlen - sclen) * 100 < 92 * qlen)::bigint as low_aligned,
 count(*) filter ((qlen - nm) * 100 < 90 * qlen or (qlen - sclen) * 100 < 92 * qlen)::bigint as excluded from reads where klass <> 'unmapped' group by all""")(
    lambda spark, d: M.filter_report(fresh_reads(spark, d).filter("klass <> 'unmapped'"), 90, 92))


def topology_sql(circular: bool, window: int) -> str:
    """Every read judged by itself, medians from sorted lists."""
    other = "(flag & 2 <> 0 or same and not mate_unmapped)" if circular else "(paired and same and not mate_unmapped and not proper)"
    past = "(e > n and s <= n)" if circular else "false"
    none = "0" if circular else "null"
    median = lambda x: f"(list_sort({x})[(len({x}) - 1) // 2 + 1] + list_sort({x})[len({x}) // 2 + 1]) / 2.0"
    return f"""
with {PRELUDE}, {DEPTH},
o as (select r.*, contig_length as n, abs(tlen) as t, contig_name = mate_contig as same, least(e - contig_length, contig_length - pos) as shorter,
    paired and contig_name = mate_contig and reverse <> mate_reverse and abs(tlen) between 1 and 9999 as proper, greatest(contig_length - {window}, 0) as edge
  from reads r join short_contigs using (contig_name) where klass = 'primary'),
j as (select *, {past} as past, paired and first and (pos < {window} and mate_pos >= edge or pos >= edge and mate_pos < {window}) and {other} as joins from o),
g as (select sample_name, contig_name, count(*) filter (past) as k, coalesce(bool_or(past and shorter >= 20), false) as sure, list(shorter) filter (past) as sides,
    count(*) filter (joins)::bigint as inserts, list({"t" if circular else "abs(n - t)"}) filter (joins) as sizes, list(t) filter (proper and first) as usual from j group by all),
first_d as (select sample_name, contig_name, depth as fd from cov where pos = 1),
last_d as (select sample_name, contig_name, depth as ld from cov join short_contigs using (contig_name) where pos = contig_length),
d as (select g.*, (coalesce(fd, 0) + coalesce(ld, 0)) / 2.0 as depth from g left join first_d using (sample_name, contig_name) left join last_d using (sample_name, contig_name))
select sample_name, contig_name, (case when sure then k else {none} end)::double as circularising_reads,
  (case when sure and depth > 0 then round(100 * k / depth) else {none} end)::double as circularising_prevalence,
  (case when sure then floor({median("sides")}) end)::double as median_overlap, (case when inserts > 0 then inserts end)::double as circularising_inserts,
  round({median("sizes")} - {median("usual")})::double as insert_size_deviation
from d"""


def topology(spark: SparkSession, d: str, circular: bool, window: int) -> DataFrame:
    contigs = derived(spark, d, "short_contigs")
    out = M.topology(M.contig_ends(fresh_reads(spark, d), contigs, circular, window=window), M.edge_depth(depth_runs(spark, d), contigs), circular)
    return out.withColumns({c: F.col(c).cast("double") for c in out.columns if c not in PAIR})


query("topology", topology_sql(True, 100))(lambda spark, d: topology(spark, d, True, 100))
query("topology_linear", topology_sql(False, 400))(lambda spark, d: topology(spark, d, False, 400))

POSITIONS = """positions as (
  select sample_name, contig_name, 'mismatch' as kind, pos, n / depth as prevalence, 1 as median_len from mmc join cov using (sample_name, contig_name, pos)
  union all select sample_name, contig_name, 'insertion', pos, n / depth, median_len from (select sample_name, contig_name, ref_start as pos, count(*) as n, (list_sort(list(len))[(count(*) - 1) // 2 + 1] + list_sort(list(len))[count(*) // 2 + 1]) // 2 as median_len from reads r join ops o using (read_no) where op = 'I' and klass = 'primary' group by all) join cov using (sample_name, contig_name, pos)
  union all select sample_name, contig_name, 'deletion', pos, n / depth, median_len from (select sample_name, contig_name, ref_start + 1 as pos, count(*) as n, (list_sort(list(len))[(count(*) - 1) // 2 + 1] + list_sort(list(len))[count(*) // 2 + 1]) // 2 as median_len from reads r join ops o using (read_no) where op = 'D' and klass = 'primary' group by all) join cov using (sample_name, contig_name, pos)
  union all select sample_name, contig_name, 'clipping', pos, n / depth, median_len from (select sample_name, contig_name, pos, count(*) as n, (list_sort(list(len))[(count(*) - 1) // 2 + 1] + list_sort(list(len))[count(*) // 2 + 1]) // 2 as median_len from clips group by all) join cov using (sample_name, contig_name, pos)),
burden as (select sample_name, contig_name, count(*) filter (kind = 'mismatch')::bigint as mismatch_count, count(*) filter (kind = 'deletion')::bigint as deletion_count, count(*) filter (kind = 'insertion')::bigint as insertion_count,
  count(*) filter (kind = 'clipping')::bigint as clipping_count, sum(case when kind = 'mismatch' then 1 else median_len end)::bigint as bases from positions where prevalence >= 0.1 group by all)"""


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Per-position variants of all kinds with their share of the depth; left and right clips at a base count together."""
    stats = S.length_stats(S.variants(derived(spark, d, "reads")), "kind", "pos")
    rows = stats.select(*PAIR, "kind", "pos", "n", F.col("mid_len").alias("median_len"))
    return S.depth_at(rows, depth_runs(spark, d)).withColumn("prevalence", F.col("n") / F.col("depth"))


query("microdiversity", f"with {PRELUDE}, {DEPTH}, {MISMATCH}, {CLIPS}, {POSITIONS} select * from burden")(lambda spark, d: M.variant_burden(positions(spark, d), 0.1))
query("microdiversity_per_100kbp", f"with {PRELUDE}, {DEPTH}, {MISMATCH}, {CLIPS}, {POSITIONS} select sample_name, contig_name, round(mismatch_count * 100000.0 / contig_length, 4) as mismatch_count_per_100kbp, round(bases * 100000.0 / contig_length, 4) as bases_per_100kbp from burden join contigs using (contig_name)")(
    lambda spark, d: rounded(M.per_100kbp(M.variant_burden(positions(spark, d), 0.1), derived(spark, d, "contigs"), ["mismatch_count", "bases"]), "mismatch_count_per_100kbp", "bases_per_100kbp", digits=4))
CLIP_PREV = """cp as (select sample_name, contig_name, side, pos, n / depth as prevalence, median_len from (select sample_name, contig_name, side, pos, count(*) as n, (list_sort(list(len))[(count(*) - 1) // 2 + 1] + list_sort(list(len))[count(*) // 2 + 1]) // 2 as median_len from clips group by all) join cov using (sample_name, contig_name, pos))"""


#: Right clips are on secondary and supplementary reads only; with all mapped reads there are clips on both sides.
ALL_CLIPS = CLIPS.replace("klass = 'primary'", "klass <> 'unmapped'")


def clip_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Clips of all mapped reads, with their share of the depth of primary ones."""
    r = fresh_reads(spark, d).withColumn("klass", F.when(F.col("klass") == "unmapped", "unmapped").otherwise("primary"))
    clips = S.length_stats(S.clip_events(r), "side", "pos").drop("median_len").withColumnRenamed("mid_len", "median_len")
    return S.depth_at(clips, depth_runs(spark, d)).withColumn("prevalence", F.col("n") / F.col("depth"))


query("paired_clip_span", f"""with {PRELUDE}, {DEPTH}, {ALL_CLIPS}, {CLIP_PREV}, l as (select *, lead(side) over w as ns, lead(pos) over w as np, lead(prevalence) over w as nv from cp window w as (partition by sample_name, contig_name order by pos, case when side = 'right' then 0 else 1 end))
select sample_name, contig_name, sum(np - pos)::bigint as span from l where side = 'right' and ns = 'left' and prevalence >= 0.04 and nv >= 0.04 group by all""")(
    lambda spark, d: M.paired_clip_span(clip_prevalence(spark, d), 0.04))
SIDE = f"""{CLIP_PREV},
sc as (select * from cp join short_contigs using (contig_name) where prevalence >= 0.05),
sl as (select * from (select *, row_number() over (partition by sample_name, contig_name order by prevalence desc, pos desc) as k from sc where side = 'left' and median_len > pos - 1) where k = 1),
sr as (select * from (select *, row_number() over (partition by sample_name, contig_name order by prevalence desc, pos desc) as k from sc where side = 'right' and median_len > contig_length - pos) where k = 1),
sides as (select coalesce(l.sample_name, r.sample_name) as sample_name, coalesce(l.contig_name, r.contig_name) as contig_name,
    l.pos::double as left_pos, l.prevalence as left_prevalence, l.median_len::double as start_collapse_bp, (l.pos - 1)::double as start_expansion_bp,
    r.pos::double as right_pos, r.prevalence as right_prevalence, r.median_len::double as end_collapse_bp, (r.contig_length - r.pos)::double as end_expansion_bp
  from sl l full join sr r on l.sample_name = r.sample_name and l.contig_name = r.contig_name)"""
SIDE_COLUMNS = ("left_pos", "start_collapse_bp", "start_expansion_bp", "right_pos", "end_collapse_bp", "end_expansion_bp")


def side_misassembly(spark: SparkSession, d: str) -> DataFrame:
    out = M.side_misassembly(clip_prevalence(spark, d), derived(spark, d, "short_contigs"), 0.05)
    return out.withColumns({c: F.col(c).cast("double") for c in SIDE_COLUMNS})


query("side_misassembly", f"""with {PRELUDE}, {DEPTH}, {ALL_CLIPS}, {SIDE}
select * replace (round(left_prevalence, 6) as left_prevalence, round(right_prevalence, 6) as right_prevalence) from sides""")(
    lambda spark, d: rounded(side_misassembly(spark, d), "left_prevalence", "right_prevalence"))
query("read_termini_long", f"""with {PRELUDE}, t as (
  select sample_name, contig_name, 'reads_starts' as kind, s as pos, begin_event as ev from edges where begin_event is not null
  union all select sample_name, contig_name, 'reads_ends', e, finish_event from edges where finish_event is not null)
select sample_name, contig_name, kind, pos, count(*)::bigint as n, list_sort(list(ev))[count(*) // 2 + 1]::int as event from t group by all""")(
    lambda spark, d: longs(S.read_termini(reads(spark, d), long_reads=True), "pos"))
query("coverage_reduced_long", runs_sql("""select sample_name, contig_name, case when begin_event is not null then s else (s + e) // 2 end as s,
    case when finish_event is not null then e else (s + e) // 2 end as e, 1 as w from edges where begin_event is not null or finish_event is not null"""))(
    lambda spark, d: K.rle(S.coverage_reduced(reads(spark, d), long_reads=True), PAIR, "value").select(*PAIR, "start", "end", F.col("value").cast("long").alias("value")))
query("clipped_ratio_long", f"""with {PRELUDE}, c as (select sample_name, contig_name, count(*)::bigint as n_primary, sum((begin_event is not null)::int + (finish_event is not null)::int)::bigint as n_clean from edges where e >= s group by all)
select *, round(case when n_clean = 0 then 1.0 else greatest(0.0, (2 * n_primary - n_clean) / n_clean) end, 6) as clipped_ratio from c""")(
    lambda spark, d: rounded(S.clipped_ratio(reads(spark, d), long_reads=True), "clipped_ratio"))
