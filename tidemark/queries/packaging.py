"""Registered queries on packaging termini, read normalisation, smoothing and bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, oracle, stored
from ..operators import circular as C
from ..operators import genome as G
from ..operators import packaging as P
from ..operators import signals as S
from .genome import rounded
from .signals import ALL_CLIPS, PRELUDE, SIGNALS, longs, reads, stored_termini

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LEAST = 3  # ends at a position; the derived reads are thin


def rings(spark: SparkSession, d: str) -> DataFrame:
    """Contigs as long as the reads reach, every other one circular."""
    return derived(spark, d, "short_contigs").withColumn("contig_length", F.col("contig_length") + 50).withColumn("circular", F.substring("contig_name", 4, 9).cast("int") % 2 == 0)


TERMINI = f"""with {PRELUDE},
src as ({SIGNALS['coverage_reduced']}),
based as (select sample_name, contig_name, unnest(range(s, e + 1)) as pos from src where s <= e),
cov as materialized (select sample_name, contig_name, pos, count(*) as depth from based group by all),
term as materialized (select sample_name, contig_name, case when reverse then 'reads_ends' else 'reads_starts' end as kind, case when reverse then e else s end as pos, count(*) as n
  from edges where (case when reverse then finish_event else begin_event end) is not null group by all),
cand as materialized (select term.*, depth from term join cov using (sample_name, contig_name, pos) where n >= {LEAST} and n >= floor(depth * 0.1)),
rings as (select contig_name, contig_length + 50 as contig_length, substr(contig_name, 4)::int % 2 = 0 as circular from short_contigs),
marked as (select *, case when pos - lag(pos) over w <= 20 then 0 else 1 end as new from cand window w as (partition by sample_name, contig_name, kind order by pos)),
numbered as (select *, sum(new) over (partition by sample_name, contig_name, kind order by pos) as island from marked),
edge as (select sample_name, contig_name, kind, min(pos) as lo, max(pos) as hi, max(island) as areas from numbered group by all),
ringed as (select n.*, contig_length, circular, circular and areas > 1 and lo + contig_length - hi <= 20 as joins, areas from numbered n join edge using (sample_name, contig_name, kind) join rings using (contig_name)),
placed as (select *, case when joins and island = areas then 1 else island end as ring, joins and island = areas as late, joins and island in (1, areas) as wraps from ringed),
areas as materialized (select sample_name, contig_name, kind, contig_length, circular, coalesce(min(pos) filter (late), min(pos)) as "start", coalesce(max(pos) filter (wraps and not late), max(pos)) as "end",
  arg_max(pos, n * 1000000 - pos) as center, sum(n)::bigint as spc, count(*)::bigint as peaks, arg_max(n / depth, n * 1000000 - pos) as tau from placed group by sample_name, contig_name, kind, contig_length, circular, ring)
"""
SQL["terminus_candidates"] = TERMINI + "select sample_name, contig_name, kind, pos, n, depth::bigint as depth from cand"
SQL["peak_areas"] = TERMINI + 'select sample_name, contig_name, kind, "start", "end", center, spc, peaks, round(tau, 6) as tau from areas'
POISSON = TERMINI + """, ends as (select sample_name, contig_name, kind, sum(n) as all_ends from term group by all), total as (select sample_name, contig_name, sum(depth) as all_depth from cov group by all),
inside as (select a.sample_name, a.contig_name, a.kind, a.center, sum(depth) as area_depth from areas a join cov c on c.sample_name = a.sample_name and c.contig_name = a.contig_name
  and case when a."start" <= a."end" then c.pos between a."start" and a."end" else c.pos <= a."end" or c.pos between a."start" and a.contig_length end group by all),
tested as (select *, area_depth * all_ends / all_depth as expected, count(*) over (partition by sample_name, contig_name, kind) as k from areas left join inside using (sample_name, contig_name, kind, center) join ends using (sample_name, contig_name, kind) join total using (sample_name, contig_name)),
valued as (select *, least(1.0, k * greatest(0.0, 1 - list_sum(list_transform(range(0, spc), lambda i: exp(i * ln(expected) - expected - lgamma(i + 1)))))) as p from tested)
"""
SQL["poisson_test"] = POISSON + "select sample_name, contig_name, kind, center, round(expected, 6) as expected, round(p, 6) as p_value, p <= 0.05 as significant from valued"
# Each area with the clips around it, the event lengths inside it, and the repeats it lies in.
TESTED = POISSON + """,
spots as (select distinct contig_name, least(p1, p2) > least(p1x, p2x) as swap, is_direct, least(p1, p2) as a1, greatest(p1, p2) as a2, least(p1x, p2x) as b1, greatest(p1x, p2x) as b2
  from ({REPEATS}) join rings using (contig_name) where least(p1, p2, p1x, p2x) <= 100 and greatest(p1, p2, p1x, p2x) > contig_length - 100 and pident >= 87),
copies as materialized (select distinct contig_name, case when swap then b1 else a1 end as fs, case when swap then b2 else a2 end as fe, case when swap then a1 else b1 end as ss, case when swap then a2 else b2 end as se, is_direct from spots),
{CLIPS},
clip_n as materialized (select sample_name, contig_name, case side when 'left' then 'reads_starts' else 'reads_ends' end as kind, pos, count(*) as n from clips where len >= 2 group by all),
clip_in as (select n.*, row_number() over (partition by sample_name, contig_name, kind, pos order by fs, fe, ss, se) as i, case when pos between fs and fe then pos - fs + ss else pos - ss + fs end as partner
  from clip_n n join copies using (contig_name) where is_direct and (pos between fs and fe or pos between ss and se)),
alone as (select * from clip_in c where i = 1 and not exists (select 1 from clip_n o where o.sample_name = c.sample_name and o.contig_name = c.contig_name and o.kind = c.kind and o.pos = c.partner)),
strong as (select n.* from clip_n n join cov using (sample_name, contig_name, pos) where n.n >= 2 and n.n >= floor(depth * 0.1)
  and not exists (select 1 from alone a where a.sample_name = n.sample_name and a.contig_name = n.contig_name and a.kind = n.kind and a.pos = n.pos)),
near_clips as (select v.sample_name, v.contig_name, v.kind, v.center, sum(c.n) as clips from valued v join strong c on c.sample_name = v.sample_name and c.contig_name = v.contig_name and c.kind = v.kind
  and case when "start" > "end" then pos >= "start" - 20 or pos <= "end" + 20
    when circular then pos between "start" - 20 and "end" + 20 or pos >= "start" - 20 + contig_length or pos <= "end" + 20 - contig_length else pos between "start" - 20 and "end" + 20 end and pos <= contig_length group by all),
events as (select sample_name, contig_name, case when reverse then 'reads_ends' else 'reads_starts' end as kind, case when reverse then e else s end as pos, list(case when reverse then finish_event else begin_event end) as l
  from edges where (case when reverse then finish_event else begin_event end) is not null group by all),
clip_mid as (select v.sample_name, v.contig_name, v.kind, v.center, median(list_sort(l)[len(l) // 2 + 1]) as median_clip from valued v join events c on c.sample_name = v.sample_name and c.contig_name = v.contig_name and c.kind = v.kind
  and case when "start" > "end" then pos >= "start" or pos <= "end" else pos between "start" and "end" end group by all),
share as (select sample_name, contig_name, count(*) as reads_, sum(case when case when reverse then finish_event else begin_event end is not null then 1 else 0 end) as clean from edges where e >= s group by all),
judged as materialized (select v.*, coalesce(clips, 0) as clips, coalesce(median_clip, 0) as median_clip, (case when clean = 0 then 1.0 else greatest(0.0, (reads_ - clean) / clean) end) * spc as wanted
  from valued v left join near_clips using (sample_name, contig_name, kind, center) left join clip_mid using (sample_name, contig_name, kind, center) left join share using (sample_name, contig_name)),
marked2 as materialized (select *, clips <= wanted or (wanted > 0 and (clips - wanted) / sqrt(wanted) <= 1.6448536) as clip_ok from judged)
""".replace("{REPEATS}", oracle("repeats")).replace("{CLIPS}", ALL_CLIPS)
SQL["area_tests"] = TESTED + "select sample_name, contig_name, kind, center, clips::bigint as clips, clip_ok, median_clip::double as median_clip from marked2"
SQL["packaging_mechanisms"] = TESTED.replace("with ", "with recursive ", 1) + """,
good as materialized (select * from marked2 where p <= 0.05 and clip_ok),
inside_copy as (select sample_name, contig_name, kind, center, arg_min(is_direct, {'a': fs, 'b': fe, 'c': ss, 'd': se, 'e': is_direct}) as direct from good join copies using (contig_name) where center between fs and fe or center between ss and se group by all),
moved as (select sample_name, contig_name, kind, center, arg_min(center - ss + fs, {'a': fs, 'b': fe, 'c': ss, 'd': se}) as place from good join copies using (contig_name) where is_direct and center between ss and se group by all),
lined as materialized (select *, row_number() over (partition by sample_name, contig_name, kind order by place, center) as i
  from (select g.*, coalesce(place, center) as place, direct from good g left join moved using (sample_name, contig_name, kind, center) left join inside_copy using (sample_name, contig_name, kind, center))),
walk as (
  select sample_name, contig_name, kind, i, place as last, true as keep from lined where i = 1
  union all select l.sample_name, l.contig_name, l.kind, l.i, case when l.place - w.last > 20 then l.place else w.last end, l.place - w.last > 20
  from walk w join lined l on l.sample_name = w.sample_name and l.contig_name = w.contig_name and l.kind = w.kind and l.i = w.i + 1),
kept as materialized (select l.* from lined l join walk w using (sample_name, contig_name, kind, i) where keep),
sums as (select sample_name, contig_name, contig_length, circular, count(*) filter (kind = 'reads_starts') as starts, count(*) filter (kind = 'reads_ends') as ends,
  min(center) filter (kind = 'reads_starts') as a, min(center) filter (kind = 'reads_ends') as b, bool_and(coalesce(direct, false)) as dtr, bool_and(coalesce(not direct, false)) as itr from kept group by all),
far as (select *, case when starts = 1 and ends = 1 then case when circular then least(abs(b - a), contig_length - abs(b - a)) else abs(b - a) end end as distance from sums),
facing as (select sample_name, contig_name, arg_min(fe - fs + 1, {'a': fs, 'b': fe, 'c': ss, 'd': se}) as size from far join copies using (contig_name)
  where not is_direct and (a between fs and fe and b between ss and se or a between ss and se and b between fs and fe) group by all),
sided as (select far.*, f.size, case when (case when circular then (b - a + contig_length) % contig_length <> distance else b < a end) then '_3''' else '_5''' end as side from far left join facing f using (sample_name, contig_name)),
centers as (select sample_name, contig_name, coalesce(string_agg(center::varchar, ',' order by center) filter (kind = 'reads_starts'), '') as start_centers,
  coalesce(string_agg(center::varchar, ',' order by center) filter (kind = 'reads_ends'), '') as end_centers, sum(peaks)::bigint as total_peaks from good group by all)
select sample_name, contig_name, case when distance <= 20 and size is not null then 'ITR_' || case when size <= 1000 then 'short' when size <= floor(contig_length * 0.1) then 'long' else 'outlier' end || side
  when distance < 2 then 'COS' when distance <= 20 then 'COS' || side
  when distance is not null then 'DTR_' || case when distance <= 1000 then 'short' when distance <= floor(contig_length * 0.1) then 'long' else 'outlier' end || side
  when starts + ends = 1 then 'PAC' else 'Unknown_packaging' end as mechanism, distance::double as distance, case when dtr then 'DTR' when itr then 'ITR' end as duplication, start_centers, end_centers, total_peaks
from sided join centers using (sample_name, contig_name)"""


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = reads(spark, d)
    termini, reduced = stored_termini(spark, d), stored(spark, d, "reduced-runs", lambda: S.coverage_reduced(r))
    return termini, reduced, P.terminus_candidates(termini, reduced, least=LEAST)


def terminus_candidates(spark: SparkSession, d: str) -> DataFrame:
    return longs(candidates(spark, d)[2].select(*P.SIDE, "pos", "n", "depth"), "pos", "depth")


def peak_areas(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(P.peak_areas(candidates(spark, d)[2], rings(spark, d)), "tau").drop("contig_length", "circular"), "start", "end", "center")


def tested(spark: SparkSession, d: str) -> DataFrame:
    termini, reduced, found = candidates(spark, d)
    return P.poisson_test(P.peak_areas(found, rings(spark, d)), termini, reduced)


def poisson_test(spark: SparkSession, d: str) -> DataFrame:
    return longs(rounded(tested(spark, d).select(*P.SIDE, "center", "expected", "p_value", "significant"), "expected", "p_value"), "center")


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Areas with both tests and the median clip, and the terminal repeats. Clips of all mapped reads are used, as only those
    lie on both sides; thresholds fit the thin derived reads."""
    r = reads(spark, d)
    termini, reduced, _ = candidates(spark, d)
    terminal = G.terminal_repeats(derived(spark, d, "repeats"), rings(spark, d), 100, 87.0)
    regions = P.repeat_regions(terminal)
    every = r.withColumn("klass", F.when(F.col("klass") == "unmapped", "unmapped").otherwise("primary"))
    clips = S.clip_events(every).withColumn("kind", F.when(F.col("side") == "left", "reads_starts").otherwise("reads_ends"))
    sure = P.confirm_dtr_clips(clips.filter("len >= 2").select(*P.SIDE, "pos").distinct(), regions)
    clips = clips.join(sure, [*P.SIDE, "pos"], "left_semi").drop("kind")
    areas = P.area_clippings(tested(spark, d), clips, reduced, least=2, length=2)
    return P.area_median_clip(P.clipping_test(areas, S.clipped_ratio(r)), termini), regions


def area_tests(spark: SparkSession, d: str) -> DataFrame:
    out = judged(spark, d)[0].select(*P.SIDE, "center", "clips", "clip_ok", F.col("median_clip").cast("double").alias("median_clip"))
    return longs(out, "center", "clips")


def packaging_mechanisms(spark: SparkSession, d: str) -> DataFrame:
    """Mechanisms from the areas that pass both tests, each place in a direct repeat once."""
    areas, regions = judged(spark, d)
    kept = areas.filter("significant and clip_ok")
    unique = P.dedupe_dtr_areas(kept, regions, gap=20)
    return P.explicit_mechanisms(kept, P.classify_packaging(unique)).withColumn("distance", F.col("distance").cast("double"))


GENES = f"""genes as (select contig_name, "start", "end" from ({oracle('annotations')}) where product like '%URGENT%'),
near as (select g2.sample_name, g2.contig_name, min(case when circular and d > 0 then least(d, contig_length - d) else d end) as terminase_distance
  from (select k.*, greatest(g."start" - center, center - g."end", 0) as d from good k join genes g using (contig_name)) g2 group by all)"""
_MECHANISMS = SQL["packaging_mechanisms"].rpartition("\nselect sample_name, contig_name, case")
SQL["terminase_distances"] = _MECHANISMS[0] + f""",
{GENES}
select sample_name, contig_name, terminase_distance::bigint as terminase_distance, round(terminase_distance / contig_length * 100)::int as terminase_percentage from near join sums using (sample_name, contig_name)"""
SQL["termini_view"] = _MECHANISMS[0] + f""",
{GENES}, mech as (select sample_name, contig_name, case{_MECHANISMS[2]})
select m.sample_name, m.contig_name, m.kind, m."start"::bigint as "start", m."end"::bigint as "end", m.center::bigint as center, m.clips::bigint as clips, m.clip_ok, m.p <= 0.05 as significant, mechanism, duplication, terminase_distance::bigint as terminase_distance
from marked2 m join mech using (sample_name, contig_name) left join near using (sample_name, contig_name)"""


def mechanisms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Areas with their tests, the mechanisms, and the distances to terminases: genes whose product is URGENT stand for these."""
    areas, regions = judged(spark, d)
    kept = areas.filter("significant and clip_ok")
    unique = P.dedupe_dtr_areas(kept, regions, gap=20)
    genes = derived(spark, d, "annotations").filter(F.contains("product", F.lit("URGENT")))
    return areas, P.explicit_mechanisms(kept, P.classify_packaging(unique)), P.terminase_distances(kept, genes, rings(spark, d))


def terminase_distances(spark: SparkSession, d: str) -> DataFrame:
    return longs(mechanisms(spark, d)[2], "terminase_distance")


def termini_view(spark: SparkSession, d: str) -> DataFrame:
    out = P.termini_view(*mechanisms(spark, d))
    return longs(out.select(*P.SIDE, "start", "end", "center", "clips", "clip_ok", "significant", "mechanism", "duplication", "terminase_distance"), "start", "end", "center", "clips", "terminase_distance")


SQL["template_lengths"] = f"""with {PRELUDE}, rings as (select contig_name, contig_length + 50 as n, substr(contig_name, 4)::int % 2 = 0 as circular from short_contigs)
select sample_name, contig_name, count(*)::bigint as n, sum(case when circular then ((mate_pos - pos) % n + n) % n else abs(tlen) end)::bigint as template_sum,
  sum(case when circular then least(abs(pos % n - mate_pos % n), n - abs(pos % n - mate_pos % n)) else abs(pos - mate_pos) end)::bigint as apart_sum
from reads join rings using (contig_name) where paired and not mate_unmapped and contig_name = mate_contig group by all"""


def template_lengths(spark: SparkSession, d: str) -> DataFrame:
    return longs(C.template_lengths(reads(spark, d), rings(spark, d)), "template_sum", "apart_sum")


QUERIES |= {f.__name__: f for f in (terminus_candidates, peak_areas, poisson_test, area_tests, packaging_mechanisms, terminase_distances, termini_view, template_lengths)}
