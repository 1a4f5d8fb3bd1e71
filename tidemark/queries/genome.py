"""Registered queries on sequences, annotations, repeats, bins and the query side, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..driver import derived, oracle
from ..functions import sequence as Q
from ..functions import text as T
from ..operators import genome as G
from ..operators import kernels as K
from ..operators import query as V
from . import signals as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(name: str) -> str:
    return f"{name} as materialized ({oracle(name)})"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


WIN = lambda size: f"win as (select contig_name, w as \"window\", substr(seq, (w * {size} + 1)::int, {size}) as s from (select contig_name, seq, unnest(range(0, (length(seq) + {size} - 1) // {size})) as w from sequences))"
COUNT = lambda letters, col="s": f"length(regexp_replace({col}, '[^{letters}]', '', 'g'))"

query("gc_windows", f"with {base('sequences')}, {WIN(500)} select contig_name, \"window\"::int as \"window\", (case when {COUNT('ACGT')} = 0 then 50 else round(100.0 * {COUNT('GC')} / {COUNT('ACGT')}) end)::int as gc from win")(
    lambda spark, d: G.gc_windows(derived(spark, d, "sequences")))
query("gc_skew_windows", f"with {base('sequences')}, {WIN(1000)} select contig_name, \"window\"::int as \"window\", round(case when {COUNT('GC')} = 0 then 0.0 else ({COUNT('G')} - {COUNT('C')}) / {COUNT('GC')} end, 6) as skew from win")(
    lambda spark, d: rounded(G.skew_windows(derived(spark, d, "sequences")), "skew"))
query("gc_stats", f"""with {base('sequences')}, {WIN(500)}, g as (select contig_name, (case when {COUNT('ACGT')} = 0 then 50 else round(100.0 * {COUNT('GC')} / {COUNT('ACGT')}) end)::int as gc from win),
win2 as ({WIN(1000)[len('win as ('):-1]}), k as (select contig_name, case when {COUNT('GC')} = 0 then 0.0 else ({COUNT('G')} - {COUNT('C')}) / {COUNT('GC')} end as skew from win2),
a as (select contig_name, avg(gc) as m, stddev_pop(gc) as sd from g group by all), b as (select contig_name, max(skew) - min(skew) as amp, 100.0 * count(*) filter (skew > 0) / count(*) as p from k group by all)
select contig_name, round(m, 6) as gc_mean, round(sd, 6) as gc_sd, round(amp, 6) as skew_amplitude, round(p, 6) as positive_skew_pct from a join b using (contig_name)""")(
    lambda spark, d: (lambda s: rounded(G.gc_stats(G.gc_windows(s), G.skew_windows(s)), "gc_mean", "gc_sd", "skew_amplitude", "positive_skew_pct"))(derived(spark, d, "sequences")))
query("nucleotides", f"with {base('sequences')} select contig_name, substr(seq, 150, 700) as seq from sequences where length(seq) >= 150")(
    lambda spark, d: G.nucleotides(G.chunked(derived(spark, d, "sequences"), 100), 150, 849, 100).filter("seq <> ''"))
query("revcomp", f"with {base('sequences')} select contig_name, reverse(translate(regexp_replace(upper(seq), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) as rc from sequences")(
    lambda spark, d: derived(spark, d, "sequences").select("contig_name", Q.revcomp(F.col("seq")).alias("rc")))
#: The twins have a genetic code of their own: fixed values, the codons of each amino acid.
BY_AMINO = {
    "F": "TTT TTC", "L": "TTA TTG CTT CTC CTA CTG", "I": "ATT ATC ATA", "M": "ATG", "V": "GTT GTC GTA GTG", "S": "TCT TCC TCA TCG AGT AGC", "P": "CCT CCC CCA CCG",
    "T": "ACT ACC ACA ACG", "A": "GCT GCC GCA GCG", "Y": "TAT TAC", "*": "TAA TAG TGA", "H": "CAT CAC", "Q": "CAA CAG", "N": "AAT AAC", "K": "AAA AAG", "D": "GAT GAC",
    "E": "GAA GAG", "C": "TGT TGC", "W": "TGG", "R": "CGT CGC CGA CGG AGA AGG", "G": "GGT GGC GGA GGG",
}
CODE_TABLE = "code as materialized (select * from (values " + ", ".join(f"('{c}', '{a}')" for a, cs in BY_AMINO.items() for c in cs.split()) + ") t(codon, amino))"
SITES_TABLE = """site_counts as materialized (
  select a.codon, count(*) filter (b.amino = a.amino) as same, count(*) filter (b.amino <> a.amino) as other from code a
  join code b on (a.codon[1] <> b.codon[1])::int + (a.codon[2] <> b.codon[2])::int + (a.codon[3] <> b.codon[3])::int = 1 where a.amino <> '*' group by a.codon)"""
CODONS_SQL = "cod as (select contig_name, i, upper(substr(seq, (i * 3 + 1)::int, 3)) as c from (select contig_name, seq, unnest(range(0, length(seq) // 3)) as i from sequences))"
query("translate_cds", f"with {base('sequences')}, {CODE_TABLE}, {CODONS_SQL} select contig_name, string_agg(coalesce(amino, 'X'), '' order by i) as protein from cod left join code on codon = c group by all")(
    lambda spark, d: derived(spark, d, "sequences").filter("length(seq) >= 3").select("contig_name", Q.translate(F.col("seq")).alias("protein")))
query("sn_sites", f"with {base('sequences')}, {CODE_TABLE}, {SITES_TABLE}, {CODONS_SQL} select contig_name, sum(coalesce(same, 0))::bigint as s_sites, sum(coalesce(other, 0))::bigint as n_sites from cod left join site_counts on codon = c group by all")(
    lambda spark, d: derived(spark, d, "sequences").filter("length(seq) >= 3").select("contig_name", Q.sn_sites(F.col("seq")).alias("x")).select("contig_name", F.col("x.s").cast("long").alias("s_sites"), F.col("x.n").cast("long").alias("n_sites")))

COPIES = "copies as (select contig_name, least(p1, p2) as s, greatest(p1, p2) as e from repeats union all select contig_name, least(p1x, p2x), greatest(p1x, p2x) from repeats)"
query("duplication_pct", f"with {base('repeats')}, {base('contigs')}, {COPIES}, b as (select distinct contig_name, unnest(range(s, e + 1)) as p from copies), n as (select contig_name, count(*) as k from b group by all) select contig_name, round(100.0 * coalesce(k, 0) / contig_length, 6) as duplication_pct from contigs left join n using (contig_name)")(
    lambda spark, d: rounded(G.duplication_pct(derived(spark, d, "repeats"), derived(spark, d, "contigs")), "duplication_pct"))
query("interval_union", f"with {base('repeats')}, {COPIES}, b as (select distinct contig_name, unnest(range(s, e + 1)) as p from copies), m as (select *, p - row_number() over (partition by contig_name order by p) as g from b) select contig_name, min(p) as \"start\", max(p) as \"end\" from m group by contig_name, g")(
    lambda spark, d: K.interval_union(derived(spark, d, "repeats").select("contig_name", F.explode(F.array(F.struct(F.least("p1", "p2").alias("start"), F.greatest("p1", "p2").alias("end")), F.struct(F.least("p1x", "p2x").alias("start"), F.greatest("p1x", "p2x").alias("end")))).alias("c")).select("contig_name", "c.*"), ["contig_name"]))
query("repeat_count_runs", f"""with {base('repeats')}, b as (select contig_name, unnest(range(least(p1, p2), greatest(p1, p2) + 1)) as p, is_direct::int as x from repeats),
n as (select contig_name, p, sum(x)::bigint as direct, sum(1 - x)::bigint as inverted from b group by all), m as (select *, p - row_number() over (partition by contig_name, direct, inverted order by p) as g from n)
select contig_name, min(p) as "start", max(p) as "end", direct, inverted from m group by contig_name, direct, inverted, g""")(
    lambda spark, d: K.rle(G.repeat_count_runs(derived(spark, d, "repeats")), ["contig_name"], "direct", "inverted"))
query("repeat_identity_segments", f"""with {base('repeats')}, r as (select contig_name, least(p1, p2) as s, greatest(p1, p2) as e, pident, least(p1x, p2x) as partner from repeats),
k as (select contig_name, s as x from r union select contig_name, e + 1 from r), g as (select contig_name, x as s, lead(x) over (partition by contig_name order by x) - 1 as e from k),
j as (select g.contig_name, g.s, g.e, r.pident, r.partner, row_number() over (partition by g.contig_name, g.s order by r.pident desc, r.partner) as n from g join r on r.contig_name = g.contig_name and g.s <= r.e and r.s <= g.e where g.e is not null)
select contig_name, s as "start", e as "end", pident, partner from j where n = 1""")(lambda spark, d: G.repeat_identity_segments(derived(spark, d, "repeats")))
query("terminal_repeats", f"with {base('repeats')}, {base('contigs')} select contig_name, p1, p2, p1x, p2x, pident from repeats join contigs using (contig_name) where least(p1, p2, p1x, p2x) <= 150 and greatest(p1, p2, p1x, p2x) > contig_length - 300 and pident >= 82")(
    lambda spark, d: G.terminal_repeats(derived(spark, d, "repeats"), derived(spark, d, "contigs").withColumn("contig_length", F.col("contig_length") - 150), 150, 82.0).select("contig_name", "p1", "p2", "p1x", "p2x", "pident"))
CANON = "canon as (select distinct case when contig_1 > contig_2 then contig_2 else contig_1 end as contig_1, case when contig_1 > contig_2 then contig_1 else contig_2 end as contig_2, case when contig_1 > contig_2 then p1x else p1 end as p1, case when contig_1 > contig_2 then p2x else p2 end as p2, case when contig_1 > contig_2 then p1 else p1x end as p1x, case when contig_1 > contig_2 then p2 else p2x end as p2x, pident from hits)"
query("canonical_hits", f"with {base('hits')}, {CANON} select * from canon")(lambda spark, d: G.canonical_hits(derived(spark, d, "hits")))
query("symmetric_hits", f"with {base('hits')}, {CANON} select * from canon union all select contig_2, contig_1, p1x, p2x, p1, p2, pident from canon")(lambda spark, d: G.symmetric_hits(G.canonical_hits(derived(spark, d, "hits"))))

OFFSETS = "placed as (select *, coalesce(sum(contig_length) over (partition by mag_name order by contig_length desc, contig_name rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from members)"
query("mag_offsets", f"with {base('members')}, {OFFSETS} select * from placed")(lambda spark, d: G.mag_offsets(derived(spark, d, "members")))
query("mag_attributes", f"""with {base('members')}, r as (select *, sum(contig_length) over (partition by mag_name order by contig_length desc, contig_name rows unbounded preceding) as upto, sum(contig_length) over (partition by mag_name) as total from members)
select mag_name, sum(contig_length)::bigint as mag_length, count(*)::bigint as n_contigs, max(case when upto >= (total + 1) // 2 then contig_length end)::bigint as n50 from r group by all""")(lambda spark, d: G.mag_attributes(derived(spark, d, "members")))
query("mag_weighted_means", f"with {base('members')} select mag_name, round(sum(s_acctbal * contig_length) / sum(contig_length), 4) as s_acctbal from members join supplier on s_name = contig_name group by all")(
    lambda spark, d: rounded(G.weighted_means(t(spark, d, "supplier").select(F.col("s_name").alias("contig_name"), "s_acctbal"), derived(spark, d, "members"), ["s_acctbal"]), "s_acctbal", digits=4))
query("mag_coordinates", f"with {base('members')}, {OFFSETS} select mag_name, contig_name, l_orderkey, (l_orderkey % 900 + \"offset\")::bigint as pos from lineitem join supplier on s_suppkey = l_suppkey join placed on contig_name = s_name")(
    lambda spark, d: G.to_mag_coords(t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.expr("s_suppkey = l_suppkey")).select(F.col("s_name").alias("contig_name"), "l_orderkey", (F.col("l_orderkey") % 900).alias("pos")), G.mag_offsets(derived(spark, d, "members")), "pos").select("mag_name", "contig_name", "l_orderkey", "pos"))

POINTS = "points as (select (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 7919 + l_suppkey * 104729 + cast(l_quantity as bigint) * 15485863) % 1000000 as point_id, concat('ctg', (l_partkey % 20)::varchar) as contig_name, (l_orderkey * 31 + l_linenumber * 7) % 1000 + 1 as pos from lineitem)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.expr("(l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 7919 + l_suppkey * 104729 + cast(l_quantity as bigint) * 15485863) % 1000000").alias("point_id"), F.concat(F.lit("ctg"), (F.col("l_partkey") % 20).cast("string")).alias("contig_name"),
                                          ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % 1000 + 1).alias("pos"))


GENES = "genes as (select annotation_id as id, contig_name, \"start\" as s, \"end\" as e from annotations where type = 'CDS')"


def genes(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, "annotations").filter("type = 'CDS'").withColumn("id", F.col("annotation_id"))


query("covering_cds", f"with {base('annotations')}, {GENES}, {POINTS}, j as (select point_id, id, row_number() over (partition by point_id order by s desc, id desc) as k from points join genes using (contig_name) where pos between s and e) select point_id, id from j where k = 1")(
    lambda spark, d: G.covering_latest(points(spark, d), genes(spark, d), ["contig_name"]))
query("nearest_gene", f"with {base('annotations')}, {GENES}, {POINTS} select point_id, min(case when pos < s then s - pos when pos > e then pos - e else 0 end)::bigint as distance from points join genes using (contig_name) group by all")(
    lambda spark, d: G.nearest_distance(points(spark, d), genes(spark, d)))


@query("gene_interval_stats", f"""with {S.PRELUDE}, {S.DEPTH}, {base('annotations')}, {GENES}, {POINTS}
select id, sample_name, count(*) filter (depth > 0)::bigint as covered, sum(depth)::bigint as total, round(sum(depth) / any_value(e - s + 1), 6) as mean from genes join cov on cov.contig_name = genes.contig_name and cov.pos between s and e group by id, sample_name""")
def gene_interval_stats(spark: SparkSession, d: str) -> DataFrame:
    """Covered bases and mean depth of each gene in each sample, from runs."""
    return rounded(G.interval_stats(genes(spark, d), S.depth_runs(spark, d), ["contig_name"], 100), "mean").select("id", "sample_name", F.col("covered").cast("long").alias("covered"), F.col("total").cast("long").alias("total"), "mean")


query("annotated_types", f"with {base('annotations')}, n as (select type, count(*)::bigint as n from annotations group by all) select type, n, row_number() over (order by n desc, type)::int as rank from n")(lambda spark, d: G.annotated_types(derived(spark, d, "annotations")))
query("main_isoform", f"with {base('annotations')} select annotation_id, locus_tag is null or row_number() over (partition by contig_name, type, locus_tag order by \"start\", annotation_id) = 1 as main_isoform from annotations")(
    lambda spark, d: G.main_isoform(derived(spark, d, "annotations")).select("annotation_id", "main_isoform"))
query("has_isoforms", f"with {base('annotations')}, n as (select contig_name, type, locus_tag, count(*) as n from annotations where locus_tag is not null group by all) select contig_name, bool_or(n > 1) as has_isoforms from n group by all")(lambda spark, d: G.has_isoforms(derived(spark, d, "annotations")))
query("gene_names", f"with {base('annotations')} select annotation_id, concat(contig_name, '_tm_', (row_number() over (partition by contig_name order by \"start\", annotation_id))::varchar) as gene from annotations where type = 'CDS'")(
    lambda spark, d: G.gene_names(derived(spark, d, "annotations").filter("type = 'CDS'")).select("annotation_id", "gene"))
query("enrich_annotations", f"with {base('annotations')}, v as (select concat('loc', c_custkey::varchar) as locus_tag, replace(c_mktsegment, '^', '_') as segment from customer) select annotation_id, segment from annotations left join v using (locus_tag)")(
    lambda spark, d: G.enrich_annotations(derived(spark, d, "annotations"), t(spark, d, "customer").select(F.concat(F.lit("loc"), F.col("c_custkey").cast("string")).alias("locus_tag"), F.col("c_mktsegment").alias("segment")), ["locus_tag"], ["segment"]).select("annotation_id", "segment"))
query("cds_annotations", f"with {base('annotations')}, {base('qualifiers')}, w as (select annotation_id, key, string_agg(value, '^' order by value) as v from qualifiers group by all) select a.annotation_id, p.v as product_q, f.v as function_q from annotations a left join w p on p.annotation_id = a.annotation_id and p.key = 'product' left join w f on f.annotation_id = a.annotation_id and f.key = 'function' where type = 'CDS'")(
    lambda spark, d: G.cds_annotations(derived(spark, d, "annotations").filter("type = 'CDS'").select("annotation_id"), derived(spark, d, "qualifiers"), ["product", "function"]).select("annotation_id", F.col("product").alias("product_q"), F.col("function").alias("function_q")))

PAIR_SQL = "cov as (select distinct concat('ctg', (l_partkey % 20)::varchar) as contig_name, concat(l_returnflag, l_linestatus) as sample_name from lineitem), metric as (select concat('ctg', (l_partkey % 20)::varchar) as contig_name, concat(l_returnflag, l_linestatus) as sample_name, sum(cast(l_quantity as bigint)) as value from lineitem group by all)"


def metric(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.concat(F.lit("ctg"), (F.col("l_partkey") % 20).cast("string")).alias("contig_name"), F.concat("l_returnflag", "l_linestatus").alias("sample_name")).agg(F.sum(F.col("l_quantity").cast("long")).alias("value"))


def _parts(spark: SparkSession, d: str) -> list[DataFrame | None]:
    m = metric(spark, d)
    value = V.predicate(F.col("value"), "number", ">", "1000")
    tagged = derived(spark, d, "annotations").join(derived(spark, d, "qualifiers").filter((F.col("key") == "product") & V.predicate(F.col("value"), "tokens", "=", "1-URGENT")).select("annotation_id"), "annotation_id", "left_semi")
    skipped = V.predicate(F.col("value"), "number", "<", "no number")
    return [m.filter(value).select(*V.PAIRS), V.expand_contigs(tagged, m), None if skipped is None else m.filter(skipped).select(*V.PAIRS), m.filter(V.predicate(F.col("sample_name"), "text", "=", "NF")).select(*V.PAIRS)]


FILTER_SQL = f"{PAIR_SQL}, {base('annotations')}, {base('qualifiers')}, tagged as (select distinct contig_name from annotations where annotation_id in (select annotation_id from qualifiers where key = 'product' and list_contains(string_split(value, '^'), '1-URGENT'))), kept as ((select contig_name, sample_name from metric where value > 1000 intersect select contig_name, sample_name from tagged left join metric using (contig_name)) union select contig_name, sample_name from metric where sample_name = 'NF')"
query("filter_pairs", f"with {FILTER_SQL} select * from kept")(lambda spark, d: V.combine(_parts(spark, d), ["AND", "OR", "OR"]))
query("filter_counts", f"with {FILTER_SQL} select count(*)::bigint as n_pairs, count(distinct contig_name)::bigint as n_contigs, count(distinct sample_name)::bigint as n_samples from kept")(lambda spark, d: V.filter_counts(V.combine(_parts(spark, d), ["AND", "OR", "OR"])))
query("search_names", "select p_name from (select distinct p_name, p_name = (select min(p_name) from part) as f from part where p_name ilike '%a%') order by p_name limit 100")(lambda spark, d: V.search_names(t(spark, d, "part"), "p_name", "a"))
query("order_samples", f"with {PAIR_SQL}, m as (select contig_name, max(value) as value from metric where sample_name = 'NO' group by all), s as (select distinct contig_name from cov) select contig_name as sample_name, value::double as value from s left join m using (contig_name) order by value desc nulls last, sample_name limit 12")(
    lambda spark, d: (lambda m: V.top_samples(m.select(F.col("contig_name").alias("sample_name")).distinct(), m.filter("sample_name = 'NO'").groupBy("contig_name").agg(F.max("value").alias("value")).withColumnRenamed("contig_name", "sample_name"), "value", 12, False).withColumn("value", F.col("value").cast("double")))(metric(spark, d)))
query("histogram", "with s as (select min(o_totalprice) lo, max(o_totalprice) hi, least(50, count(*)) n from orders) select least(floor((o_totalprice - lo) / ((hi - lo) / n)), n - 1)::bigint as bin, count(*)::bigint as n from orders, s group by 1")(lambda spark, d: V.histogram(t(spark, d, "orders"), "o_totalprice"))
query("histogram_log", "with s as (select min(log10(o_totalprice)) lo, max(log10(o_totalprice)) hi, least(20, count(*)) n from orders) select least(floor((log10(o_totalprice) - lo) / ((hi - lo) / n)), n - 1)::bigint as bin, count(*)::bigint as n from orders, s group by 1")(lambda spark, d: V.histogram(t(spark, d, "orders"), "o_totalprice", 20, True))
query("value_counts", "select p_brand, count(*)::bigint as n from part group by all")(lambda spark, d: V.value_counts(t(spark, d, "part"), "p_brand"))
query("distinct_values", "select distinct p_type from part where p_type is not null")(lambda spark, d: V.distinct_values(t(spark, d, "part"), "p_type"))
query("null_stats", f"with {base('annotations')} select count(locus_tag)::bigint as n_values, count(*)::bigint as n_rows from annotations")(lambda spark, d: V.null_stats(derived(spark, d, "annotations"), "locus_tag"))
SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]
query("metric_matrix", f"with {PAIR_SQL} select contig_name, " + ", ".join(f"coalesce(sum(value) filter (sample_name = '{s}'), 0)::bigint as \"{s}\"" for s in SAMPLES) + " from metric group by all")(
    lambda spark, d: V.metric_matrix(metric(spark, d), metric(spark, d).select("contig_name"), "contig_name", "value", SAMPLES))
query("dense_grid", f"with {PAIR_SQL} select c.contig_name, s.sample_name, coalesce(value, 0)::bigint as value from (select distinct contig_name from cov) c cross join (select distinct sample_name from cov) s left join (select * from metric where value > 1000) m on m.contig_name = c.contig_name and m.sample_name = s.sample_name")(
    lambda spark, d: (lambda m: V.dense_grid(m.filter("value > 1000"), m, m, "contig_name", "value"))(metric(spark, d)))
RUNS_B = f"with {base('repeats')}, {base('contigs')}, b as (select contig_name, unnest(range(least(p1, p2), greatest(p1, p2) + 1)) as p from repeats)"


def repeat_runs(spark: SparkSession, d: str) -> DataFrame:
    return K.sweep(derived(spark, d, "repeats").select("contig_name", F.least("p1", "p2").alias("start"), F.greatest("p1", "p2").alias("end")), ["contig_name"], {"value": F.lit(1)})


query("zoom_dense", f"{RUNS_B}, n as (select contig_name, (p - 1) // 100 as bin, count(*) as k from b group by all) select contig_name, bin::bigint as bin, round(k / least(100, contig_length - bin * 100), 6) as value from n join contigs using (contig_name)")(
    lambda spark, d: rounded(V.zoom_dense(repeat_runs(spark, d), ["contig_name"], derived(spark, d, "contigs"), 100), "value"))
query("zoom_sparse", f"with {POINTS} select contig_name, ((pos - 1) // 100)::bigint as bin, max(point_id)::bigint as value from points group by all")(
    lambda spark, d: V.zoom_sparse(points(spark, d).withColumn("value", F.col("point_id")), ["contig_name"], 100))
query("inspect_region", f"{RUNS_B}, n as (select contig_name, p, count(*)::bigint as value from b where p between 200 and 640 group by all), m as (select *, p - row_number() over (partition by contig_name, value order by p) as g from n) select contig_name, min(p) as \"start\", max(p) as \"end\", value from m group by contig_name, value, g")(
    lambda spark, d: K.rle(V.region(repeat_runs(spark, d), 200, 640), ["contig_name"], "value").withColumn("value", F.col("value").cast("long")))
query("compact_pvalue", "with p as (select o_orderkey, 1 / o_totalprice as p, (floor(log10(1 / o_totalprice)) - 1)::int as e from orders) select o_orderkey, concat(round(p / pow(10, e))::int, 'e', e) as p from p")(
    lambda spark, d: t(spark, d, "orders").select("o_orderkey", T.compact_pvalue(1 / F.col("o_totalprice")).alias("p")))
RULES = [{"key": "status", "mode": "exact", "value": "F", "color": "#00ff00"}, {"key": "priority", "mode": "has", "value": "URGENT", "color": "#ff0000"}, {"key": "priority", "mode": "random"}]
query("rule_color", "select o_orderkey, case when o_orderstatus = 'F' then '#00ff00' when contains(lower(o_orderpriority), 'urgent') then '#ff0000' else '#' || substr(sha256(o_orderpriority), 1, 6) end as color from orders")(
    lambda spark, d: t(spark, d, "orders").select("o_orderkey", T.rule_color(F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")), RULES).alias("color")))
query("gff_escape", "select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), ',', '%2C'), '&', '%26'), '=', '%3D'), ';', '%3B'), chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09') as escaped, true as back from documents")(
    lambda spark, d: t(spark, d, "documents").select("doc_id", T.gff_escape(F.col("text")).alias("escaped"), (T.gff_unescape(T.gff_escape(F.col("text"))) == F.col("text")).alias("back")))
