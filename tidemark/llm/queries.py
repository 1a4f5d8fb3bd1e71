"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, divergence, hmm, html_extract, line_dedup, ngram_join, packing, prefix_counts, quality, token_io, topk, url_filter
from .common import crc32_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.encode_roundtrip(_table(spark, sf_dir, "documents"), end_id=0)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), end_id=2, size=1024)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = _table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 4)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold != 2)
    scored = quality.score(docs, model, "doc_id")
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 10) == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), digest=True)[0].withColumnRenamed("groups", "groups_sha256")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_counts.prefix_table(_table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_url_filter, op2_html_extract, op3_token_ids, op4_topk, op5_ngram_join, op6_packing, op7_line_dedup, op8_quality,
        op9_decontamination, op10_lm_score, op11_alignment, op12_token_counts, op13_divergence,
    )}


def _op1_sql() -> str:
    """The spread of op1: one recursion step for each link, until less than a millionth of a host's seed moves anywhere."""
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))

    def case(what) -> str:
        out = []
        for kind, text in rules:
            name, _, start = text.partition("/")
            out.append(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{start}') then '{what(kind, text)}'")
        return "case " + " ".join(out) + " end"

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive rest as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, html, {lower.format("regexp_extract(r, '^[^/?#]*')")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
judged as materialized (select page_id, host, path, {case(lambda k, t: t)} as rule, {case(lambda k, t: k)} as ruled from parts),
links as (select host as src, {lower.format("unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']?\\s*(?:https?:)?//([^/?#\"''\\s>]+)', 1))")} as dst from parts),
edges as materialized (select src, dst, count(*) as n from links where src <> '' and dst <> '' and src <> dst group by src, dst),
ways as materialized (
  select 'trust' as kind, src as a, dst as b, n / sum(n) over (partition by src) as w from edges
  union all select 'distrust', dst, src, n / sum(n) over (partition by dst) from edges),
seeds as (select host, avg(case when ruled = 'allow' then 1.0 else 0.0 end) as trust, avg(case when ruled = 'block' then 1.0 else 0.0 end) as distrust
  from judged where host <> '' group by host),
mass as (
  select 0 as k, 'trust' as kind, host, trust::double as r from seeds where trust > 0
  union all select 0, 'distrust', host, distrust::double from seeds where distrust > 0
  union all
  select k, kind, host, sum(r) from (
    select m.k + 1 as k, w.kind, w.b as host, 0.85 * m.r * w.w as r from mass m join ways w on w.kind = m.kind and w.a = m.host where m.k < 500)
  group by k, kind, host having sum(r) > 1e-9),
blocked as (select host from mass group by host having sum(case when kind = 'distrust' then r else -r end) > 0.5)
select j.page_id, j.host, j.path, j.rule, coalesce(j.ruled, case when b.host is not null then 'block' end, 'allow') as verdict
from judged j left join blocked b on j.host = b.host
"""


OP4_SQL = """
with q as (
  select vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.v, b.v)::bigint as score
  from q a join q b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 5
"""

OP5_SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as w from documents),
sets as materialized (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as s from words),
ids as materialized (select s, min(doc_id) as rep, len(s) as n from sets group by s),
items as (select rep, n, unnest(s) as g from ids),
pairs as (select a.rep as a, b.rep as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb
  from items a join items b on a.g = b.g and a.rep <> b.rep group by a.rep, b.rep),
links as materialized (select a, b from pairs where k / (na + nb - k) >= 0.8),
reach(a, b) as (select rep, rep from ids union select r.a, l.b from reach r join links l on l.a = r.b),
roots as (select a, min(b) as root from reach group by a),
n_links as (select a, count(*) as n from links group by a)
select s.doc_id, r.root as class_id, coalesce(l.n, 0) as n_links
from sets s join ids i on s.s = i.s join roots r on r.a = i.rep left join n_links l on l.a = i.rep
"""

OP7_SQL = r"""
with l as (select doc_id, text, case when text is null then null else string_split(text, chr(10)) end as x from documents),
w as (
  select doc_id, len, p - 1 as pos, trim(x[p]) as a, trim(x[p + 1]) as b, trim(x[p + 2]) as c
  from (select doc_id, x, len(x) as len, unnest(range(1, greatest(len(x) - 1, 2))) as p from l where x is not null)),
n as (
  select doc_id, len, pos, row_number() over (partition by a, b, c order by doc_id, pos) as k from w
  where not (a = '' and coalesce(b, '') = '' and coalesce(c, '') = '')),
gone as (select distinct doc_id, pos + d as pos from n, (values (0), (1), (2)) t(d) where k > 1 and pos + d < len),
per as (select doc_id, list(pos) as g from gone group by doc_id)
select l.doc_id, coalesce(len(x), 0)::bigint as n_lines, coalesce(len(g), 0)::bigint as n_removed,
  case when g is null then text else array_to_string(list_filter(x, lambda v, i: not list_contains(g, i - 1)), chr(10)) end as text
from l left join per on per.doc_id = l.doc_id
"""


OP13_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as materialized (select id, lang, source, term, count(*) as c from (select id, lang, source, unnest(w) as term from d) group by all),
kept as materialized (select lang, term, sum(c) as n from t group by lang, term having count(distinct id) >= 10),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (select distinct lang, source from d),
c as materialized (select lang, source, term, sum(c) as c from t semi join kept using (lang, term) group by lang, source, term),
totals as (select lang, source, sum(c) as total from c group by lang, source),
dense as materialized (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
    (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (coalesce(o.total, 0) + 2 * l.v))::bigint as p,
    (1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.v))::bigint as q
  from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
    left join totals o on o.lang = g.lang and o.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
gaps as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(g.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join gaps g on g.lang = a.lang and g.source = a.source and g.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from dense where c > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from found)
select * from ranked where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _op1_sql(), "op4_topk": OP4_SQL, "op5_ngram_join": OP5_SQL, "op7_line_dedup": OP7_SQL, "op13_divergence": OP13_SQL}
