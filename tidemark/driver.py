"""Read-like tables derived from the driver's tables, by SQL text that Spark and DuckDB both run.

Each text names its inputs in braces: spark.sql() gets DataFrames for them, the oracles get table names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
_STORED: dict[tuple[str, str, str], tuple[str, StructType, str]] = {}

READS = """
select sample_name, contig_name, read_id, qname, flag, pos, mapq,
  case k when 1 then concat(q, 'M') when 2 then concat('3S', q, 'M') when 3 then concat(q, 'M2I3M') when 4 then concat(q, 'M2D3M')
    when 5 then concat('4M5N', q, 'M') else concat(q, 'M2S') end as cigar,
  mate_contig, mate_pos, tlen,
  substr(repeat('ACGT', 20), off, cast(q + case k when 1 then 0 when 2 then 3 when 3 then 5 when 4 then 3 when 5 then 4 else 2 end as int)) as seq,
  case when q >= 6 and o % 7 = 0 then concat('0C', case when k = 4 then concat(q - 1, '^AC3') else cast(m - 1 as string) end)
    when q >= 6 and o % 3 = 0 then concat('2A', case when k = 4 then concat(q - 3, '^AC3') else cast(m - 3 as string) end)
    when k = 4 then concat(q, '^AC3') else cast(m as string) end as md,
  cast(case when k = 3 or k = 4 then 2 else 0 end + case when q >= 6 and (o % 7 = 0 or o % 3 = 0) then 1 else 0 end as int) as nm
from (
  select concat(l_returnflag, l_linestatus) as sample_name, concat('ctg', cast(l_partkey % 20 as string)) as contig_name,
    (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 7919 + l_suppkey * 104729 + cast(l_quantity as bigint) * 15485863) % 1000000 as read_id, concat('r', cast(l_orderkey as string)) as qname,
    cast(1 + case when l_partkey % 97 = 0 then 4 else 0 end + case when l_partkey % 13 = 0 then 8 else 0 end
      + case when l_suppkey % 2 = 1 then 16 else 0 end + case when l_suppkey % 3 = 0 then 32 else 0 end
      + case when l_orderkey % 2 = 0 then 64 else 128 end + case when l_linenumber = 6 then 256 when l_linenumber = 7 then 2048 else 0 end as int) as flag,
    cast((l_orderkey * 31 + l_linenumber * 7) % 950 as int) as pos, cast(round(l_discount * 100) as int) as mapq,
    cast(l_quantity as int) as q, l_linenumber as k, l_orderkey as o,
    cast(l_quantity as int) + case when l_linenumber = 3 then 3 when l_linenumber = 5 then 4 else 0 end as m,
    cast(l_suppkey % 4 + 1 as int) as off,
    concat('ctg', cast((l_partkey + case when l_suppkey % 11 = 0 then 1 else 0 end) % 20 as string)) as mate_contig,
    cast((l_orderkey * 31 + l_linenumber * 7 + 200) % 950 as int) as mate_pos,
    cast(case when l_partkey % 5 = 0 then 20000 when l_orderkey % 2 = 0 then 150 + l_quantity else -150 - l_quantity end as int) as tlen
  from {lineitem}) base
"""

CONTIGS = "select distinct concat('ctg', cast(p_partkey % 20 as string)) as contig_name, cast(1100 as bigint) as contig_length from {part}"

SHORT_CONTIGS = "select distinct concat('ctg', cast(p_partkey % 20 as string)) as contig_name, cast(960 as bigint) as contig_length from {part}"

SEQUENCES = """
select concat('doc', cast(doc_id as string)) as contig_name,
  translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMNOPQRSUVWXYZ', 'CTACGTNACGTACGTACGTNAC') as seq
from {documents} where text is not null and length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0
"""

ANNOTATIONS = """
select cast(o_orderkey as bigint) as annotation_id, concat('ctg', cast(o_custkey % 20 as string)) as contig_name,
  cast(o_orderkey * 17 % 1000 + 1 as bigint) as start, cast(o_orderkey * 17 % 1000 + 1 + o_custkey % 90 as bigint) as {{end}},
  case when o_orderkey % 2 = 0 then 1 else -1 end as strand, case when o_orderstatus = 'P' then 'tRNA' when o_orderkey % 5 = 0 then 'mRNA' else 'CDS' end as type,
  case when o_orderkey % 4 = 0 then null else concat('loc', cast(o_custkey as string)) end as locus_tag, o_orderpriority as product
from {orders}
"""

QUALIFIERS = """
select cast(o_orderkey as bigint) as annotation_id, 'product' as key, concat(o_orderpriority, '^', o_orderstatus) as value from {orders}
union all select cast(o_orderkey as bigint), 'function', o_orderstatus from {orders} where o_orderkey % 3 <> 0
union all select cast(o_orderkey as bigint), 'function', o_orderpriority from {orders} where o_orderkey % 5 = 0
"""

REPEATS = """
select concat('ctg', cast(l_partkey % 20 as string)) as contig_name, cast(l_orderkey * 13 % 900 + 1 as bigint) as p1,
  cast(l_orderkey * 13 % 900 + 1 + l_quantity as bigint) as p2,
  case when l_suppkey % 2 = 0 then cast(l_orderkey * 29 % 900 + 1 as bigint) else cast(l_orderkey * 29 % 900 + 1 + l_quantity as bigint) end as p1x,
  case when l_suppkey % 2 = 0 then cast(l_orderkey * 29 % 900 + 1 + l_quantity as bigint) else cast(l_orderkey * 29 % 900 + 1 as bigint) end as p2x,
  cast(80 + l_linenumber as double) as pident, l_suppkey % 2 = 0 as is_direct
from {lineitem}
"""

HITS = """
select concat('ctg', cast(l_partkey % 20 as string)) as contig_1, concat('ctg', cast(l_suppkey % 20 as string)) as contig_2,
  cast(l_orderkey % 500 + 1 as bigint) as p1, cast(l_orderkey % 500 + 1 + l_quantity as bigint) as p2,
  cast(l_orderkey % 300 + 1 as bigint) as p1x, cast(l_orderkey % 300 + 1 + l_quantity as bigint) as p2x, cast(90 as double) as pident
from {lineitem} where l_partkey % 20 <> l_suppkey % 20
"""

MEMBERS = """
select concat('bin', cast(s_nationkey as string)) as mag_name, s_name as contig_name, cast(1000 + s_suppkey * 37 % 900 as bigint) as contig_length
from {supplier}
"""

TEXTS = {"reads": READS, "contigs": CONTIGS, "short_contigs": SHORT_CONTIGS, "sequences": SEQUENCES, "annotations": ANNOTATIONS, "qualifiers": QUALIFIERS, "repeats": REPEATS, "hits": HITS, "members": MEMBERS}
INPUTS = ("lineitem", "part", "documents", "orders", "supplier", "customer", "nation", "region")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables above as a DataFrame."""
    text = TEXTS[name].replace("{{end}}", "`end`")
    if name == "sequences":
        text = text.replace(", 'g')", ")")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in INPUTS if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def oracle(name: str) -> str:
    """Its text for DuckDB."""
    text = TEXTS[name].replace("{{end}}", '"end"')
    for t in INPUTS:
        text = text.replace(f"{{{t}}}", t)
    return text


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a
    folder of its own, and a cluster an error: there, executors would each write to a disk that the others don't see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> str:
    """What tells whether the files of some tables are still the same: their paths, sizes and times, summed up by Spark. No
    content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{sf_dir}/{t}.parquet" for t in tables])
    row = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return f"{row[0]}/{row[1]}"


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], tables: tuple[str, ...] = ("lineitem",)) -> DataFrame:
    """A table that several queries of a session share, as a dataset is built once and asked often: written to the shared
    folder when it is first asked for, and read from there as long as the files of the tables it is made of stay the same."""
    out = if_stored(spark, sf_dir, name, tables)
    if out is None:
        now = fingerprint(spark, sf_dir, tables)
        df, path = make(), shared_path(spark, name)
        df.write.parquet(path)
        _STORED[spark.sparkContext.applicationId, sf_dir, name] = path, df.schema, now
        out = spark.read.schema(df.schema).parquet(path)
    return out


def if_stored(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...] = ("lineitem",)) -> DataFrame | None:
    """Such a table if a query has made it of the files as they are now, else None."""
    found = _STORED.get((spark.sparkContext.applicationId, sf_dir, name))
    if found is None or found[2] != fingerprint(spark, sf_dir, tables):
        return None
    return spark.read.schema(found[1]).parquet(found[0])
