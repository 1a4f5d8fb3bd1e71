"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

ROW = "__row"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a folder of
    its own, and a cluster an error: there, executors would each write to a disk that the others don't see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def splittable_join(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of groups, which are sums of rows by keys. A key besides makes Spark deal both sides for the join
    and not reuse the sums' partitions; only then can it split a key that has very many rows over tasks."""
    k = F.xxhash64(*keys, F.lit(1))
    return rows.withColumn("__k", k).join(groups.withColumn("__k", k), [*keys, "__k"]).drop("__k")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """__row and doc, the row as a struct (so that no name can clash). The numbers are written with the rows: Spark's own
    depend on how a scan is split, and another scan may be split otherwise."""
    return staged(df.select(F.monotonically_increasing_id().alias(ROW), F.struct("*").alias("doc")), name)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes, as some rows hold very long texts. Spark reads
    both settings when a plan runs, so the session keeps them; lower bounds of the caller stay, and sizes given with a unit."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """About n rows of df (all, if fewer), picked by a hash of key: the same rows in every run."""
    total = df.count()
    grain = 1 << 30
    if total <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(grain)) < int(grain * n / total))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m: the folds that contracts fix. Null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut a stream of frames that is sorted by keys so that no group spans two of them."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if pdf.empty:
            continue
        last = pdf[keys].iloc[-1]
        same = (pdf[keys] == last).all(axis=1).to_numpy()
        cut = len(same) - (int((~same[::-1]).argmax()) if not same.all() else len(same))
        if cut:
            held.append(pdf.iloc[:cut])
            first = held[0][keys].iloc[-1]
            if len(held) > 1 and not (pdf[keys].iloc[0] == first).all():
                yield pd.concat(held[:-1], ignore_index=True)
                held = held[-1:]
            yield pd.concat(held, ignore_index=True)
            held = [pdf.iloc[cut:]]
        else:
            if held and not (pdf[keys].iloc[0] == held[0][keys].iloc[-1]).all():
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)
