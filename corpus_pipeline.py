"""From raw documents to packed token sequences: five stages, each on all rows that the one before kept.

All stages but the last return the columns of documents (COLUMNS) and drop others. Rows go by row numbers or by content, never
by doc_id, so null and repeated ids are rows like others. Null and empty texts stay unless a stage says otherwise; an empty table
gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, ngram_join, packing, quality
from tidemark.llm.common import crc32_mod, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a quality score below 0.7. Null and empty texts are scored as empty; without usable labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, crc32_mod(F.col("doc_id"), 4) != 2)
    return quality.score(docs.withColumn("__text", F.col("text")), model, *[c for c in COLUMNS if c != "text"], "__text").filter(
        "score >= 0.7").withColumnRenamed("__text", "text").select(*COLUMNS)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated three-line passages, the first by doc_id stays; a document of which nothing is left goes, one that
    was empty or null before stays. n_chars is made anew where lines went."""
    cleaned = line_dedup.dedup_lines(docs).filter("n_removed = 0 or trim(text) <> ''")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (of equal or null ids, the first row). Texts
    without words, null ones among them, are a group."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy of a benchmark item, exact or edited; null and empty texts hold none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most 1024 tokens; a null or empty text is its end token."""
    return packing.pack_documents(docs, end_id=2, size=1024)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("n-gram jaccard join", near_duplicate_filter),
    ("benchmark decontamination", benchmark_filter),
    ("best-fit packing", pack_sequences),
]

#: The quality score, the alignment and the tokens are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
