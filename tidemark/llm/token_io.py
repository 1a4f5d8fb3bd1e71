"""Token-id files: each document compressed by itself with one shared zstandard dictionary.

The dictionary is trained on the serialized id arrays of a bounded sample of documents (fit only; about `sample` documents of
at most 32 kB each, picked by a hash of text and id). Documents are range-partitioned and sorted by doc_id and written as blocks. A block is a
self-contained image: a header with the dictionary's hash, an index (ids, token counts, offsets) and one zstandard frame
for each document, so one short document is read without its neighbours. Spark's Parquet writer holds the images, which
makes the output atomic and safe against lost executors; first_doc_id and last_doc_id let a reader skip files.

Edge cases: a null or empty text is the end id alone; a null doc_id sorts first and comes back null; repeated rows are
kept, in the order of a hash of their texts (so `start` is the same in every run); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, hash_sample, new_path
from .tokens import encoder, vocabulary

MAGIC = b"TDMKIDS1"
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
SCHEMA = "part int, block int, first_doc_id long, last_doc_id long, start long, n_docs int, n_tokens long, image binary"


def _serial(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _codec(dictionary: bytes, level: int = 3):
    import zstandard as zstd

    d = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    if d is not None and level:
        d.precompute_compress(level=level)
    return zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_dict_id=False), zstd.ZstdDecompressor(dict_data=d)


def dictionary_hash(dictionary: bytes) -> int:
    import xxhash

    return xxhash.xxh64(dictionary).intdigest()


def pack_block(docs: list[tuple[int | None, bytes]], dictionary: bytes, compressor=None) -> bytes:
    """The image of some documents, given as (doc_id, ids as little-endian unsigned 32-bit bytes)."""
    compressor = compressor or _codec(dictionary)[0]
    wide = any(len(b) and int(np.frombuffer(b, "<u4").max()) > 0xFFFF for _, b in docs)
    frames = [compressor.compress(_serial(b, wide)) for _, b in docs]
    index = [
        np.array([dictionary_hash(dictionary)], "<u8"),
        np.array([len(docs), int(wide)], "<u4"),
        np.array([0 if d is None else d for d, _ in docs], "<i8"),
        np.array([d is None for d, _ in docs], "u1"),
        np.array([len(b) // 4 for _, b in docs], "<u4"),
        np.cumsum([0, *map(len, frames)]).astype("<u8"),
    ]
    return MAGIC + b"".join(x.tobytes() for x in index) + b"".join(frames)


def unpack_block(image: bytes, dictionary: bytes, wanted: set | None = None, decompressor=None) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, tokens before it in the block, ids) of the documents, or of those in wanted; only their frames are read."""
    decompressor = decompressor or _codec(dictionary, 0)[1]
    if image[:8] != MAGIC:
        raise ValueError("not a token block")
    if int(np.frombuffer(image, "<u8", 1, 8)[0]) != dictionary_hash(dictionary):
        raise ValueError("the block was written with another dictionary")
    n, wide = map(int, np.frombuffer(image, "<u4", 2, 16))
    at = 24
    ids, at = np.frombuffer(image, "<i8", n, at), at + 8 * n
    nulls, at = np.frombuffer(image, "u1", n, at), at + n
    sizes, at = np.frombuffer(image, "<u4", n, at), at + 4 * n
    offsets, at = np.frombuffer(image, "<u8", n + 1, at), at + 8 * (n + 1)
    before = np.cumsum(sizes.astype("i8")) - sizes
    for k in range(n):
        doc = None if nulls[k] else int(ids[k])
        if wanted is None or doc in wanted:
            raw = decompressor.decompress(image[at + int(offsets[k]) : at + int(offsets[k + 1])])
            yield doc, int(before[k]), raw if wide else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _encoded(batch: pa.RecordBatch, vocab: str, end_id: int) -> list[bytes]:
    ids, bounds = encoder(vocab)(batch.column("text"), end_id)
    raw, at = ids.astype("<u4", copy=False).tobytes(), (4 * bounds).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def train_dictionary(docs: DataFrame, vocab: str, end_id: int, sample: int = 1000, size: int = 1 << 16, longest: int = 1 << 15) -> bytes:
    """A zstandard dictionary from the id arrays of about `sample` documents of at most `longest` bytes, which bounds what
    reaches the driver; empty where there is too little to train on."""
    import zstandard as zstd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([_serial(b, False) for b in _encoded(batch, vocab, end_id)], pa.binary())})

    rows = hash_sample(docs.select("doc_id", "text").filter(F.octet_length("text") <= longest), F.xxhash64("doc_id", "text"), sample).mapInArrow(run, "ids binary").collect()
    arrays = sorted(bytes(r.ids) for r in rows)
    if len(arrays) < 8:
        return b""
    try:
        return zstd.train_dictionary(min(size, max(1024, sum(map(len, arrays)) // 8)), arrays).as_bytes()
    except zstd.ZstdError:
        return b""


def _write_part(batches: Iterator[pa.RecordBatch], vocab: str, end_id: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, compressor = TaskContext.get().partitionId(), _codec(dictionary)[0]
    block, start, held, size = 0, 0, [], 0

    def close() -> pa.RecordBatch:
        nonlocal block, start, held, size
        tokens, ids = sum(len(b) for _, b in held) // 4, [d for d, _ in held if d is not None]
        row = (part, block, min(ids, default=None), max(ids, default=None), start, len(held), tokens, pack_block(held, dictionary, compressor))
        block, start, held, size = block + 1, start + tokens, [], 0
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        columns = (c.split() for c in SCHEMA.split(", "))
        return pa.RecordBatch.from_pydict({name: pa.array([v], kinds[kind]) for (name, kind), v in zip(columns, row)})

    for batch in batches:
        for doc, ids in zip(batch.column("doc_id").to_pylist(), _encoded(batch, vocab, end_id)):
            held.append((doc, ids))
            size += len(ids)
            if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                yield close()
    if held:
        yield close()


def write_ids(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 0, sample: int = 1000) -> None:
    """Encode every document and write path/blocks and path/dictionary."""
    spark, vocab = docs.sparkSession, vocab or vocabulary()
    bounded_batches(spark)
    dictionary = train_dictionary(docs, vocab, end_id, sample)
    spark.createDataFrame([(f"{dictionary_hash(dictionary):016x}", bytearray(dictionary))], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    # ids that many rows share, or null ones, are told apart by their texts, and copies of a row by their place in the table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias(ROW))
    order = [F.col("doc_id").asc_nulls_first(), "h", ROW]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(partial(_write_part, vocab=vocab, end_id=end_id, dictionary=dictionary), SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def _read_part(frames: Iterator[pd.DataFrame], dictionary: bytes, wanted: frozenset | None, digest: bool) -> Iterator[pd.DataFrame]:
    decompressor = _codec(dictionary, 0)[1]
    for pdf in frames:
        for base, image in zip(pdf["start"], pdf["image"]):
            rows = list(unpack_block(bytes(image), dictionary, wanted, decompressor))
            if rows:
                last = {"ids_crc32": [zlib.crc32(b) for _, _, b in rows]} if digest else {"ids": [np.frombuffer(b, "<u4").astype("i8") for _, _, b in rows]}
                yield pd.DataFrame({"doc_id": pd.array([d for d, _, _ in rows], "Int64"), "start": [int(base) + s for _, s, _ in rows], "n_tokens": [len(b) // 4 for _, _, b in rows]} | last)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their crc32) of all documents, or of the given few, without touching other blocks."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks")
    # a row for each written partition: as many as the writer had tasks
    sums = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    bases = F.broadcast(spark.createDataFrame(before, "part int, base long"))
    if doc_ids is not None:
        near = F.lit(False)
        for d in doc_ids:
            near = near | ((F.col("first_doc_id") <= d) & (F.col("last_doc_id") >= d))
        blocks = blocks.filter(near)
    rows = blocks.join(bases, "part").select((F.col("start") + F.col("base")).alias("start"), "image")
    kind = "ids_crc32 long" if digest else "ids array<long>"
    wanted = None if doc_ids is None else frozenset(doc_ids)
    return rows.mapInPandas(partial(_read_part, dictionary=dictionary, wanted=wanted, digest=digest), f"doc_id long, start long, n_tokens long, {kind}")


def encode_roundtrip(docs: DataFrame, vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder, read them back, and return each document's place and digest."""
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocab, end_id)
    return read_ids(docs.sparkSession, path, digest=True)
