"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces go in
falling length into the open sequence that fits under every capacity and scores best: by the weighted dot product of the
piece with what the sequence has left ("dot"), or by the smallest weighted norm of what would be left ("norm").

Tokenized pieces (numbers only) are dealt by a hash of a row number written with them into shards of about `per_shard` pieces, which are packed
side by side; each shard can leave a few sequences that aren't full, well under 1 % of its own. Memory is that of a shard's
numbers. Deals and ties are by value, so a recomputed task gives the same result.

Edge cases: a null or empty text is its end id alone; rows with one doc_id are packed one by one; null ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, staged
from .tokens import encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], vocab: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, bounds = encoder(vocab)(batch.column("text"), end_id)
        n = np.diff(bounds)
        pieces = -(-n // size)
        owner = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = n - (pieces - 1) * size  # the first piece takes what the others leave
        start = np.where(piece > 0, first[owner] + (piece - 1) * size, 0)
        length = np.where(piece > 0, size, first[owner])
        raw, at = memoryview(ids.astype("<u4", copy=False).tobytes()), 4 * (bounds[:-1][owner] + start)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
        columns = (batch.column("doc_id").take(pa.array(owner)), piece.astype("i4"), start, length, crc)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")]
        )


def pieces_of(docs: DataFrame, vocab: str | None = None, end_id: int = 2, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Documents longer than size are cut; the first piece takes the remainder."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(partial(_cut, vocab=vocab or vocabulary(), end_id=end_id, size=size), PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths in falling order. capacity: tokens, documents, attention cost."""
    scale = np.array(weights) / np.array(capacity, float) ** 2
    open_ = np.zeros((1024, 3))
    owner = np.zeros(1024, np.int64)
    used, bins = 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tokens = capacity[0]
    least = float(lengths[-1]) if len(lengths) else 0.0
    for i, n in enumerate(lengths.tolist()):
        item = np.array((n, 1.0, float(n) * n))
        left = open_[:used]
        fits = np.flatnonzero((left[:, 0] >= n) & (left[:, 1] >= 1) & (left[:, 2] >= item[2]))
        if len(fits):
            rest = left[fits]
            if score == "dot":  # most aligned with the room that is left, per unit of that room
                rank = -((rest * scale) @ item) / np.maximum((rest * rest) @ scale, 1e-12)
            else:
                rank = ((rest - item) ** 2) @ scale
            k = int(fits[np.argmin(rank)])
        else:
            if used == len(open_):
                open_, owner = np.vstack([open_, np.zeros_like(open_)]), np.concatenate([owner, np.zeros_like(owner)])
            k = used
            open_[k], owner[k] = capacity, bins
            used, bins = used + 1, bins + 1
        where[i], offset[i] = owner[k], tokens - int(open_[k, 0])
        open_[k] -= item
        if open_[k, 0] < least or open_[k, 1] < 1 or open_[k, 2] < least * least:  # full: nothing to come fits
            used -= 1
            open_[k], owner[k] = open_[used], owner[used]
    return where, offset


def _pack(frames: Iterator[pd.DataFrame], capacity, weights, score) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    held = [pdf for pdf in frames if len(pdf)]
    if not held:
        return
    pdf = pd.concat(held, ignore_index=True)
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
    where, offset = best_fit(pdf["length"].to_numpy(), capacity, weights, score)
    base = TaskContext.get().partitionId() << 32
    yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), sequence_id=base + where, offset=offset)


def pack(pieces: DataFrame, tokens: int = 1024, documents: int = 1024, attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm", per_shard: int = 4000) -> DataFrame:
    """pieces with sequence_id and offset. A piece longer than `tokens` is an error; attention defaults to tokens squared,
    which never binds by itself, and documents to one for each token."""
    pieces = staged(pieces.withColumn(ROW, F.monotonically_increasing_id()), "pieces")
    n = pieces.count()
    shards = max(1, -(-n // per_shard))
    if n and pieces.agg(F.max("length")).first()[0] > tokens:
        raise ValueError("a piece is longer than a sequence")
    # by the number written with the row: many rows may have one id, or none
    dealt = pieces.repartition(shards, F.xxhash64(ROW)).drop(ROW)
    capacity = (tokens, documents, attention or tokens * tokens)
    return dealt.mapInPandas(partial(_pack, capacity=capacity, weights=weights, score=score), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str | None = None, end_id: int = 2, size: int = 1024, **how) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return pack(pieces_of(docs, vocab, end_id, size), tokens=size, **how)
