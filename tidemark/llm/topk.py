"""Exact top-k by inner product with norm buckets.

Candidates are dealt over tasks. Each task sorts its vectors by length into buckets and meets the queries, which come in
blocks of a fixed number. For a bucket and a query, the k-th best score so far gives a local cosine threshold,
theta / (|q| * longest in the bucket). Above 1 the bucket, and all that follow, are skipped (length pruning). Where it is
high, a few large coordinates of the query bound the product by partial sum plus the product of the remaining lengths
(coordinate pruning); where it is low, vectors too short for the threshold are skipped. What is left is verified by the
whole product. The best k of each task are merged by query.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; vectors of another dimension than
the query's are no candidates of it; a row with the query's id is never its candidate; ties go to the smaller id; fewer
than k candidates give as many rows as there are; repeated rows are candidates each, but not of a query with their id;
query rows that share an id share one ranking over all their products; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

OUT = "query_id long, vec_id long, score long"
EXACT = float(1 << 53)


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); rows with null or non-finite components are left out."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def search_bucketed(ids: np.ndarray, vecs: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int, best: np.ndarray, owner: np.ndarray, bucket: int = 512, focus: int = 16) -> None:
    """Put these candidates, by norm buckets, to the best k of each query: best has their scores (-inf: none yet), owner their
    ids. Ties go to the smaller id."""
    norms = np.sqrt((vecs * vecs).sum(1))
    order = np.lexsort((ids, -norms))
    ids, vecs, norms = ids[order], vecs[order], norms[order]
    q_norms = np.sqrt((queries * queries).sum(1))
    nq = len(queries)
    live = np.arange(nq)
    by_size = np.argsort(-np.abs(queries), axis=1)[:, :focus]
    for a in range(0, len(ids), bucket):
        block, names, size = vecs[a : a + bucket], ids[a : a + bucket], norms[a : a + bucket]
        theta = best[live, k - 1]
        live = live[~(theta > q_norms[live] * size[0] * (1 + 1e-12))]  # no later bucket is longer
        if not len(live):
            break
        theta = best[live, k - 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(q_norms[live] * size[0] > 0, theta / (q_norms[live] * size[0]), -np.inf)
        for rows, how in ((live[cosine > 0.5], "coordinate"), (live[cosine <= 0.5], "length")):
            if not len(rows):
                continue
            if how == "coordinate" and len(rows) * 8 < nq and block.shape[1] > focus:
                for r in rows:
                    f = by_size[r]
                    head = block[:, f] @ queries[r, f]
                    rest = np.sqrt(np.maximum(0.0, size**2 - (block[:, f] ** 2).sum(1))) * np.sqrt(max(0.0, q_norms[r] ** 2 - (queries[r, f] ** 2).sum()))
                    keep = np.flatnonzero((head + rest) * (1 + 1e-12) + 1e-6 >= best[r, k - 1])
                    _offer(best, owner, np.array([r]), (block[keep] @ queries[r])[None], names[keep], q_ids, k)
                continue
            # vectors too short for the lowest threshold of these queries
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(q_norms[rows] > 0, best[rows, k - 1] / q_norms[rows], -np.inf).min()
            n = int(np.searchsorted(-size, -need * (1 - 1e-12), side="right")) if need > 0 else len(size)
            for c in range(0, len(rows), 1024):
                part = rows[c : c + 1024]
                _offer(best, owner, part, queries[part] @ block[:n].T, names[:n], q_ids, k)


def _offer(best, owner, rows, scores, names, q_ids, k) -> None:
    if not scores.size:
        return
    scores = np.where(names[None, :] == q_ids[rows][:, None], -np.inf, scores)
    for i in np.flatnonzero((scores.max(1) >= best[rows, k - 1]) & np.isfinite(scores.max(1))):
        r = rows[i]
        new = np.flatnonzero((scores[i] >= best[r, k - 1]) & np.isfinite(scores[i]))
        if len(new) > 4 * k:  # the k-th best of them, with its ties
            new = new[scores[i, new] >= np.partition(scores[i, new], len(new) - k)[len(new) - k]]
        s, o = np.concatenate([best[r], scores[i, new]]), np.concatenate([owner[r], names[new]])
        top = np.lexsort((o, -s))[:k]
        best[r], owner[r] = s[top], o[top]


def _task(frames: Iterator[pd.DataFrame], q_ids: np.ndarray, queries: np.ndarray, k: int, together: int = 100_000) -> Iterator[pd.DataFrame]:
    """The best k of each query among a task's candidates. They come in groups of `together`; thresholds go on from one to the
    next, and only the last best leave the task."""
    best, owner = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    floats, reach = queries.astype(float), float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
    ids, vecs, odd = [], [], []

    def search() -> None:
        names, own = np.concatenate(ids), np.concatenate(vecs)
        exact = np.abs(own).max(1, initial=0) * reach < EXACT  # products of whole numbers are exact in doubles
        search_bucketed(names[exact], own[exact].astype(float), q_ids, floats, k, best, owner)
        if not exact.all():
            odd.append(_large(names[~exact], own[~exact], q_ids, queries, k))
        ids.clear()
        vecs.clear()

    for pdf in frames:
        same = [i for i, v in enumerate(pdf["v"]) if len(v) == queries.shape[1]]
        if same:
            ids.append(pdf["vec_id"].to_numpy()[same])
            vecs.append(np.stack([np.asarray(pdf["v"].iloc[i], np.int64) for i in same]))
        if sum(map(len, ids)) >= together:
            search()
        yield from odd
        odd.clear()
    if ids:
        search()
    yield from odd
    hit = np.isfinite(best)
    yield pd.DataFrame({"query_id": q_ids[np.nonzero(hit)[0]], "vec_id": owner[hit], "score": best[hit].astype(np.int64)})


def _large(names: np.ndarray, own: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The best k of each query among vectors whose products are beyond doubles, in whole numbers of any size."""
    rows, vecs = [], own.astype(object)
    for name, query in zip(q_ids.tolist(), queries.astype(object)):
        scores = [(-s, i) for s, i in zip((vecs @ query).tolist(), names.tolist()) if i != name]
        rows += [(name, i, -s) for s, i in heapq.nsmallest(k, scores)]
    if any(abs(s) >> 63 for _, _, s in rows):
        raise OverflowError("a score does not fit in 64 bits: use a smaller scale")
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are handled in blocks of about `block` rows, each sent to all tasks: a block of
    64 dimensions is 16 MB, whatever the number of queries. A block's best are written before the next is read, so the driver
    holds one block, and the candidates are read once for each."""
    spark = vectors.sparkSession
    rows = staged(quantized(vectors, scale), "vectors")
    queries = staged(rows.filter(is_query).select(F.col("vec_id").alias("q"), "v", F.size("v").alias("dim")).distinct(), "queries")
    found = []
    for dim in sorted(r.dim for r in queries.select("dim").distinct().collect()):
        own = queries.filter(F.col("dim") == dim)
        blocks = -(-own.count() // block)
        dealt = own.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)))
        for b in range(blocks):
            part = dealt.filter(F.col("b") == b).select("q", "v").collect()
            if part:
                q_ids, q_vecs = np.array([r.q for r in part], np.int64), np.array([r.v for r in part], np.int64).reshape(len(part), dim)
                found.append(staged(rows.mapInPandas(partial(_task, q_ids=q_ids, queries=q_vecs, k=k), OUT), "best"))
    found = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], OUT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
