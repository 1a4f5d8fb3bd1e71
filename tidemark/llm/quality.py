"""Compression classifier for text quality.

Zstandard dictionaries are trained on good and on bad labelled texts, `pairs` of each on different texts, as a dictionary holds
what its few samples happen to have. A text that is like the good ones gets shorter with theirs. The difference of its mean
compressed sizes, normalised by size, by length and by its logarithm, is turned into
a probability by a logistic calibration on other labelled texts. A difference means more in some texts than in others, so
each of the three also counts with the logarithm of the length; all inputs of the calibration are 0 where the sizes agree.

Fit: a hash of the id deals the labelled documents to two halves. About `per_class` texts of each class of one half are
read whole and train the dictionaries (texts of at most `longest` bytes, which bounds what reaches the driver; where a class
has none, its shortest; lines that several of them have are left out); about `calibrate` rows of each class of the other half are compressed where they
lie, and only their numbers are collected. Classes are weighted as they occur. Scoring covers every document in one pass
without a shuffle; the model sent to the tasks is 2 * `pairs` dictionaries of `size` bytes and a few numbers.

Edge cases: null and empty texts are scored as empty; labels that are null, or given twice with different values, don't
count; with labels of one class only the score is 1 or 0, and without labels 1; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, bounded_batches

LEVEL = 3


@dataclass
class Model:
    good: list[bytes] = field(default_factory=list)
    bad: list[bytes] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    constant: float | None = None


def _compressor(dictionary: bytes):
    import zstandard as zstd

    trained = dictionary[:4] == b"\x37\xa4\x30\xec"
    d = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard as zstd

    try:
        trained = zstd.train_dictionary(size, texts).as_bytes()
    except (zstd.ZstdError, ValueError):
        trained = b""
    return trained or b"\n".join(texts)[-size:]  # too few to train on: their own bytes serve


def tools(model: Model) -> list[tuple]:
    return [(_compressor(g), _compressor(b)) for g, b in zip(model.good, model.bad)]


def features(texts: list[bytes], pairs: list[tuple]) -> np.ndarray:
    """pairs: compressors for good and for bad texts."""
    mean = lambda side: np.array([sum(len(p[side].compress(t)) for p in pairs) / len(pairs) for t in texts])
    n, good, bad = np.maximum(1.0, np.array(list(map(len, texts)))), mean(0), mean(1)
    d = bad - good
    x = d / np.maximum(good, bad)
    own = np.c_[x, d / n, np.sign(d) * np.log1p(np.abs(d))]
    return np.c_[own, own * np.log(n)[:, None], x * x, np.minimum(x, 0.0)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    z = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * (p * (1 - p) + 1e-9))[:, None]) + penalty, z.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _own_lines(texts: dict[int, list[str]]) -> dict[int, list[str]]:
    """The texts without lines that several of them have: a line that went round says nothing of the texts it is in."""
    seen = Counter(line for own in texts.values() for t in own for line in set(t.split("\n")))
    return {q: ["\n".join(x for x in t.split("\n") if seen[x] < 2) for t in own] for q, own in texts.items()}


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _measure(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    own = tools(model)
    for pdf in frames:
        yield pd.DataFrame({"quality": pdf["quality"], "x": features(_bytes(pdf["text"]), own).tolist()})


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 2000, calibrate: int = 10_000, size: int = 1 << 16, longest: int = 1 << 15, pairs: int = 4) -> Model:
    """train: which labelled doc_id may be learned from."""
    bounded_batches(docs.sparkSession)
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other")
    ).filter("quality = other").select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half"))
    found = {(r.quality, r.half): r.n for r in usable.groupBy("quality", "half").agg(F.count("*").alias("n")).collect()}
    totals = {q: sum(n for (k, _), n in found.items() if k == q) for q in {q for q, _ in found}}
    if len(totals) < 2:
        return Model(constant=0.0 if 0 in totals else 1.0)

    def some(half: int, n: int) -> DataFrame:
        """doc_id, quality and text of about n rows of each class of a half (of both halves, if a class has none there)."""
        own = [usable.filter((F.col("quality") == q) & (F.col("half") == half if (q, half) in found else F.lit(True))) for q in (0, 1)]
        ids = hash_sample(own[0], F.col("doc_id"), n).unionByName(hash_sample(own[1], F.col("doc_id"), n)).drop("half")
        return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # about 2 * n short rows, whatever the tables' size

    texts: dict[int, list] = {0: [], 1: []}
    half = some(0, per_class).select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    for r in sorted(half.filter(F.octet_length("text") <= longest).collect()):
        texts[r.quality].append(r.text)
    for q in (0, 1):
        if not any(texts[q]):
            texts[q] = [r.text for r in half.filter(F.col("quality") == q).orderBy(F.octet_length("text"), "doc_id").limit(8).collect()]
    if not texts[0] or not texts[1]:  # labels without documents
        return Model(constant=float(bool(texts[1] or not texts[0])))
    pairs = max(1, min(pairs, *(len(texts[q]) // 50 for q in (0, 1))))  # a dictionary needs about 50 texts
    texts = _own_lines(texts)
    good, bad = ([_dictionary(_bytes(texts[q][k::pairs]), size) for k in range(pairs)] for q in (1, 0))
    model = Model(good, bad)
    others = some(1, calibrate).select("quality", "text").mapInPandas(partial(_measure, model=model), "quality int, x array<double>")
    rows = sorted((r.quality, list(r.x)) for r in others.collect())
    if len({q for q, _ in rows}) < 2:  # nothing to calibrate on but the texts of the dictionaries
        rows = [(q, v) for q in (0, 1) for v in features(_bytes(texts[q]), tools(model)).tolist()]
    x, y = np.array([v for _, v in rows]), np.array([q for q, _ in rows], float)
    share = {q: totals[q] / sum(totals.values()) / max(1, (y == q).sum()) * len(y) for q in (0, 1)}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - mean) / scale, y, np.where(y == 1, share[1], share[0]))
    return Model(good, bad, mean.tolist(), scale.tolist(), w.tolist())


def _score(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    own = [] if model.constant is not None else tools(model)
    for pdf in frames:
        if model.constant is not None:
            s = np.full(len(pdf), model.constant)
        else:
            x = features(_bytes(pdf["text"]), own)
            z = ((x - np.array(model.mean)) / np.array(model.scale)) @ np.array(model.weights[1:]) + model.weights[0]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        yield pdf.drop(columns="text").assign(score=s)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns in keep, which must not be called score, and score from 0 to 1."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[c for c in keep if c != "text"], "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(partial(_score, model=model), f"{kinds + ', ' if kinds else ''}score double")
