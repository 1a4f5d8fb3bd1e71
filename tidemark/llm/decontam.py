"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. One pass over the documents keeps those that have n-grams of test
items, by a bitmap of fixed size over the items' n-gram hashes, with the n-grams that hit. These are exploded, counted
over all documents and joined to the seeds table, the items' n-grams; so each document meets the items that share an
n-gram with it, in blocks of a fixed number of items, and only those.

Of the n-grams that an item and a document share, the `seeds` that are rarest in the corpus come first: around them the
text is aligned to the item (match 2, mismatch -1, gap -1), then around the other shared n-grams; the best score divided
by that of the whole item is the passage's score, and its span is traced from the alignment. A passage is left out only if
it can't reach the threshold, or the best score so far, whatever its order: its score is at most the share of the item's
words that it holds.

Edge cases: null and empty texts match nothing; items of fewer than n words have no n-gram and match nothing (a word or
two would mark every text that has them); a null item_id comes back null; repeated items and rows match each; very common
passages are found too, as rarity only orders the n-grams; documents go by their content, so null and repeated ids are no
reason to remove one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, staged

OUT = "doc_id long, item_id long, score double, start long, n_words long"
#: The bitmap has a place for each value of so many leading bits of a hash.
BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    """The words' hashes, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n words in a row."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    w = words.view(np.uint64)
    out = np.zeros(len(w) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ w[k : len(w) - n + 1 + k]) * MIX
            out ^= out >> np.uint64(29)
    return out


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


class _Seeds:
    """n-grams of a block of items: hash to the items and places that have it."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], n: int):
        self.items, self.n = items, n
        self.where: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            for at, h in enumerate(grams(words, n).tolist()):
                self.where.setdefault(h, []).append((k, at))
        self.sorted = np.array(sorted(self.where), np.uint64)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[_place(self.sorted)] = True
        self.vocabulary = np.unique(np.concatenate([words for _, words in items]))
        self.numbers = [np.searchsorted(self.vocabulary, words) for _, words in items]

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers in the items' vocabulary; its size for others."""
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == words, k, len(self.vocabulary))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the n-grams that items have."""
        g = grams(words, self.n)
        at = np.flatnonzero(self.bits[_place(g)])
        k = np.minimum(np.searchsorted(self.sorted, g[at]), len(self.sorted) - 1)
        at = at[self.sorted[k] == g[at]]
        return at, g[at]


def align(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Smith-Waterman: the best local score and the place in text where that alignment ends."""
    steps = np.arange(len(text) + 1) * -gap
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for w in item:
        up = row + gap
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(text == w, match, mismatch))
        row = np.maximum(up, 0)
        row[0] = 0
        row = np.maximum(np.maximum.accumulate(row + steps) - steps, 0)  # gaps in the item's row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The best local score, and where the shortest alignment that has it and ends there first starts and ends."""
    best, end = align(item, text)
    return best, end - align(item[::-1], text[:end][::-1])[1], end


def _grams(frames: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for block, words in zip(pdf["block"], pdf["words"]):
            h = np.unique(grams(np.asarray(words, np.int64), n))
            yield pd.DataFrame({"block": np.full(len(h), block, "i4"), "h": h.view(np.int64)})


def _bitmap(seeds: DataFrame) -> bytes:
    """A bit for each place that some seed has; Spark builds it in pieces of 32,768 bits."""
    place = F.shiftrightunsigned("h", 64 - BITS) + 1
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(1 << BITS - 3)
    for r in parts.collect():
        out[(r.part - 1) * 4096 : r.part * 4096] = r.bits
    return bytes(out)


def _find(frames: Iterator[pd.DataFrame], bitmap: bytes, n: int) -> Iterator[pd.DataFrame]:
    """Documents with n-grams whose place the bitmap has, and these n-grams."""
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").astype(bool)
    for pdf in frames:
        found: list = []
        for words in pdf["words"]:
            g = grams(np.asarray(words, np.int64), n)
            found.append(np.unique(g[bits[_place(g)]]).view(np.int64))
        keep = np.array([len(x) > 0 for x in found], bool)
        if keep.any():
            yield pdf[keep].assign(found=[x for x in found if len(x)], doc_id=pdf["doc_id"][keep].astype("Int64"))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _judge(frames: Iterator[pd.DataFrame], every: _Seeds, counts: dict[int, int], seeds: int, threshold: float) -> Iterator[pd.DataFrame]:
    has = np.zeros(len(every.vocabulary) + 1, bool)

    def most(k: int, own: np.ndarray) -> float:
        """What an alignment of item k to these words can reach."""
        has[own] = True
        has[-1] = False
        share = float(has[every.numbers[k]].mean())
        has[own] = False
        return share

    for pdf in frames:
        rows = []
        for row, doc, words in zip(pdf[ROW], pdf["doc_id"], pdf["words"]):
            words = np.asarray(words, np.int64)
            numbers = every.numbered(words)
            spans: dict[int, dict[int, list[tuple[int, int]]] | None] = {}
            for at, h in zip(*(x.tolist() for x in every.hits(words))):
                for k, place in every.where[h]:
                    if k not in spans:
                        spans[k] = {} if most(k, numbers) >= threshold else None
                    if spans[k] is not None:
                        n = len(every.items[k][1])
                        spans[k].setdefault(h, []).append((max(0, at - place - n // 2 - 2), min(len(words), at - place + n + n // 2 + 2)))
            for k, own in spans.items():
                if own is None:
                    continue
                item_id, item = every.items[k]
                best = (0.0, 0, 0)
                ranked = sorted(own, key=lambda h: (counts[h], h))
                for hs in (ranked[:seeds], ranked[seeds:]):
                    for a, b in _merged([span for h in hs for span in own[h]]):
                        for c in range(a, b, 4096):  # a passage that repeats without end: windows that overlap by the item
                            end = min(b, c + 4096 + 2 * len(item))
                            reach = most(k, numbers[c:end])
                            if reach < threshold or reach <= best[0]:
                                continue
                            score, _ = align(item, words[c:end])
                            if score / (2 * len(item)) > best[0]:
                                best = (score / (2 * len(item)), c, end)
                if best[0] >= threshold:
                    _, first, last = span(item, words[best[1] : best[2]])
                    rows.append((row, doc, item_id, best[0], best[1] + first, last - first))
        if rows:
            yield pd.DataFrame(rows, columns=[ROW, *(c.split()[0] for c in OUT.split(", "))]).astype({"doc_id": "Int64", "item_id": "Int64"})


def _content(text: Column) -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(text, F.lit("two"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, score, start, n_words for each document and item that it holds a copy of, exact or edited: the passage
    is n_words long and starts at word `start`."""
    return _contaminated(docs, benchmark, **how)[0].drop(ROW)


def _contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, seeds: int = 16, threshold: float = 0.5, block: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The same with __row, and the documents met: __row with two hashes of the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") >= n)
    blocks = max(1, -(-texts.count() // block))
    items = staged(texts.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int")), "items")
    table = staged(items.select("block", "words").mapInPandas(partial(_grams, n=n), "block int, h long").distinct(), "seeds")
    one, two = _content(F.col("text"))
    corpus = docs.select(F.monotonically_increasing_id().alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), one.alias("__one"), two.alias("__two"), words_of(F.col("text")).alias("words"))
    near = staged(corpus.mapInPandas(partial(_find, bitmap=_bitmap(table), n=n), f"{ROW} long, doc_id long, __one long, __two long, words array<long>, found array<long>"), "near")
    hits = near.select(ROW, F.explode("found").alias("h"))
    rare = staged(hits.groupBy("h").agg(F.count("*").alias("n")).join(table, "h"), "rarity")
    routes = staged(hits.join(rare, "h").select(ROW, "block").distinct(), "routes") if blocks > 1 else None
    out = []
    for b in range(blocks):
        part = items.filter(F.col("block") == b)
        own = sorted(((r.item_id, np.array(r.words, np.int64)) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1].tolist()))  # a block
        if not own:
            continue
        counts = {r.h & 0xFFFFFFFFFFFFFFFF: r.n for r in rare.filter(F.col("block") == b).collect()}  # at most a row for each n-gram of the block
        mine = near if routes is None else near.join(routes.filter(F.col("block") == b).select(ROW), ROW, "left_semi")
        judged = mine.select(ROW, "doc_id", "words").mapInPandas(partial(_judge, every=_Seeds(own, n), counts=counts, seeds=seeds, threshold=threshold), f"{ROW} long, {OUT}")
        out.append(staged(judged, "judged"))
    found = reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"{ROW} long, {OUT}")
    return found, near.select(ROW, "__one", "__two")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows that hold a copy of a test item, each by its own content."""
    found, met = _contaminated(docs, benchmark, **how)
    bad = staged(found.select(ROW).distinct().join(met, ROW).select("__one", "__two").distinct(), "contaminated")
    one, two = _content(docs["text"])
    return docs.join(bad, (one == bad["__one"]) & (two == bad["__two"]), "left_anti")
