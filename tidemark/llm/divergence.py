"""How the word use of each source of a language differs from that of the others, in whole numbers.

Words are cut by one translate table: it lowers A-Z and turns every other ASCII character but letters into a space, so that
bytes.translate and bytes.split make the words of a text in two passes over its bytes. A Counter for each document gives a
row for each of its words: how often it occurs there, and 1 document. Rows are added up inside an Arrow batch, inside a
task and by a shuffle on the word, so that no frequent word and no large source gathers in one task.

The table of a language is sparse: a word holds the sources that have it. Of the sum over all kept words, a pair of sources
needs single terms only for words that one of them has; all others are alike, and are counted. The sources of a language
are taken in blocks of `block`: a task meets its words with a block, and adds its terms up for each pair of sources. So work
is the number of (word, source) entries times the number of sources, and memory a batch of words times a block.

Edge cases: null text, language and source count as empty; texts without words leave their group with counts of 0, and a
language without kept words has values of 0 and no terms; repeated rows are documents each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged

#: Letters are lowered, bytes of other scripts stay, the rest of ASCII is blank.
TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
UNIT = 1_000_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: the words of a batch's documents, added up by language and source."""
    for batch in batches:
        words: list[bytes] = []
        times: list[int] = []
        sizes: list[int] = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            count = Counter(words_of(text))
            words += count.keys()
            times += count.values()
            sizes.append(len(count))
        owner = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        columns = [batch.column("lang").take(owner), batch.column("source").take(owner), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
        table = pa.table(columns, ["lang", "source", "term", "n"]).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n", "count")])
        yield from table.select(["lang", "source", "term", "n_sum", "n_count"]).rename_columns(["lang", "source", "term", "n", "docs"]).combine_chunks().to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), exact for counts far beyond what a long holds 10^9 times of."""
    whole = (count + 2).cast("decimal(38,0)") * F.lit(UNIT)
    parts = total.cast("decimal(38,0)") + 2 * kept.cast("decimal(38,0)")
    return (F.call_function("div", whole, parts) + 1).cast("long")


def gap(p, q):
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits in 64 bits."""
    return (p - q) * (p - q) // (p + q)


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For words (their sources and shares) met with a block of sources: for each source that has the word and each of the
    block, the sum of gaps, of those where both have it, and how many these are; added up over a batch."""
    for pdf in frames:
        for (lang, _), part in pdf.groupby(["lang", "block"], sort=False):
            names, floor = list(part["names"].iloc[0]), np.asarray(part["floors"].iloc[0], np.int64)
            at = {s: i for i, s in enumerate(names)}
            sizes = part["sources"].map(len).to_numpy()
            sources = np.concatenate(part["sources"].to_numpy())
            shares = np.concatenate(part["shares"].to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(part)), sizes)
            column = np.fromiter((at.get(s, -1) for s in sources), np.int64, len(sources))
            dense, has = np.tile(floor, (len(part), 1)), np.zeros((len(part), len(names)), bool)
            inside = column >= 0
            dense[row[inside], column[inside]] = shares[inside]
            has[row[inside], column[inside]] = True
            codes, own = pd.factorize(sources)
            order = np.argsort(codes, kind="stable")
            first = np.searchsorted(codes[order], np.arange(len(own)))
            for k, (s, e) in enumerate(zip(first, [*first[1:], len(order)])):
                rows = row[order[s:e]]
                gaps, both = gap(shares[order[s:e], None], dense[rows]), has[rows]
                yield pd.DataFrame({"lang": lang, "source": own[k], "item": names, "some": gaps.sum(0), "shared": np.where(both, gaps, 0).sum(0), "n_shared": both.sum(0)})


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = 256) -> DataFrame:
    """lang, source, part (pair: item is another source of the language; term: a word that the source has more often than
    the language), item, value, and rank by value within (lang, source, part)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = staged(term_counts(docs), "term-counts", compression="zstd")
    per_word = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", F.col("n").alias("c"))).alias("by_source")
    )
    kept = staged(per_word.filter(F.col("docs") >= min_docs).drop("docs"), "kept-words", compression="zstd")
    entries = kept.select("lang", "term", "n", F.explode("by_source").alias("e")).select("lang", "term", "n", "e.source", "e.c")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("c").alias("total"), F.count("*").alias("has"))
    every = docs.select(text("lang").alias("lang"), text("source").alias("source")).distinct()
    none = F.lit(0).cast("long")
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "has", "v", "lang_total")]
    )
    floor = F.when(F.col("v") > 0, share(none, F.col("total"), F.greatest("v", F.lit(1)))).otherwise(F.lit(1).cast("long"))
    groups = staged(groups.withColumn("floor", floor), "groups")

    # each entry with its own share; the table of groups is as small as the result's count of sources
    shared = entries.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("c"), F.col("total"), F.col("v")).alias("p"), share(F.col("n"), F.col("lang_total"), F.col("v")).alias("q")
    )
    square = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    terms = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", square, F.col("p") + F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    words = shared.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p")).alias("e")).select("lang", "e.source", "e.p")
    size = F.ceil(F.count("*").over(Window.partitionBy("lang")) / block)
    blocks = groups.filter("v > 0").withColumn("block", F.pmod(F.xxhash64("source"), size).cast("int")).groupBy("lang", "block").agg(
        F.collect_list(F.struct("source", "floor")).alias("g")
    ).select("lang", "block", F.col("g.source").alias("names"), F.col("g.floor").alias("floors"))
    met = words.select("lang", F.col("source").alias("sources"), F.col("p").alias("shares")).join(blocks, "lang").mapInPandas(
        _pairs, "lang string, source string, item string, some long, shared long, n_shared long"
    )
    sums = met.groupBy("lang", "source", "item").agg(*[F.sum(c).alias(c) for c in ("some", "shared", "n_shared")])
    a = groups.select("lang", "source", "has", "v", F.col("floor").alias("fa"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("has").alias("has_b"), F.col("floor").alias("fb"))
    back = sums.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("some").alias("other"))
    pairs = a.join(b, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left").join(back, ["lang", "source", "item"], "left")
    zero = lambda c: F.coalesce(F.col(c), none)
    neither = F.col("v") - F.col("has") - F.col("has_b") + zero("n_shared")
    low = F.call_function("div", (F.col("fa") - F.col("fb")) * (F.col("fa") - F.col("fb")), F.col("fa") + F.col("fb"))
    value = F.when(F.col("v") > 0, zero("some") + zero("other") - zero("shared") + neither * low).otherwise(none)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
