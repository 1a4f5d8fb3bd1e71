"""Hidden Markov language model over word classes.

The `own` most frequent words of the training texts are classes of their own; all other words, seen or not, are dealt to
`endings` classes by their last two letters, so the emission table has a fixed number of rows. Inside a class, words share
the smoothed frequency (c + d) / (n + d * (v + 1)), where c counts the word, n and v the tokens and distinct words of the
class in the training texts, and one place is kept for words never seen (a class of one word needs none). So a text's
probability is that of its classes, by the scaled forward recursion over all latent state paths, times that of the words
inside their classes.

Training is Baum-Welch: each task runs forward and backward over its texts and sums expected transitions and emissions;
the sums are added over partitions by class, and only that table (states x classes, of fixed size) reaches the driver,
which forms the next model. The first updates take growing shares of the training texts (a hash deals them: 1/32 up to
1/2), so that the states settle early. All later ones take every training text, until an update adds less than `tol`
(base e, a token) to the likelihood; Model.history has the likelihood before each. A very long text is cut into blocks,
whose steps are taken side by side between rows and columns from products of their step matrices: exact, with bounded memory.

Word counts cover all training texts. The `hot` most frequent words of at most 64 bytes (a list of fixed size) are counted
where the text is read; the others leave it as a row for each text and different word, which meet their counts by a
shuffle, so that no common word gathers in one task.

Edge cases: a null or empty text is the end token alone; without training texts N and V are 0 and every word is unknown;
repeated rows are scored alike and count as texts each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, new_path, staged

DELTA = 0.1
#: A word that no text has, as words hold no space.
END = " "
#: Training texts are dealt to shares of 1/32, 1/32, 1/16, 1/8, 1/4 and 1/2; the stepwise updates take these in turn.
SHARES = (1, 1, 2, 4, 8, 16)
STEPS = (0, 0, 0, 0, 1, 1, 2, 2, 3, 4, 5)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # (classes + 1) x states; the last class is the end
    history: list[float] = field(default_factory=list)  # log likelihood (base e) of a token before each update on all texts


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, with A-Z lowered and an END after each text's, and where each text starts, with the
    end of the last one."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, bounds = lists.values, lists.offsets.to_numpy()
    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at the ends leaves empty words
    bounds = np.concatenate([[0], np.cumsum(some)])[bounds]
    # END takes its place by number: texts and ends are one list of words, which is put in order
    words = pa.concat_arrays([words.filter(pa.array(some)), pa.array([END], pa.string())])
    order = np.insert(np.arange(bounds[-1]), bounds[1:], len(words) - 1)
    return words.take(pa.array(order)), bounds + np.arange(len(bounds))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, c: a row for each different word of a batch."""
    for batch in batches:
        if batch.num_rows:
            counts = pc.value_counts(words_of(batch.column("text"))[0])
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "c"])


def _ending(word: Column, endings: int) -> Column:
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % endings).cast("int")


@dataclass
class Vocabulary:
    """What tasks know of words: the frequent ones with their logs, and how the others are dealt to classes."""

    hot: list[str]  # by falling count; the first `own` are classes of their own
    own: int
    endings: int
    base: np.ndarray  # of each hot word: log10 of its smoothed frequency
    inside: np.ndarray  # log10 of that inside its class
    end: tuple[float, float]  # the same of END

    @property
    def end_class(self) -> int:
        return self.own + self.endings


CODED = f"{ROW} long, doc_id long, held_out boolean, share int, classes array<int>, tokens long, hot long, base double, inside double, rare array<struct<word:string,k:long>>"


def _code(batches: Iterator[pa.RecordBatch], voc: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Texts as class numbers, with the logs of their frequent words summed and their other words counted."""
    number = {w: i for i, w in enumerate(voc.hot)} | {END: len(voc.hot)}
    base, inside = np.append(voc.base, [voc.end[0], 0.0]), np.append(voc.inside, [voc.end[1], 0.0])  # the last is for rare words

    @lru_cache(100_000)
    def ending(last: str) -> int:
        return voc.own + zlib.crc32(last.encode()) % voc.endings

    for batch in batches:
        if not batch.num_rows:
            continue
        words, bounds = words_of(batch.column("text"))
        different = words.dictionary_encode()
        codes, names = different.indices.to_numpy(), different.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.array([number.get(w, -1) for w in names])
        kinds = np.where((known >= 0) & (known < voc.own), known, voc.end_class)
        for i in np.flatnonzero((known < 0) | (known >= voc.own) & (known < len(voc.hot))).tolist():
            kinds[i] = ending(names[i][-2:])
        rare = known[codes] < 0
        owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        pairs, k = np.unique(owner[rare] * len(names) + codes[rare], return_counts=True)
        lists = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(1, len(names)), minlength=batch.num_rows))])
        items = pa.StructArray.from_arrays([different.dictionary.take(pa.array(pairs % max(1, len(names)))), pa.array(k, pa.int64())], ["word", "k"])
        total = lambda x: pa.array(np.add.reduceat(x, bounds[:-1]))
        columns = {c: batch.column(c) for c in (ROW, "doc_id", "held_out", "share")} | {
            "classes": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(kinds[codes], pa.int32())),
            "tokens": pa.array(np.diff(bounds)), "hot": total((~rare).astype(np.int64)),
            "base": total(base[known][codes]), "inside": total(inside[known][codes]),
            "rare": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), items),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _batches(frames: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Row numbers and sequences of about `most` tokens together: large batches share their steps among many texts."""
    rows: list = []
    arrays: list[np.ndarray] = []
    size = 0
    for pdf in frames:
        for row, classes in zip(pdf[ROW], pdf["classes"]):
            rows.append(row)
            arrays.append(np.asarray(classes, np.int64))
            size += len(arrays[-1])
            if size >= most:
                yield rows, arrays
                rows, arrays, size = [], [], 0
    if rows:
        yield rows, arrays


#: Sequences longer than LONG are cut into blocks of CUT, whose steps are taken side by side.
LONG, CUT = 32_768, 2048


def _cut(model: Model, a: np.ndarray) -> list[tuple]:
    """A long sequence as blocks: their classes, the scaled forward row before each (none before the first), and the backward
    column after each. The product of the scaled step matrices of a block is found for all blocks at once; two walks over these
    products give rows and columns, so that the blocks' own recursions are those of the whole sequence."""
    n, states = -(-len(a) // CUT), len(model.start)
    last = len(a) - (n - 1) * CUT
    product = np.repeat(np.eye(states)[None], n, 0)
    for t in range(CUT):
        live = n if t < last else n - 1
        at = model.emit[a[t::CUT][:live]]
        moved = product[:live] @ model.move
        if t == 0:
            moved[0] = np.eye(states)  # the first block starts without a move
        moved *= at[:, None, :]
        product[:live] = moved / moved.sum((1, 2), keepdims=True)
    rows, columns = [model.start], [np.ones(states)]
    for m in product:
        row = rows[-1] @ m
        rows.append(row / row.sum())
    for m in product[:0:-1]:
        column = m @ columns[-1]
        columns.append(column / column.max())
    columns.reverse()
    return [(a[k * CUT : (k + 1) * CUT], None if k == 0 else rows[k], columns[k] / (rows[k + 1] @ columns[k]) if k < n - 1 else None) for k in range(n)]


def forward(model: Model, arrays: list[np.ndarray], counts: tuple | None = None, most: int = 1_000_000) -> np.ndarray:
    """The log (base e) of each sequence's probability, by the scaled forward recursion. With counts (start, move, emit), the
    expected counts are added there. Memory is that of the steps of about `most` tokens, however long a sequence is."""
    total = np.zeros(len(arrays))
    parts = [(r, *part) for r, a in enumerate(arrays) for part in (_cut(model, a) if len(a) > LONG else [(a, None, None)])]
    parts.sort(key=lambda p: -len(p[1]))
    ends, size = [], 0
    for i, p in enumerate(parts):
        size += len(p[1])
        if size >= most or i == len(parts) - 1:
            ends.append(i + 1)
            size = 0
    for s, e in zip([0, *ends], ends):
        np.add.at(total, [p[0] for p in parts[s:e]], _steps(model, parts[s:e], counts))
    return total


def _steps(model: Model, parts: list[tuple], counts: tuple | None) -> np.ndarray:
    """The recursions over sequences and blocks of sequences, longest first, all side by side."""
    arrays = [p[1] for p in parts]
    n, states = len(arrays), len(model.start)
    sizes = np.array([len(a) for a in arrays])
    steps = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
    firsts = np.concatenate([[0], np.cumsum(live)])
    flat = np.empty(firsts[-1], np.int64)
    for r, a in enumerate(arrays):
        flat[firsts[: len(a)] + r] = a
    emit = model.emit[flat]
    alpha, norm = (np.empty_like(emit) if counts is not None else None), np.empty(firsts[-1])
    inner = np.array([p[2] is not None for p in parts])  # blocks that go on from another
    before = np.array([model.start if p[2] is None else p[2] for p in parts])
    first = np.where(inner[:, None], before @ model.move, before)
    total, row = np.zeros(n), None
    for t in range(steps):
        lo, hi = firsts[t], firsts[t + 1]
        row = (first if t == 0 else row[: hi - lo] @ model.move) * emit[lo:hi]
        c = row.sum(1)
        row = row / c[:, None]
        norm[lo:hi] = c
        if alpha is not None:
            alpha[lo:hi] = row
    logs = np.log(norm)
    for t in range(steps):
        total[: live[t]] += logs[firsts[t] : firsts[t + 1]]
    if counts is None:
        return total
    start, move, emitted = counts
    after = np.array([np.ones(states) if p[3] is None else p[3] for p in parts])
    beta = after[: live[-1]]  # alpha becomes alpha * beta on the way back
    alpha[firsts[steps - 1] :] *= beta
    moved = np.zeros((states, states))
    for t in range(steps - 2, -1, -1):
        lo, mid, hi = firsts[t], firsts[t + 1], firsts[t + 2]
        ahead = emit[mid:hi] * beta / norm[mid:hi, None]
        moved += alpha[lo : lo + hi - mid].T @ ahead
        beta = after[: mid - lo].copy()
        beta[: hi - mid] = ahead @ model.move.T
        alpha[lo:mid] *= beta
    if inner.any():  # the moves into blocks
        moved += before[inner].T @ (emit[: live[0]] * beta / norm[: live[0], None])[inner]
    move += moved * model.move
    start += alpha[: live[0]][~inner].sum(0)
    for k in range(states):
        emitted[:, k] += np.bincount(flat, alpha[:, k], len(emitted))
    return total


def _expect(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """Expected counts of a task: a row for each class that occurs, and one for each state's start and moves, and one that has
    the log likelihood."""
    states, log = len(model.start), np.zeros(len(model.start))
    start, move, emitted = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    for _, arrays in _batches(frames):
        log[0] += forward(model, arrays, (start, move, emitted)).sum()
    used = np.flatnonzero(emitted.sum(1))
    ids = np.concatenate([used, [-1], -2 - np.arange(states), [-2 - states]])
    values = np.vstack([emitted[used], start[None], move, log[None]])
    yield pd.DataFrame({"class": ids} | {f"s{k}": values[:, k] for k in range(states)})


def _updated(sums: DataFrame, states: int, prior: np.ndarray, weight: float) -> tuple[Model, float, float]:
    """The next model from the summed counts, pulled towards the training texts' class frequencies where counts are few, and
    the log likelihood of a token under the model before, and the tokens."""
    start, move, emit = np.full(states, 0.1), np.full((states, states), 0.1), weight * np.repeat(prior[:, None], states, 1)
    log, tokens = 0.0, 0.0
    for r in sums.collect():  # at most classes + states + 3 rows
        if r[0] >= 0:
            emit[r[0]] += r[1:]
            tokens += sum(r[1:])
        elif r[0] == -1:
            start += r[1:]
        elif r[0] == -2 - states:
            log += r[1]
        else:
            move[-2 - r[0]] += r[1:]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), log / max(1.0, tokens), tokens


def train(rows: DataFrame, prior: np.ndarray, states: int, tol: float = 1e-3, seed: int = 7, weight: float = 20.0) -> Model:
    """rows: __row, share, classes. Baum-Welch over shares of the rows, then over all until an update adds less than tol to the
    log likelihood of a token. It is below 0 and each update but the last adds tol, which bounds their number."""
    rng = np.random.default_rng(seed)
    emit = prior[:, None] * np.exp(rng.normal(0, 1.0, (len(prior), states)))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)), emit / emit.sum(0))
    np.fill_diagonal(model.move, 0.9)
    model.move /= model.move.sum(1, keepdims=True)
    schema = "class int, " + ", ".join(f"s{k} double" for k in range(states))
    tasks, history = rows.rdd.getNumPartitions(), []
    for share in chain(STEPS, repeat(None)):
        part = rows.select(ROW, "classes")
        if share is not None:  # as much for each task as in a full step
            part = rows.filter(F.col("share") == share).select(ROW, "classes").coalesce(max(1, tasks * SHARES[share] // sum(SHARES)))
        sums = part.mapInPandas(partial(_expect, model=model), schema).groupBy("class").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)])
        new, log, tokens = _updated(sums, states, prior, weight)
        model = new if tokens else model  # a share without texts says nothing
        if share is None:
            history.append(log)
            if len(history) > 1 and history[-1] - history[-2] < tol:
                break
            if len(history) > 2 - history[0] / tol:
                raise RuntimeError("the likelihood rises past its bound")
    model.history = history
    return model


def _likelihood(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for rows, arrays in _batches(frames):
        yield pd.DataFrame({ROW: rows, "path": forward(model, arrays) / np.log(10)})


def _share(key: Column) -> Column:
    dealt, share = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(sum(SHARES))), F.lit(len(SHARES) - 1)
    for k in range(len(SHARES) - 2, -1, -1):
        share = F.when(dealt < sum(SHARES[: k + 1]), k).otherwise(share)
    return share


def score(docs: DataFrame, held_out: Column, states: int = 8, own: int = 12_000, endings: int = 4096, hot: int = 50_000, tol: float = 1e-3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; the log10 of its probability by
    word frequencies and by the model. Training takes the rows that aren't held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), _share(F.col("doc_id")).alias("share"), "text")
    counted = rows.filter("not held_out").select("text").mapInArrow(_count, "word string, c long")
    words = staged(counted.groupBy("word").agg(F.sum("c").alias("c")).withColumn("class", _ending(F.col("word"), endings)), "words")
    n_all, n_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    texts = words.filter(F.col("word") != END)
    n_end = n_all - (texts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    short = texts.filter(F.octet_length("word") <= 64)
    top = short.orderBy(F.col("c").desc(), "word").limit(hot).collect()
    own = min(own, len(top))
    groups = texts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    n, v = np.zeros(endings), np.zeros(endings)
    for r in groups.collect():  # at most `endings` rows
        n[r["class"]], v[r["class"]] = r.n, r.v
    for r in top[:own]:
        n[r["class"]] -= r.c
        v[r["class"]] -= 1
    counts = np.array([r.c for r in top], float)
    rest_mass = n + DELTA * (v + 1)
    mass = np.concatenate([counts[:own] + DELTA, rest_mass, [n_end + DELTA]])
    base_mass = n_all + DELTA * (n_words + 1)
    of = np.array([mass[i] if i < own else rest_mass[r["class"]] for i, r in enumerate(top)])
    voc = Vocabulary([r.word for r in top], own, endings, np.log10((counts + DELTA) / base_mass), np.log10((counts + DELTA) / of) if len(top) else counts, (float(np.log10((n_end + DELTA) / base_mass)), 0.0))
    path = new_path(spark, "classes")
    rows.mapInArrow(partial(_code, voc=voc), CODED).write.option("compression", "zstd").partitionBy("share").parquet(path)
    coded = spark.read.schema(CODED).parquet(path)
    model = train(coded.filter("not held_out"), mass / mass.sum(), states, tol)
    paths = coded.select(ROW, "classes").mapInPandas(partial(_likelihood, model=model), f"{ROW} long, path double")

    within = F.broadcast(spark.createDataFrame([(k, float(m)) for k, m in enumerate(rest_mass)], "class int, mass double"))
    rare = coded.select(ROW, F.explode("rare").alias("r")).select(ROW, "r.word", "r.k").join(words.select("word", "c"), "word", "left")
    rare = rare.withColumn("class", _ending(F.col("word"), endings)).join(within, "class")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy(ROW).agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"), F.sum(F.col("k") * F.log10((c + DELTA) / base_mass)).alias("rare_base"),
        F.sum(F.col("k") * F.log10((c + DELTA) / F.col("mass"))).alias("rare_inside"),
    )
    none = F.lit(0.0)
    return coded.drop("classes", "rare").join(sums, ROW, "left").join(paths, ROW).select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), (F.when(F.lit(n_all) > 0, F.col("hot")).otherwise(0) + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", none)).alias("base_score"),
        (F.col("path") + F.col("inside") + F.coalesce("rare_inside", none)).alias("score"),
    )
