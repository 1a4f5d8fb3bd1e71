"""Alignment of two tokenizers on the same texts, with corpus-wide counts of aligned id pairs.

A byte-level BPE (A) and a sentencepiece model (B) encode each text. Offsets where tokens of both end cut them into groups;
the two tokens that end there are linked. For each document the operator gives its groups, and how well its links agree with
the whole corpus: how often their pairs are linked, and how many are the best of their B id.

Counting is external. Tasks turn their documents into records (pair, document, times), sort them by (B id, A id, document)
and write them as zstandard runs, one for each radix digit of the B id. A merge task holds the compressed runs of a digit
(or of a part of them, where a digit has many bytes: so no frequent id gathers in one task), opens a block of each at a
time, and merges by a heap of the blocks' last pairs, which counts each pair. The pairs' sums come in side-major order, by B
id and then A id, so that the highest count of a B id is known when its pairs have passed. Then the same runs are merged
again beside those counts, and each document's share streams back. Memory is that of the compressed runs of a part
(`part_bytes`), a block of each, and the counted pairs of a digit; all else is on disk, in tables of the shared folder.

Edge cases: null and empty texts, and texts whose tokens of either side don't join to a space and the text (such as those
that hold U+2581), have no tokens: zeros and empty groups. Repeated rows count each; null ids are kept, as rows go by a
row number that is written with them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, staged
from .tokens import ODD_SPACE, letters, vocabulary

#: Runs are dealt by the low digit of the B id; records of a block, and those sorted at once.
DIGITS, BLOCK, SORTED = 64, 8192, 1 << 20
#: Ids of A take the low bits of a pair.
BITS = 20
#: B writes a space as this.
MARK = "▁"
_LOADED: dict[tuple[str, str], "Pairer"] = {}

LINKED = f"{ROW} long, doc_id long, n_a long, n_b long, n_groups long, groups string, digit int, size long, run binary"
COUNTS = "digit int, first long, size long, run binary"


class Pairer:
    """Groups and linked pairs of texts. Neither tokenizer joins what stands before a single space or line feed to what
    follows, so texts are cut there, and each different piece is encoded and aligned once in a worker; texts with other
    white space are handled whole. The pieces kept are bounded: past `keep`, the half met first stays."""

    def __init__(self, a_path: str, b_path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = letters()
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for token, i in names.items():
            self.a_bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        joins = any(MARK in p.lstrip(MARK) or "\n" in p for p in map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.odd = "" if joins else ODD_SPACE  # a model whose pieces hold inner spaces can't be cut: every text is odd
        self.keep = keep
        self.known: dict[str, int] = {"": 0}
        self.strings: list[str | None] = [""]  # None: B loses bytes there
        self.sizes = np.zeros((1, 3), np.int64)  # tokens of A, tokens of B, groups
        self.pairs = np.empty(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(MARK, " ").encode()

    def _aligned(self, data: bytes, a: np.ndarray, b: np.ndarray, cuts: np.ndarray):
        """For each part of data (that ends at a cut): its groups as text, its sizes, and all pairs; None if bytes differ."""
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return None
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.zeros(len(data) + 1, np.int8)
        ends[a_ends] += 1
        ends[b_ends] += 1
        if (ends[cuts] < 2).any():
            return None
        shared = np.flatnonzero(ends == 2)
        at_a, at_b = np.searchsorted(a_ends, shared) + 1, np.searchsorted(b_ends, shared) + 1
        pairs = (b[at_b - 1] << BITS) | a[at_a - 1]
        x, y = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for p, q in zip(at_a.tolist(), at_b.tolist()):
            groups.append(f"{x[i] if p == i + 1 else ','.join(x[i:p])}|{y[j] if q == j + 1 else ','.join(y[j:q])}")
            i, j = p, q
        n_groups, n_a, n_b = (np.searchsorted(e, cuts, side="right") for e in (shared, a_ends, b_ends))
        bounds = [0, *n_groups.tolist()]
        sizes = np.c_[n_a, n_b, n_groups]
        return [";".join(groups[s:e]) for s, e in zip(bounds, bounds[1:])], np.diff(sizes, axis=0, prepend=np.zeros((1, 3), np.int64)), pairs

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of text, which starts with the space that B adds."""
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(text[1:]), np.int64)

    def _parts(self, pieces: list[str], together: int = 4000) -> tuple[list, list, list]:
        """Groups, sizes and pairs of pieces that stand after a space, or start with a line feed; many are encoded as one text."""
        strings, sizes, pairs = [], [], []
        for k in range(0, len(pieces), together):
            # a first part with a space takes the one that B adds
            part = [" a", *(p if p[0] == "\n" else " " + p for p in pieces[k : k + together])]
            data = list(map(str.encode, part))
            done = None if any(MARK in p for p in part) else self._aligned(b"".join(data), *self._ids("".join(part)), np.cumsum(list(map(len, data))))
            if done is not None:
                found = done[0][1:], [done[1][1:]], [done[2][int(done[1][0, 2]) :]]
            elif together > 1:  # to find those that B changes
                found = self._parts(pieces[k : k + together], max(1, together // 32))
            else:
                found = [None], [np.zeros((1, 3), np.int64)], []
            for all_, new in zip((strings, sizes, pairs), found):
                all_ += new
        return strings, sizes, pairs

    def _by_pieces(self, texts: pa.Array):
        """texts, each with a space before it: groups, sizes, and pairs of all in a row with their texts' numbers."""
        if len(self.known) > self.keep:  # those met first, the frequent ones, stay
            n = self.keep // 2
            self.known = dict(islice(self.known.items(), n))
            self.strings, self.sizes, self.pairs, self.ends = self.strings[:n], self.sizes[:n], self.pairs[: self.ends[n - 1]], self.ends[:n]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets, different = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        codes, pieces = different.indices.to_numpy(), different.dictionary.to_pylist()
        new = [p for p in pieces if p not in self.known]
        if new:
            strings, sizes, pairs = self._parts(new)
            self.known.update(zip(new, range(len(self.strings), len(self.strings) + len(new))))
            self.strings += strings
            self.sizes, self.pairs = np.concatenate([self.sizes, *sizes]), np.concatenate([self.pairs, *pairs])
            self.ends = np.cumsum(self.sizes[:, 2])
        at = np.array([self.known[p] for p in pieces], np.int64)[codes]
        strings = [self.strings[i] for i in at.tolist()]
        groups = []
        bounds = offsets.tolist()
        for r, (s, e) in enumerate(zip(bounds, bounds[1:])):
            own = strings[s + 1 : e]  # the first is what stands before the space
            if None in own:
                at[s:e] = 0
                groups.append("")
            else:
                groups.append(";".join(own))
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        sizes = np.add.reduceat(self.sizes[at], offsets[:-1]) if len(texts) else np.zeros((0, 3), np.int64)
        n = self.sizes[at, 2]
        take = np.repeat(self.ends[at] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return groups, sizes, self.pairs[take], np.repeat(owner, n)

    def __call__(self, texts: pa.Array):
        """groups, sizes (tokens of A, of B, groups), and pairs with the number of the text that each is of."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(pc.binary_join_element_wise(" ", texts, ""), self.odd).to_numpy(zero_copy_only=False) if self.odd else np.ones(len(texts), bool)
        odd = odd | (pc.binary_length(texts).to_numpy() == 0)
        rows = np.flatnonzero(~odd)
        own, sizes_of, pairs, owner = self._by_pieces(pc.binary_join_element_wise(" ", texts.filter(pa.array(~odd)), ""))
        groups, sizes = [""] * len(texts), np.zeros((len(texts), 3), np.int64)
        sizes[rows] = sizes_of
        for r, g in zip(rows.tolist(), own):
            groups[r] = g
        pairs, owner = [pairs], [rows[owner]]
        for r in np.flatnonzero(odd).tolist():
            text = texts[r].as_py()
            if text and MARK not in text:
                data = f" {text}".encode()
                done = self._aligned(data, *self._ids(f" {text}"), np.array([len(data)]))
                if done:
                    groups[r], sizes[r] = done[0][0], done[1][0]
                    pairs.append(done[2])
                    owner.append(np.full(len(done[2]), r))
        return groups, sizes, np.concatenate(pairs), np.concatenate(owner)


def pairer(a_path: str, b_path: str) -> Pairer:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Pairer(a_path, b_path)
    return _LOADED[a_path, b_path]


# ---- runs: blocks of columns, each block compressed by itself, so that a merge opens one at a time


def _pack(columns: tuple[np.ndarray, ...]) -> bytes:
    """Sorted columns as a run. The first column, which rises, goes by its steps."""
    import zstandard as zstd

    tool, out = zstd.ZstdCompressor(level=3), []
    for k in range(0, len(columns[0]), BLOCK):
        part = [c[k : k + BLOCK] for c in columns]
        raw = np.diff(part[0], prepend=0).astype("<u8").tobytes() + b"".join(c.astype("<i8").tobytes() for c in part[1:])
        frame = tool.compress(raw)
        out.append(np.array([len(frame), len(part[0])], "<u4").tobytes() + frame)
    return b"".join(out)


def _blocks(run: bytes, width: int) -> Iterator[list[np.ndarray]]:
    import zstandard as zstd

    tool, at = zstd.ZstdDecompressor(), 0
    while at < len(run):
        size, n = map(int, np.frombuffer(run, "<u4", 2, at))
        raw = np.frombuffer(tool.decompress(run[at + 8 : at + 8 + size]), "<i8").reshape(width, n)
        yield [np.cumsum(raw[0]), *raw[1:]]
        at += 8 + size


def _sorted(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns[1::-1])
    return tuple(c[order] for c in columns)


def merged(runs: list[bytes], width: int = 3) -> Iterator[tuple[np.ndarray, ...]]:
    """All records of the runs in order, in chunks; of each run one block is open. The heap has the open blocks' last pairs:
    up to the lowest of them, all records of all runs are at hand."""
    small, large = [], []
    for run in runs:  # runs of one block meet in memory first, else each step would touch very many
        (small if int(np.frombuffer(run, "<u4", 2)[1]) < BLOCK else large).append(run)
    held, n = [], 0
    for run in small:
        held += _blocks(run, width)
        n += len(held[-1][0])
        if n >= SORTED // 2:
            large.append(_pack(_sorted([np.concatenate(c) for c in zip(*held)])))
            held, n = [], 0
    if held:
        large.append(_pack(_sorted([np.concatenate(c) for c in zip(*held)])))
    streams = [_blocks(run, width) for run in large]
    opened = [next(s) for s in streams]
    heap = [(int(o[0][-1]), i) for i, o in enumerate(opened)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        parts = []
        for i, o in enumerate(opened):
            if o is not None and len(o[0]) and o[0][0] <= bound:
                n = int(np.searchsorted(o[0], bound, side="right"))
                parts.append([c[:n] for c in o])
                opened[i] = [c[n:] for c in o]
        used = []
        while heap and heap[0][0] == bound:
            used.append(heapq.heappop(heap)[1])
        for i in used:  # a pair can go on in the next block, which is not read yet
            opened[i] = next(streams[i], None)
            if opened[i] is not None:
                heapq.heappush(heap, (int(opened[i][0][-1]), i))
        yield _sorted([np.concatenate(c) for c in zip(*parts)])


def _link(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document, and runs of its task's records."""
    held, n = [], 0
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in LINKED.split(", ")]

    def rows(n_rows: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(n_rows, kinds[k]) for c, k in fields], [c for c, _ in fields])

    def runs() -> Iterator[pa.RecordBatch]:
        pair, row, times = _sorted([np.concatenate(c) for c in zip(*held)])
        digit = (pair >> BITS) % DIGITS
        for d in np.unique(digit).tolist():
            own = digit == d
            run = _pack((pair[own], row[own], times[own]))
            yield rows(1, digit=[d], size=[len(run)], run=[run])

    for batch in batches:
        if not batch.num_rows:
            continue
        groups, sizes, pairs, owner = pairer(a_path, b_path)(batch.column("text"))
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        numbers = batch.column(ROW).to_numpy()
        yield rows(batch.num_rows, **{ROW: numbers, "doc_id": batch.column("doc_id"), "n_a": sizes[:, 0], "n_b": sizes[:, 1], "n_groups": sizes[:, 2], "groups": groups})
        # a record for each pair of a document
        order = np.lexsort((pairs, owner))
        pairs, owner = pairs[order], owner[order]
        first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])]) if len(pairs) else np.empty(0, int)
        held.append((pairs[first], numbers[owner[first]], np.diff(first, append=len(pairs))))
        n += len(first)
        if n >= SORTED:
            yield from runs()
            held, n = [], 0
    if n:
        yield from runs()


def _parts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (digit, part); both rise."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = (row["digit"], row["part"])
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append({c: row[c] for c in columns})
    if rows:
        yield key, rows


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sums of values by keys, which rise."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], *(np.add.reduceat(v, first) for v in values)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _parts(batches, ["run"]):
        for pair, _, times in merged([r["run"] for r in rows]):
            pair, times = _sums(pair, times)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times)], ["pair", "n"])


def _maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of counted pairs, with 1 where none of the B id is more frequent. Pairs come in order, so a B id is done when
    the next one starts."""
    held = np.empty((2, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, [batch.column("pair").to_numpy(), batch.column("n").to_numpy()]], axis=1)
        side = held[0] >> BITS
        done = int(np.flatnonzero(side == side[-1])[0]) if len(side) else 0  # the last one may go on
        yield from _best(held[:, :done])
        held = held[:, done:]
    yield from _best(held)


def _best(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A run for each digit of a table of pairs and counts that holds whole B ids."""
    if not table.shape[1]:
        return
    side = table[0] >> BITS
    first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
    best = (table[1] == np.repeat(np.maximum.reduceat(table[1], first), np.diff(first, append=len(side)))).astype(np.int64)
    for part in np.split(np.arange(len(side)), np.flatnonzero(np.diff(side % DIGITS)) + 1):
        run = _pack((table[0, part], table[1, part], best[part]))
        row = (int(side[part[0]] % DIGITS), int(table[0, part[0]]), len(run), run)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["digit", "first", "size", "run"])


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's links of a part that are best, and the sum of their counts; runs of counts come first."""
    for _, rows in _parts(batches, ["kind", "run"]):
        counted = [b for r in rows if r["kind"] == 0 for b in _blocks(r["run"], 3)]
        pairs, n, best = (np.concatenate(c) for c in zip(*counted))
        for pair, row, times in merged([r["run"] for r in rows if r["kind"] == 1]):
            at = np.searchsorted(pairs, pair)
            order = np.argsort(row, kind="stable")
            row, good, total = _sums(row[order], (times * best[at])[order], (times * n[at])[order])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(good), pa.array(total)], [ROW, "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, digest: bool = False, part_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, `a1,a2|b1;a3|b2,b3` (with digest, its
    sha256, or nothing if it is empty). pairs: a, b, n and best for each linked pair of ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    a_path, b_path = a_path or vocabulary(), b_path or vocabulary("piece_bpe_32k.model")
    rows = docs.select(F.monotonically_increasing_id().alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), "text")
    linked = staged(rows.mapInArrow(partial(_link, a_path=a_path, b_path=b_path, digest=digest), LINKED), "links", compression="zstd")
    runs = linked.filter("run is not null")
    sizes = {r.digit: r.n for r in runs.groupBy("digit").agg(F.sum("size").alias("n")).collect()}  # DIGITS rows at most
    # no part has more than twice what a digit has on average, so that a frequent id's records are shared out
    most = min(part_bytes, max(1 << 16, 2 * sum(sizes.values()) // max(1, len(sizes))))
    shares = [max(1, -(-sizes.get(d, 0) // most)) for d in range(DIGITS)]
    n_parts, of = sum(shares), F.array(*map(F.lit, shares))[F.col("digit")]
    dealt = runs.select("digit", F.pmod(F.xxhash64("run"), of).cast("int").alias("part"), "run")

    together = dealt.repartition(n_parts, "digit", "part").sortWithinPartitions("digit", "part")
    pairs = together.mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    digit = (F.shiftright("pair", BITS) % DIGITS).cast("int").alias("digit")
    in_order = pairs.select(digit, "pair", "n").repartition(DIGITS, "digit").sortWithinPartitions("digit", "pair").select("pair", "n")
    counts = staged(in_order.mapInArrow(_maxima, COUNTS), "pair-counts")

    each = counts.select("digit", F.explode(F.sequence(F.lit(0), of - 1)).alias("part"), F.lit(0).alias("kind"), "first", "run")
    both = each.unionByName(dealt.select("digit", "part", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("first"), "run"))
    back = both.repartition(n_parts, "digit", "part").sortWithinPartitions("digit", "part", "kind", "first")
    sums = back.mapInArrow(_share, f"{ROW} long, n_best long, count_sum long").groupBy(ROW).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    documents = linked.filter("run is null").select(ROW, "doc_id", "n_a", "n_b", "n_groups", "groups").join(sums, ROW, "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups"
    )
    return documents, counts.mapInArrow(_unpacked, "a int, b int, n long, best boolean")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in batch.column("run").to_pylist():
            for pair, n, best in _blocks(run, 3):
                yield pa.RecordBatch.from_arrays([pa.array((pair % (1 << BITS)).astype(np.int32)), pa.array((pair >> BITS).astype(np.int32)), pa.array(n), pa.array(best == 1)], ["a", "b", "n", "best"])
