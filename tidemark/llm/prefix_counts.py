"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

In byte-pair encoding the tokens of a prefix are those of a shorter prefix and one last token: the only token that ends
there and may stand after the last token of what is before it (two tokens may be neighbours if encoding their bytes gives
just these two). So last[i] and count[i] = count[i - length] + 1 follow from shorter prefixes, and every prefix of a text
is counted in one pass. A word's prefixes don't depend on the words before, so the pass runs once for each different piece
of text in a worker, and a text's counts are those of its pieces, added up.

Three things differ between a prefix and the text that goes on: white space before a word (a prefix that ends in a run of
white space has the whole run as one word), contractions ('l is not yet 'll), and special tokens (a part of <|endoftext|> is
plain text, and the words before it may go on into it). All three are counted as the prefix by itself would be encoded.

The table has a row for each document: its size, its count, and the steps of its counts, one for each character, as
little-endian signed 32-bit integers compressed by zstandard. Questions about truncation and budgets read the table alone;
counts can fall as a text grows, so the longest prefix within a budget is looked for over all prefixes.

Edge cases: null and empty texts have one prefix of 0 tokens; repeated and null ids are rows each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .tokens import ODD_SPACE, letters, vocabulary

TABLE = "doc_id long, n_chars long, n_bytes long, n_tokens long, steps binary"
#: Contractions that are words of their own, and of which a part is two words.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: White space as the pre-tokenizer has it: two or more before something else.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}(?=[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])")
_LOADED: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Counts of all prefixes of a text. `keep` bounds the pieces that are remembered (the half met first stays)."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.halves: dict[str, tuple[str, str]] = {}
        for pair in pairs:
            self.halves.setdefault(pair[0] + pair[1], pair)
        self.special = [t.content for t in tool.get_added_tokens_decoder().values() if t.content]
        self.specials = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        self.pre = tool.pre_tokenizer.pre_tokenize_str
        own = letters()
        self.continues = frozenset(c for c, b in own.items() if 0x80 <= b < 0xC0)
        self.odd = "|".join([ODD_SPACE, "\\x00", *map(re.escape, self.special)])
        self.keep = keep
        self.known: dict[str, int] = {"": 0}
        self.steps, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)
        # what is remembered of tokens and words
        self.reached: dict[str, bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.found = ahocorasick.Automaton()
        for token in model["vocab"]:
            if token not in self.special and all(map(own.__contains__, token)) and self._reached(token):
                self.found.add_word(token, (token, len(token)))
        self.found.make_automaton()

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts of a token that stand at its start (side 0) or end (1) while it is put together, from the whole to a byte,
        and the rank at which each is joined to what is inside."""
        out = self.edges.get((token, side))
        if out is None:
            out, part, until = [], token, float("inf")
            while True:
                out.append((part, until))
                halves = self.halves.get(part)
                if halves is None:
                    break
                part, until = halves[side], self.rank[halves]
            self.edges[token, side] = out
        return out

    def _may_follow(self, a: str, b: str) -> bool:
        """If the bytes of two tokens are encoded as just these two: no part at a's end is joined to one at b's start before
        both are joined inside. Of equal pairs the left one is joined first."""
        out = self.fits.get((a, b))
        if out is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            rank, out = self.rank, True
            for x, x_until in self._edge(a, 1):
                for y, y_until in self._edge(b, 0):
                    r = rank.get((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        out = False
            self.fits[a, b] = out
        return out

    def _reached(self, token: str) -> bool:
        """If a token's own bytes are encoded as this token."""
        out = self.reached.get(token)
        if out is None:
            halves = self.halves.get(token)
            if halves is None:
                out = len(token) == 1
            else:  # its halves would stay two, were it not for their own pair
                a, b = halves
                out = self._reached(a) and self._reached(b) and not any(
                    r is not None and r < x_until and r <= y_until
                    for x, x_until in self._edge(a, 1) for y, y_until in self._edge(b, 0) if (x, y) != halves for r in [self.rank.get((x, y))]
                )
            self.reached[token] = out
        return out

    def word(self, word: str, n_chars: int) -> list[int]:
        """The steps of the counts of all prefixes of a word, given in byte letters, at its character ends."""
        out = self.words.get(word)
        if out is not None:
            return out
        n = len(word)
        last, count, fits = [""] * n, [0] * n, self.fits.get
        for end, (token, size) in self.found.iter(word):  # tokens that end at each place, the longest first
            if not count[end]:
                before = end - size
                if before < 0:
                    last[end], count[end] = token, 1
                elif count[before]:
                    fit = fits((last[before], token))
                    if self._may_follow(last[before], token) if fit is None else fit:
                        last[end], count[end] = token, count[before] + 1
        if n > n_chars:
            count = [c for c, after in zip(count, [*word[1:], ""]) if after not in self.continues]
        if word in CONTRACTIONS:
            count[1] = 2
        out = [b - a for a, b in zip([0, *count], count)]
        if n < 64:
            if len(self.words) > 300_000:
                self.words = dict(islice(self.words.items(), 150_000))
            self.words[word] = out
        return out

    def plain(self, text: str) -> np.ndarray:
        """The counts of all prefixes of a text without special tokens, the empty one first."""
        steps = [0]
        for word, (start, end) in self.pre(text):
            steps += self.word(word, end - start)
        out = np.cumsum(steps)
        # a prefix that ends at the last character of a run of white space before a word has the run as one word
        for m in RUN.finditer(text):
            run = self.pre(m.group())
            out[m.end()] = out[m.start()] + sum(self.word(run[0][0], len(m.group())))
        return out

    def whole(self, text: str) -> np.ndarray:
        """The counts of all prefixes of any text."""
        out, base, at = np.zeros(len(text) + 1, np.int32), 0, 0
        for m in self.specials.finditer(text) if self.specials else ():
            counts = self.plain(text[at : m.end() - 1]) + base
            out[at : m.end()] = counts
            at, base = m.end(), int(counts[m.start() - at]) + 1
            out[at] = base
        out[at:] = self.plain(text[at:]) + base
        return out

    def _number(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in pieces if p not in self.known]
        if new:
            # cut as one text: each starts with a space or line feed, or gets one that is skipped
            added = [not p[0] in " \n" for p in new]
            words, steps, sizes = iter(self.pre("".join("\n" + p if x else p for p, x in zip(new, added)))), [], []
            for p, x in zip(new, added):
                if x:
                    next(words)
                first = len(steps)
                while len(steps) - first < len(p):
                    word, (start, end) = next(words)
                    steps += self.word(word, end - start)
                sizes.append(len(p))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.steps = np.concatenate([self.steps, np.array(steps, np.int32)])
        return np.array([self.known[p] for p in pieces], np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The steps of the counts of all texts in a row, one for each character, and where each text starts, with the end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if len(self.known) > self.keep:
            n = self.keep // 2
            self.known = dict(islice(self.known.items(), n))
            self.steps, self.ends = self.steps[: self.ends[n - 1]], self.ends[:n]
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        # pieces start with their space or line feed, but for the first of a text
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", "\0\n"), " ", "\0 "), "\0")
        different = lists.values.dictionary_encode()
        at = self._number(different.dictionary.to_pylist())[different.indices.to_numpy()]
        begins = np.where(at > 0, self.ends[at - 1], 0)
        n = self.ends[at] - begins
        take = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own, sizes = self.steps[take], np.zeros(len(texts), np.int64)
        if len(at):
            sizes[~odd] = np.add.reduceat(n, lists.offsets.to_numpy()[:-1])
        others = [np.diff(self.whole(texts[r].as_py())) for r in np.flatnonzero(odd).tolist()]
        sizes[odd] = list(map(len, others))
        if not others:
            return own, np.concatenate([[0], np.cumsum(sizes)])
        bounds, plain = np.concatenate([[0], np.cumsum(sizes)]), np.repeat(~odd, sizes)
        out = np.empty(int(bounds[-1]), np.int32)
        out[plain] = own
        out[~plain] = np.concatenate(others)
        return out, bounds


def counter(path: str) -> PrefixCounter:
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def _tabled(batches: Iterator[pa.RecordBatch], vocab: str) -> Iterator[pa.RecordBatch]:
    import zstandard as zstd

    tool = zstd.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column("text")
        steps, bounds = counter(vocab)(texts)
        sums = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
        raw, at = memoryview(steps.astype("<i4", copy=False)).cast("B"), (4 * bounds).tolist()
        frames = [tool.compress(raw[a:b]) for a, b in zip(at, at[1:])]
        columns = (batch.column("doc_id"), np.diff(bounds), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), np.diff(sums[bounds]), pa.array(frames, pa.binary()))
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in TABLE.split(", ")])


def prefix_table(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_bytes, n_tokens and steps of every document, written to the shared folder."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(partial(_tabled, vocab=vocab or vocabulary()), TABLE), "prefix-counts", compression="none")


def counts_of(steps: bytes) -> np.ndarray:
    """The counts of all prefixes of a document, the empty one first."""
    import zstandard as zstd

    return np.concatenate([[0], np.cumsum(np.frombuffer(zstd.ZstdDecompressor().decompress(steps), "<i4"), dtype=np.int64)])


def _answered(frames: Iterator, name: str, answer: Callable[[np.ndarray, int], int | None]) -> Iterator:
    for pdf in frames:
        asked = [None if q != q or q is None else int(q) for q in pdf["__asked"]]
        said = [None if q is None else answer(counts_of(bytes(s)), q) for q, s in zip(asked, pdf["steps"])]
        yield pdf.drop(columns=["steps", "__asked"]).assign(**{name: np.array(said, object)}).astype({name: "Int64"})


def _ask(table: DataFrame, asked, name: str, answer) -> DataFrame:
    kept = [f for f in table.schema if f.name != "steps"]
    rows = table.withColumn("__asked", asked.cast("long") if not isinstance(asked, int) else F.lit(asked).cast("long"))
    return rows.mapInPandas(partial(_answered, name=name, answer=answer), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", {name} long")


def _at(counts: np.ndarray, n: int) -> int:
    return int(counts[min(max(n, 0), len(counts) - 1)])


def _within(counts: np.ndarray, budget: int) -> int | None:
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else None


def tokens_of_prefix(table: DataFrame, n_chars) -> DataFrame:
    """The table with tokens, the count of each document's first n_chars characters (a number, or a column of the table; past
    the end, the whole document; null gives null), without steps."""
    return _ask(table, n_chars, "tokens", _at)


def longest_within(table: DataFrame, budget) -> DataFrame:
    """The table with fits, the characters of each document's longest prefix of at most budget tokens, without steps; a
    budget below 0, or null, gives null."""
    return _ask(table, budget, "fits", _within)


def truncated(docs: DataFrame, budget: int, vocab: str | None = None) -> DataFrame:
    """doc_id and text of every document, cut to its longest prefix of at most budget tokens; null stays null. Counts are made
    where the text is, so that nothing is joined."""
    bounded_batches(docs.sparkSession)
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, bounds = counter(vocab)(batch.column("text"))
            cut = [None if t is None else t[: _within(np.concatenate([[0], np.cumsum(steps[a:b])]), budget) or 0] for t, a, b in zip(batch.column("text").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cut, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")
