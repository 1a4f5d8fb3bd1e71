"""Token ids of whole texts, with the tokenizers library."""

from __future__ import annotations

import os
import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOADED: dict[str, "Encoder"] = {}

#: White space runs, white space at an end, or any but single spaces and line feeds.
ODD_SPACE = "[ \\n][ \\n]|[ \\n]\\z|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]"
#: Pieces encoded as one text.
TOGETHER = 5000


def letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, the others from 256 up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """The ids of whole texts, many at a time.

    The byte-level pre-tokenizer never joins what stands before a single space or line feed to what follows it. So texts
    are cut there, column by column in Arrow; each different piece is encoded once in a worker, and the ids of a text are
    taken from those of its pieces. Texts with other white space, or that hold an added token such as <|endoftext|>, are
    encoded whole. Both give the ids that the library gives for the whole text. The pieces kept are bounded: past `keep`,
    those met first (the frequent ones) stay.
    """

    def __init__(self, path: str, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([ODD_SPACE, *(re.escape(t) for t in added if t)])
        self.keep = keep
        # in a byte-level vocabulary each character of a token stands for one byte
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.n_bytes[i] = len(token)
        # piece -> its number; a piece at the start of a text has a space before it, which no other piece has
        self.known: dict[str, int] = {"": 0}
        self.pool = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)  # the end of piece k in the pool at k, its start at k - 1
        self.used = 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, end = len(self.known), self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while first + len(keys) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.pool[self.used : end] = ids
        self.ends[first : first + len(keys)] = self.used + np.cumsum(sizes)
        self.known.update(zip(keys, range(first, first + len(keys))))
        self.used = end

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that stand after a space, or start with a line feed: encoded as one text, which is cut between them again."""
        for k in range(0, len(pieces), TOGETHER):
            part = [p if p[0] == "\n" else " " + p for p in pieces[k : k + TOGETHER]]
            ids = self._encode(["".join(part)])[0]
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy())
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
            self._keep(pieces[k : k + TOGETHER], ids, np.diff(cuts, prepend=0))

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = lists.offsets.to_numpy()[:-1]
        different = lists.values.dictionary_encode()
        codes, pieces = different.indices.to_numpy(), different.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.keep:
            self.known = dict(islice(self.known.items(), self.keep // 2))
            self.used = int(self.ends[len(self.known) - 1])
        later = np.ones(len(codes), bool)
        later[starts] = False
        asked = np.zeros(len(pieces), bool)
        asked[codes[later]] = True
        numbers = self._numbers(pieces)
        unknown = np.flatnonzero(asked & (numbers < 0)).tolist()
        if unknown:
            new, first = [pieces[i] for i in unknown], len(self.known)
            self._learn(new)
            numbers[unknown] = np.arange(first, first + len(new))
        heads = [" " + p if p else p for p in map(pieces.__getitem__, codes[starts].tolist())]
        unknown = list(dict.fromkeys(h for h in heads if h not in self.known))
        for k in range(0, len(unknown), 256):
            each = self._encode([h[1:] for h in unknown[k : k + 256]])
            self._keep(unknown[k : k + 256], np.concatenate(each), np.array(list(map(len, each))))
        at = numbers[codes]
        at[starts] = self._numbers(heads)
        ends = self.ends[at]
        begins = np.where(at > 0, self.ends[at - 1], 0)
        sizes = ends - begins
        take = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.pool[take], np.add.reduceat(sizes, starts) if len(starts) else sizes

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by end_id, and where each starts, with the end of the last one."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        ids, sizes = self._by_pieces(texts.filter(pa.array(~whole)))
        sizes_of = np.zeros(len(texts), np.int64)
        sizes_of[~whole] = sizes
        others, rows = [], np.flatnonzero(whole)
        for k in range(0, len(rows), 64):
            others += self._encode(texts.take(pa.array(rows[k : k + 64])).to_pylist())
        sizes_of[rows] = list(map(len, others))
        bounds = np.concatenate([[0], np.cumsum(sizes_of + 1)])
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        out[np.repeat(bounds[:-1][~whole] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
        for row, own in zip(rows.tolist(), others):
            out[bounds[row] : bounds[row] + len(own)] = own
        return out, bounds


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
