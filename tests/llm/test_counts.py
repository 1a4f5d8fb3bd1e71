"""Token alignment, prefix counts and divergence of sources against brute force, on small tables with odd rows."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import alignment, divergence, prefix_counts, queries
from tidemark.llm.tokens import letters, vocabulary

PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "é", "漢", "🙂", "<|endoftext|>", "<|endof", "<s>", "'s", "'ll", "'re", "1", "23", "The", "ing", "\t", "\x00", "\x1c", "　", "!", "...", " the ", " hello", "ation", "▁"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 18))) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], "doc_id long, text string, n_links string, digit int, steps string, n int")


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(vocabulary()), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    return a, b


def aligned(tools, text):
    """Groups as text, sizes, and linked pairs, from the plain libraries."""
    a_tool, b_tool = tools
    if not text:
        return "", (0, 0, 0), []
    a_tool.encode_special_tokens = True
    a, b, own = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text), letters()
    a_tool.encode_special_tokens = False
    a_bytes = [bytes(own[c] for c in a_tool.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return "", (0, 0, 0), []
    ends_a, ends_b = (np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes))
    groups, links, i, j = [], [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return ";".join(groups), (len(a), len(b), len(groups)), links


def test_alignment_brute_force(spark, tools):
    words = odd_texts(120)
    rows = [(i, t) for i, t in enumerate(words)] + [(None, "alpha beta"), (None, None), (7, "alpha beta"), (7, "alpha beta"), (900, ""), (901, " the end. " * 3000), (902, "x" * 20000), (903, "a▁b")]
    want = [(i, *aligned(tools, t)) for i, t in rows]
    counts = collections.Counter(link for *_, links in want for link in links)
    top = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    for part_bytes in (32 << 20, 500):  # one part for a digit, and many
        docs, pairs = alignment.align(documents(spark, rows).repartition(3), part_bytes=part_bytes)
        got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in docs.collect())
        assert got == sorted((str(i), *sizes, sizes[2], sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), g) for i, g, sizes, links in want)
        assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {x: (n, n == top[x[1]]) for x, n in counts.items()}
    assert alignment.align(documents(spark, []))[0].count() == 0


def test_alignment_query_gives_digests(spark, tools, tmp_path):
    rows = [(i, t) for i, t in enumerate(odd_texts(30, 5))] + [(50, None), (51, "plain words, plain words")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.groups_sha256 for r in queries.op11_alignment(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(g.encode()).hexdigest() if (g := aligned(tools, t)[0]) else "" for i, t in rows}


def test_merge_of_runs():
    """Runs of less than a block and of many, with one pair that fills several blocks of all runs."""
    rng = np.random.default_rng(4)
    runs, every = [], []
    for n in (10, 500, 20_000, 40_000, 3, 60_000):
        pair = np.where(rng.random(n) < 0.4, 77, rng.integers(0, 5000, n))
        table = np.array([pair, rng.integers(0, 1 << 40, n), rng.integers(1, 5, n)])
        every.append(table)
        runs.append(alignment._pack(alignment._sorted(list(table))))
    chunks = [np.array(c) for c in alignment.merged(runs)]
    assert all((a[0, -1] <= b[0, 0]) for a, b in zip(chunks, chunks[1:])) and all((np.diff(c[0]) >= 0).all() for c in chunks)
    assert sorted(map(tuple, np.concatenate(chunks, 1).T.tolist())) == sorted(map(tuple, np.concatenate(every, 1).T.tolist()))
    assert max(c.shape[1] for c in chunks) < 6 * alignment.BLOCK  # a block of each run at most


def test_hot_digit_is_split(spark):
    """One pair that two thirds of all records have is merged in parts, and still counted whole."""
    rows = [(i, "the " * 3 + f"w{i % 50}") for i in range(3000)]
    docs, pairs = alignment.align(documents(spark, rows).repartition(24), part_bytes=400)
    assert {r.doc_id for r in docs.collect()} == set(range(3000))
    assert max(r.n for r in pairs.collect()) == 3000 * 3


def test_prefix_counts_equal_the_library(tools):
    a, counter = tools[0], prefix_counts.counter(vocabulary())
    texts = odd_texts(400) + [None, "", "a" * 300, "ab" * 200, " " * 50, "\n" * 30 + "x", "it'll we've you're 'l 'r", "x <|endoftext|><|endoftext|> y"]
    steps, bounds = counter(pa.array(texts))
    for t, s, e in zip(texts, bounds, bounds[1:]):
        t = t or ""
        assert [0, *np.cumsum(steps[s:e]).tolist()] == [len(a.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t


def test_prefix_counts_of_random_bytes(tools):
    """Words of random letters and scripts: whole counts, with few pieces remembered."""
    rng = random.Random(6)
    counter = prefix_counts.PrefixCounter(vocabulary(), keep=50)
    for _ in range(20):
        texts = [" ".join("".join(chr(rng.choice([rng.randint(97, 122), rng.randint(97, 122), rng.randint(33, 0x2FF), rng.randint(0x4E00, 0x4E40)])) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 10))) for _ in range(20)]
        steps, bounds = counter(pa.array(texts))
        for t, s, e in zip(texts, bounds, bounds[1:]):
            assert steps[s:e].sum() == len(tools[0].encode(t, add_special_tokens=False).ids), t


def test_prefix_table_answers_questions(spark, tools):
    count = lambda t: len(tools[0].encode(t, add_special_tokens=False).ids)
    rows = [(i, t) for i, t in enumerate(odd_texts(40, 8))] + [(None, "one two three"), (None, None), (60, ""), (61, "some words here, " * 2000), (62, "z" * 30000)]
    table = prefix_counts.prefix_table(documents(spark, rows))
    key = lambda r: (str(r[0]), *r[1:])
    got = sorted(key((r.doc_id, r.n_chars, r.n_bytes, r.n_tokens)) for r in table.collect())
    assert got == sorted(key((i, len(t or ""), len((t or "").encode()), count(t or ""))) for i, t in rows)
    texts = {i: t or "" for i, t in rows if i is not None}
    for r in prefix_counts.tokens_of_prefix(table.filter("doc_id is not null"), 7).collect():
        assert r.tokens == count(texts[r.doc_id][:7])
    longest = lambda t, n: max(k for k in range(len(t) + 1) if count(t[:k]) <= n)
    for r in prefix_counts.longest_within(table.filter("doc_id < 40"), 4).collect():
        assert r.fits == longest(texts[r.doc_id], 4)
    cut = {r.doc_id: r.text for r in prefix_counts.truncated(documents(spark, rows[:40] + rows[-3:]), 4).collect()}
    assert all(cut[i] == texts[i][: longest(texts[i], 4)] for i in range(40)) and count(cut[61]) <= 4 and cut[60] == ""
    assert {r.fits for r in prefix_counts.longest_within(table, -1).collect()} == {None}
    assert prefix_counts.prefix_table(documents(spark, [])).count() == 0


def plain_divergence(rows, min_docs=10):
    """The contract in plain Python."""
    import re

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = collections.Counter(), collections.defaultdict(set), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            w = w.translate(table)
            count[lang, source, w] += 1
            docs[lang, w].add(k)
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (g, w), d in docs.items() if g == lang and len(d) >= min_docs]
        sources, v = sorted(s for g, s in groups if g == lang), len(kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v) for w in kept}
        p = {s: share({w: count[lang, s, w] for w in kept}) for s in sources}
        q = share({w: sum(count[lang, s, w] for s in sources) for w in kept})
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][w], q[w]), w) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(found[:most])]
    return sorted(out)


def divergent_rows(n=600, seed=9):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma-delta", "é", "Été", "x1y", "漢字", "it's", "under_score", "ZZ", "\x00", "tab\tword"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", None])) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "xx", "lone"), ("!!! 123", "xx", "other"), ("rare", "yy", None), ("alpha " * 5000, "fr", "s1"), ("x" * 50000, "en", "s2")] + [("copy copy Copy", "en", "s3")] * 12


@pytest.mark.parametrize("block", [256, 2])
def test_divergence_brute_force(spark, block):
    rows = divergent_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(4)
    got = sorted(tuple(r) for r in divergence.divergence(docs, block=block).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_agrees_with_its_sql(spark, tmp_path):
    spark.createDataFrame(divergent_rows(300, 10), "text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["op13_divergence"]).fetchall()
    got = queries.op13_divergence(spark, str(tmp_path)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_shares_stay_exact_for_huge_counts(spark):
    from pyspark.sql import functions as F

    n, total, v = 3_000_000_000_000, 9_000_000_000_007, 12_345_678
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)
