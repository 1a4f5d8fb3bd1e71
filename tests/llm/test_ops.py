"""Training-data operators against brute force, on small tables with odd rows."""

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, hmm, html_extract, line_dedup, ngram_join, packing, quality, token_io, topk, url_filter
from tidemark.llm.common import new_path
from tidemark.llm.tokens import Encoder, vocabulary

DOCS = "doc_id long, text string, extra string, class_id string"
WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, text(rng, int(rng.integers(1, 120)))) for i in range(60)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS)


ODD = [(None, "alpha beta gamma"), (100, None), (101, ""), (102, "one two"), (102, "one two"), (103, "  a  b \n\n c "), (104, "é ü " * 3000)]


def test_url_filter_rules_and_spread(spark):
    page = lambda i, url, html="": (i, url, html, "h")
    pages = spark.createDataFrame([
        page(1, "http://A.example.org/en/1?x"), page(2, "https://b.net/p"), page(3, None), page(4, "no scheme"), page(5, "http://x.com/de/a"),
        page(6, "http://far.net/", '<a href="http://x.com/de/a">x</a>'), page(7, "http://org/x"), page(8, "http://x.com", None), page(8, "http://x.com", None),
    ], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, threshold=0.1).collect()}
    assert (1, "a.example.org", "/en/1", "example.org/en/1", "block") in got and (7, "org", "/x", "org/", "allow") in got
    assert (3, "", "", None, "allow") in got and (4, "", "", None, "allow") in got
    assert (6, "far.net", "/", None, "block") in got and (2, "b.net", "/p", None, "allow") in got
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_spread_equals_power_iteration(spark):
    links = {"a": "bc", "b": "c", "c": "a", "d": "a"}
    pages = spark.createDataFrame([(i, f"http://{h}.{'org' if h == 'a' else 'net'}/x", "".join(f'<a href="//{x}.{"org" if x == "a" else "net"}/">' for x in to)) for i, (h, to) in enumerate(links.items())], "page_id long, url string, html string")
    got = {r.host: r.trust for r in url_filter.host_scores(pages, max_iter=6).collect()}
    name = lambda h: f"{h}.{'org' if h == 'a' else 'net'}"
    mass, want = {"a": 1.0}, {"a": 1.0}
    for _ in range(6):
        new = {}
        for h, m in mass.items():
            for x in links[h]:
                new[x] = new.get(x, 0) + 0.85 * m / len(links[h])
        mass = new
        for h, m in mass.items():
            want[h] = want.get(h, 0) + m
    assert all(abs(got[name(h)] - v) < 1e-9 for h, v in want.items())


def test_spread_settles_on_chains_and_cycles(spark):
    # four blocked sites behind a hub, a chain of 11 hosts before it, and a cycle that links to a blocked site
    links = {f"c{i}": [f"c{i + 1}"] for i in range(1, 11)} | {"c11": ["hub"], "hub": ["b0", "b1", "b2", "b3"], "r0": ["r1"], "r1": ["r2", "b4"], "r2": ["r0"], "b0": [], "b1": [], "b2": [], "b3": [], "b4": []}
    url = lambda h: f"http://{h}.com/de/a" if h[0] == "b" else f"http://{h}.net/"
    site = lambda h: url(h).split("/")[2]
    pages = spark.createDataFrame([(i, url(h), "".join(f'<a href="//{site(x)}/">' for x in to)) for i, (h, to) in enumerate(links.items())], "page_id long, url string, html string")
    at = {h: i for i, h in enumerate(links)}
    back = np.zeros((len(at), len(at)))
    for h, to in links.items():
        for x in to:
            back[at[h], at[x]] = 1 / sum(x in y for y in links.values())
    want = np.linalg.solve(np.eye(len(at)) - 0.85 * back, np.array([float(h[0] == "b") for h in at]))
    got = {r.host: r.distrust for r in url_filter.host_scores(pages).collect()}
    assert all(abs(got.get(site(h), 0.0) - want[i]) < 1e-5 for h, i in at.items())
    verdicts = {r.host: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert {h for h in at if verdicts[site(h)] == "block"} == {h for h, i in at.items() if want[i] > 0.5} and verdicts["c1.net"] == "block"


def test_url_filter_agrees_with_its_sql_on_a_graph(spark, tmp_path):
    """Chains, cycles, dead ends and several links between two hosts, through rules and both spreads."""
    import duckdb

    from tidemark.llm import queries

    rng = np.random.default_rng(11)
    kinds = ["http://s{}.org/x", "http://b{}.com/de/a", "http://m{}.com/fr/b", "http://n{}.net/p"]
    urls = [kinds[int(rng.integers(4))].format(i) for i in range(60)] + [None, "no scheme", "HTTP://N1.NET?q"]
    hosts = [u.split("/")[2] for u in urls[:60]]
    html = ["".join(f'<p><A class="q" HREF=//{h.upper()}/z>x</a>' for h in rng.choice(hosts, int(rng.integers(0, 5)))) for _ in urls]
    html[3], html[4] = None, "<a href='http://n7.net/'>x</a>" * 20000
    pages = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, host string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op1_url_filter(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["op1_url_filter"]).fetchdf()
    order = lambda df: sorted(map(str, df[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(df.notna(), None).values.tolist()))
    assert order(got) == order(want)
    spread = got[got.rule.isna()].verdict.value_counts()
    assert spread["block"] >= 3 and spread["allow"] > 3


def test_html():
    page = """<html><head><title>t</title></head><body><header>site</header><nav><a href=x>menu</a></nav><div class="cookie-notice">Accept</div>
      <article><h1>Head &amp; line</h1><p>First,\n para <b>bold</b>.<p>Second &lt;one&gt;<br>goes on</article>
      <aside>side</aside><div id=comments><p>I say, this, that</p></div><form>f</form><footer>&copy;</footer>"""
    assert html_extract.extract_text(page) == "Head & line First, para bold. Second <one> goes on"
    assert html_extract.extract_text(None) == html_extract.extract_text("") == ""
    assert html_extract.extract_text("plain text") == "plain text"
    assert html_extract.extract_text("<div><p>cut off, here <!-- x").startswith("cut off")


def plain():
    """The library alone, as it comes from the vocabulary file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


ODD_TEXTS = [None, "", " ", "\n", "a", "a b", "a\nb", "\na", " a", "a  b", "a <|endoftext|> b", "<|endoftext|>", "a <|endoftext|>b", "x\n\ny ", "é ü\tz", "don't  stop'll", "a\xa0 b",
             "a\u3000b", "\U0001f600 ok\n", "ab" * 5000, "q\x00 w", "a\x85 b", "x \u200b y", "\ufffd \U00010000"]


def test_html_of_labelled_pages(spark):
    """Pages around a known article: its blocks come back whole, and nothing of what surrounds them."""
    rng = np.random.default_rng(13)
    around = ['<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>', "<header><h2>Site name</h2></header>", '<aside class="sidebar"><p>Read more, here, and there</p></aside>',
              '<div class="cookie-consent"><p>We use cookies, sorry.</p></div>', "<footer><p>Imprint, contact</p></footer>", '<section id="comments"><p>First, nice, really nice, indeed</p></section>',
              "<script>var p = '<p>not, text</p>';</script>", "<style>p { color: red }</style>", '<form><p>Sign up, now</p><input value="x"></form>', '<div class="ad-banner"><p>Buy, buy, buy</p></div>', "<!-- <p>hidden, text</p> -->"]
    rows, want = [], {}
    for i in range(120):
        blocks = [", ".join(text(rng, 6) for _ in range(int(rng.integers(2, 6)))) + "." for _ in range(int(rng.integers(2, 7)))]
        article = "".join(f"<p>{b.replace(' ', chr(10) if k % 2 else ' ')} &amp; <b>more</b></p>" for k, b in enumerate(blocks))
        parts = [str(x) for x in rng.choice(around, 5, replace=False)]
        k = int(rng.integers(0, 6))
        rows.append((i, f"http://x/{i}", "<html><body>" + "".join(parts[:k]) + f"<article><h1>Title {i}</h1>{article}</article>" + "".join(parts[k:]) + "</body></html>", 1))
        want[i] = " ".join([f"Title {i}", *(f"{b} & more" for b in blocks)])
    rows += [(200, None, None, 1), (201, "u", "", 1), (202, "u", "<p>\U0001f600, e\u0301 &#x1F600; &nbsp; a</p>", 1), (202, "u", "<p>\U0001f600, e\u0301 &#x1F600; &nbsp; a</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_extract.extract(pages).collect()
    assert {r.page_id: r.text for r in got if r.page_id < 200} == want and all(r.n_chars == len(r.text) for r in got)
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id > 200) == [(201, "u", "", 0)] + [(202, "u", "\U0001f600, e\u0301 \U0001f600 a", 9)] * 2
    assert [(r.url, r.text) for r in got if r.page_id == 200] == [(None, "")]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_work_is_linear_in_depth():
    import time

    for page in ("<div>x, y", "<i>", "<p>z", "<a href=x>y", "<b></div>", "<td><tr>q"):
        took = []
        for n in (5_000, 40_000):
            began = time.perf_counter()
            html_extract.extract_text(page * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * took[0] + 1, page


def test_ids_equal_the_plain_library():
    rng = np.random.default_rng(3)
    parts = ["a", "b", "1", "'", ",", ".", " ", " ", "\n", "\t", "é", "\xa0", " the", "<|endoftext|>", "'s", "\u2003", "\u6f22", "\U0001f600"]
    texts = ODD_TEXTS + ["".join(rng.choice(parts, int(rng.integers(0, 12)))) for _ in range(20000)]
    for keep in (1_000_000, 50):  # a small cache forgets pieces between batches
        own = Encoder(vocabulary(), keep)
        for k in range(0, len(texts), 5000):
            some = texts[k : k + 5000]
            ids, bounds = own(pa.array(some, pa.string()), 7)
            for t, a, b, e in zip(some, bounds, bounds[1:], plain().encode_batch([t or "" for t in some], add_special_tokens=False)):
                assert ids[a:b].tolist() == [*e.ids, 7], t
    ids, bounds = own(pa.array([], pa.string()), 7)
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_tokens_and_round_trip(spark, docs):
    rows = docs + ODD + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    tok = plain()
    want = {}
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    path = new_path(spark, "t")
    token_io.write_ids(frame(spark, rows), path)
    got = token_io.read_ids(spark, path, digest=True).collect()
    back = {}
    for r in got:
        back.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    some = token_io.read_ids(spark, path, doc_ids=[7, 104]).collect()
    assert {r.doc_id for r in some} == {7, 104}
    assert list(next(r.ids for r in some if r.doc_id == 7))[:-1] == tok.encode(dict(docs)[7], add_special_tokens=False).ids
    empty = new_path(spark, "t")
    token_io.write_ids(frame(spark, rows).limit(0), empty)
    assert token_io.read_ids(spark, empty).count() == 0


def test_topk_brute_force(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.normal(0, 1, 8).round(2).tolist()) for i in range(300)] + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [0.5] * 8), (304, [0.5] * 8), (305, [1.0])]
    df = spark.createDataFrame([(i, v, "z") for i, v in vecs], "vec_id long, embedding array<double>, score string")
    ok = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vecs if v is not None and None not in v and np.isfinite(v).all()}
    want = {(q, k + 1, i, s) for q in ok if q % 50 == 0 for k, (s, i) in enumerate(sorted(((int(ok[q] @ ok[i]), i) for i in ok if i != q and len(ok[i]) == len(ok[q])), key=lambda x: (-x[0], x[1]))[:5])}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=3).collect()}
    assert got == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(twice, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 131072), (0, 2, 1, 131072)]


def edited(rng, words, edits, name):
    words = list(words)
    for k in rng.choice(len(words), edits, replace=False):
        words[k] = f"{name}{k}"
    return " ".join(words)


def test_near_duplicates_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    base, other = text(rng, 150).split(), text(rng, 150).split()
    rows = list(docs) + ODD
    for i in range(40):  # groups of edited copies, larger than a block: tight, and at any distance up to the threshold
        rows.append((200 + i, edited(rng, base, 1, f"new{i}x")))
    for i in range(60):
        rows.append((400 + i, edited(rng, other, int(rng.integers(0, 8)), f"new{i % 20}x")))
    rows += [(300, rows[0][1]), (301, rows[0][1])]
    got = {}
    for r in ngram_join.near_duplicates(frame(spark, rows), block=16).collect():
        got.setdefault(r.doc_id, set()).add((r.class_id, r.n_links))

    def shingle(t):
        w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = sorted({shingle(t) for _, t in rows}, key=lambda s: sorted(map(str, s)))
    link = {s: [u for u in sets if u != s and s and u and len(s & u) / len(s | u) >= 0.8] for s in sets}
    group = {}
    for s in sets:
        todo, seen = [s], {s}
        while todo:
            for u in link[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        group[s] = seen
    for d, t in rows:
        s = shingle(t)
        name = min((x for x, u in rows if x is not None and shingle(u) in group[s]), default=None)
        assert (name, len(link[s])) in got[d]
    kept = ngram_join.keep_one(frame(spark, rows), block=16)
    assert kept.count() == len({frozenset(g) for g in group.values()}) and kept.columns == ["doc_id", "text", "extra", "class_id"]
    assert ngram_join.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_forest_recall_near_the_threshold(spark):
    """Links of 0.8 to 0.9 alone, measured against all pairs."""
    rng = np.random.default_rng(5)
    rows, sets = [], []
    for i in range(400):
        words = text(rng, 240).split()
        for name in ("a", "b"):
            rows.append((len(rows), edited(rng, words, int(rng.integers(1, 4)), f"{name}{i}x")))
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    same = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    want = {2 * i for i, s in enumerate(same) if s >= 0.8} | {2 * i + 1 for i, s in enumerate(same) if s >= 0.8}
    got = {r.doc_id for r in ngram_join.near_duplicates(frame(spark, rows)).collect() if r.n_links}
    assert sum(0.8 <= s < 0.9 for s in same) > 150 and got <= want and len(got) >= 0.995 * len(want)


def test_missed_links_are_estimated():
    rng = np.random.default_rng(6)
    true = rng.uniform(0.8, 0.95, 20000)  # similarities of links; each tree's common prefix has length geometric in them
    for depth in (8, 5, 4):
        trees = rng.random((20000, ngram_join.TREES)) < true[:, None] ** depth
        k = np.rint(true * ngram_join.VALUES).astype(int)
        links, lost = ngram_join.missed(np.bincount(k, trees.sum(1), ngram_join.VALUES + 1), depth, 0.79)
        assert abs(links / 20000 - 1) < 0.05 and abs(lost - (~trees.any(1)).sum()) < 0.01 * 20000


def test_a_large_family_stays_linear(spark):
    rng = np.random.default_rng(7)
    base = text(rng, 100).split()
    rows = [(i, edited(rng, base, 1, f"n{i}x")) for i in range(3000)]
    docs = frame(spark, rows)
    got = ngram_join.near_duplicates(docs, block=64).collect()
    # each text differs from the others in one word: up to ten of 96 shingles, fewer at the ends
    assert {r.class_id for r in got} == {0} and all(r.n_links == 2999 for r in got)


def test_row_numbers_do_not_depend_on_the_scan(spark, tmp_path):
    """The same rows are kept when the parallelism, and so the split of the files, changes between two scans."""
    rng = np.random.default_rng(8)
    words = text(rng, 80).split()
    rows = [(i, edited(rng, words, 1, f"n{i}x") if i % 3 == 0 else text(rng, 60)) for i in range(300)]
    frame(spark, rows).repartition(6).write.parquet(f"{tmp_path}/docs")
    docs, before = spark.read.parquet(f"{tmp_path}/docs"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    first = ngram_join.keep_one(docs)
    lines = line_dedup.dedup_lines(docs)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert {r.doc_id for r in first.collect()} == {0} | {i for i in range(300) if i % 3}
        assert {r.doc_id: r.text for r in lines.collect()} == dict(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_packing(spark, docs):
    rows = docs + ODD
    rows = rows + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = packing.pack_documents(frame(spark, rows), size=256).collect()
    tok, pieces, want = plain(), [], 0
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        pieces += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        want += len(ids)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(pieces, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(bins) <= -(-want // 256) + 2
    sizes = np.sort(np.random.default_rng(0).integers(1, 100, 500))[::-1]
    for how in ("norm", "dot"):
        where, _ = packing.best_fit(sizes, (100, 3, 6000), (1.0, 0.1, 0.1), how)
        for b in range(where.max() + 1):
            own = sizes[where == b]
            assert own.sum() <= 100 and len(own) <= 3 and ((own**2).sum() <= 6000 or len(own) == 1 and own[0] ** 2 > 6000) if (own**2 <= 6000).all() else True
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\nb\nc\nd"), (4, None), (5, ""), (6, "a\nb"), (7, "\n\n\n\n"), (7, "\n\n\n\n"), (8, " a \nb\nc "),
            (9, "a\nb"), (10, "lone"), (11, " lone "), (12, "lone\n"), (13, "a\nb\n")]
    rows += [(20 + i, "\n".join(rng.choice(list("abc "), int(rng.integers(1, 7))))) for i in range(60)] + [(None, "u\nv"), (99, "u\nv")]
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=str)
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [] if t is None else t.split("\n")
        gone = set()
        for k in range(max(1, len(lines) - 2) if lines else 0):
            w = tuple(x.strip(" ") for x in lines[k : k + 3])
            if any(w):
                if w in seen:
                    gone.update(range(k, min(k + 3, len(lines))))
                seen.add(w)
        want.append((d, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_quality_held_out(spark):
    rng = np.random.default_rng(6)
    good = [(i, text(rng, 80), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(f"{w}$$$ ###" for w in rng.choice(WORDS, 40)), 0) for i in range(200)]
    rows = good + bad
    df = frame(spark, [(d, t) for d, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(None, 1), (102, None), (103, 0), (103, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels, F.col("doc_id") % 4 != 2)
    scores = {r.doc_id: r.score for r in quality.score(df, model, "doc_id").collect()}
    held = [(scores[d] >= 0.7) == (q == 1) for d, _, q in rows if d % 4 == 2]
    assert np.mean(held) > 0.95 and all(0 <= s <= 1 for s in scores.values())
    long = quality.fit(df, labels, F.col("doc_id") % 4 != 2, longest=1)  # no text is that short: the shortest make the dictionaries
    assert long.constant is None and long.good and long.bad
    same = b"ab " * 50
    tool = quality._compressor(model.good[0])
    assert (quality.features([same, b""], [(tool, tool)]) == 0).all()  # nothing but the difference counts
    assert quality.fit(df, labels.filter("quality = 1"), F.lit(True)).constant == 1.0
    assert quality.fit(df, labels.limit(0), F.lit(True)).constant == 1.0


def test_quality_figures_on_held_out_documents(spark):
    """The query on sf0.1: ranking and decisions on the fold that the fit has not seen."""
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id], r.predicted) for r in queries.op8_quality(spark, sf).filter("held_out").collect() if r.doc_id in labels]
    good, bad = [s for s, q, _ in rows if q == 1], [s for s, q, _ in rows if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.99
    assert np.mean([p == q for _, q, p in rows]) > 0.97 and np.mean([p for _, q, p in rows if q == 1]) > 0.98


def test_decontamination(spark, docs):
    rng = np.random.default_rng(8)
    item = [f"q{i}" for i in range(30)]
    edited = list(item)
    for k in (4, 13, 22):
        edited[k] = "other"
    rows = docs + ODD + [(500, text(rng, 50) + " " + " ".join(item).upper() + "! " + text(rng, 20)), (501, " ".join(edited)), (502, " ".join(item[:8]))]
    bench = spark.createDataFrame([(1, " ".join(item), "s"), (2, None, "s"), (3, "", "s"), (4, "beta", "s"), (None, "q0 nothing else here", "s")], "item_id long, text string, score string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(500, 1), (501, 1)}
    places = {r.doc_id: (r.start, r.n_words) for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert places == {500: (50, 30), 501: (0, 30)}
    in_blocks = decontam.contaminated(frame(spark, rows), bench.unionByName(bench), block=1).collect()
    assert sorted((r.doc_id, r.item_id) for r in in_blocks) == [(500, 1)] * 2 + [(501, 1)] * 2
    left = {r.doc_id for r in decontam.decontaminate(frame(spark, rows), bench).collect()}
    assert left == {d for d, _ in rows} - {500, 501}
    assert decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_scattered_edits(spark, docs):
    rng = np.random.default_rng(12)
    items = [[f"q{i}x{k}" for k in range(n)] for i, n in enumerate((30, 40, 59, 100, 200))]

    def edit(item, share):
        return [f"new{k}" if k in set(rng.choice(len(item), int(share * len(item)), replace=False)) else w for k, w in enumerate(item)]

    def six(item):  # one copy alone, six single words edited
        return [f"new{k}" if k in (4, 9, 14, 19, 24, 28) else w for k, w in enumerate(item)]

    copies = [six(items[0]), items[1], edit(items[1], 0.2), edit(items[2], 0.15), edit(items[2], 0.1), items[3][:60], edit(items[3], 0.1), edit(items[4], 0.05)]
    # all rare shared n-grams in a short quotation, and the copy elsewhere with n-grams that many documents have
    copies += [items[4][:20] + ["far"] * 500 + items[4][20:140]] + [items[4][20:60]] * 3 + [items[4][60:100]] * 3 + [items[4][100:140]] * 3
    rows = docs + ODD + [(500 + i, text(rng, 30) + " " + " ".join(c) + " " + text(rng, 9)) for i, c in enumerate(copies)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    code = {w: i for i, w in enumerate({w for _, t in rows for w in (t or "").split()} | {w for x in items for w in x})}
    coded = lambda words: np.array([code[w] for w in words], np.int64)
    want = {}
    for d, t in rows:
        for i, x in enumerate(items):
            if d is not None and d >= 500 and (score := decontam.align(coded(x), coded(t.split()))[0] / (2 * len(x))) >= 0.5:
                want[d, i] = score
    assert got == want and set(want) == {(500, 0), (501, 1), (502, 1), (503, 2), (504, 2), (505, 3), (506, 3), (507, 4), (508, 4)}


def test_decontamination_goes_by_rows(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(None, item), (None, "clean and null"), (7, item), (7, "clean and repeated"), (8, "clean")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontam.decontaminate(frame(spark, rows), bench)
    assert sorted(r.text for r in left.collect()) == sorted(t for _, t in rows if t != item)
    assert left.columns == ["doc_id", "text", "extra", "class_id"]
    clash = spark.createDataFrame([(1, item, 5), (2, "clean", 6)], "doc_id long, text string, __one int")
    assert [tuple(r) for r in decontam.decontaminate(clash, bench).collect()] == [(2, "clean", 6)]
    none = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert {r.item_id for r in decontam.contaminated(clash, none).collect()} == {None}


def test_alignment_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 14)
        h = np.zeros((10, 15), int)
        for i, k in itertools.product(range(1, 10), range(1, 15)):
            h[i, k] = max(0, h[i - 1, k - 1] + (2 if a[i - 1] == b[k - 1] else -1), h[i - 1, k] - 1, h[i, k - 1] - 1)
        assert decontam.align(a, b)[0] == h.max()


def test_forward_and_counts_over_all_paths():
    rng = np.random.default_rng(1)
    s, v = 3, 5
    m = hmm.Model(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(v), s).T.copy())
    seqs = sorted([rng.integers(0, v, n) for n in (1, 2, 4, 5, 5)], key=lambda x: -len(x))
    counts = np.zeros(s), np.zeros((s, s)), np.zeros((v, s))
    logs = hmm.forward(m, seqs, counts)
    emitted, want = np.zeros((v, s)), []
    for q in seqs:
        total, own = 0.0, np.zeros((v, s))
        for p in itertools.product(range(s), repeat=len(q)):
            x = m.start[p[0]] * m.emit[q[0], p[0]]
            for t in range(1, len(q)):
                x *= m.move[p[t - 1], p[t]] * m.emit[q[t], p[t]]
            total += x
            for t in range(len(q)):
                own[q[t], p[t]] += x
        want.append(np.log(total))
        emitted += own / total
    assert np.allclose(logs, want) and np.allclose(counts[2], emitted)


def test_training_steps_take_every_share():
    assert set(hmm.STEPS) == set(range(len(hmm.SHARES)))  # no part of the training texts is left to the last update alone


def test_lm_score(spark, docs):
    rows = docs + ODD
    got = hmm.score(frame(spark, rows), F.coalesce(F.col("doc_id"), F.lit(0)) % 10 == 0, own=50, endings=16, hot=120).collect()
    low = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]
    train = [w for d, t in rows if (d or 0) % 10 != 0 for w in low(t)]
    count = {w: train.count(w) for w in set(train)}
    n, v = len(train), len(count)
    want = sorted((d if d is not None else -1, len(low(t)), sum(w in count for w in low(t)), round(sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in low(t)), 6)) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and np.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(frame(spark, rows).limit(0), F.lit(False)).count() == 0


def test_lm_score_brute_force(spark, docs, monkeypatch):
    """score by hand, from the trained model: plain forward sums over all words."""
    kept, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **k: kept.append(train(*a, **k)) or kept[-1])
    rows, own, endings = docs + ODD, 30, 16
    got = hmm.score(frame(spark, rows), F.coalesce(F.col("doc_id"), F.lit(0)) % 10 == 0, own=own, endings=endings, hot=60).collect()
    m = kept[0]
    assert len(m.history) >= 1 and all(b > a - 1e-6 for a, b in zip(m.history, m.history[1:]))
    low = lambda t: [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) if w]
    count = {}
    for d, t in rows:
        if (d or 0) % 10:
            for w in low(t):
                count[w] = count.get(w, 0) + 1
    first = sorted(count, key=lambda w: (-count[w], w.encode()))[:own]
    kind = lambda w: first.index(w) if w in first else own + zlib.crc32(w[-2:].encode()) % endings
    rest = [w for w in count if w not in first]
    want = []
    for d, t in rows:
        words = low(t)
        log, row = 0.0, m.start
        for k in [*map(kind, words), own + endings]:
            row = row * m.emit[k]
            log += np.log10(row.sum())
            row = (row / row.sum()) @ m.move
        for w in words:
            if w not in first:
                same = [count[x] for x in rest if kind(x) == kind(w)]
                log += np.log10((count.get(w, 0) + 0.1) / (sum(same) + 0.1 * (len(same) + 1)))
        want.append((str(d), round(log, 5)))
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in got) == sorted(want)


def test_pipeline_stages_brute_force(spark, docs, tmp_path):
    """Each stage on rows with null and repeated ids, null and empty texts and repeated rows, against plain Python."""
    import corpus_pipeline as p

    rng = np.random.default_rng(21)
    item = [f"q{i}" for i in range(30)]
    lines = ["one line", "two lines", "three lines"]
    texts = [(d, t) for d, t in docs] + ODD + [(None, " ".join(item)), (None, "clean and null"), (7, "again " + " ".join(item)), (300, "\n".join([*lines, "a"])), (301, "\n".join(["b", *lines])), (302, docs[0][1])]
    texts += [(400 + i, edited(rng, docs[5][1].split() * 3, 1, f"n{i}x")) for i in range(4)] + [(500 + i, "$$$ ### " * 30 + text(rng, 3)) for i in range(60)]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in texts]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, kinds)
    labels = [(d, 1) for d, _ in docs] + [(500 + i, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda k, df: sorted((tuple(r) for r in p.STAGES[k][1](spark, df, str(tmp_path)).collect()), key=str)

    model = quality.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) != 2)
    x = quality.features([(r[1] or "").encode() for r in rows], quality.tools(model))
    z = (x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights[1:]) + model.weights[0]
    assert run(0, table) == sorted((r for r, v in zip(rows, z) if 1 / (1 + np.exp(-np.clip(v, -30, 30))) >= 0.7), key=str)

    seen, want = set(), []
    for d, t, *rest in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        parts, gone = [] if t is None else t.split("\n"), set()
        for k in range(max(1, len(parts) - 2) if parts else 0):
            w = tuple(v.strip(" ") for v in parts[k : k + 3])
            if any(w):
                gone.update(range(k, min(k + 3, len(parts))) if w in seen else ())
                seen.add(w)
        left = t if not gone else "\n".join(v for i, v in enumerate(parts) if i not in gone)
        if not gone or left.strip(" "):
            want.append((d, left, *rest[:2], rest[2] if not gone else len(left)))
    assert run(1, table) == sorted(want, key=str)

    def shingle(t):
        w = [v for v in re.split(r"[ \t\n\x0b\f\r]+", (t or "").lower()) if v]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])

    left, kept = [(r, shingle(r[1])) for r in rows], []
    while left:  # a class at a time
        todo, own = [left.pop()], []
        while todo:
            r, s = todo.pop()
            own.append(r)
            near = [(q, u) for q, u in left if s == u or s and u and len(s & u) / len(s | u) >= 0.8]
            left = [x for x in left if x not in near]
            todo += near
        kept.append(min((r for r in own if r[0] is not None), default=None, key=lambda r: r[0]))
    got = run(2, table)
    assert len(got) == len(kept) and {r[0] for r in got if r[0] is not None} == {r[0] for r in kept if r is not None}

    code = {w: i for i, w in enumerate({w for r in rows for w in re.findall(r"[a-z0-9é]+", (r[1] or "").lower())} | set(item))}
    numbers = lambda t: np.array([code[w] for w in re.findall(r"[a-z0-9é]+", (t or "").lower())], np.int64)
    clean = [r for r in rows if decontam.align(numbers(" ".join(item)), numbers(r[1]))[0] < 30]
    assert len(clean) == len(rows) - 2 and run(3, table) == sorted(((r[0], r[1], *r[2:]) for r in clean), key=str)

    tok, pieces = plain(), []
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        pieces += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r[:5] for r in run(4, table)), key=str) == sorted(pieces, key=str)
    for k in range(5):
        assert run(k, table.limit(0)) == []


def test_pipeline_keeps_clean_rows(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = p.staged(stage(spark, docs, sf), "test")
        assert docs.columns == p.COLUMNS
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before)
        before = after
    assert {r.doc_id for r in p.pack_sequences(spark, docs, sf).select("doc_id").collect()} == before


def test_line_dedup_keeps_clashing_columns_and_long_repeats(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\n" * 20000, 7, 1), (2, "x\ny", 8, 2)], "doc_id long, text string, lines int, __gone int")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1]["__gone"] == 1
    assert out[1].text == "a\nb\nc\n" and out[1].n_removed == 59997  # the first copy of each window stays
    assert out[1].lines == 7 and out[2].text == "x\ny" and out[2].n_removed == 0
