"""Ids that very many rows share, texts of megabytes, and other large or odd inputs."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontam, divergence, hmm, html_extract, line_dedup, ngram_join, packing, prefix_counts, quality, token_io, topk
from tidemark.llm.common import new_path

CUSTOM = ["video-player", "title-bar", "select-box", "style-guide", "audio-x", "canvas-a", "object-x", "svg-x", "script-x"]


@pytest.mark.parametrize("tag", CUSTOM)
def test_custom_elements_keep_what_follows(tag):
    page = f"<article><p>First one, here.</p><{tag}></{tag}><{tag} a=b /><p>Second one, there.</p></article>"
    assert html_extract.extract_text(page) == "First one, here. Second one, there."


def test_raw_elements():
    inside = lambda x: html_extract.extract_text(f"<article><p>First one, here.</p>{x}<p>Second one, there.</p></article>")
    whole, half = "First one, here. Second one, there.", "First one, here."
    for x in ("<script/>var x</script>", "<script src='a>b' />x</script >", "<style>p {}</style x>", "<SVG a='/'><path/></svg>", "<svg/>", "<math />", "<iframe></iframe>", "<video src=x>not shown</video>"):
        assert inside(x) == whole, x
    for x in ("<video src=x>", "<object>", "<select/>", "</video>", "</script>", "<canvas><audio>"):  # nothing closes them: what follows stays
        assert inside(x) == whole, x
    for x in ("<script>", "<script/>", "<style>", "<title>", "<textarea>"):  # no markup up to the page's end
        assert inside(x) == half, x
    began = time.time()
    html_extract.extract_text("<video><svg><object>" * 100_000)
    assert time.time() - began < 5


def repeated(spark, n=20_000):
    """A third of the ids null, a third one and the same."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 6 < 3, "the same words in every copy").otherwise(F.concat(F.lit("word "), F.col("id").cast("string"), F.repeat(F.lit(" and more"), (F.col("id") % 40).cast("int")))).alias("text"),
    ).repartition(8)


def test_packing_shares_out_rows_of_one_id(spark):
    out = packing.pack_documents(repeated(spark), per_shard=1000).groupBy(F.shiftright("sequence_id", 32).alias("shard")).count().collect()
    sizes = sorted(r["count"] for r in out)
    assert sum(sizes) == 20_000 and len(sizes) == 20 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_token_files_share_out_rows_of_one_id(spark):
    path = new_path(spark, "hot")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_io.write_ids(repeated(spark), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    parts = sorted(r.n for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_docs").alias("n")).collect())
    assert sum(parts) == 20_000 and parts[-1] < 2 * parts[len(parts) // 2]
    rows = sorted(((r.start, r.n_tokens, r.doc_id) for r in token_io.read_ids(spark, path, digest=True).collect()))
    assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:])) and rows[0][0] == 0
    ids = [-1 if d is None else d for _, _, d in rows]
    assert ids == sorted(ids)


def test_topk_keeps_thresholds_over_groups():
    """A task sends k rows a query, whatever the number of its candidates, and large numbers stay exact."""
    import pandas as pd

    rng = np.random.default_rng(0)
    vecs = rng.integers(-100, 100, (1000, 6))
    queries, q_ids = vecs[:20], np.arange(20)
    frames = [pd.DataFrame({"vec_id": np.arange(a, a + 100), "v": list(vecs[a : a + 100])}) for a in range(0, 1000, 100)]
    got = pd.concat(topk._task(iter(frames), q_ids, queries, 5, together=150))
    assert len(got) == 20 * 5
    for q in range(20):
        s = vecs @ vecs[q]
        want = [(i, s[i]) for i in np.lexsort((np.arange(1000), -s)) if i != q][:5]
        assert list(zip(got[got.query_id == q].vec_id, got[got.query_id == q].score)) == want
    large = [10**9, 10**9 + 1]
    got = pd.concat(topk._task(iter([pd.DataFrame({"vec_id": [1, 2], "v": [[x, 1] for x in large]})]), np.array([9]), np.array([[10**9, 3]]), 1))
    assert got.score.tolist() == [10**9 * (10**9 + 1) + 3]
    with pytest.raises(OverflowError):
        list(topk._task(iter([pd.DataFrame({"vec_id": [1], "v": [[10**12, 1]]})]), np.array([9]), np.array([[10**12, 3]]), 1))


def test_long_sequences_in_blocks_are_exact(monkeypatch):
    rng = np.random.default_rng(0)
    states, n = 4, 50
    model = hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(n), states).T.copy())
    arrays = [rng.integers(0, n, k) for k in (700, 1, 3, 64, 65, 128, 1000, 199)]
    counts = lambda: (np.zeros(states), np.zeros((states, states)), np.zeros((n, states)))
    plain = counts()
    want = hmm.forward(model, arrays, plain)
    monkeypatch.setattr(hmm, "CUT", 64)
    monkeypatch.setattr(hmm, "LONG", 64)
    for most in (10**6, 300):
        cut = counts()
        assert np.allclose(hmm.forward(model, arrays, cut, most), want, rtol=1e-12) and np.allclose(hmm.forward(model, arrays, None, most), want, rtol=1e-12)
        assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(plain, cut))


def test_training_goes_on_until_it_settles(spark):
    rng = np.random.default_rng(3)
    topics = rng.dirichlet(np.ones(40) * 0.2, 4)
    rows = [(int(i), 0, np.concatenate([rng.choice(40, 20, p=topics[rng.integers(4)]) for _ in range(4)]).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "__row long, share int, classes array<int>")
    model = hmm.train(frame, np.full(41, 1 / 41), 4, tol=1e-6)
    gains = np.diff(model.history)
    assert len(model.history) > 4 and gains[-1] < 1e-6 and (gains[:-1] >= 1e-6).all()


LONG = "".join(f"w{i % 7919} " for i in range(500_000)) + "\n" + "line of text\n" * 100_000


@pytest.fixture(scope="module")
def megabytes(spark):
    rows = [(i, f"short text number {i}, of some words that differ {i * 7}", "en", "s") for i in range(60)] + [(100, LONG, "en", "s"), (101, "x" * 2_000_000, "fr", "s"), (None, "y " * 500_000, "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


RUNS = {
    "token_io": lambda d: token_io.encode_roundtrip(d),
    "ngram_join": lambda d: ngram_join.near_duplicates(d),
    "packing": lambda d: packing.pack_documents(d).select("doc_id").distinct(),
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "quality": lambda d: quality.score(d, quality.fit(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), F.lit(True)), "doc_id"),
    "decontam": lambda d: decontam.decontaminate(d, d.filter("doc_id = 1").select(F.lit(1).alias("item_id"), F.lit("nothing like any of these texts at all").alias("text"))),
    "hmm": lambda d: hmm.score(d, F.lit(False)),
    "alignment": lambda d: alignment.align(d)[0],
    "prefix_counts": lambda d: prefix_counts.prefix_table(d),
    "divergence": lambda d: divergence.divergence(d).select(F.explode(F.sequence(F.lit(1), F.lit(63)))).limit(63),
}


@pytest.mark.parametrize("name", RUNS)
def test_texts_of_megabytes(spark, megabytes, name):
    began = time.time()
    assert RUNS[name](megabytes).count() == 63
    assert time.time() - began < 150
