"""What reads tell by their texts is worked out once for each different text, with the same results as read by read."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import signals as S

READS = [  # pos, flag, cigar, md
    (0, 0, "10M", "10"), (0, 0, "10M", "10"), (5, 16, "10M", "2A4C2"), (5, 0, "3S4M2I4M1S", "0A7"), (7, 0, "4M2D4M3N3M", "4^AC3T3"), (9, 0, "2H4M5N4M2H", None),
    (3, 0, "6I", "0"), (4, 0, "*", ""), (4, 0, None, None), (8, 256, "9M", "0A8"), (8, 2048, "9M", "0A8"), (8, 4, "9M", "0A8"), (70_000, 0, "4S9M", "9"), (None, 0, "9M", "9"),
    (65_530, 0, "2M1I3M4D20M5S", "5^ACGT20"), (11, 0, "5=1X5=", "5A5"), (11, 0, "5M", "99A1"),
]


@pytest.fixture(scope="module")
def alignments(spark):
    rows = [(f"s{i % 2}", "c", p, f, c, "ACGT" * 20, m) for i, (p, f, c, m) in enumerate(READS * 2)]
    found = spark.createDataFrame(rows, "sample_name string, contig_name string, pos int, flag int, cigar string, seq string, md string")
    return found.select("*", F.lit("c").alias("mate_contig"), F.lit(0).alias("mate_pos"), F.lit(0).alias("tlen"))


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_depth(alignments):
    assert listed(S.depth_of(alignments)) == listed(S.signal(S.prepare(alignments), "primary_reads"))


def test_variants(alignments):
    r = S.prepare(alignments)
    rows = S.mismatch_events(r).select(*S.PAIR, F.lit("mismatch").alias("kind"), "pos", F.lit(1).alias("len"))
    for kind, events in (("insertion", S.insertion_events(r)), ("deletion", S.deletion_events(r)), ("clipping", S.clip_events(r))):
        rows = rows.unionByName(events.select(*S.PAIR, F.lit(kind).alias("kind"), "pos", "len"))
    got = listed(S.variants(alignments))
    assert got == listed(rows) and {x[2] for x in got} == {"mismatch", "insertion", "deletion", "clipping"}


def test_texts_are_parsed_once(spark, alignments, monkeypatch):
    """The rows that are parsed are the different texts, however many reads have them."""
    made, written = [], S.written
    monkeypatch.setattr(S, "written", lambda df, name: made.append((name, written(df, name), df)) or made[-1][1])
    rows = S.variants(alignments.crossJoin(spark.range(50).select()))
    assert rows.count() == 50 * S.variants(alignments).count()
    (name, each, plan), (_, told, _) = made[:2]
    assert name == "texts" and told.count() < each.count() <= len(READS)
    for df in (plan, rows):  # no step on all reads parses a text
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
