"""Steps whose work grows no faster than their input."""

import random

from tidemark.operators import coding as D
from tidemark.operators import genome as G


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_distance_looks_back_only(spark):
    """A frame that looks ahead without end starts anew at each row. Many points at few places, against a plain search."""
    rng = random.Random(3)
    genes = [(f"c{rng.randint(0, 2)}", s, s + rng.randint(0, 30)) for s in (rng.randint(1, 400) for _ in range(25))]
    points = [(i, f"c{rng.randint(0, 3)}", rng.randint(1, 500)) for i in range(400)]
    out = G.nearest_distance(spark.createDataFrame(points, "point_id long, contig_name string, pos long"), spark.createDataFrame(genes, "contig_name string, start long, `end` long"), chunk=64)
    assert "unboundedfollowing" not in plan(out).lower()
    want = {i: min(max(s - p, p - e, 0) for k, s, e in genes if k == c) for i, c, p in points if any(k == c for k, _, _ in genes)}
    assert {r.point_id: r.distance for r in out.collect()} == want


def test_regions_at_one_place_are_worked_out_once(spark, monkeypatch):
    cds = spark.createDataFrame([(i, "c", 1 + 10 * (i % 3), 20) for i in range(300)] + [(300, "c", 90, 95)], "id long, contig_name string, start long, `end` long")
    runs = spark.createDataFrame([("s", "c", 1, 15, 4), ("s", "c", 16, 18, 2)], "sample_name string, contig_name string, start long, `end` long, value long")
    positions = spark.createDataFrame([("s", "c", "mismatch", 12, 0.5), ("s", "c", "clipping", 3, 0.25)], "sample_name string, contig_name string, kind string, pos long, prevalence double")
    seen, join = [], D.overlap_join
    monkeypatch.setattr(D, "overlap_join", lambda left, *rest: seen.append(left.count()) or join(left, *rest))
    got = {r.id: tuple(r)[2:] for r in D.cds_mapping_patterns(cds, runs, positions, 8).select("id", "sample_name", "aligned_pct", "median_depth", "mismatch_count", "clipping_count", "mismatch_prevalence").collect()}
    assert seen == [4, 4]
    assert got == {i: [(90.0, 4.0, 1, 1, 0.5), (80.0, 3.0, 1, 0, 0.5)][i % 3] for i in range(300) if i % 3 < 2}


def test_codon_effect_shuffles_texts_not_points(spark):
    """A changed base at every place agrees with points one by one; no shuffle lies above what makes a row a base."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACGTACGTACGTN") for _ in range(n))
    cds = []
    for i in range(12):
        at, segments = rng.randint(1, 60), []
        for _ in range(rng.randint(1, 3)):
            segments.append((at, at + rng.randint(0, 25)))
            at = segments[-1][1] + rng.randint(2, 12)
        cds.append((i, f"c{i % 2}", segments[0][0], segments[-1][1], rng.choice([1, -1]), segments, text(sum(e - s + 1 for s, e in segments))))
    changed = {c: text(150).replace("N", "G") for c in ("c0", "c1", "c2")}
    regions = spark.createDataFrame(cds, "id long, contig_name string, start long, `end` long, strand int, segments array<struct<start:long,end:long>>, seq string").cache()
    points = spark.createDataFrame([(f"{c}:{i + 1}", c, i + 1, b) for c, t in changed.items() for i, b in enumerate(t)], "point_id string, contig_name string, pos long, base string")
    blocks = spark.createDataFrame([(c, k, t[16 * k : 16 * k + 16]) for c, t in changed.items() for k in range(10)], "contig_name string, block long, bases string")
    want = {tuple(r) for r in D.codon_effect(points, regions).select("point_id", "category", "codon", "amino_acid").collect()}
    out = D.codon_effect_of_texts(blocks, regions, 16)
    got = [(f"{r.contig_name}:{r.pos}", r.category, r.codon, r.amino_acid) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r[1] for r in want}) == 3


def test_codon_effect_has_a_row_a_base(spark):
    from tests.test_entry import SF
    from tidemark.queries.coding import SQL, codon_effect
    assert codon_effect(spark, SF).columns == ["point_id", "category", "codon", "amino_acid"]
    assert SQL["codon_effect"].endswith("select point_id, category, codon, amino_acid from every")


def test_clean_ends_parse_no_cigar_again_and_scan_once(spark):
    from tests.test_entry import SF
    from tidemark.operators import signals as S
    from tidemark.queries.signals import reads
    text = plan(S.read_termini(reads(spark, SF)))
    assert "regexp_extract_all" not in text and text.count("Relation [") == 1


def test_top_features_go_on_with_open_rows_only(spark, monkeypatch):
    """Chains of two steps are done after two rounds, and tops are in no round."""
    rows = [(10 * g + k, {"ID": f"{k}-{g}", **({"Parent": f"{max(k - 1, 0)}-{g}"} if k else {})}) for g in range(20) for k in range(3)]
    frame = spark.createDataFrame([(n, "x", a) for n, a in rows], "row_no long, type string, attributes map<string,string>")
    sizes, write = [], D.written
    monkeypatch.setattr(D, "written", lambda df, name: (lambda out: sizes.append(out.count()) or out)(write(df, name)))
    got = {r.row_no: (r.top_no, r.level) for r in D.top_features(frame).collect()}
    assert got == {10 * g + k: (10 * g, k) for g in range(20) for k in range(3)}
    assert len(sizes) <= 3 and max(sizes) == 40


def test_hits_at_one_place_are_one_row(spark, monkeypatch):
    """Hits of other bins are left out before anything is shuffled; those at one place are counted, not carried on."""
    hits = [("a", "b", 1, 10, i, i + 5, 90.0 + i % 3) for i in range(1, 41)] + [("a", "x", 1, 10, i, i + 5, 99.0) for i in range(1, 41)]
    members = spark.createDataFrame([("m", "a", 100), ("m", "b", 100), ("n", "x", 100)], "mag_name string, contig_name string, contig_length int")
    sizes, write = {}, G.written
    monkeypatch.setattr(G, "written", lambda df, name: (lambda out: sizes.update({name: out.count()}) or out)(write(df, name)))
    out = G.mag_hit_features(spark.createDataFrame(hits, "contig_1 string, contig_2 string, p1 int, p2 int, p1x int, p2x int, pident double"), members)
    assert [tuple(r)[1:] for r in out.filter("contig_name = 'a'").collect()] == [(1, 10, 40, 92.0, "b")]
    assert sizes == {"members": 3, "hit-places": 41}


def test_attributes_are_worked_out_once(spark, tmp_path):
    """However many keys are renamed, a row's attributes are split and put together once."""
    from tidemark.sources import files as X
    line = "c\t.\tCDS\t1\t9\t.\t-\t.\tID=a;Product=p%3Bq;product=own;locus-tag=l;Locus_tag=L;ID=b;=x;PHROG=7;flag"
    (tmp_path / "a.gff").write_text(line + "\n")
    out = X.read_gff3(spark, str(tmp_path))
    assert out.first().attributes == {"ID": "a", "product": "own", "locus_tag": "L", "phrog": "7", "flag": ""}
    assert plan(out).count("array_position") == 1


def test_queries_do_not_store_reads_that_they_need_little_of(spark, tmp_path):
    from tests.test_entry import SF
    from tidemark import driver
    from tidemark import queries as engine
    folder = tmp_path / "t"
    folder.symlink_to(SF)  # no other test has asked for reads by this path
    for name in ("removal_problems", "signal_splicings", "significant_clips", "paired_clip_span", "inspect_window"):
        engine.queries()[name](spark, str(folder))
        assert not [k for k in driver._STORED if k[1:] == (str(folder), "prepared-reads")], name
