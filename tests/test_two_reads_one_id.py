"""Pairs of different reads that share a read_id: queries and their SQL against plain Python, which takes one read at a time."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from tidemark import queries as engine

HALF = 480  # length of the contigs of drop_ghosts


def hashed(p, s, q):
    """The last part of a read_id."""
    return (p * 7919 + s * 104729 + q * 15485863) % 1_000_000


def lines():
    """Rows of lineitem (order, line, part, supplier, quantity, discount, sample): every second one has a partner with other
    keys and the same read_id."""
    rng, out = random.Random(5), []
    for _ in range(300):
        o, k, p, s, q = rng.randrange(42), rng.randint(1, 7), rng.randrange(1000) * 20 + rng.randrange(2), rng.randrange(100), rng.randint(1, 50)
        out.append((o, k, p, s, q, rng.randrange(11) / 100, rng.choice(("AF", "NO"))))
        while rng.random() < 0.98 and len(out) % 2:  # a part that brings the hash back, on one of the two contigs
            s2, q2 = rng.randrange(100), rng.randint(1, 50)
            p2 = (hashed(p, s, q) - hashed(0, s2, q2)) * pow(7919, -1, 1_000_000) % 1_000_000
            if p2 % 20 < 2 and p2 != p:
                out.append((o, k, p2, s2, q2, rng.randrange(11) / 100, rng.choice(("AF", "NO"))))
    return out


class Read:
    """What driver.READS makes of a row, worked out by hand."""

    def __init__(self, o, k, p, s, q, discount, sample):
        self.id, self.k, self.q, self.name, self.mapq = (o * 8 + k) * 1_000_000 + hashed(p, s, q), k, q, f"r{o}", round(discount * 100)
        self.pair, self.pos = (sample, f"ctg{p % 20}"), (o * 31 + k * 7) % 950
        self.klass = "unmapped" if p % 97 == 0 else {6: "secondary", 7: "supplementary"}.get(k, "primary")
        self.reverse, self.mate_reverse, self.mate_unmapped = s % 2 == 1, s % 3 == 0, p % 13 == 0
        self.mate_elsewhere, self.inward = s % 11 == 0, self.reverse != self.mate_reverse and p % 5 != 0
        self.size = q + {3: 3, 4: 5, 5: 9}.get(k, 0)
        self.length = q + {2: 3, 3: 5, 4: 3, 5: 4, 6: 2, 7: 2}.get(k, 0)
        self.clipped = {2: 3, 6: 2, 7: 2}.get(k, 0)
        self.missed = None if q < 6 or o % 7 and o % 3 else 0 if o % 7 == 0 else 2  # the aligned base that differs
        self.edits = (2 if k in (3, 4) else 0) + (self.missed is not None)
        self.base = None if self.missed is None else "ACGT"[(s + (3 if k == 2 else 0) + self.missed) % 4]
        self.bases = range(self.pos + 1, self.pos + self.size + 1)

    def covered(self):
        return [b for b in self.bases if self.k != 5 or not self.pos + 5 <= b <= self.pos + 9]


def written(con, folder, rows):
    """Tables of these rows, with some genes; the views of the SQL."""
    con.execute("create or replace table l (l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double, sample varchar)")
    con.executemany("insert into l values (?, ?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"copy (select * exclude (sample), sample[1] as l_returnflag, sample[2] as l_linestatus from l) to '{folder}/lineitem.parquet' (format parquet)")
    con.execute(f"copy (select range as p_partkey from range(20)) to '{folder}/part.parquet' (format parquet)")
    con.execute(f"copy (select range as o_orderkey, range * 7 % 100 as o_custkey, 'O' as o_orderstatus, '1-URGENT' as o_orderpriority from range(1500)) to '{folder}/orders.parquet' (format parquet)")
    for t in ("lineitem", "part", "orders"):
        con.execute(f"create or replace view {t} as select * from read_parquet('{folder}/{t}.parquet')")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, con, rows = tmp_path_factory.mktemp("ids"), duckdb.connect(), lines()
    written(con, folder, rows)
    reads = [Read(*r) for r in rows]
    assert len(reads) - len({r.id for r in reads}) > 100
    return str(folder), con, reads


def check(spark, tables, name, columns, want):
    """The query and its SQL give these rows, to the last digit."""
    folder, con, _ = tables
    got = [tuple(r) for r in engine.queries()[name](spark, folder).select(*columns).collect()]
    sql = con.execute(f"select {', '.join(columns)} from ({engine.oracle_sql()[name]})".replace("start, end", '"start", "end"')).fetchall()
    assert want and sorted(got) == sorted(want)
    assert sorted(sql) == sorted(want)


def runs(values):
    """(sample, contig, start, end, value) from the values of single bases."""
    out = []
    for (pair, pos), value in sorted(values.items()):
        if out and out[-1][:2] == pair and out[-1][3] + 1 == pos and out[-1][4] == value:
            out[-1] = (*out[-1][:3], pos, value)
        else:
            out.append((*pair, pos, pos, value))
    return out


def depth(reads, bases=lambda r: r.bases):
    return Counter((r.pair, b) for r in reads if r.klass == "primary" for b in bases(r))


RUNS = ["sample_name", "contig_name", "start", "end", "value"]


def rounded(total, n):
    """total / n to six digits, halves up."""
    return int(Fraction(total, n) * 1_000_000 + Fraction(1, 2)) / 1_000_000


def fits(r):
    """Both filters: enough of the length without edits, and enough of it aligned."""
    return (r.length - r.edits) * 100 >= 90 * r.length, (r.length - r.clipped) * 100 >= 92 * r.length


def test_filter_reads(spark, tables):
    check(spark, tables, "filter_reads", ["read_id", "sample_name", "contig_name"], [(r.id, *r.pair) for r in tables[2] if r.klass != "unmapped" and all(fits(r))])


def test_filter_report(spark, tables):
    by = defaultdict(list)
    for r in tables[2]:
        if r.klass != "unmapped":
            by[r.pair[0]].append(fits(r))
    want = [(s, len(x), sum(not a for a, _ in x), sum(not b for _, b in x), sum(not (a and b) for a, b in x)) for s, x in by.items()]
    check(spark, tables, "filter_report", ["sample_name", "n", "low_identity", "low_aligned", "excluded"], want)


def test_gene_interval_stats(spark, tables):
    at, want = depth(tables[2], Read.covered), []
    for o in range(1500):
        start, length = o * 17 % 1000 + 1, o * 7 % 100 % 90 + 1
        for sample in ("AF", "NO") if o % 5 else ():
            own = [at[(sample, f"ctg{o * 7 % 100 % 20}"), b] for b in range(start, start + length)]
            if any(own):
                want.append((o, sample, sum(d > 0 for d in own), sum(own), rounded(sum(own), length)))
    check(spark, tables, "gene_interval_stats", ["id", "sample_name", "covered", "total", "mean"], want)


def test_insertions(spark, tables):
    at = Counter((r.pair, r.pos + r.q) for r in tables[2] if r.klass == "primary" and r.k == 3)
    check(spark, tables, "insertions", ["sample_name", "contig_name", "pos", "n", "mean_len", "median_len", "std_len"], [(*pair, pos, n, 2.0, 2, 0.0) for (pair, pos), n in at.items()])


def mean_lengths(reads):
    total = Counter()
    for r in reads:
        if r.klass == "primary":
            total.update({(r.pair, b): r.length for b in r.bases})
    return runs({k: rounded(total[k], n) for k, n in depth(reads).items()})


def test_mean_read_lengths(spark, tables):
    check(spark, tables, "mean_read_lengths", RUNS, mean_lengths(tables[2]))


def test_mean_read_lengths_on_a_half(spark, tmp_path):
    """Means over 640 reads can lie on a half of the sixth digit: it goes up, whatever the double nearest to it is."""
    rows, con = [(950 * i, 1, 20 * (97 * i + 1), 0, 33 if i < 7 else 32, 0.0, "AF") for i in range(640)], duckdb.connect()
    written(con, tmp_path, rows)
    reads = [Read(*r) for r in rows]
    assert len({r.id for r in reads}) == 640 and {r.klass for r in reads} == {"primary"}
    want = mean_lengths(reads)
    assert want[0] == ("AF", "ctg0", 8, 39, 32.010938)  # 20,487 / 640 = 32.0109375
    check(spark, (str(tmp_path), con, reads), "mean_read_lengths", RUNS, want)


def test_signal_coverage_reduced(spark, tables):
    """Reads whose first base differs don't start cleanly; all of these end cleanly."""
    check(spark, tables, "signal_coverage_reduced", RUNS, runs(depth(r for r in tables[2] if r.reverse or r.missed != 0)))


def test_signal_mate_on_another_contig(spark, tables):
    check(spark, tables, "signal_mate_on_another_contig", RUNS, runs(depth(r for r in tables[2] if r.mate_elsewhere and not r.mate_unmapped)))


def test_signal_non_inward_pairs(spark, tables):
    check(spark, tables, "signal_non_inward_pairs", RUNS, runs(depth(r for r in tables[2] if not r.mate_elsewhere and not r.mate_unmapped and not r.inward)))


def test_signal_primary_reads(spark, tables):
    check(spark, tables, "signal_primary_reads", RUNS, runs(depth(tables[2], Read.covered)))


def test_mismatches(spark, tables):
    at = defaultdict(Counter)
    for r in tables[2]:
        if r.klass == "primary" and r.missed is not None:
            at[r.pair, r.pos + r.missed + 1][r.base] += 1
    check(spark, tables, "mismatches", ["sample_name", "contig_name", "pos", "n", "n_a", "n_c", "n_g", "n_t"], [(*pair, pos, c.total(), *(c[b] for b in "ACGT")) for (pair, pos), c in at.items()])


def test_signal_deletions(spark, tables):
    check(spark, tables, "signal_deletions", RUNS, runs(depth((r for r in tables[2] if r.k == 4), lambda r: (r.pos + r.q + 1, r.pos + r.q + 2))))


def test_drop_ghosts(spark, tables):
    """Of two alignments that share a read_id, one can lie inside a primary one and the other not."""
    reads = tables[2]
    primary, extra = defaultdict(list), [r for r in reads if r.klass in ("secondary", "supplementary")]
    for r in reads:
        if r.klass == "primary":
            primary[r.pair, r.name].append(r)
    ghost = lambda x: any((x.pos - p.pos) % HALF + x.size <= p.size for p in primary[x.pair, x.name])
    kept, places = [], set()
    for x in sorted((x for x in extra if not ghost(x)), key=lambda x: (x.id, x.mapq)):
        place = (x.pair, x.name, x.pos % HALF)
        if x.klass == "secondary" or place not in places:
            kept.append(x)
        if x.klass == "supplementary":
            places.add(place)
    split = {x.id for x in extra if ghost(x)} & {x.id for x in kept}
    assert split
    only_ghosts = {(x.pair[0], x.name) for x in extra} - {(x.pair[0], x.name) for x in kept}
    main = [(r.id, 60 if r.klass == "primary" and (r.pair[0], r.name) in only_ghosts else r.mapq) for r in reads if r.klass in ("primary", "unmapped")]
    check(spark, tables, "drop_ghosts", ["read_id", "mapq"], main + [(x.id, x.mapq) for x in kept])
