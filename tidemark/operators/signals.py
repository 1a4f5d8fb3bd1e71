"""Reads to position signals: runs of depth and tables of events. Reads become a few events each, never a row a base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..driver import written
from ..functions import cigar as C
from .kernels import sweep, wrap_circular

PAIR = ["sample_name", "contig_name"]


def klass() -> Column:
    """What an alignment is by its flag."""
    return F.when(C.has_flag(4), "unmapped").when(C.has_flag(256), "secondary").when(C.has_flag(2048), "supplementary").otherwise("primary")


def prepare(alignments: DataFrame) -> DataFrame:
    """Alignments with what all signals use: class, strand, start and end (1-based), operations with their places."""
    ops = alignments.withColumn("ops", C.parse_cigar(F.col("cigar")))
    rows = ops.withColumns({
        "klass": klass(),
        "reverse": C.has_flag(16), "mate_reverse": C.has_flag(32), "mate_unmapped": C.has_flag(8), "first": C.has_flag(64), "paired": C.has_flag(1),
        "start": F.col("pos") + 1, "end": F.col("pos") + C.ref_span(F.col("ops")), "qlen": C.query_length(F.col("ops")),
    })
    return rows.withColumn("places", C.cigar_offsets(F.col("ops"), F.col("pos")))


def mapped(reads: DataFrame, klass: str = "primary", told: Column | None = None) -> DataFrame:
    """Mapped reads of a class. told: what their texts must tell, looked at before a CIGAR is parsed."""
    own = reads.filter(F.col("klass") == klass)
    return (own if told is None else own.filter(told)).filter(F.col("end") >= F.col("start"))


def op_spans(reads: DataFrame, kind: str) -> DataFrame:
    """The reference spans of one kind of operation."""
    reads = reads.filter(F.instr("cigar", kind) > 0)
    own = reads.withColumn("o", F.explode(F.filter("places", lambda o: o.op == kind)))
    return own.select(*PAIR, (F.col("o.ref_start") + 1).alias("start"), (F.col("o.ref_start") + F.col("o.len")).alias("end"))


def depth(reads: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Runs of the depth of these reads, without the bases they skip (N): sample_name, contig_name, start, end, value.

    With contigs (contig_name, contig_length, circular), what runs past the end of a circular contig goes on from its first
    base, as often as it takes, and linear ones are cut at their ends."""
    skips = op_spans(reads, "N")
    spans = reads.select(*PAIR, "start", "end", F.lit(1).alias("w")).unionByName(skips.withColumn("w", F.lit(-1)))
    if contigs is not None:
        spans = wrap_circular(spans.join(contigs.select("contig_name", "contig_length", "circular"), "contig_name"), weight="w")
    return sweep(spans, PAIR, {"value": F.col("w")})


def on_circle(events: DataFrame, contigs: DataFrame, *columns: str) -> DataFrame:
    """Events with their positions (from 1) brought back onto circular contigs; on linear ones, those past the end go."""
    rows = events.join(contigs.select("contig_name", F.col("contig_length").alias("__n"), F.col("circular").alias("__c")), "contig_name")
    for c in columns:
        rows = rows.filter(F.col("__c") | F.col(c).between(0, F.col("__n"))).withColumn(c, F.when(F.col("__c"), F.pmod(F.col(c) - 1, F.col("__n")) + 1).otherwise(F.col(c)))
    return rows.select(*events.columns)


def signal(reads: DataFrame, name: str) -> DataFrame:
    """Runs of a depth signal by its name."""
    primary = mapped(reads)
    pick = {
        "primary_reads": lambda: primary,
        "primary_reads_plus_only": lambda: primary.filter("not reverse"),
        "primary_reads_minus_only": lambda: primary.filter("reverse"),
        "secondary_reads": lambda: mapped(reads, "secondary"),
        "supplementary_reads": lambda: mapped(reads, "supplementary"),
        "mate_not_mapped": lambda: primary.filter("paired and mate_unmapped"),
        "mate_on_another_contig": lambda: primary.filter("paired and not mate_unmapped and contig_name <> mate_contig"),
        "non_inward_pairs": lambda: primary.filter(
            F.col("paired") & ~F.col("mate_unmapped") & (F.col("contig_name") == F.col("mate_contig"))
            & ~C.proper_pair(F.col("contig_name"), F.col("mate_contig"), F.col("reverse"), F.col("mate_reverse"), F.abs("tlen"))
        ),
    }
    if name in ("splicings", "deletions"):
        kind = "N" if name == "splicings" else "D"
        return sweep(op_spans(mapped(reads, told=F.instr("cigar", kind) > 0), kind), PAIR, {"value": F.lit(1)})
    if name == "coverage_reduced":
        return coverage_reduced(reads)
    return depth(pick[name]()) if name in ("primary_reads", "primary_reads_plus_only", "primary_reads_minus_only", "secondary_reads", "supplementary_reads") else sweep(pick[name](), PAIR, {"value": F.lit(1)})


def mean_signal(reads: DataFrame, name: str) -> DataFrame:
    """Runs of the mean of a read property over the reads at each base."""
    primary = mapped(reads)
    rows, what = {
        "mapq": (primary, F.col("mapq")),
        "read_lengths": (primary, F.col("qlen")),
        "insert_sizes": (primary.filter("first and tlen > 0"), F.col("tlen")),
    }[name]
    runs = sweep(rows, PAIR, {"n": F.lit(1), "total": what.cast("long")})
    return runs.filter("n > 0").select(*PAIR, "start", "end", (F.col("total") / F.col("n")).alias("value"))


def clean_edges(reads: DataFrame, most: int = 5) -> DataFrame:
    """Primary reads with begin_event and finish_event: the boundary events at their 5' and 3' ends along the reference."""
    return mapped(reads).withColumns({side_name: C.boundary_event(F.col("cigar"), F.col("md"), side, most, F.col("ops")) for side_name, side in (("begin_event", "start"), ("finish_event", "end"))})


def told_by_texts(alignments: DataFrame, texts: list[str], tell: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans or events (told: start, end and more, counted from a read's own start) of primary alignments at their places. What texts
    tell is worked out once for each different set of them, as many short reads have the same, and joined back. Both steps are
    written, as the optimizer would else move filters on what is told before the distinct, and to all reads."""
    own = alignments.filter((klass() == "primary") & F.col("pos").isNotNull()).select(*PAIR, "pos", *[F.coalesce(c, F.lit("")).alias(c) for c in texts])
    each = written(own.select(*texts).distinct(), "texts").withColumn("ops", C.parse_cigar(F.col("cigar")))
    each = each.withColumns({"span": C.ref_span(F.col("ops")), "places": C.cigar_offsets(F.col("ops"), F.lit(0))}).filter("span > 0")
    told = tell(each).select(*texts, "told").filter(F.size("told") > 0)
    rows = own.join(written(told, "told"), texts).select(*PAIR, F.col("pos").alias("__pos"), F.explode("told").alias("x")).select(*PAIR, "__pos", "x.*")
    return rows.withColumns({"start": F.col("__pos") + F.col("start"), "end": F.col("__pos") + F.col("end")}).drop("__pos")


def depth_of(alignments: DataFrame) -> DataFrame:
    """The same runs as depth() of the primary reads, from alignments as they are."""
    part = lambda start, end, w: F.struct(start.alias("start"), end.alias("end"), F.lit(w).alias("w"))
    skips = F.transform(F.filter("places", lambda o: o.op == "N"), lambda o: part(o.ref_start + 1, o.ref_start + o.len, -1))
    spans = told_by_texts(alignments, ["cigar"], lambda each: each.withColumn("told", F.concat(F.array(part(F.lit(1), F.col("span"), 1)), skips)))
    return sweep(spans, PAIR, {"value": F.col("w")})


def variants(alignments: DataFrame) -> DataFrame:
    """kind, pos and len of the mismatches, insertions, deletions and clips of the primary reads, from alignments as they are: those
    of mismatch_events, insertion_events, deletion_events and clip_events, without their bases."""
    event = lambda kind, pos, n: F.struct(F.lit(kind).alias("kind"), pos.alias("start"), pos.alias("end"), n.alias("len"))
    of = lambda op, kind, add: F.transform(F.filter("places", lambda o: o.op == op), lambda o: event(kind, o.ref_start + add, o.len))
    clip = lambda own, o, pos: F.when(own & o.op.isin("S", "H"), event("clipping", pos, o.len))
    clips = F.array_compact(F.array(clip(F.lit(True), F.get("ops", F.lit(0)), F.lit(1)), clip(F.size("ops") > 1, F.element_at("ops", -1), F.col("span"))))
    missed = F.transform(C.md_mismatches(F.col("places"), F.col("md"), F.lit(None).cast("string")), lambda m: event("mismatch", m.ref_pos + 1, F.lit(1)))
    told = lambda each: each.withColumn("told", F.concat(missed, of("I", "insertion", 0), of("D", "deletion", 1), clips))
    return told_by_texts(alignments, ["cigar", "md"], told).select(*PAIR, "kind", F.col("start").alias("pos"), "len")


def coverage_reduced(reads: DataFrame, long_reads: bool = False) -> DataFrame:
    """Depth of reads that start cleanly (the end, on the reverse strand). Long reads: whole if both ends are clean, else the
    half up to the midpoint from the clean end."""
    rows = clean_edges(reads)
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    a, b = F.col("begin_event").isNotNull(), F.col("finish_event").isNotNull()
    if long_reads:
        spans = rows.filter(a | b).select(*PAIR, F.when(a, F.col("start")).otherwise(middle).alias("start"), F.when(b, F.col("end")).otherwise(middle).alias("end"))
    else:
        spans = rows.filter(F.when(F.col("reverse"), b).otherwise(a)).select(*PAIR, "start", "end")
    return sweep(spans, PAIR, {"value": F.lit(1)})


def read_termini(reads: DataFrame, long_reads: bool = False) -> DataFrame:
    """Counts of clean read starts and ends by position, with the upper median of their event lengths: kind, pos, n, event.
    Short reads count where they begin: starts of the plus strand, ends of the minus strand. Long reads count at each clean
    end, whatever their strand."""
    rows = clean_edges(reads)
    begin, finish = F.col("begin_event"), F.col("finish_event")
    plus, minus = (F.lit(True), F.lit(True)) if long_reads else (~F.col("reverse"), F.col("reverse"))
    end = lambda own, kind, pos, event: F.when(own & event.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(pos).cast("long").alias("pos"), event.alias("len")))
    both = F.array_compact(F.array(end(plus, "reads_starts", "start", begin), end(minus, "reads_ends", "end", finish)))
    ends = rows.select(*PAIR, F.explode(both).alias("x")).select(*PAIR, "x.*")  # one pass over the reads
    return length_stats(ends, "kind", "pos").select(*PAIR, "kind", "pos", "n", F.col("median_len").cast("int").alias("event"))


def length_stats(events: DataFrame, *keys: str) -> DataFrame:
    """n, mean_len, median_len, mid_len and std_len of the lengths (len) of events by pair and keys, from the number of events
    of each length: a list has different lengths only. median_len is the upper median, mid_len the whole part of the mean of
    both middle ones."""
    by = [*PAIR, *keys]
    each = events.groupBy(*by, F.col("len").cast("long").alias("len")).agg(F.count("*").alias("k"))
    n, total, squares = F.sum("k"), F.sum(F.col("len") * F.col("k")), F.sum(F.col("len") * F.col("len") * F.col("k"))
    rows = each.groupBy(*by).agg(n.alias("n"), total.alias("s1"), squares.alias("s2"), F.sort_array(F.collect_list(F.struct("len", "k"))).alias("h"))

    def at(i: Column) -> Column:
        """The i-th length in order, from 0."""
        first = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("len"))
        step = lambda acc, x: F.struct((acc.upto + x.k).alias("upto"), F.when(acc.len.isNull() & (acc.upto + x.k > i), x.len).otherwise(acc.len).alias("len"))
        return F.aggregate("h", first, step, lambda acc: acc.len)

    upper, lower = at(F.floor(F.col("n") / 2)), at(F.floor((F.col("n") - 1) / 2))
    mean = F.col("s1") / F.col("n")
    return rows.select(
        *by, "n", mean.alias("mean_len"), upper.alias("median_len"), F.floor((upper + lower) / 2).alias("mid_len"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("std_len"),
    )


def insertion_events(reads: DataFrame) -> DataFrame:
    """Each insertion of the primary reads: pos is the base before it; long inserts keep both ends of their sequence."""
    own = mapped(reads, told=F.instr("cigar", "I") > 0).withColumn("o", F.explode(F.filter("places", lambda o: o.op == "I")))
    seq = F.substring(F.col("seq"), F.col("o.query_start") + 1, F.col("o.len"))
    cut = F.when(F.length(seq) > 40, F.concat(F.substring(seq, 1, 20), F.lit("..."), F.substring(seq, -20, 20))).otherwise(seq)
    return own.select(*PAIR, F.col("o.ref_start").alias("pos"), F.col("o.len").alias("len"), cut.alias("sequence"))


def insertions(reads: DataFrame) -> DataFrame:
    return length_stats(insertion_events(reads), "pos").drop("mid_len")


def deletion_events(reads: DataFrame) -> DataFrame:
    """Each deletion of the primary reads by its first base."""
    return op_spans(mapped(reads, told=F.instr("cigar", "D") > 0), "D").select(*PAIR, F.col("start").alias("pos"), (F.col("end") - F.col("start") + 1).alias("len"))


def deletion_lengths(reads: DataFrame) -> DataFrame:
    """Deletions by first base, with their lengths."""
    return length_stats(deletion_events(reads), "pos").drop("mid_len")


def clip_events(reads: DataFrame) -> DataFrame:
    """Soft and hard clips of the primary reads: side, pos (the first or last aligned base), len, sequence up to 20 bases."""
    rows = mapped(reads, told=F.col("cigar").rlike("[SH]"))
    left, right = F.get("ops", F.lit(0)), F.element_at("ops", -1)
    clip = lambda own, side, pos, o, sequence: F.when(own & o.op.isin("S", "H"), F.struct(F.lit(side).alias("side"), F.col(pos).alias("pos"), o.len.alias("len"), F.when(o.op == "S", sequence).alias("sequence")))
    both = F.array_compact(F.array(
        clip(F.lit(True), "left", "start", left, F.substring(F.substring("seq", F.lit(1), left.len), -20, 20)),
        clip(F.size("ops") > 1, "right", "end", right, F.substring(F.substring("seq", F.length("seq") - right.len + 1, right.len), 1, 20)),
    ))
    return rows.select(*PAIR, F.explode(both).alias("x")).select(*PAIR, "x.*")  # one pass over the reads


def clippings(reads: DataFrame) -> DataFrame:
    return length_stats(clip_events(reads), "side", "pos").drop("mid_len")


def mismatch_events(reads: DataFrame) -> DataFrame:
    """Each mismatch of the primary reads: pos (1-based), base."""
    own = mapped(reads, told=C.md_tells(F.col("md"))).withColumn("m", F.explode(C.md_mismatches(F.col("places"), F.col("md"), F.col("seq"))))
    return own.select(*PAIR, (F.col("m.ref_pos") + 1).alias("pos"), F.col("m.base").alias("base"))


def mismatches(reads: DataFrame) -> DataFrame:
    """Counts by position, in all and by base."""
    each = [F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in "ACGT"]
    return mismatch_events(reads).groupBy(*PAIR, "pos").agg(F.count("*").alias("n"), *each)


def depth_at(points: DataFrame, runs: DataFrame, bucket: int = 4096) -> DataFrame:
    """points (sample, contig, pos) with depth, from runs of depth; points where there is none are dropped."""
    from .kernels import overlap_join

    spans = points.withColumns({"start": F.col("pos"), "end": F.col("pos")})
    met = overlap_join(spans, runs.select(*PAIR, "start", "end", F.col("value").alias("depth")), PAIR, bucket)
    return met.drop("start", "end", "r_start", "r_end")


def dominant_base(counts: DataFrame, runs: DataFrame, pct: float = 10.0) -> DataFrame:
    """The most frequent mismatched base by position, with its share of the depth if that is at least pct percent.
    Ties go to the last of A, C, G, T."""
    best = F.greatest(*[F.struct(F.col(f"n_{b.lower()}").alias("n"), F.lit(b).alias("base")) for b in "ACGT"])
    rows = depth_at(counts.select(*PAIR, "pos", best.alias("best")), runs)
    share = F.col("best.n") / F.col("depth")
    return rows.filter((F.col("best.n") > 0) & (F.col("best.n") * 100 >= F.col("depth") * pct)).select(*PAIR, "pos", "best.base", "best.n", share.alias("prevalence"))


def dominant_sequence(events: DataFrame, runs: DataFrame, keys: tuple[str, ...] = (), pct: float = 10.0) -> DataFrame:
    """The most frequent sequence of events at a position; ties go to the largest text. All sequences are counted."""
    counts = events.filter("sequence is not null and sequence <> ''").groupBy(*PAIR, *keys, "pos", "sequence").agg(F.count("*").alias("k"))
    best = counts.groupBy(*PAIR, *keys, "pos").agg(F.max(F.struct("k", "sequence")).alias("best"))
    rows = depth_at(best, runs)
    return rows.filter(F.col("best.k") * 100 >= F.col("depth") * pct).select(*PAIR, *keys, "pos", "best.sequence", F.col("best.k").alias("n"), (F.col("best.k") / F.col("depth")).alias("prevalence"))


def significant_events(events: DataFrame, runs: DataFrame, pct: float = 10.0, min_occ: int = 2) -> DataFrame:
    """Events (with n) that reach min_occ and pct percent of the depth, with prevalence; those at bases without depth go."""
    rows = depth_at(events, runs)
    return rows.filter((F.col("n") >= min_occ) & (F.col("n") * 100 >= F.col("depth") * pct)).withColumn("prevalence", F.col("n") / F.col("depth"))


def clipped_ratio(reads: DataFrame, long_reads: bool = False) -> DataFrame:
    """By pair: max(0, (k * primary - clean) / clean), 1 without clean reads; long reads count each end (k = 2)."""
    rows = clean_edges(reads)
    a, b = F.col("begin_event").isNotNull().cast("int"), F.col("finish_event").isNotNull().cast("int")
    clean = a + b if long_reads else F.when(F.col("reverse"), b).otherwise(a)
    k = 2 if long_reads else 1
    sums = rows.groupBy(*PAIR).agg(F.count("*").alias("n_primary"), F.sum(clean).alias("n_clean"))
    return sums.withColumn("clipped_ratio", F.when(F.col("n_clean") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), (k * F.col("n_primary") - F.col("n_clean")) / F.col("n_clean"))))
