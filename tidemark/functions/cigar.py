"""Column functions on CIGAR and MD texts, flags and circular coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = r"(\d+)([MIDNSHP=X])"


def parse_cigar(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR text; empty for null and "*"."""
    text = F.coalesce(cigar, F.lit(""))
    lens, kinds = F.regexp_extract_all(text, F.lit(OPS), F.lit(1)), F.regexp_extract_all(text, F.lit(OPS), F.lit(2))
    return F.zip_with(lens, kinds, lambda n, k: F.struct(n.cast("int").alias("len"), k.alias("op")))


def span(ops: Column, kinds: str) -> Column:
    """Sum of the lengths of the operations of these kinds."""
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(F.instr(F.lit(kinds), o.op) > 0, o.len).otherwise(0))


def ref_span(ops: Column) -> Column:
    return span(ops, "MDN=X")


def query_length(ops: Column) -> Column:
    return span(ops, "MIS=X")


def running(items: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array, it and all before it put together. Round k adds what stands 2^k places before, so n elements
    take log2(n) rounds, each of n steps; no array grows step by step, as long reads have thousands of operations."""
    def summed(a: Column) -> Column:
        rounds = F.when(F.size(a) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        before = lambda k: F.call_function("shiftleft", F.lit(1), k)
        return F.aggregate(rounds, a, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= before(k), add(F.get(acc, i - before(k)), x)).otherwise(x)))

    return F.element_at(F.transform(F.array(items), summed), 1)  # a lambda's variable is worked out once


def cigar_offsets(ops: Column, pos: Column) -> Column:
    """Each operation with where it starts: ref_start (0-based), query_start and mcol_start (match columns before it)."""
    takes = lambda o, kinds: F.when(F.instr(F.lit(kinds), o.op) > 0, o.len).otherwise(0)
    own = F.transform(ops, lambda o: F.struct(o.op.alias("op"), o.len.alias("len"), takes(o, "MDN=X").alias("r"), takes(o, "MIS=X").alias("q"), takes(o, "M=X").alias("m")))
    add = lambda a, b: F.struct(b.op.alias("op"), b.len.alias("len"), (a.r + b.r).alias("r"), (a.q + b.q).alias("q"), (a.m + b.m).alias("m"))
    first = F.coalesce(pos.cast("int"), F.lit(0))
    return F.transform(running(own, add), lambda o: F.struct(
        o.op.alias("op"), o.len.alias("len"), (first + o.r - takes(o, "MDN=X")).alias("ref_start"), (o.q - takes(o, "MIS=X")).alias("query_start"), (o.m - takes(o, "M=X")).alias("mcol_start"),
    ))


def parse_md(md: Column) -> Column:
    """The tokens of an MD text: numbers, deletions with their caret, single mismatched bases."""
    return F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))


def md_tells(md: Column) -> Column:
    """Whether an MD text has a mismatch."""
    return F.coalesce(md, F.lit("")).rlike("[0-9][A-Z]|^[A-Z]")


def md_mismatches(offsets: Column, md: Column, seq: Column) -> Column:
    """array<struct<ref_pos, ref_base, base>> of the mismatches: the k-th match column lies in the operation that holds it.
    Positions come from the CIGAR; deletions in MD take no match column. Operations and mismatches are put in one order, and
    each mismatch takes the operation that started last."""
    none = F.lit(None).cast("int")
    width = lambda t: F.when(t.rlike("^[0-9]"), t.cast("int")).when(t.startswith("^"), 0).otherwise(1)
    tokens = F.transform(parse_md(md), lambda t: F.struct(t.alias("t"), width(t).alias("n")))
    ends = running(tokens, lambda a, b: F.struct(b.t.alias("t"), (a.n + b.n).alias("n")))
    own = F.filter(ends, lambda t: t.t.rlike("^[A-Z]"))
    columns = F.filter(offsets, lambda o: o.op.isin("M", "=", "X"))
    item = lambda k, kind, r, q, end, base: F.struct(k.alias("k"), kind.alias("kind"), r.alias("r"), q.alias("q"), end.alias("end"), base.alias("base"))
    starts = F.transform(columns, lambda o: item(o.mcol_start, F.lit(0), o.ref_start - o.mcol_start, o.query_start - o.mcol_start, o.mcol_start + o.len, F.lit(None).cast("string")))
    both = F.array_sort(F.concat(starts, F.transform(own, lambda t: item(t.n - 1, F.lit(1), none, none, none, t.t))))  # at one column, the operation comes first
    met = running(both, lambda a, b: item(b.k, b.kind, F.coalesce(b.r, a.r), F.coalesce(b.q, a.q), F.coalesce(b.end, a.end), b.base))
    hits = F.filter(met, lambda m: (m.kind == 1) & (m.k < m.end))
    placed = F.transform(hits, lambda m: F.struct((m.r + m.k).alias("ref_pos"), m.base.alias("ref_base"), F.substring(seq, m.q + m.k + 1, F.lit(1)).alias("base")))
    return F.when(md_tells(md), placed).otherwise(F.array().cast("array<struct<ref_pos:int,ref_base:string,base:string>>"))


def edge_match(cigar: Column, md: Column, side: str) -> Column:
    """If a read begins ("start") or ends ("end") in a matching base: no clip or insertion there, and an MD run above 0."""
    text = F.coalesce(md, F.lit(""))
    if side == "start":
        return F.coalesce(~cigar.rlike(r"^\d+[SHI]") & text.rlike(r"^0*[1-9]"), F.lit(False))
    return F.coalesce(~cigar.rlike(r"[SHI]$") & (F.regexp_extract(text, r"(\d+)$", 1).try_cast("int") > 0), F.lit(False))


def boundary_event(cigar: Column, md: Column, side: str, most: int = 5, ops: Column | None = None) -> Column:
    """0 for a clean edge; the length of a clip or insertion below `most` whose neighbour is a match that MD confirms; else null.
    With ops, the parsed CIGAR, it isn't parsed again."""
    ops = parse_cigar(cigar) if ops is None else ops
    first, second = (F.get(ops, F.lit(0)), F.get(ops, F.lit(1))) if side == "start" else (F.element_at(ops, -1), F.get(ops, F.size(ops) - 2))
    text = F.coalesce(md, F.lit(""))
    run = text.rlike(r"^0*[1-9]") if side == "start" else F.regexp_extract(text, r"(\d+)$", 1).try_cast("int") > 0
    return F.when(F.size(ops) == 0, None).when(edge_match(cigar, md, side), 0).when(
        first.op.isin("S", "H", "I") & (first.len < most) & ~second.op.isin("S", "H", "I") & run, first.len
    )


def circ_dist(a: Column, b: Column, length: Column) -> Column:
    """The shorter way between two places on a circle."""
    d = F.abs(a - b)
    return F.least(d, length - d)


def wrapped_tlen(pos: Column, mate_pos: Column, length: Column, circular: Column, tlen: Column) -> Column:
    """Distance of the starts along the circle, or the template length as given."""
    return F.when(circular, F.pmod(mate_pos - pos, length)).otherwise(F.abs(tlen))


def proper_pair(contig: Column, mate_contig: Column, reverse: Column, mate_reverse: Column, tlen: Column, most: int = 10_000) -> Column:
    """Same contig, opposite strands, 0 < template length < most; the flag's own bit isn't used."""
    return (contig == mate_contig) & (reverse != mate_reverse) & (tlen > 0) & (tlen < most)


def has_flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(bit) != 0
