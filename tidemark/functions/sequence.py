"""Column functions on nucleotide texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The amino acids of the 64 codons, bases in the order T, C, A, G.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def codon_sites(codon: str) -> tuple[int, int]:
    """Of the nine single changes of a codon, how many keep the amino acid and how many change it; 0, 0 for stops."""
    own = CODONS.get(codon, "*")
    if own == "*":
        return 0, 0
    changed = [codon[:i] + b + codon[i + 1 :] for i in range(3) for b in "ACGT" if b != codon[i]]
    same = sum(CODONS[c] == own for c in changed)
    return same, 9 - same


def _of_codon(codon: Column, letters: str) -> Column:
    """The letter at a codon's place among the 64; null for codons with other bases."""
    at = [F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) for i in (1, 2, 3)]
    known = (at[0] > 0) & (at[1] > 0) & (at[2] > 0) & (F.length(codon) == 3)
    return F.when(known, F.substring(F.lit(letters), (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2], F.lit(1)))


def pieces(seq: Column, size: int) -> Column:
    """A text cut into pieces of `size` characters in one pass; the last may be shorter, and an empty text has none."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT become N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def codons(seq: Column) -> Column:
    """The whole codons of a sequence; a last one that isn't full is dropped."""
    return F.regexp_extract_all(F.upper(seq), F.lit("(?s).{3}"), F.lit(0))


def translate(seq: Column) -> Column:
    """Amino acids; X for codons with other letters."""
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(_of_codon(c, _AMINO), F.lit("X"))), "")


def sn_sites(seq: Column) -> Column:
    """struct<s, n>: synonymous and other single changes over the codons; stops and codons with other letters count nothing."""
    sites = [codon_sites(c) for c in CODONS]
    add = lambda k: F.aggregate(codons(seq), F.lit(0), lambda a, c: a + F.coalesce(_of_codon(c, "".join(str(s[k]) for s in sites)).cast("int"), F.lit(0)))
    return F.struct(add(0).alias("s"), add(1).alias("n"))


def base_count(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_percent(seq: Column) -> Column:
    """Whole percent of G and C among ACGT; 50 where there is none of them."""
    gc, all_ = base_count(seq, "GCgc"), base_count(seq, "ACGTacgt")
    return F.when(all_ == 0, 50).otherwise(F.round(100.0 * gc / all_)).cast("int")


def gc_skew(seq: Column) -> Column:
    """(G - C) / (G + C); 0 where there is neither."""
    g, c = base_count(seq, "Gg"), base_count(seq, "Cc")
    return F.when(g + c == 0, 0.0).otherwise((g - c) / (g + c))


def splice(seq: Column, segments: Column, strand: Column) -> Column:
    """The segments (start, end) of a sequence joined in order, reversed on the minus strand."""
    joined = F.array_join(F.transform(segments, lambda s: F.substring(seq, s.start, s.end - s.start + 1)), "")
    return F.when(strand < 0, revcomp(joined)).otherwise(joined)
