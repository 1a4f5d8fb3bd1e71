"""Coding regions: what a changed base does to a codon, how reads cover a region, and which transcript a region belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..driver import written
from ..functions.sequence import CODONS, codons, translate
from .genome import covering_latest
from .kernels import best_over, overlap_join
from .signals import PAIR

#: Names of the amino acids.
NAMES = {
    "A": "Alanine", "C": "Cysteine", "D": "Aspartic acid", "E": "Glutamic acid", "F": "Phenylalanine", "G": "Glycine", "H": "Histidine", "I": "Isoleucine", "K": "Lysine", "L": "Leucine", "M": "Methionine",
    "N": "Asparagine", "P": "Proline", "Q": "Glutamine", "R": "Arginine", "S": "Serine", "T": "Threonine", "V": "Valine", "W": "Tryptophan", "Y": "Tyrosine", "*": "Stop",
}


def spliced_offset(pos: Column, segments: Column, strand: Column) -> Column:
    """Bases of the spliced sequence before a position; null between segments. Segments are in order of start."""
    size = lambda s: (s.end - s.start + 1).cast("long")
    before = F.aggregate(F.filter(segments, lambda s: s.end < pos), F.lit(0).cast("long"), lambda a, s: a + size(s))
    here = F.get(F.filter(segments, lambda s: pos.between(s.start, s.end)), F.lit(0))
    forward = before + pos - here.start
    whole = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + size(s))
    return F.when(strand == -1, whole - 1 - forward).otherwise(forward)


def codon_effect(points: DataFrame, cds: DataFrame) -> DataFrame:
    """Changed bases with category (Synonymous, Non-synonymous, Intergenic), codon and amino_acid.

    points: point_id, contig_name, pos, base. cds: id, contig_name, start, end, strand, segments, seq (spliced, in reading
    direction). Of several regions over a point the one that starts last counts. Points between segments, in a last codon
    that isn't whole or in one with other letters are left out. Codons are joined one by one: no row carries a sequence.
    """
    of = covering_latest(points.select("point_id", "contig_name", "pos"), cds.select("contig_name", "start", "end", "id"), ["contig_name"])
    outside = points.join(of, "point_id", "left_anti").select("point_id", F.lit("Intergenic").alias("category"), F.lit("").alias("codon"), F.lit("").alias("amino_acid"))
    placed = points.join(of, "point_id").join(cds.select("id", "strand", "segments"), "id").withColumn("offset", spliced_offset(F.col("pos"), F.col("segments"), F.col("strand"))).filter("offset is not null")
    own = F.when(F.col("strand") == -1, F.translate("base", "ACGT", "TGCA")).otherwise(F.col("base"))
    placed = placed.select("point_id", "id", F.floor(F.col("offset") / 3).cast("int").alias("codon_idx"), (F.col("offset") % 3).cast("int").alias("place"), own.alias("base"))
    read = cds.select("id", F.posexplode(codons(F.col("seq"))).alias("codon_idx", "was"))
    rows = placed.join(read, ["id", "codon_idx"])
    rows = rows.withColumn("codon", F.concat(F.substring(F.col("was"), F.lit(1), F.col("place")), F.col("base"), F.substring(F.col("was"), F.col("place") + 2, F.lit(2))))
    rows = rows.withColumns({"a": translate(F.col("was")), "b": translate(F.col("codon"))}).filter("a <> 'X' and b <> 'X'")
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.col("b"))
    inside = rows.select("point_id", F.when(F.col("a") == F.col("b"), "Synonymous").otherwise("Non-synonymous").alias("category"), "codon", F.concat("b", F.lit(" ("), name, F.lit(")")).alias("amino_acid"))
    return inside.unionByName(outside)


def _changes() -> list[tuple[str, int, str, str, str, str]]:
    """Each base at each place of each codon, with category, codon and amino acid."""
    made = [(was, i, b, was[:i] + b + was[i + 1 :]) for was in CODONS for i in range(3) for b in "ACGT"]
    return [(was, i, b, "Synonymous" if CODONS[was] == CODONS[c] else "Non-synonymous", c, f"{CODONS[c]} ({NAMES[CODONS[c]]})") for was, i, b, c in made]


_CHANGES = _changes()


def codon_effect_of_texts(bases: DataFrame, cds: DataFrame, size: int) -> DataFrame:
    """The same for a changed base at every place of a stretch: contig_name, pos, category, codon, amino_acid.

    bases: contig_name, block, bases: the changed bases of the positions block * size + 1 to (block + 1) * size, the last block's
    may be fewer. Regions are cut at the blocks, with the codons that a cut needs, and meet them there: texts are shuffled, a
    byte a base, and points are made after the join, so that no row a base is ever shuffled.
    """
    key = ["contig_name", "block"]
    blocks = lambda a, b: F.explode(F.sequence(F.floor((a - 1) / size), F.floor((b - 1) / size))).alias("block")
    first, last = F.col("block") * size + 1, (F.col("block") + 1) * size
    own = cds.select("contig_name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "id")
    # of several regions over a place the one that starts last counts: stretches between places where regions start or end
    marks = own.select("contig_name", F.explode(F.array("start", F.col("end") + 1)).alias("pos")).distinct()
    stretches = marks.withColumn("until", F.lead("pos").over(Window.partitionBy("contig_name").orderBy("pos")) - 1).filter("until is not null")
    best = best_over(stretches, own, ["contig_name"], F.struct("start", "id"))
    latest = stretches.join(best, ["contig_name", "pos"]).select("contig_name", F.col("best.id").alias("id"), F.col("pos").alias("s"), F.col("until").alias("e"))

    length = lambda x: (x.end - x.start + 1).cast("long")
    before = lambda i: F.aggregate(F.slice("segments", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + length(x))
    parts = F.transform("segments", lambda x, i: F.struct(x.start.cast("long").alias("start"), x.end.cast("long").alias("end"), before(i).alias("before")))
    whole = F.aggregate("segments", F.lit(0).cast("long"), lambda a, x: a + length(x))
    held = latest.join(cds.select("id", "strand", parts.alias("parts"), whole.alias("whole"), F.col("seq").cast("binary").alias("seq")), "id")
    cut = held.select("contig_name", "s", "e", "strand", "whole", "seq", F.explode("parts").alias("p"))
    cut = cut.withColumns({"s": F.greatest("s", "p.start"), "e": F.least("e", "p.end")}).filter("s <= e")
    cut = cut.select("*", blocks(F.col("s"), F.col("e"))).withColumns({"s": F.greatest("s", first), "e": F.least("e", last)})
    # an offset is a + b * pos: forward, or back from the end
    minus = F.col("strand") == -1
    b, ahead = F.when(minus, -1).otherwise(1), F.col("p.before") - F.col("p.start")
    a = F.when(minus, F.col("whole") - 1 - ahead).otherwise(ahead)
    cut = cut.withColumns({"a": a, "b": b}).withColumns({"c0": F.floor(F.least(F.col("a") + F.col("b") * F.col("s"), F.col("a") + F.col("b") * F.col("e")) / 3), "c1": F.floor(F.greatest(F.col("a") + F.col("b") * F.col("s"), F.col("a") + F.col("b") * F.col("e")) / 3)})
    text = F.substring("seq", (F.col("c0") * 3 + 1).cast("int"), ((F.col("c1") - F.col("c0") + 1) * 3).cast("int"))
    inside = cut.select(*key, F.struct("s", "e", "a", "b", (F.col("c0") * 3).alias("from"), text.alias("text")).alias("part"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("over"))
    over = latest.select("contig_name", "s", "e", blocks(F.col("s"), F.col("e"))).select(*key, F.lit(None).cast(inside.schema["part"].dataType).alias("part"), F.struct(F.greatest("s", first).alias("s"), F.least("e", last).alias("e")).alias("over"))
    cells = inside.unionByName(over).groupBy(*key).agg(F.collect_list("part").alias("parts"), F.array_sort(F.collect_list("over")).alias("over"))

    met = bases.select(*key, F.col("bases").cast("binary").alias("bases")).join(cells, key, "left")
    size_of = F.length("bases")
    # what lies between the stretches of a block, which are in order and don't overlap
    edges = F.concat(F.array(F.struct(first.alias("s"), (first - 1).alias("e"))), F.coalesce("over", F.array().cast("array<struct<s:bigint,e:bigint>>")), F.array(F.struct((first + size_of).alias("s"), first.alias("e"))))
    met = met.withColumn("edges", edges)
    gaps = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct((F.get("edges", i - 1).e + 1).alias("s"), (F.get("edges", i).s - 1).alias("e")))
    gaps = F.filter(gaps, lambda g: g.s <= g.e)
    run = F.explode(F.sequence("g.s", "g.e")).alias("pos")
    outside = met.select("contig_name", F.explode(gaps).alias("g")).select("contig_name", run).select("contig_name", "pos", F.lit("Intergenic").alias("category"), F.lit("").alias("codon"), F.lit("").alias("amino_acid"))
    rows = met.select("contig_name", (first - 1).alias("base_from"), "bases", F.explode("parts").alias("g")).select("contig_name", "base_from", "bases", "g", run).filter(F.col("pos") <= F.col("base_from") + size_of)
    rows = rows.withColumn("offset", F.col("g.a") + F.col("g.b") * F.col("pos"))
    base = F.substring("bases", (F.col("pos") - F.col("base_from")).cast("int"), F.lit(1)).cast("string")
    own_base = F.when(F.col("g.b") == -1, F.translate(base, "ACGT", "TGCA")).otherwise(base)
    was = F.upper(F.substring("g.text", (F.col("offset") - F.col("offset") % 3 - F.col("g.from") + 1).cast("int"), F.lit(3)).cast("string"))
    rows = rows.select("contig_name", "pos", was.alias("was"), (F.col("offset") % 3).cast("int").alias("place"), own_base.alias("base"))
    # looked up and not worked out a row: the code for that outgrows what the JVM compiles
    changes = F.broadcast(bases.sparkSession.createDataFrame(_CHANGES, "was string, place int, base string, category string, codon string, amino_acid string"))
    inside = rows.join(changes, ["was", "place", "base"]).select("contig_name", "pos", "category", "codon", "amino_acid")
    return inside.unionByName(outside)


def dn_ds(non_synonymous: Column, synonymous: Column, s_sites: Column, n_sites: Column) -> Column:
    """(N changes per N site) / (S changes per S site) to 4 decimals; 0 where undefined."""
    return F.when((synonymous > 0) & (n_sites > 0), F.round(non_synonymous * s_sites / (synonymous * n_sites), 4)).otherwise(0.0)


def cds_mapping_patterns(cds: DataFrame, runs: DataFrame, positions: DataFrame, bucket: int = 1000) -> DataFrame:
    """By region and sample: aligned percent, median depth, and for each kind of variant its number and summed prevalence.

    cds: id, contig_name, start, end. runs: pair, start, end, value. positions: pair, kind, pos, prevalence. Bases without
    a run count as depth 0 in the median, which is the mean of both middle ones where their number is even. Only pairs of
    region and sample with a read over the region are listed. Regions at the same place are worked out once. A bucket should be
    about as long as a region: each is compared with all runs and variants of its buckets.
    """
    size = F.col("g_end") - F.col("g_start") + 1
    place = ["contig_name", "start", "end"]
    genes = cds.select(*place).distinct().withColumn("id", F.struct(*place))
    met = overlap_join(genes.withColumns({"g_start": F.col("start"), "g_end": F.col("end")}), runs.filter("value > 0"), ["contig_name"], bucket)
    met = met.select("id", "sample_name", size.alias("size"), "value", (F.least("end", "r_end") - F.greatest("start", "r_start") + 1).alias("n"))
    keys = ["id", "sample_name"]
    counts = met.groupBy(*keys, "size", "value").agg(F.sum("n").alias("n"))
    zero = counts.groupBy(*keys, "size").agg(F.sum("n").alias("covered")).select(*keys, "size", F.lit(0).cast(dict(runs.dtypes)["value"]).alias("value"), (F.col("size") - F.col("covered")).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value"))
    spread = counts.unionByName(zero).withColumn("upto", upto)
    middle = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    depth = spread.groupBy(*keys, "size").agg(
        (100.0 * F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)) / F.col("size")).alias("aligned_pct"),
        ((middle(F.floor((F.col("size") + 1) / 2)) + middle(F.floor(F.col("size") / 2) + 1)) / 2).alias("median_depth"),
    ).drop("size")
    points = positions.select(*PAIR, "kind", F.col("pos").alias("start"), F.col("pos").alias("end"), "prevalence")
    kinds = ("mismatch", "insertion", "deletion", "clipping")
    seen = overlap_join(genes, points, ["contig_name"], bucket).groupBy(*keys).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds], *[F.sum(F.when(F.col("kind") == k, F.col("prevalence")).otherwise(0.0)).alias(f"{k}_prevalence") for k in kinds])
    out = depth.join(seen, keys, "left").fillna(0, [f"{k}_{what}" for k in kinds for what in ("count", "prevalence")])
    return cds.select("id", F.struct(*place).alias("place")).join(out.withColumnRenamed("id", "place"), "place").drop("place")


def resolve_cds_parent(features: DataFrame) -> DataFrame:
    """annotation_id of a CDS and parent_id: the only mRNA with its locus tag (else gene) and strand that holds all its segments.

    features: annotation_id, contig_name, type, strand, locus_tag, gene, segments.
    """
    rows = features.withColumn("key", F.coalesce("locus_tag", "gene")).filter("key is not null").select("annotation_id", "contig_name", "type", "strand", "key", "segments")
    rna = rows.filter("type = 'mRNA'").select(F.col("annotation_id").alias("parent_id"), "contig_name", "strand", "key", F.col("segments").alias("outer"))
    inside = F.forall("segments", lambda s: F.exists("outer", lambda o: (o.start <= s.start) & (s.end <= o.end)))
    met = rows.filter("type = 'CDS'").join(rna, ["contig_name", "strand", "key"]).filter(inside)
    return met.groupBy("annotation_id").agg(F.min("parent_id").alias("parent_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


#: Types of features that take exons and coding parts in.
TRANSCRIPTS = ("mRNA", "transcript", "primary_transcript")


def _attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _first_of_id(rows: DataFrame) -> DataFrame:
    """name, parent_no and type of the first row that has an ID."""
    first = rows.select(_attribute("ID").alias("name"), "row_no", "type").filter("name is not null").groupBy("name").agg(F.min(F.struct("row_no", "type")).alias("r"))
    return first.select("name", F.col("r.row_no").alias("parent_no"), F.col("r.type").alias("parent_type"))


def transcript_of(rows: DataFrame) -> DataFrame:
    """row_no and parent_no of exons and coding parts: the first of their Parent list that is the ID of a transcript. Names that no
    row has, and those of other features, are passed over."""
    children = rows.filter("type in ('exon', 'CDS')").select("row_no", F.posexplode(F.split(_attribute("Parent"), ",")).alias("ord", "name")).withColumn("name", F.trim("name"))
    met = children.join(_first_of_id(rows).filter(F.col("parent_type").isin(*TRANSCRIPTS)), "name")
    return met.groupBy("row_no").agg(F.min_by("parent_no", "ord").alias("parent_no"))


def fold_gff(rows: DataFrame) -> DataFrame:
    """Features with exons and coding parts folded into their transcripts: row_no, contig_name, type, start, end, strand,
    attributes, segments, parent_no.

    A transcript has its exons as segments, in order of place, if they are two or more. Its coding parts become one CDS with the
    transcript's row number and as parent_no the same: from the least start to the largest end, on the first part's strand, with
    the transcript's attributes and those of the first part (by row number) that it lacks. Parts without a transcript stay as
    they are. rows: row_no, contig_name, type, start, end, strand, attributes (ID, Parent).
    """
    columns = ["row_no", "contig_name", "type", "start", "end", "strand", "attributes"]
    owned = rows.select(*columns).join(transcript_of(rows), "row_no", "left")
    kind = "array<struct<start:bigint,end:bigint>>"
    span, none = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), F.array().cast(kind)
    is_part, is_coding = F.col("parent_no").isNotNull(), F.col("parent_no").isNotNull() & (F.col("type") == "CDS")
    # a row and all parts that fold into it meet once, under the row's number; only coding parts bring their attributes
    parts = lambda what: F.array_sort(F.collect_list(F.when(is_part & (F.col("type") == what), span)))
    own = [F.first(F.when(~is_part, F.col(c)), ignorenulls=True).alias(c) for c in columns[1:]]
    first = F.min_by(F.when(is_coding, F.struct("strand", "attributes")), F.when(is_coding, F.col("row_no")))
    dealt = owned.withColumns({"into": F.coalesce("parent_no", "row_no"), "attributes": F.when(~is_part | is_coding, F.col("attributes"))}).repartition("into")  # rows take less than sums of one row each
    whole = dealt.groupBy(F.col("into").alias("row_no")).agg(*own, parts("exon").alias("exons"), parts("CDS").alias("coding"), first.alias("first"))
    several = lambda c: F.when(F.size(c) > 1, F.col(c)).otherwise(none)
    missing = F.map_filter("first.attributes", lambda k, _: ~F.map_contains_key("attributes", k))
    last = ["type", "start", "end", "strand", "attributes", "segments", "parent_no"]
    plain = F.struct("type", "start", "end", "strand", "attributes", several("exons").alias("segments"), F.lit(None).cast("long").alias("parent_no"))
    folded = F.struct(
        F.lit("CDS").alias("type"), F.array_min("coding.start").alias("start"), F.array_max("coding.end").alias("end"), F.col("first.strand").alias("strand"),
        F.map_concat("attributes", missing).alias("attributes"), several("coding").alias("segments"), F.col("row_no").cast("long").alias("parent_no"),
    )
    both = F.when(F.size("coding") > 0, F.array(plain, folded)).otherwise(F.array(plain))
    return whole.select("row_no", "contig_name", F.explode(both).alias("x")).select("row_no", "contig_name", *[F.col("x")[c].alias(c) for c in last])


def top_features(rows: DataFrame, rounds: int = 6) -> DataFrame:
    """row_no, top_no and level of every feature: the row at the upper end of its chain of parents (the first of a Parent list
    that some row has), and how many steps up it is. Each round doubles the steps that are known, for the rows that are not yet
    at a top, until there are none. A feature without a known parent is its own top; one on a circle of parents, or more than
    2^rounds levels deep, has a null top."""
    ids = _first_of_id(rows).drop("parent_type")
    children = rows.select("row_no", F.posexplode(F.split(_attribute("Parent"), ",")).alias("ord", "name")).withColumn("name", F.trim("name"))
    edges = children.join(ids, "name").groupBy("row_no").agg(F.min_by("parent_no", "ord").alias("at"))
    # rows with a parent: the row reached so far, the steps to it, and whether it may have a parent itself
    known = written(edges.select("row_no", "at", F.lit(1).alias("level"), F.lit(True).alias("open")), "parents")
    for k in range(rounds + 1):
        if known.filter("open").isEmpty():
            break
        above = known.select(F.col("row_no").alias("at"), F.col("at").alias("next"), F.col("level").alias("more"), F.col("open").alias("on"))
        met = known.filter("open").join(above, "at", "left")
        if k == rounds:  # what still has a row above it is too deep, or on a circle
            step = met.select("row_no", "at", "level", F.col("next").isNotNull().alias("open"))
        else:
            step = met.select("row_no", F.coalesce("next", "at").alias("at"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), F.coalesce("on", F.lit(False)).alias("open"))
        known = written(known.filter("not open").unionByName(step), "parents")
    out = rows.select("row_no").join(known.withColumnRenamed("level", "steps"), "row_no", "left")
    top = F.when(F.col("at").isNull(), F.col("row_no")).when(~F.col("open"), F.col("at"))
    return out.select("row_no", top.alias("top_no"), F.when(top.isNotNull(), F.coalesce("steps", F.lit(0))).alias("level"))
