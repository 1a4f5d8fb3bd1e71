"""File sources and sinks, all as Spark jobs over text, CSV and Parquet; a path may be a folder, a pattern or a list.

Lines are split by Spark's readers, so a large file is read by many tasks. Only FASTA and GenBank use a record separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import pieces
from ..functions.text import gff_escape, gff_unescape, once, rename_keys

#: The columns of the formats, in order.
SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
BLAST6 = "q STRING, s STRING, pident DOUBLE, length LONG, mismatch LONG, gapopen LONG, p1 LONG, p2 LONG, p1x LONG, p2x LONG"
GFF3 = ["contig_name", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
#: Spellings of attribute keys and the names they get.
KEY_NAMES = {"Product": "product", "Function": "function", "Gene": "gene", "Locus_tag": "locus_tag", "Note": "note", "Phrog": "phrog"}
OTHER_KEY_NAMES = {"locus-tag": "locus_tag", "PHROG": "phrog"}
#: GFF3 rows that describe sequences, not features.
NOT_FEATURES = ("source", "gene", "region")


def attributes(keys: Column, values: Column) -> Column:
    """A map with the first value of each key, keys under their usual names."""
    first = lambda z: F.map_from_entries(F.filter(z, lambda e, i: (e.k != "") & (F.array_position(z.getField("k"), e.k) == i + 1)))
    return rename_keys(rename_keys(once(F.arrays_zip(keys.alias("k"), values.alias("v")), first), KEY_NAMES), OTHER_KEY_NAMES)


def stem(column: str = "_metadata.file_name") -> Column:
    """A file's name without its last ending, and without `_with_MD`."""
    return F.regexp_replace(F.regexp_replace(column, r"\.[^.]*$", ""), "_with_MD$", "")


def _lines(spark: SparkSession, path, **options: str) -> DataFrame:
    rows = spark.read.options(**options).text(path)
    return rows.select("value", (F.col("sample_name").cast("string") if "sample_name" in rows.columns else stem()).alias("file"))


def read_alignments(spark: SparkSession, path) -> DataFrame:
    """Mapped alignments of SAM text files, one file (or one folder sample_name=...) a sample: pos from 0, MD and NM from the tags (null if absent).

    read_id numbers the lines by task and place, so a task that runs again gives the same ones.
    """
    f = F.split("value", "\t")
    at = {name: f[i] for i, name in enumerate(SAM)}
    tag = lambda name: F.nullif(F.regexp_extract("value", rf"\t{name}:[A-Za-z]:([^\t]*)", 1), F.lit(""))
    rows = _lines(spark, path).filter(~F.startswith("value", F.lit("@")) & (F.size(f) >= len(SAM)))
    rows = rows.select(
        F.col("file").alias("sample_name"), at["rname"].alias("contig_name"), F.monotonically_increasing_id().alias("read_id"), at["qname"].alias("qname"),
        at["flag"].cast("int").alias("flag"), (at["pos"].cast("int") - 1).alias("pos"), at["mapq"].cast("int").alias("mapq"), at["cigar"].alias("cigar"),
        F.when(at["rnext"] == "=", at["rname"]).otherwise(F.nullif(at["rnext"], F.lit("*"))).alias("mate_contig"), (at["pnext"].cast("int") - 1).alias("mate_pos"),
        at["tlen"].cast("int").alias("tlen"), at["seq"].alias("seq"), tag("MD").alias("md"), tag("NM").cast("int").alias("nm"),
    )
    return rows.filter((F.col("flag").bitwiseAND(4) == 0) & (F.col("contig_name") != "*"))


def read_headers(spark: SparkSession, path) -> DataFrame:
    """Header lines of SAM text files: sample_name, value."""
    return _lines(spark, path).filter(F.startswith("value", F.lit("@"))).withColumnRenamed("file", "sample_name")


def contigs_from_headers(headers: DataFrame) -> DataFrame:
    """Contigs that any file names, by name; n_lengths above 1 tells of files that disagree (the largest length stays)."""
    part = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]*)", 1)
    rows = headers.filter(F.startswith("value", F.lit("@SQ"))).select(part("SN").alias("contig_name"), part("LN").cast("long").alias("contig_length"))
    return rows.groupBy("contig_name").agg(F.max("contig_length").alias("contig_length"), F.countDistinct("contig_length").alias("n_lengths")).orderBy("contig_name")


def sample_circularity(headers: DataFrame) -> DataFrame:
    """Whether a sample's header comments say circular=true; false if they say nothing."""
    says = F.startswith("value", F.lit("@CO")) & F.col("value").rlike("circular=true")
    return headers.groupBy("sample_name").agg(F.bool_or(says).alias("circular"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """contig_name (the first word) and seq of FASTA records; empty ones go."""
    rows = spark.read.option("lineSep", ">").text(path).select(F.split("value", "\n", 2).alias("p"))
    return rows.select(F.regexp_extract(F.col("p")[0], r"^(\S+)", 1).alias("contig_name"), F.regexp_replace(F.get("p", F.lit(1)), r"\s", "").alias("seq")).filter("contig_name <> '' and seq <> ''")


def read_gff3(spark: SparkSession, path) -> DataFrame:
    """Features of GFF3 files: annotation columns and a map of unescaped attributes with the usual key names."""
    f = F.split("value", "\t")
    rows = _lines(spark, path).filter(~F.startswith("value", F.lit("#")) & (F.size(f) == len(GFF3))).select("file", *[f[i].alias(c) for i, c in enumerate(GFF3)])
    parts = F.split("attributes", ";")
    keys, values = F.transform(parts, lambda x: F.trim(F.split(x, "=", 2)[0])), F.transform(parts, lambda x: gff_unescape(F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit(""))))
    rows = rows.filter(~F.col("type").isin(*NOT_FEATURES)).select(
        "file", "contig_name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"), "type",
        attributes(keys, values).alias("attributes"),
    )
    return rows.filter("start is not null and end is not null")


def gff3_contigs(spark: SparkSession, path) -> DataFrame:
    """Contig lengths of GFF3 files: of the ##sequence-region lines, else the largest end of any row, features or not."""
    f, r = F.split("value", "\t"), F.split("value", r"\s+")
    rows = spark.read.text(path)
    said = rows.filter(F.startswith("value", F.lit("##sequence-region"))).select(r[1].alias("contig_name"), r[3].cast("long").alias("said"), F.lit(None).cast("long").alias("seen"))
    seen = rows.filter(~F.startswith("value", F.lit("#")) & (F.size(f) == len(GFF3))).select(f[0].alias("contig_name"), F.lit(None).cast("long").alias("said"), f[4].cast("long").alias("seen"))
    return said.unionByName(seen).groupBy("contig_name").agg(F.coalesce(F.max("said"), F.max("seen")).alias("contig_length"))


#: A part of a GenBank location: a name with its bracket, a closing one, or a place with the record it is in, if another.
LOCATION = r"[a-z-]+\(|\)|[.^]+[<>]?\d+|(?:[A-Za-z0-9_.]+:)?[<>]?\d++(?:[.^]+[<>]?\d++)?(?![.^])"


def location_segments(place: Column) -> Column:
    """array<struct<start, end, strand>> of a GenBank location (without blanks), in the order of the text. join, order and
    complement may hold one another; strand is -1 inside an odd number of complements. Single bases and open ends count as they
    stand; places between two bases (^), one of several (one-of, n.m), gaps and places in other records are no segments."""
    kind = "array<struct<start:bigint,end:bigint,strand:int>>"

    def step(acc: Column, t: Column) -> Column:
        opens = F.when(t == "complement(", "c").when(t.isin("join(", "order("), "j").otherwise("x")
        first, last = (F.regexp_extract(t, r"^[<>]?(\d+)(?:\.\.[<>]?(\d+))?$", i) for i in (1, 2))
        strand = F.when(F.length(F.replace(acc.stack, F.lit("c"), F.lit(""))) % 2 != F.length(acc.stack) % 2, -1).otherwise(1)
        own = F.array(F.struct(first.try_cast("bigint").alias("start"), F.coalesce(last.try_cast("bigint"), first.try_cast("bigint")).alias("end"), strand.alias("strand"))).cast(kind)
        stack = F.when(F.endswith(t, F.lit("(")), F.concat(acc.stack, opens)).when(t == ")", F.substring(acc.stack, F.lit(1), F.greatest(F.length(acc.stack) - 1, F.lit(0)))).otherwise(acc.stack)
        return F.struct(stack.alias("stack"), F.when((first != "") & (F.instr(acc.stack, "x") == 0), F.concat(acc.out, own)).otherwise(acc.out).alias("out"))

    none = F.struct(F.lit("").alias("stack"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.regexp_extract_all(place, F.lit(LOCATION), F.lit(0)), none, step, lambda acc: acc.out)


def _genbank(spark: SparkSession, path) -> DataFrame:
    """A row for each record, up to its `//` line: contig_name, value."""
    record = spark.read.option("lineSep", "\n//").text(path).filter(F.col("value").contains("LOCUS"))
    return record.select(F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("contig_name"), "value")


def _genbank_features(records: DataFrame) -> DataFrame:
    """contig_name, type, place and attributes of all features; they are found by their column."""
    table = F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\n(?:ORIGIN|CONTIG|BASE COUNT)|\z)", 1)
    rows = records.select("contig_name", F.explode(F.split(table, r"\n(?= {5}\S)")).alias("block"))
    place = F.regexp_replace(F.regexp_extract("block", r"(?s)^\s*\S+\s+(.*?)(?=\n\s+/|\z)", 1), r"\s", "")
    flat, key = F.regexp_replace("block", r"\n\s{21}(?!/)", " "), F.lit(r'\n\s+/(\w+)(?:="?([^"\n]*)"?)?')
    found = attributes(F.regexp_extract_all(flat, key, F.lit(1)), F.regexp_extract_all(flat, key, F.lit(2)))
    return rows.select("contig_name", F.regexp_extract("block", r"^\s*(\S+)", 1).alias("type"), place.alias("place"), found.alias("attributes"))


def _origin() -> Column:
    """The bases of a record."""
    return F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)\z", 1), "[^A-Za-z]", "")


def read_genbank(spark: SparkSession, path) -> DataFrame:
    """Features of GenBank records: contig_name, contig_length, type, start, end, strand, segments (each with its own strand),
    attributes. strand is -1 where complement is around the whole location; features without a segment on the contig go, and
    `source` is no feature but tells of the contig."""
    lengths = genbank_contigs(spark, path).select("contig_name", "contig_length")
    rows = _genbank_features(_genbank(spark, path)).filter("type <> 'source'").withColumn("segments", location_segments(F.col("place"))).filter(F.size("segments") > 0)
    rows = rows.withColumns({"strand": F.when(F.startswith("place", F.lit("complement(")), -1).otherwise(1), "start": F.array_min("segments.start"), "end": F.array_max("segments.end")})
    return rows.join(lengths, "contig_name", "left").select("contig_name", "contig_length", "type", "start", "end", "strand", "segments", "attributes")


def genbank_contigs(spark: SparkSession, path) -> DataFrame:
    """contig_name, contig_length (of its bases, or as the LOCUS line says, if there are none), alias (its version, where that is
    another name) and qualifiers, those of `source`."""
    records = _genbank(spark, path)
    version, said = F.nullif(F.regexp_extract("value", r"\nVERSION\s+(\S+)", 1), F.lit("")), F.regexp_extract("value", r"LOCUS\s+\S+\s+(\d+)", 1).try_cast("long")
    rows = records.select("contig_name", F.coalesce(F.nullif(F.length(_origin()).cast("long"), F.lit(0)), said).alias("contig_length"), F.nullif(version, F.col("contig_name")).alias("alias"))
    tells = _genbank_features(records).filter("type = 'source'").groupBy("contig_name").agg(F.first("attributes").alias("qualifiers"))
    return rows.join(tells, "contig_name", "left")


def genbank_sequences(spark: SparkSession, path, size: int = 65_536) -> DataFrame:
    """The bases of GenBank records in pieces: contig_name, chunk_idx from 0, seq."""
    return _genbank(spark, path).select("contig_name", F.posexplode(pieces(_origin(), size)).alias("chunk_idx", "seq"))


def read_blast6(spark: SparkSession, path) -> DataFrame:
    """Hits of tabular BLAST files without exact self-hits; rows of fewer than ten fields go."""
    f = F.split("value", "\t")
    kinds = [c.split(" ") for c in BLAST6.split(", ")]
    rows = spark.read.text(path).filter(F.size(f) >= len(kinds)).select(*[f[i].try_cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)])
    rows = rows.filter("p1 is not null and p2 is not null and p1x is not null and p2x is not null")
    return rows.filter("not (q = s and p1 = p1x and p2 = p2x)").select(F.col("q").alias("contig_1"), F.col("s").alias("contig_2"), "p1", "p2", "p1x", "p2x", "pident", ((F.col("p2") >= F.col("p1")) == (F.col("p2x") >= F.col("p1x"))).alias("is_direct"))


def infer_types(rows: DataFrame, key: str) -> dict[str, str]:
    """For each text column but the key: bigint if all its values are, else double if all are, else string; blanks are no values."""
    names = [c for c in rows.columns if c != key]
    if not names:
        return {}
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    fits = [F.coalesce(F.bool_and(F.when(value(c).isNotNull(), value(c).try_cast(k).isNotNull())), F.lit(False)).alias(f"{k}.{c}") for c in names for k in ("bigint", "double")]
    found = rows.agg(*fits).first().asDict()
    return {c: next((k for k in ("bigint", "double") if found[f"{k}.{c}"]), "string") for c in names}


def read_metadata_csv(spark: SparkSession, path, key: str) -> DataFrame:
    """A table of user columns by key, each with the narrowest type that holds its values; blanks are null."""
    rows = spark.read.csv(path, header=True)
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(key, *[value(c).try_cast(k).alias(c) for c, k in infer_types(rows, key).items()])


def read_custom_feature(spark: SparkSession, path) -> DataFrame:
    """contig_name, sample_name (null: all), first_position, last_position, value."""
    rows = spark.read.csv(path, header=True, schema="Contig STRING, Sample STRING, First_position INT, Last_position INT, Value DOUBLE", mode="DROPMALFORMED", enforceSchema=False)
    return rows.select(*[F.col(c).alias(n) for c, n in zip(rows.columns, ["contig_name", "sample_name", "first_position", "last_position", "value"], strict=True)])


def read_enrichment(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several CSV files with the union of their columns."""
    out = spark.read.csv(paths[0], header=True)
    for p in paths[1:]:
        out = out.unionByName(spark.read.csv(p, header=True), allowMissingColumns=True)
    return out


def mag_manifest(spark: SparkSession, path) -> DataFrame:
    """mag_name (the file's stem), contig_name, contig_length of a folder of FASTA files, one file a bin."""
    rows = spark.read.option("lineSep", ">").text(path).select(stem().alias("mag_name"), F.split("value", "\n", 2).alias("p"))
    rows = rows.select("mag_name", F.regexp_extract(F.col("p")[0], r"^(\S+)", 1).alias("contig_name"), F.length(F.regexp_replace(F.get("p", F.lit(1)), r"\s", "")).cast("long").alias("contig_length"))
    return rows.filter("contig_name <> '' and contig_length > 0")


def merge_sequences(contigs: DataFrame, fasta: DataFrame) -> DataFrame:
    """Annotated contigs with the sequences of an assembly; names known only there are added."""
    own = fasta.select("contig_name", "seq")
    return contigs.join(own, "contig_name", "full").withColumn("contig_length", F.coalesce("contig_length", F.length("seq").cast("long")))


def write_dataset(tables: dict[str, DataFrame], path: str) -> None:
    """All tables under one folder; those by sample get a partition each, and a sample written again replaces only its own."""
    for name, df in tables.items():
        if "sample_name" in df.columns:
            # dealt by what a row holds, so that a task run again deals its rows as before
            whole = [f.name for f in df.schema if "map" not in f.dataType.simpleString()]
            df.repartition("sample_name", F.pmod(F.xxhash64(*whole), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_name").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_sam(alignments: DataFrame, path: str) -> None:
    """Alignments as SAM text without headers, a folder for each sample."""
    pos = lambda c: (F.col(c) + 1).cast("string")
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "contig_name", pos("pos"), F.col("mapq").cast("string"), "cigar", F.coalesce("mate_contig", F.lit("*")), F.coalesce(pos("mate_pos"), F.lit("0")), F.coalesce(F.col("tlen").cast("string"), F.lit("0")), F.coalesce("seq", F.lit("*")), F.lit("*"),
                       F.concat(F.lit("MD:Z:"), "md"), F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))
    alignments.select("sample_name", line.alias("value")).write.partitionBy("sample_name").text(path)


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), "contig_name", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_runs_tsv(runs: DataFrame, path: str, digits: int = 4) -> None:
    """Runs as tab-separated lines under a header: [mag] contig sample feature position_start position_end value."""
    lead = ["mag_name"] if "mag_name" in runs.columns else []
    names = {"mag_name": "mag", "contig_name": "contig", "sample_name": "sample", "feature": "feature", "start": "position_start", "end": "position_end"}
    cols = [F.col(c).alias(n) for c, n in names.items() if c in [*lead, "contig_name", "sample_name", "feature", "start", "end"]]
    runs.select(*cols, F.format_string(f"%.{digits}f", F.col("value").cast("double")).alias("value")).write.csv(path, sep="\t", header=True)


def write_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.csv(path, sep="\t", header=True)


def metrics_wide(samples: DataFrame, views: dict[str, DataFrame]) -> DataFrame:
    """Every sample with the columns of each metric view, prefixed with its name; one left join for each view."""
    out = samples
    for name, view in views.items():
        out = out.join(view.withColumnsRenamed({c: f"{name}_{c}" for c in view.columns if c != "sample_name"}), "sample_name", "left")
    return out


def gff3_lines(annotations: DataFrame) -> DataFrame:
    """Annotations with a map of attributes as GFF3 lines; values are escaped, keys in order."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e.key, gff_escape(e.value))), ";")
    return annotations.select(F.concat_ws("\t", "contig_name", F.lit("."), "type", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.when(F.col("strand") == -1, "-").otherwise("+"), F.lit("."), pairs).alias("value"))


def write_gff3(annotations: DataFrame, path: str) -> None:
    gff3_lines(annotations).write.text(path)


def chunks_of_files(spark: SparkSession, path, size: int = 65_536) -> DataFrame:
    """FASTA sequences in pieces: contig_name, chunk_idx from 0, seq."""
    return read_fasta(spark, path).select("contig_name", F.posexplode(pieces(F.col("seq"), size)).alias("chunk_idx", "seq"))


def duplicate_names(contigs: DataFrame) -> DataFrame:
    """Names that several inputs use: name and n."""
    return contigs.groupBy("contig_name").agg(F.count("*").alias("n")).filter("n > 1")


def first_of(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
