"""Changes to a dataset of Parquet tables, each as a new DataFrame; the caller writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signals import PAIR


def add_metadata(table: DataFrame, rows: DataFrame, key: str, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table with the columns of rows, and the keys of rows that it does not have. Columns there already need force."""
    new = [c for c in rows.columns if c != key]
    clash = [c for c in new if c in table.columns]
    if clash and not force:
        raise ValueError(f"columns exist already: {', '.join(clash)}")
    own = rows.dropDuplicates([key])
    return table.drop(*clash).join(own, key, "left"), own.join(table, key, "left_anti").select(key)


def list_metadata(table: DataFrame, built_in: list[str]) -> list[str]:
    """The columns that users added; from the schema, without a scan."""
    return [c for c in table.columns if c not in built_in]


def drop_metadata(table: DataFrame, column: str, built_in: list[str]) -> DataFrame:
    if column in built_in or column not in table.columns:
        raise ValueError(f"{column} is built in or unknown")
    return table.drop(column)


def check_feature(rows: DataFrame, contigs: DataFrame, samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each row of a custom feature with problem: null, or the first of the rules that it breaks.

    Rows: contig_name, sample_name (null for all), first_position, last_position, value.
    """
    known = rows.join(contigs.select("contig_name", "contig_length"), "contig_name", "left")
    known = known.join(samples.select("sample_name", F.lit(True).alias("__s")).distinct(), "sample_name", "left").join(pairs.select(*PAIR, F.lit(True).alias("__p")).distinct(), PAIR, "left")
    order = Window.partitionBy("contig_name", "sample_name").orderBy("first_position", "last_position")
    reach = F.max("last_position").over(order.rowsBetween(Window.unboundedPreceding, -1))
    named = F.col("sample_name").isNotNull()
    bounds = (F.col("first_position") < 0) | (F.col("first_position") > F.col("last_position")) | (F.col("last_position") > F.col("contig_length"))
    problem = (
        F.when(F.col("contig_length").isNull(), "unknown contig").when(named & F.col("__s").isNull(), "unknown sample").when(bounds, "outside the contig")
        .when(named & F.col("__p").isNull(), "pair not present").when(F.col("first_position") <= reach, "overlaps")
    )
    return known.withColumn("problem", problem).drop("__s", "__p", "contig_length")


def remove(tables: dict[str, DataFrame], column: str, name: str) -> dict[str, DataFrame]:
    """All tables without the rows of one sample, contig or bin (column says which)."""
    return {n: df.filter(~F.col(column).eqNullSafe(F.lit(name))) if column in df.columns else df for n, df in tables.items()}


#: What rows of a table hang on: its column, the owner and the owner's column. Tables that are not listed hang on the contig,
#: sample and bin that their columns name.
OWNERS = {
    "contigs": [], "samples": [], "bins": [], "qualifiers": [("annotation_id", "annotations", "annotation_id")],
    "hits": [("contig_1", "contigs", "contig_name"), ("contig_2", "contigs", "contig_name")], "termini": [("packaging_id", "packaging", "packaging_id")],
}
BY_NAME = (("contig_name", "contigs"), ("sample_name", "samples"), ("mag_name", "bins"))


def owners(table: str, columns: list[str]) -> list[tuple[str, str, str]]:
    return OWNERS.get(table, [(c, owner, c) for c, owner in BY_NAME if c in columns])


def in_order(tables: dict[str, DataFrame]) -> list[str]:
    """Names of tables, each after those that its rows hang on."""
    done: list[str] = []
    while len(done) < len(tables):
        ready = [n for n in tables if n not in done and all(o in done or o not in tables for _, o, _ in owners(n, tables[n].columns))]
        if not ready:
            raise ValueError("tables hang on each other in a circle")
        done += ready
    return done


def cascade(tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All tables without the rows that hang on what goes, directly or through other rows, and the rows removed of each table that
    loses any. gone: by owner (contigs, samples, bins), a table of the names that go. A table is read once for each owner."""
    kept, removed = {}, {}
    roots = {"contigs": "contig_name", "samples": "sample_name", "bins": "mag_name"}
    for name in in_order(tables):
        df, lost = tables[name], None
        if name in roots and name in gone:
            ways = [(roots[name], gone[name].select(roots[name]))]
        else:
            ways = [(c, (removed[o] if o in removed else gone[o]).select(F.col(k).alias(c))) for c, o, k in owners(name, df.columns) if o in removed or o in gone]
        for column, keys in ways:
            keys = keys.distinct()
            out = df.join(keys, column, "left_semi")
            lost = out if lost is None else lost.unionByName(out)
            df = df.join(keys, column, "left_anti")
        kept[name] = df.select(*tables[name].columns)
        if lost is not None:
            removed[name] = lost.select(*tables[name].columns)
    return kept, removed


def recounted(kept: dict[str, DataFrame], removed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """kept with mapped reads of samples, and sample counts of contigs and bins, made anew where read_counts lost rows."""
    if "read_counts" not in removed:
        return kept
    out, lost, left = dict(kept), removed["read_counts"], kept["read_counts"]

    def anew(table: str, key: str, touched: DataFrame, values: DataFrame, column: str) -> DataFrame:
        own = touched.select(key).distinct().join(values, key, "left").select(key, F.coalesce("__v", F.lit(0)).cast("long").alias("__v"), F.lit(True).alias("__t"))
        rows = kept[table].join(own, key, "left").withColumn(column, F.when(F.col("__t"), F.col("__v")).otherwise(F.col(column)))
        return rows.select(*kept[table].columns)

    if "samples" in kept:
        out["samples"] = anew("samples", "sample_name", lost, left.groupBy("sample_name").agg(F.sum("read_count").alias("__v")), "n_mapped")
    counted = lambda rows, key: rows.filter("read_count > 0").groupBy(key).agg(F.count_distinct("sample_name").alias("__v"))
    if "contig_counts" in kept:
        out["contig_counts"] = anew("contig_counts", "contig_name", lost, counted(left, "contig_name"), "n_samples")
    if "bin_counts" in kept:
        members = kept["members"].select("mag_name", "contig_name")
        out["bin_counts"] = anew("bin_counts", "mag_name", lost.join(members, "contig_name"), counted(left.join(members, "contig_name"), "mag_name"), "n_samples")
    return out


def removal_problems(tables: dict[str, DataFrame], contigs: DataFrame) -> DataFrame:
    """Contigs that can't be removed by themselves: unknown ones and, in a dataset of bins, all."""
    known = tables["contigs"].select("contig_name", F.lit(True).alias("__k")).distinct()
    rows = contigs.select("contig_name").join(known, "contig_name", "left")
    says = F.when(F.col("__k").isNull(), "unknown contig")
    return rows.select("contig_name", says.when(F.lit("bins" in tables), "in bin mode").alias("problem")).filter("problem is not null")


def remove_contigs(tables: dict[str, DataFrame], contigs: DataFrame) -> dict[str, DataFrame]:
    """All tables without some contigs, recounted; refused in a dataset of bins and for unknown names."""
    if found := removal_problems(tables, contigs).limit(3).collect():
        raise ValueError("; ".join(f"{r.problem}: {r.contig_name}" for r in found))
    return recounted(*cascade(tables, {"contigs": contigs}))


def remove_samples(tables: dict[str, DataFrame], samples: DataFrame) -> dict[str, DataFrame]:
    return recounted(*cascade(tables, {"samples": samples}))


def remove_bins(tables: dict[str, DataFrame], bins: DataFrame) -> dict[str, DataFrame]:
    """All tables without some bins and their contigs, recounted."""
    if "bins" not in tables:
        raise ValueError("not a dataset of bins")
    contigs = tables["members"].join(bins.select("mag_name"), "mag_name", "left_semi").select("contig_name")
    return recounted(*cascade(tables, {"bins": bins, "contigs": contigs}))


def purge_mapping(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only the tables on genomes: those that have no sample."""
    return {n: df for n, df in tables.items() if "sample_name" not in df.columns}


def names(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """All names in a column of any table, in order."""
    out = None
    for df in tables.values():
        if column in df.columns:
            own = df.select(column).filter(F.col(column).isNotNull())
            out = own if out is None else out.unionByName(own)
    return out.distinct().orderBy(column)


def drop_unused(variables: DataFrame, values: DataFrame) -> DataFrame:
    """Variables that have values."""
    return variables.join(values, "variable", "left_semi")


def drop_empty(tables: dict[str, DataFrame], metrics: list[str]) -> dict[str, DataFrame]:
    """All tables but those of metrics that have no row."""
    return {n: df for n, df in tables.items() if n not in metrics or not df.isEmpty()}


def mag_burden(counts: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """By bin and sample: counts of its contigs per 100,000 bases of the whole bin."""
    size = members.groupBy("mag_name").agg(F.sum("contig_length").alias("size"))
    sums = counts.join(members.select("mag_name", "contig_name"), "contig_name").groupBy("mag_name", "sample_name").agg(*[F.sum(c).alias(c) for c in columns])
    return sums.join(size, "mag_name").select("mag_name", "sample_name", *[(F.col(c) * 100_000.0 / F.col("size")).alias(f"{c}_per_100kbp") for c in columns])


def mag_rpkm_tpm(rpkm: DataFrame, members: DataFrame) -> DataFrame:
    """By bin and sample: the sum of its contigs' RPKM, and its share of all bins of the sample times a million."""
    sums = rpkm.join(members.select("mag_name", "contig_name"), "contig_name").groupBy("mag_name", "sample_name").agg(F.sum("rpkm").alias("rpkm"))
    total = F.sum("rpkm").over(Window.partitionBy("sample_name"))
    return sums.withColumn("tpm", F.when(total > 0, F.col("rpkm") / total * 1e6).otherwise(0.0))
