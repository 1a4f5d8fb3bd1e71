"""Removal of passages that repeat: overlapping windows of three lines.

Three consecutive lines are a window; a document of one or two lines is a window by itself, which equals only such a
document. Where a window occurs again, in the same or another document, all occurrences but the first are covered, and
every line that some covered window holds is removed. First means smallest doc_id, then row, then position. Windows are
compared by two 64-bit hashes; only hashes and positions are shuffled until the texts meet the lines that they lose.

Edge cases: a null text stays null and an empty one empty; windows of blank lines alone don't count; lines are compared
without the spaces around them and returned with them; repeated rows are rows of their own, the later ones lose what
repeats; a null doc_id sorts first; other columns are kept as they are (one named `n_lines` or `n_removed` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, numbered, splittable_join, staged

GONE = "__gone"


def _lines() -> Column:
    return F.split(F.col("doc.text"), "\n", -1)


def windows_of(rows: DataFrame) -> DataFrame:
    """The windows of each numbered row: __row, doc_id, pos, h1, h2."""
    trimmed = rows.select(ROW, F.col("doc.doc_id").alias("doc_id"), F.transform(_lines(), lambda x: F.trim(x)).alias("l")).filter(F.size("l") > 0)
    at = lambda i: (F.get("l", i), F.get("l", i + 1), F.get("l", i + 2))  # noqa: E731  (null beyond the end)
    blank = lambda line: F.coalesce(line, F.lit("")) == ""
    window = lambda i: F.struct(
        i.cast("int").alias("pos"),
        F.xxhash64(*at(i), F.least(F.size("l"), F.lit(3))).alias("h1"),
        F.xxhash64(at(i)[2], F.lit("\n"), *at(i)[:2], F.least(F.size("l"), F.lit(3))).alias("h2"),
        (blank(at(i)[0]) & blank(at(i)[1]) & blank(at(i)[2])).alias("blank"),
    )
    last = F.greatest(F.size("l") - 3, F.lit(0))
    each = trimmed.select(ROW, "doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), window)).alias("w"))
    return each.filter("not w.blank").select(ROW, "doc_id", "w.pos", "w.h1", "w.h2")


def covered_lines(rows: DataFrame) -> DataFrame:
    """__row and __gone, the positions covered (some may lie beyond a short text), for the rows that have any."""
    windows = staged(windows_of(rows), "windows")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), ROW, "pos")).alias("first"))
    again = first.filter("n > 1").select("h1", "h2", F.col(f"first.{ROW}").alias("first_row"), F.col("first.pos").alias("first_pos"))
    later = splittable_join(windows, again, "h1", "h2").filter(~((F.col(ROW) == F.col("first_row")) & (F.col("pos") == F.col("first_pos"))))
    return later.groupBy(ROW).agg(F.collect_set("pos").alias("starts")).select(
        ROW, F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(p, p + 1, p + 2)))).alias(GONE)
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cleaned, and n_lines and n_removed."""
    rows = numbered(docs.drop("n_lines", "n_removed"), "texts")
    gone = staged(covered_lines(rows), "covered")
    # the lines are cut before the join: above it they are a column, so picking one by its number takes no new cut
    # (merged at any size, so that plans for small and for large tables are the same)
    joined = rows.withColumn("lines", _lines()).join(gone.hint("merge"), ROW, "left")
    all_lines = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.array_except(all_lines, GONE)
    kept = F.transform(left, lambda i: F.get(F.col("lines"), i))
    text = F.when(F.col(GONE).isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    size = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    removed = F.when(F.col(GONE).isNull(), 0).otherwise(F.size("lines") - F.size(left))
    columns = [text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, size.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
