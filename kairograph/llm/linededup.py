"""Removal of repeated passages by overlapping three-line windows, with SQL functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """``id, key, pos, h1, h2``: two hashes of each run of ``size`` lines; rows that are equal give their windows once."""
    lines = F.split("text", "\n")
    at = F.col("pos")
    own = [F.get(F.col("lines"), at + i) for i in range(size)]
    long_enough = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), lines.alias("lines")
    ).where(F.size("lines") >= size)
    return long_enough.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("lines") - size))).select(
        "id", "key", "pos", F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(size), *own).alias("h2")
    )


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``id, key, spans``: runs of lines (first, last) of each document that earlier windows hold already.

    A window's first occurrence is the one of the smallest (doc_id, text hash,
    line), null ids first; all others are covered, and covered windows that
    overlap or touch are one span.
    """
    windows = _windows(docs, size)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = first.where("n > 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    here = F.struct("id", "key", "pos")
    # one row a hash on the right: a window with many copies only makes its own side long, which AQE splits
    later = windows.join(again, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(~here.eqNullSafe(F.col("first")))
    covered = later.select("id", "key", "pos").distinct()
    own = Window.partitionBy("id", "key").orderBy("pos")
    apart = F.col("pos") > F.lag("pos").over(own) + size
    runs = covered.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(own))
    spans = runs.groupBy("id", "key", "run").agg(F.min("pos").alias("a"), (F.max("pos") + (size - 1)).alias("b"))
    return spans.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_spans, text`` of every row, ``text`` without the repeated spans.

    Texts of fewer than ``size`` lines stay as they are; a null text has no
    lines and stays null.  Rows that repeat doc_id and text count as one
    document and are cut alike.  Texts of any number of lines are looked through
    whole; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_key"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left")
    lines = F.split("text", "\n")
    n = F.size(lines)
    # what lies before, between and behind the spans, by slices
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["b"] + 1))
    stops = F.concat(F.transform("spans", lambda s: s["a"]), F.array(n))
    gaps = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("_lines", g["a"] + 1, F.greatest(g["n"], F.lit(0)))))
    removed = F.aggregate("spans", F.lit(0), lambda t, s: t + (s["b"] - s["a"] + 1))
    return joined.withColumn("_lines", F.when(F.col("spans").isNotNull(), lines)).select(
        "doc_id",
        F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("spans").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
    )
