"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
JUMP_MULTIPLIER = 2862933555777941757
JUMP_SCALE = float(1 << 31)

#: Modulus and factor of the rule that deals the rows of a shard into buckets.
MIX_MODULUS = 2147483647
MIX_FACTOR = 48271


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys step at once."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    mul = np.uint64(JUMP_MULTIPLIER)
    while len(going):
        step = key[going] * mul + np.uint64(1)
        key[going] = step
        ahead = ((shard[going] + 1) * (JUMP_SCALE / ((step >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        inside = ahead < shards
        going = going[inside]
        shard[going] = ahead[inside]
    return shard.astype(np.int32)


def _jump(shards: int):
    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards))

    return shard_of


def with_shard(docs: DataFrame, shards: int, column: str = "shard") -> DataFrame:
    """Add the shard of each row's ``doc_id`` (null counts as key 0)."""
    return docs.withColumn(column, _jump(shards)(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))


def assign_slots(docs: DataFrame, shards: int = 16, buckets: int = 1024) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    The law is ``key``: ``doc_id`` and the number of shards alone decide, so
    one more shard takes rows only into itself (``grown_shard``).  ``slot``
    numbers the rows of a shard from 0 without gaps.  Each shard is cut into
    ``buckets`` by a rule on (doc_id, size); rows are numbered inside buckets,
    whose starts come from a table of shards x buckets sums, which is the only
    thing broadcast.  Equal rows (doc_id, size, checksum) are counted before
    the shuffle and spread again after it, so a run of repeated rows isn't
    dealt to one task.

    Null text: size 1, checksum 0.  Null doc_id: the shard of key 0.  Empty
    input: empty result.  Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    spot = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(MIX_MODULUS)) * MIX_FACTOR + F.col("size")
    grouped = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    dealt = (
        with_shard(with_shard(grouped, shards), shards + 1, "grown_shard")
        .withColumn("bucket", (F.pmod(spot, F.lit(MIX_MODULUS)) % buckets).cast("int"))
    )
    sums = dealt.groupBy("shard", "bucket").agg(F.sum("n").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", "bucket", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"))
    before = (
        Window.partitionBy("shard", "bucket")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = dealt.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (
        numbered.join(F.broadcast(starts), ["shard", "bucket"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("ahead") + F.col("copy")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


#: Columns that :func:`shard_rows` adds.
SHARD_COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row with its columns and :data:`SHARD_COLUMNS`, where ``slot`` goes by the order in which the rows are stored.

    ``docs`` is read from files; the order is that of the files' names, and of
    the rows in each.  Rows are numbered by shard and file, and the numbers at
    which a file's rows begin come from a table of counts.  Null text: size 1,
    checksum 0; null doc_id: the shard of key 0; repeated rows get a slot each;
    a column of ``docs`` with an added column's name is replaced; an empty table
    gives an empty result.
    """
    kept = [c for c in docs.columns if c not in SHARD_COLUMNS]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"),
    )
    dealt = with_shard(with_shard(rows, shards), shards + 1, "grown_shard")
    ahead = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = with_shard(docs.select("doc_id", F.col("_metadata.file_path").alias("_file")), shards).groupBy("shard", "_file").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("shard", "_file", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_file").orderBy("_at")
    return dealt.withColumn("_nth", F.row_number().over(within)).join(starts, ["shard", "_file"]).select(
        "_row.*", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the rows into ``path/shard=N`` folders, each by several tasks."""
    with_shard(docs, shards).write.partitionBy("shard").parquet(path)
