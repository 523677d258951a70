"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, as a table for bytes.translate.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Stands for a null doc_id where an order or a join key is needed.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder is taken, but only under a local
    master, where every task runs on this machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="kairograph-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


_written: list[str] = []
_tables: list[str] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage and survives the loss of an executor.  The files stay
    until :func:`release`, as results are read from them later.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _written.append(at)
    return spark.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, key: str, buckets: int, what: str) -> DataFrame:
    """Like :func:`stored`, bucketed by ``key``: a cogroup on it reads the table where it lies, without a shuffle."""
    spark = df.sparkSession
    name = f"{what}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", at).format("parquet").saveAsTable(name)
    _tables.append(name)
    _written.append(at)
    return spark.table(name)


def written() -> tuple[int, int]:
    """How much :func:`stored` and :func:`bucketed` have written so far, for :func:`release`."""
    return len(_written), len(_tables)


def release(spark: SparkSession, since: tuple[int, int] = (0, 0), keep: int = 0) -> None:
    """Delete what was written after ``since``, but for the last ``keep``; call it when the results have been written elsewhere."""
    files, tables = _written[since[0] : len(_written) - keep], _tables[since[1] :]
    del _written[since[0] : len(_written) - keep], _tables[since[1] :]
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for at in files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


def text_key() -> Column:
    """64-bit hash of the text, which tells rows apart that share a doc_id."""
    return F.xxhash64(F.col("text"))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.length(flat) > 0, F.size(F.split(flat, " +"))).otherwise(0).cast("long")


def packed(docs: DataFrame) -> DataFrame:
    """The rows in one column ``_row``, whatever their columns are called, with ``_id`` and ``_key``."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_key"),
    )
