"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and all tasks run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="kairograph-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage of an iteration ends here."""
    at = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bucketed(df: DataFrame, key: str, what: str) -> DataFrame:
    """Like :func:`cut`, in as many buckets of ``key`` as a shuffle has partitions: joins on it read the rows where they lie."""
    spark = df.sparkSession
    name, n = f"{what}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)
