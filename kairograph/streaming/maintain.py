"""Derived tables that follow the log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.operators.temporal import concept_rows, latest_by
from kairograph.types import LOG


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log's files as a stream; ``recorded_at`` only grows, so nothing is late."""
    return spark.readStream.schema(LOG).parquet(path)


def follow_concepts(stream: DataFrame, path: str, checkpoint: str):
    """Write the newest concept row of each entity of every batch to ``path/batch=N``; :func:`newest` folds them."""

    def batch(rows: DataFrame, number: int) -> None:
        last = latest_by(rows.where("table_name = 'concepts'"), ["entity_id"], F.desc("seq_id"))
        concept = concept_rows(last)
        out = concept.join(last.select(F.col("entity_id").alias("id"), "seq_id"), "id")
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that runs again replaces its own files

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    rows = latest_by(spark.read.parquet(path), ["id"], F.desc("seq_id"))
    return rows.where("not retired").drop("batch", "seq_id", "retired")


def activity(stream: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Log rows by table and window of ``recorded_at``, each window once its time is over."""
    return (
        stream.withWatermark("recorded_at", lateness)
        .groupBy(F.window("recorded_at", width), "table_name")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("seq_id").alias("last_seq"))
    )
