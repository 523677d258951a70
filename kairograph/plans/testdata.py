"""The test tables as ledger inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairograph.functions.columns import instant


class Data:
    """Views of one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def log(self) -> DataFrame:
        """Events as log rows of user concepts; an error retires the user."""
        e = self.table("events")
        name = F.concat(F.lit("u:"), F.col("user_id").cast("string"))
        own = Window.partitionBy("user_id").orderBy("event_id")
        payload = F.to_json(
            F.struct(
                F.lit(2).alias("v"), F.col("event_type").alias("title"), F.col("props").alias("content"), F.lit("1970-01-01T00:00:00.000000Z").alias("valid_from"),
                F.lit("9999-12-31T23:59:59.999999Z").alias("valid_to"), (F.col("event_type") == "error").alias("retired"), F.lit(None).cast("string").alias("embedding_model"),
            ),
            {"ignoreNullFields": "false"},
        )
        return e.select(
            (F.col("event_id") + 1).cast("long").alias("seq_id"), F.lit("concepts").alias("table_name"), name.alias("entity_id"),
            F.when(F.row_number().over(own) == 1, "I").otherwise("U").alias("operation"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("recorded_at"),
        )

    def intervals(self) -> DataFrame:
        """Each user's events of a type as edges that last until the next one."""
        own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("source_id"), F.concat(F.lit("e:"), F.col("event_type")).alias("target_id"),
            F.upper(F.regexp_replace("event_type", "[^A-Za-z0-9]", "")).alias("edge_type"), ts.alias("valid_from"),
            F.coalesce(F.lead(ts).over(own), instant(None)).alias("valid_to"), F.col("value").alias("weight"), F.lit("{}").alias("properties"), ts.alias("recorded_at"),
        )

    def assertions(self) -> DataFrame:
        """Line items as assertions that a supplier supplies a part; a later shipment supersedes, a return closes."""
        li = self.table("lineitem")
        stamp = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey"))
        return li.select(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"),
            F.lit("SUPPLIES").alias("edge_type"), F.lit("1995-01-01T00:00:00Z").cast("timestamp").alias("valid_from"),
            F.when(F.col("l_returnflag") == "R", F.lit("1998-01-01T00:00:00Z").cast("timestamp")).otherwise(instant(None)).alias("valid_to"),
            F.col("l_quantity").alias("weight"), F.lit("{}").alias("properties"), stamp.alias("recorded_at"),
        )

    def supply(self) -> DataFrame:
        """Supplier and part, once each pair, with the largest quantity."""
        li = self.table("lineitem")
        return li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id")).agg(
            F.max("l_quantity").alias("weight")
        ).select("source_id", "target_id", F.lit("SUPPLIES").alias("edge_type"), "weight", F.lit("1995-01-01T00:00:00Z").cast("timestamp").alias("valid_from"), instant(None).alias("valid_to"))

    def both_ways(self) -> DataFrame:
        s = self.supply()
        rest = ("weight", "valid_from", "valid_to")
        there = F.struct("source_id", "target_id", "edge_type", *rest)
        back = F.struct(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("SUPPLIEDBY").alias("edge_type"), *rest)
        return s.select(F.inline(F.array(there, back)))  # supply is grouped once

    def places(self) -> DataFrame:
        """Region, nation, customer and order as a forest; an order leads to its customer's next one."""
        n, c, o = self.table("nation"), self.table("customer"), self.table("orders")
        up = lambda df, a, x, b, y, kind, w: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target_id"), F.lit(kind).alias("edge_type"), w.cast("double").alias("weight"))
        rows = up(n, "r", "n_regionkey", "n", "n_nationkey", "HASNATION", F.lit(1.0))
        rows = rows.unionByName(up(c, "n", "c_nationkey", "c", "c_custkey", "HASCUSTOMER", F.lit(0.5)))
        rows = rows.unionByName(up(o, "c", "o_custkey", "o", "o_orderkey", "HASORDER", F.lit(0.25)))
        return rows.withColumns({"valid_from": F.lit("1995-01-01T00:00:00Z").cast("timestamp"), "valid_to": instant(None)})

    def trade_concepts(self) -> DataFrame:
        """Suppliers and parts as concepts; suppliers in debt and parts of size 13 are retired."""
        return self._concepts(self.table("supplier"), "s", "s_suppkey", "s_name", F.col("s_acctbal") < 0).unionByName(
            self._concepts(self.table("part"), "p", "p_partkey", "p_name", F.col("p_size") == 13)
        )

    def all_concepts(self) -> DataFrame:
        """Those of the trade, and customers; customers in debt are retired."""
        return self.trade_concepts().unionByName(self._concepts(self.table("customer"), "c", "c_custkey", "c_name", F.col("c_acctbal") < 0))

    @staticmethod
    def _concepts(df: DataFrame, a: str, key: str, title: str, gone: Column) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(key).cast("string")).alias("id"), F.col(title).alias("title"), F.lit("").alias("content"), F.lit(None).cast("string").alias("embedding_model"), F.lit("1995-01-01T00:00:00Z").cast("timestamp").alias("valid_from"), instant(None).alias("valid_to"), gone.alias("retired"), F.lit("1995-01-01T00:00:00Z").cast("timestamp").alias("recorded_at"))

    def documents(self) -> DataFrame:
        """Documents as concepts; those that are labelled toxic are retired."""
        toxic = self.table("labels").where("toxic = 1").select("doc_id").distinct().withColumn("retired", F.lit(True))
        d = self.table("documents").join(toxic, "doc_id", "left")
        return d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.coalesce("retired", F.lit(False)).alias("retired"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("concept_id"), "embedding")

    def vector(self, vec_id: int) -> list[float]:
        return list(self.table("embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])
