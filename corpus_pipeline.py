"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the rows it keeps.

All stages take rows with null, empty and very long texts, null ids and sources,
repeated rows, empty tables and columns of any name; what they do with them is
stated for each.  ``docs`` is what was read from the files of the stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairograph.llm import decontam, mixing, sharding, simhash, toxicity
from kairograph.llm.common import release, stored, table, written
from kairograph.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go.

    Null and empty texts stay, as nothing is found in them; repeated rows stay
    or go together; without labels the lexicon decides.
    """
    ship(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id.

    Rows without words are copies of one another; of repeated rows one stays; a
    null doc_id is larger than all others.
    """
    ship(spark)
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat benchmark items go; null and empty texts stay; an empty benchmark lets all stay."""
    ship(spark)
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, in its order.

    Rows without words aren't taken; a null source is a source of its own.
    """
    ship(spark)
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix, whole, with its shard and its slot there, which keeps the mix's order; a null doc_id counts as 0."""
    ship(spark)
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: The toxicity stage trains a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again, and what it needed is deleted."""
    docs, since = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        release(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
