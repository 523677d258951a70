"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents.  A document's virtual finish
time is the running number of its source's words, itself included, divided by
the source's target; the mix takes documents in the order of finish times until
the budget is spent.  A queue is passed through ``epochs`` times at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import packed, stored, word_count

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """``source, source_rank, source_size, target`` and ``budget`` by source.

    ``sizes`` has ``source, source_size``, a row a source.  Sources in order of
    code points, null last, get the weights in turn.  The budget is ``share``
    of all words; targets stop at ``epochs`` times the source's size and what
    is over is shared again by weight.  The level at which this ends is found
    in closed form: in order of size by weight, the sources before the first
    one that the level doesn't fill are full.
    """
    all_rows = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("source_rank", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * float(epochs)).withColumn("reach", F.col("most") / F.col("weight"))
    before = all_rows.orderBy("reach", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    since = all_rows.orderBy("reach", "source_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(all_rows) * float(share)
    levels = ranked.withColumn("budget", budget).withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(since),
    )
    order = F.struct("reach", "source_rank")
    held = F.min_by(F.when(F.col("level") <= F.col("reach"), F.col("level")), F.when(F.col("level") <= F.col("reach"), order))
    return levels.withColumn("final", held.over(all_rows)).select(
        "source",
        "source_rank",
        F.col("source_size").cast("long").alias("source_size"),
        F.coalesce(F.least("most", F.col("weight") * F.col("final")), F.col("most")).alias("target"),
        "budget",
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2, seed: str = "mix", ranges: int = 16384) -> DataFrame:
    """A row for every row of ``docs`` and pass through its source's queue.

    Returns ``doc_id, source, text_key, size, source_size, target, copy`` (which
    of several equal rows), ``epoch``, ``finish`` and ``taken`` (boolean).

    Queues are in order of the MD5 of seed and doc_id.  Running sums are made
    in two steps, inside ranges of the order and over a table of range sums, so
    that neither a large source nor the whole mix is one task: 4,096 ranges of
    the queue a source, ``ranges`` of the finish time to a unit.  Ranges of
    finish times that end within the budget are taken, later ones aren't; only
    the range in which the budget ends is sorted row by row.

    Documents without words take no part and are returned with ``epoch`` 0 and
    ``taken`` false.  Equal rows are counted before the shuffle.  A null source
    is a source of its own; texts of any length are one row; an empty table
    gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text_key"),
        word_count(F.col("text")).alias("size"),
    )
    # The texts are read once; what follows works on this small table.
    groups = stored(rows.groupBy("source", "doc_id", "text_key", "size").agg(F.count(F.lit(1)).alias("n")), "mix")
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sizes, weights, share, epochs)
    placed = (
        groups.withColumnRenamed("source", "of")
        .join(targets, F.col("of").eqNullSafe(F.col("source")))
        .drop("of")
        .withColumn("mass", F.col("size") * F.col("n"))
        .withColumn("place", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
        .withColumn("part", F.substring("place", 1, 3))
    )
    queued = placed.where("size > 0")
    idle = placed.where("size = 0")

    ahead = Window.partitionBy("source_rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = queued.groupBy("source_rank", "part").agg(F.sum("mass").alias("part_mass"))
    parts = parts.select("source_rank", "part", F.coalesce(F.sum("part_mass").over(ahead), F.lit(0)).alias("part_start"))
    within = (
        Window.partitionBy("source_rank", "part")
        .orderBy("place", "doc_id", "text_key", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    copies = (
        queued.withColumn("before", F.coalesce(F.sum("mass").over(within), F.lit(0)))
        .join(parts, ["source_rank", "part"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
        .withColumn(
            "finish",
            (F.col("epoch") * F.col("source_size") + F.col("part_start") + F.col("before") + (F.col("copy") + 1) * F.col("size"))
            / F.col("target"),
        )
        .withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(8 * ranges)).cast("long"))
    )
    # at most 8 x ranges rows, whatever the input
    ends = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    by_range = copies.groupBy("range").agg(F.sum("size").alias("words"), F.max("budget").alias("limit"))
    by_range = by_range.withColumn("end", F.sum("words").over(ends)).withColumn("start", F.col("end") - F.col("words"))
    placed_copies = copies.join(F.broadcast(by_range.select("range", "start", "end")), "range")

    columns = ["doc_id", "source", "text_key", "size", "source_size", "target", "copy", "epoch", "finish"]
    clear = placed_copies.where("end <= budget or start >= budget").select(*columns, (F.col("end") <= F.col("budget")).alias("taken"))
    running = (
        Window.partitionBy("range")
        .orderBy("finish", "source_rank", "epoch", "place", "doc_id", "text_key", "copy")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    last = placed_copies.where("end > budget and start < budget").select(
        *columns, (F.col("start") + F.sum("size").over(running) <= F.col("budget")).alias("taken")
    )
    rest = idle.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "copy",
        F.lit(0).alias("epoch"), F.lit(None).cast("double").alias("finish"), F.lit(False).alias("taken"),
    )
    return clear.unionByName(last).unionByName(rest)


def mix_summary(mixed: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` (words) by row of the input."""
    return (
        mixed.groupBy("source", "doc_id", "text_key", "size", "copy", "source_size", "target")
        .agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(F.lit(0))).alias("taken"))
        .select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, in the order of finish times.

    Rows without words aren't taken; a null source is a source, the last one;
    repeated rows are taken each for itself; columns may have any names; an
    empty table gives none.
    """
    of = lambda *names: F.xxhash64(*names).alias("_at")
    taken = mix(docs, **how).where("taken").select(
        F.col("doc_id").alias("_of"), F.col("source").alias("_of_source"), F.col("text_key").alias("_of_key"),
        F.col("copy").alias("_copy"), F.col("finish").alias("_finish"), of("doc_id", "source", "text_key"),
    )
    keyed = packed(docs).withColumn("_source", F.col("_row.source").cast("string"))
    # One shuffle of the texts serves the numbers of equal rows and the join: both are by _at, what else must agree is a condition.
    keyed = keyed.select("*", of("_id", "_source", "_key")).repartition("_at")
    same = Window.partitionBy("_at", "_id", "_source", "_key").orderBy(F.lit(0))
    joined = keyed.withColumn("_nth", F.row_number().over(same) - 1).join(taken, "_at").where(
        F.coalesce(F.col("_id") - F.col("_of") == 0, F.col("_id").isNull() & F.col("_of").isNull())
        & F.coalesce(F.concat("_source", F.lit("")) == F.concat("_of_source", F.lit("")), F.col("_source").isNull() & F.col("_of_source").isNull())
        & (F.col("_key") - F.col("_of_key") == 0)
        & (F.col("_nth") - F.col("_copy") == 0)
    )
    return joined.repartitionByRange("_finish").sortWithinPartitions("_finish").select("_row.*")
