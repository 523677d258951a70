"""Second open intervals against brute force, and the memory that one task takes for them."""

import datetime as dt
import random
import uuid
from collections import defaultdict

from pyspark.sql import functions as F

from kairograph.functions.columns import instant
from kairograph.operators import integrity, temporal
from kairograph.types import OPEN

SCHEMA = "source_id string, target_id string, edge_type string, valid_from string, valid_to string"
START = dt.datetime(2026, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})


def test_second_opens_are_those_of_brute_force(spark):
    rng = random.Random(3)
    text = lambda day: (START + dt.timedelta(days=day)).isoformat() + "Z"

    def some(n):
        out = {}
        for _ in range(n):
            row = (rng.choice(["a", "b", "c", None]), rng.choice(["s", "t", "u", None]), rng.choice("EF"), rng.choice([None, *map(text, range(4))]), rng.choice([OPEN, OPEN, text(9), None]))
            out[row[:4]] = row
        return list(out.values())

    seen = 0
    for _ in range(3):
        new, current = some(20), some(60)
        replaced = {r[:4] for r in new if None not in r[:4]}
        starts, fresh = defaultdict(set), set()
        for r, is_new in [*((r, False) for r in current if r[:4] not in replaced), *((r, True) for r in new)]:
            if r[4] == OPEN:
                starts[r[:3]] |= {r[3]} - {None}
                fresh |= {r[:3]} if is_new else set()
        want = {k for k in fresh if len(starts[k]) > 1}
        got = [tuple(r) for r in integrity.second_open(frame(spark, new), frame(spark, current)).collect()]
        assert len(got) == len(want) and set(got) == want
        seen += len(want)
    assert seen


def peak_mb(spark, df):
    """Most memory that a task of ``df`` took, by Spark's own figure."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, most = context.statusTracker(), context._jsc.sc().statusStore(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            if (info := tracker.getStageInfo(stage)) and info.numCompletedTasks:
                tasks = store.taskList(stage, 0, 1000)
                most = max([most, *(tasks.apply(k).taskMetrics().get().peakExecutionMemory() for k in range(tasks.size()))])
    return most / 1e6


def test_a_task_holds_neither_a_split_nor_tables_of_edges(spark):
    n, parts = 2_000_000, spark.conf.get("spark.sql.shuffle.partitions")
    links = spark.range(0, n, 1, 1).select(  # one split
        F.concat(F.lit("s"), F.col("id") % 1000).alias("source_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("target_id"), F.lit("E").alias("edge_type"),
        F.lit("1995-01-01T00:00:00Z").cast("timestamp").alias("valid_from"), instant(None).alias("valid_to"),
        (F.col("id") % 50).cast("double").alias("weight"), F.timestamp_seconds("id").alias("recorded_at"),
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        current = temporal.latest_belief(links)
        new = current.where("weight > 47").withColumn("valid_from", instant("1996-01-01T00:00:00Z"))
        found = integrity.second_open(new, current)
        assert found.count() == n // 25
        assert 0 < peak_mb(spark, found) < 160
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
