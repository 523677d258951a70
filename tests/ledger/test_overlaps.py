"""Overlapping intervals against brute force, and on one edge that holds all rows."""

import collections
import datetime as dt
import random
import threading

from pyspark.sql import functions as F

from kairograph.operators import integrity
from kairograph.types import OPEN

START = dt.datetime(2026, 1, 1)


def frame(spark, rows):
    texts = spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, valid_from string, valid_to string")
    return texts.withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})


def test_overlaps_are_those_of_brute_force(spark):
    rng = random.Random(7)

    def some(n):
        out = []
        for _ in range(n):
            a = rng.randint(-200, 400)
            b = a + rng.choice([0, 1, 2, 5, 40, 300, -3])
            text = lambda x: (START + dt.timedelta(hours=x)).isoformat() + "Z"
            out.append((rng.choice("ab"), "t", "E", text(a), OPEN if rng.random() < 0.15 else text(b)))
        return list({r[:4]: r for r in out}.values())

    new, current = some(60), some(60)
    got = integrity.overlapping(frame(spark, new), frame(spark, current))
    assert got.columns == ["source_id", "target_id", "edge_type", "valid_from", "valid_to", "other_from", "other_to"]
    replaced = {r[:4] for r in new}
    want = collections.Counter()
    for x in new:
        for y in [r for r in current if r[:4] not in replaced] + new:
            both_open = x[4] == OPEN and y[4] == OPEN
            if x[:3] == y[:3] and x[3] != y[3] and not both_open and max(x[3], y[3]) < min(x[4], y[4]):
                want[x[0], x[3][:19], y[3][:19]] += 1
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    assert want and collections.Counter(map(tuple, got.select("source_id", stamp("valid_from"), stamp("other_from")).collect())) == want


def test_an_edge_with_all_rows_ends(spark):
    n = 200_000
    rows = spark.range(n).select(
        F.lit("a").alias("source_id"), F.lit("b").alias("target_id"), F.lit("E").alias("edge_type"),
        F.timestamp_seconds(F.col("id") * 60).alias("valid_from"), F.timestamp_seconds(F.col("id") * 60 + 61).alias("valid_to"),
    )
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert integrity.overlapping(rows, rows.where("false")).count() == 2 * (n - 1)
    finally:
        late.cancel()
