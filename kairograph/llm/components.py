"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import stored


def _forest(batches):
    """Of a partition's edges those that join two trees; what it keeps in memory is one number a node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for pdf in batches:
        kept = []
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((a, b))
        yield pd.DataFrame(np.array(kept, np.int64).reshape(-1, 2), columns=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node under the smallest of them (large: only the larger ones, small: the others and the node)."""
    if large:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = ways.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a, b`` long): root is the smallest node of its component.

    Each round's edges are written to the shared folder.  It ends when a round
    leaves the edges as they were, which then are the answer.
    """
    now = stored(edges.mapInPandas(_forest, "a bigint, b bigint"), "components")
    sign = None
    while True:
        now = stored(_star(_star(now, True), False), "components")
        last, sign = sign, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == last:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a"), F.col("a")).distinct())
