"""What may be moved to the cold tier, and moving it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import ArchiveWindow
from kairograph.functions.columns import instant, is_open
from kairograph.functions.scalars import from_canonical, to_canonical
from kairograph.types import BELIEF_KEY

MOST_SESSIONS = 4096


def archivable_links(links: DataFrame, cutoff: str) -> DataFrame:
    """Assertions before ``cutoff`` that are superseded, or whose interval ended by then."""
    newest = Window.partitionBy(*BELIEF_KEY)
    marked = links.withColumn("_last", F.max("recorded_at").over(newest))
    old = F.col("recorded_at") < instant(cutoff)
    ended = ~is_open() & (F.col("valid_to") <= instant(cutoff))
    return marked.where(old & ((F.col("_last") > F.col("recorded_at")) | ended)).drop("_last")


def archivable_log(log: DataFrame, cutoff: str) -> DataFrame:
    """Log rows before ``cutoff`` behind which the entity has a newer one."""
    newest = Window.partitionBy("table_name", "entity_id")
    marked = log.withColumn("_last", F.max("seq_id").over(newest))
    return marked.where((F.col("recorded_at") < instant(cutoff)) & (F.col("_last") > F.col("seq_id"))).drop("_last")


def archivable_concepts(concepts: DataFrame, links: DataFrame, cutoff: str) -> DataFrame:
    """Retired concepts that were recorded and ended before ``cutoff`` and that no hot link names."""
    ends = links.select(F.col("source_id").alias("id")).union(links.select("target_id")).distinct()
    gone = F.col("retired") & (F.col("recorded_at") < instant(cutoff)) & (F.col("valid_to") < instant(cutoff))
    return concepts.where(gone).join(ends, "id", "left_anti")


def without(df: DataFrame, moved: DataFrame, key: list[str]) -> DataFrame:
    return df.join(moved.select(*key), key, "left_anti")


def boundaries(oldest: str, cutoff: str, window: dt.timedelta, most: int | None = MOST_SESSIONS) -> list[str]:
    """Cutoffs of archiving in sessions: oldest + window, + 2 windows, ..., the last is ``cutoff``; more than ``most`` are refused (None: never)."""
    if window <= dt.timedelta(0):
        raise ArchiveWindow(reason="it must be positive")
    begin, end = from_canonical(oldest), from_canonical(cutoff)
    count = max(1, -(-(end - begin) // window))
    if most is not None and count > most:
        raise ArchiveWindow(reason=f"{count} sessions, more than {most}")
    return [to_canonical(begin + k * window) for k in range(1, count)] + [cutoff]
