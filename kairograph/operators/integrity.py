"""Audit and rebuilding of what is derived, and checks before a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import (
    CurrentDrift,
    DuplicateAssertion,
    InvalidEdgeType,
    InvalidId,
    InvalidTimestamp,
    InvalidWeight,
    NotFound,
    OverlappingInterval,
    RecordedAtRegression,
    SingleOpenViolation,
)
from kairograph.functions.columns import edge_type_ok, formatted, id_ok, instant, is_open, overlaps, weight_ok
from kairograph.operators.temporal import latest_belief
from kairograph.types import BELIEF_KEY

LINK_COLUMNS = [*BELIEF_KEY, "valid_to", "weight", "properties", "recorded_at"]


def drift(current: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``drift``: rows in which stored current belief and the assertions' projection differ, both ways."""
    stored, told = current.select(*LINK_COLUMNS), latest_belief(links).select(*LINK_COLUMNS)
    return stored.subtract(told).unionByName(told.subtract(stored)).agg(F.count(F.lit(1)).alias("drift"))


def audit(current: DataFrame, links: DataFrame) -> None:
    if n := drift(current, links).first()["drift"]:
        raise CurrentDrift(n=n)


def overlapping(new: DataFrame, current: DataFrame) -> DataFrame:
    """Pairs of intervals of one edge that overlap though they begin apart: new against current, and new against new.

    Two open intervals are left to :func:`second_open`.
    """
    key = ["source_id", "target_id", "edge_type"]
    a = new.select(*key, "valid_from", "valid_to")
    rows = current.select(*key, F.col("valid_from").alias("other_from"), F.col("valid_to").alias("other_to"))
    replaced = a.select(*key, F.col("valid_from").alias("other_from"))
    kept = rows.join(replaced, [*key, "other_from"], "left_anti")
    own = a.select(*key, F.col("valid_from").alias("other_from"), F.col("valid_to").alias("other_to"))
    others = kept.unionByName(own)
    both_open = is_open("valid_to") & is_open("other_to")
    wanted = ~both_open & overlaps(F.col("valid_from"), F.col("valid_to"), F.col("other_from"), F.col("other_to"))
    # of two that overlap, the later one begins within the earlier one
    after = _begins_within(a, others, "valid", "other", key)
    before = _begins_within(others, a, "other", "valid", key)
    return after.unionByName(before).where(wanted).select(*key, "valid_from", "valid_to", "other_from", "other_to")


def _begins_within(earlier: DataFrame, later: DataFrame, x: str, y: str, key: list[str]) -> DataFrame:
    """Pairs in which ``later`` begins after ``earlier`` and near it: an equality join on buckets of time.

    Buckets are as wide as the interval, rounded up to a power of two of
    microseconds, so it touches two; a beginning goes to a bucket of each of
    the widths there are, at most 60.
    """
    start, end = F.unix_micros(f"{x}_from"), F.unix_micros(F.coalesce(F.col(f"{x}_to"), instant(None)))
    placed = earlier.withColumns({"_a": start, "_b": end}).where("_b > _a").withColumn("_level", F.ceil(F.log2(F.col("_b") - F.col("_a"))).cast("int"))
    levels = placed.select("_level").distinct()
    placed = placed.withColumn("_k", F.explode(F.expr("sequence(shiftright(_a, _level), shiftright(_b - 1, _level))"))).drop("_a", "_b")
    spots = later.crossJoin(F.broadcast(levels)).withColumn("_k", F.expr(f"shiftright(unix_micros({y}_from), _level)"))
    return placed.join(spots, [*key, "_level", "_k"]).where(F.col(f"{x}_from") < F.col(f"{y}_from")).drop("_level", "_k")


def second_open(new: DataFrame, current: DataFrame) -> DataFrame:
    """Edges that would have two open intervals.

    The side is a text, of which the maximum is found over sorted rows; hash
    tables of all edges took several times their memory.
    """
    key = ["source_id", "target_id", "edge_type"]
    replaced = current.join(new.select(*BELIEF_KEY), list(BELIEF_KEY), "left_anti")
    after = replaced.select(*BELIEF_KEY, "valid_to", F.lit("current").alias("side")).unionByName(new.select(*BELIEF_KEY, "valid_to", F.lit("new").alias("side")))
    sums = after.where(is_open()).groupBy(*key).agg(F.min("valid_from").alias("first"), F.max("valid_from").alias("last"), F.max("side").alias("side"))
    return sums.where("first < last and side = 'new'").select(*key)


def unknown_ends(new: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of edge ends that no concept has."""
    ends = new.select(F.col("source_id").alias("id")).union(new.select("target_id")).distinct()
    return ends.join(ids.select("id"), "id", "left_anti")


def check_edges(new: DataFrame, current: DataFrame, ids: DataFrame) -> None:
    """Raise the error of the first rule that a batch of assertions breaks; each check brings one row to the driver."""
    if row := new.where(~(id_ok("source_id") & id_ok("target_id"))).first():
        raise InvalidId(id=row["source_id"] if not row["source_id"] or "|" in row["source_id"] else row["target_id"])
    if row := new.where(~edge_type_ok() | F.col("edge_type").isNull()).first():
        raise InvalidEdgeType(edge_type=row["edge_type"])
    if row := new.where(F.col("valid_from").isNull() | F.col("valid_to").isNull()).first():
        raise InvalidTimestamp(value=f"{row['source_id']} -> {row['target_id']}", reason="a bound of the interval is missing or no timestamp")
    if row := new.where(~weight_ok()).first():
        raise InvalidWeight(weight=row["weight"])
    if row := unknown_ends(new, ids).first():
        raise NotFound(id=row["id"])
    named = ("source_id", "target_id", "edge_type")
    twice = new.groupBy(*BELIEF_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("valid_from", formatted("valid_from"))
    if row := twice.first():
        raise DuplicateAssertion(**{c: row[c] for c in BELIEF_KEY})
    if row := second_open(new, current).first():
        raise SingleOpenViolation(**{c: row[c] for c in named})
    if row := overlapping(new, current).withColumns({c: formatted(c) for c in ("valid_from", "other_from")}).first():
        raise OverlappingInterval(**{c: row[c] for c in (*BELIEF_KEY, "other_from")})


def check_concepts(new: DataFrame, current: DataFrame) -> None:
    """Each id once, valid, and recorded later than before (``recorded_at`` of ``new``)."""
    if row := new.where(~id_ok("id")).first():
        raise InvalidId(id=row["id"])
    if row := new.where(F.col("valid_from").isNull() | F.col("valid_to").isNull()).first():
        raise InvalidTimestamp(value=row["id"], reason="a bound of the interval is missing or no timestamp")
    own = Window.partitionBy("id").orderBy("recorded_at")
    both = current.select("id", "recorded_at").unionByName(new.select("id", "recorded_at"))
    late = both.withColumn("_had", F.lag("recorded_at").over(own)).where("_had >= recorded_at")
    if row := late.select("id", formatted("recorded_at").alias("got"), formatted("_had").alias("had")).first():
        raise RecordedAtRegression(**row.asDict())
