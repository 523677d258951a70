"""Current belief, folds of the log, valid time, hydration of attributes."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import AttributeModeUnstated, PayloadVersion, ReplayCorrupt, ReplayNeedsArchive
from kairograph.functions.columns import instant, parsed, valid_at
from kairograph.types import BELIEF_KEY, CONCEPT_PAYLOAD, LINK_PAYLOAD, PAYLOAD_VERSION, Meta


class Mode(Enum):
    """Which attributes of a node are returned."""

    CURRENT = "current"
    AT_TIME = "at_time"
    OMIT = "omit"


class Reach(Enum):
    """Whether the log at hand can answer for an instant."""

    COVERS = "covers"
    PREDATES_RECORDED_HISTORY = "predates_recorded_history"
    NEEDS_ARCHIVE = "needs_archive"


def latest_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key; Spark keeps one row a key before the shuffle (WindowGroupLimit)."""
    own = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def latest_belief(links: DataFrame) -> DataFrame:
    """For each edge and start of validity the assertion that was recorded last.

    Most assertions are the only ones of their key, so they are dealt out by the
    edge's ends first: sorted before that, a task would hold a whole split of a
    file. The number of parts is given, so that none is merged with others.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return latest_by(links.repartition(parts, "source_id", "target_id"), list(BELIEF_KEY), F.desc("recorded_at"))


def as_of_edges(current: DataFrame, ts: str) -> DataFrame:
    """Edges that are valid at ``ts`` by current belief."""
    return current.where(valid_at(instant(ts))).select(*BELIEF_KEY, "valid_to")


def as_of_many(current: DataFrame, instants: DataFrame) -> DataFrame:
    """Edges valid at each of many instants (``ts``): an as-of join on buckets of time.

    Buckets of an interval are as wide as it is long, rounded up to a power of
    two of microseconds, so it touches two or three, whether it is closed or
    open; an instant goes to a bucket of each width, so the join is on equality.
    """
    start, end = F.unix_micros("valid_from"), F.unix_micros("valid_to")
    placed = current.where("valid_from < valid_to").withColumns({"_a": start, "_b": end}).withColumn("_level", F.ceil(F.log2(F.col("_b") - F.col("_a"))).cast("int"))
    placed = placed.withColumn("_k", F.explode(F.expr("sequence(shiftright(_a, _level), shiftright(_b - 1, _level))"))).drop("_a", "_b")
    asked = instants.select("ts").distinct().withColumn("_level", F.explode(F.expr("sequence(0, 62)")))
    asked = asked.withColumn("_k", F.expr("shiftright(unix_micros(ts), _level)"))
    return placed.join(asked, ["_level", "_k"]).where(valid_at(F.col("ts"))).select("ts", *BELIEF_KEY, "valid_to")


def newest_log_rows(log: DataFrame, ts: str | None = None, after_seq: int | None = None, table: str | None = None) -> DataFrame:
    """The log row with the largest seq_id of each entity among those recorded up to ``ts``."""
    rows = log
    if ts is not None:
        rows = rows.where(F.col("recorded_at") <= instant(ts))
    if after_seq is not None:
        rows = rows.where(F.col("seq_id") > after_seq)
    if table is not None:
        rows = rows.where(F.col("table_name") == table)
    return latest_by(rows, ["table_name", "entity_id"], F.desc("seq_id"))


def check_payloads(newest: DataFrame) -> None:
    """Raise for a winning row that can't be replayed; reads one offending row at most."""
    row = _unreadable(newest).orderBy("seq_id").first()
    if row is None:
        return
    if row["operation"] == "D":
        raise ReplayCorrupt(seq=row["seq_id"], reason="a deletion in an append-only log")
    raise PayloadVersion(got=row["v"], max=PAYLOAD_VERSION)


def _unreadable(rows: DataFrame) -> DataFrame:
    version = F.coalesce(F.get_json_object("payload", "$.v").cast("int"), F.lit(1))
    return rows.select("seq_id", "operation", version.alias("v")).where((F.col("operation") == "D") | (F.col("v") > PAYLOAD_VERSION))


def concept_rows(newest: DataFrame) -> DataFrame:
    """``id, title, content, embedding_model, retired`` of the log rows of concepts."""
    rows = newest.where("table_name = 'concepts'").withColumn("p", F.from_json("payload", CONCEPT_PAYLOAD))
    return rows.select(
        F.col("entity_id").alias("id"),
        F.coalesce("p.title", F.lit("")).alias("title"),
        F.coalesce("p.content", F.lit("")).alias("content"),
        F.col("p.embedding_model").alias("embedding_model"),
        F.coalesce("p.retired", F.get_json_object("payload", "$.retired").cast("int") == 1, F.lit(False)).alias("retired"),
    )


def link_rows(newest: DataFrame) -> DataFrame:
    """``source_id, target_id, edge_type, valid_from, valid_to`` of the log rows of links."""
    rows = newest.where("table_name = 'links'").withColumn("p", F.from_json("payload", LINK_PAYLOAD))
    return rows.select("p.source_id", "p.target_id", "p.edge_type", parsed("p.valid_from").alias("valid_from"), parsed("p.valid_to").alias("valid_to"))


def fold_log(log: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and edges as they were believed at ``ts``, from the first log row on.

    Retired concepts are left out; edges stay whether their interval is open or
    closed.
    """
    newest = newest_log_rows(log, ts)
    return concept_rows(newest).where("not retired").drop("retired"), link_rows(newest)


def compose(base: tuple[DataFrame, DataFrame], log: DataFrame, ts: str, anchor: int) -> tuple[DataFrame, DataFrame]:
    """A stored state brought forward by the log rows behind ``anchor``."""
    newest = newest_log_rows(log, ts, after_seq=anchor)
    concepts, edges = concept_rows(newest), link_rows(newest)
    kept = base[0].join(concepts.select("id"), "id", "left_anti").unionByName(concepts.where("not retired").drop("retired"))
    kept_edges = base[1].join(edges.select(*BELIEF_KEY), list(BELIEF_KEY), "left_anti").unionByName(edges)
    return kept, kept_edges


def log_bounds(log: DataFrame) -> DataFrame:
    """One row: number of log rows, first and last seq_id, first and last instant."""
    return log.agg(
        F.count(F.lit(1)).alias("n"), F.min("seq_id").alias("first_seq"), F.max("seq_id").alias("last_seq"),
        F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"),
    )


def is_intact(log: DataFrame) -> bool:
    """Nothing was ever moved out of the log."""
    b = log_bounds(log).first()
    return b["n"] == 0 or (b["first_seq"] == 1 and b["n"] == b["last_seq"])


def reach(log: DataFrame, ts: str, has_cold: bool) -> Reach:
    b = log_bounds(log).withColumns({"begun": F.col("first_at") <= instant(ts), "ended": F.col("last_at") <= instant(ts)}).first()
    if has_cold:
        return Reach.COVERS if b["ended"] else Reach.NEEDS_ARCHIVE
    if b["n"] == 0:
        return Reach.PREDATES_RECORDED_HISTORY
    if b["begun"]:
        return Reach.COVERS
    intact = b["first_seq"] == 1 and b["n"] == b["last_seq"]
    return Reach.PREDATES_RECORDED_HISTORY if intact else Reach.NEEDS_ARCHIVE


def archive_hint(log: DataFrame) -> str:
    b = log_bounds(log).first()
    if not b["n"]:
        return "the hot log is empty"
    return f"{b['last_seq'] - b['n']} log rows were archived; the hot log begins at seq_id {b['first_seq']}"


def reconstruct(log: DataFrame, ts: str, cold_log: DataFrame | None = None, base: tuple[DataFrame, DataFrame] | None = None, anchor: int = 0) -> tuple[DataFrame, DataFrame, Meta]:
    """State of belief at ``ts``: concepts, edges and what they were made from."""
    got = reach(log, ts, cold_log is not None)
    if got is Reach.NEEDS_ARCHIVE and cold_log is None:
        raise ReplayNeedsArchive(timestamp=ts, hint=archive_hint(log))
    rows = log.unionByName(cold_log) if got is Reach.NEEDS_ARCHIVE else log
    after = None if base is None else anchor
    if not _unreadable(rows).isEmpty():  # a scan; which rows win is only asked where one can't be read
        check_payloads(newest_log_rows(rows, ts, after_seq=after))
    concepts, edges = fold_log(rows, ts) if base is None else compose(base, rows, ts, anchor)
    return concepts, edges, Meta(ts, anchor, got is Reach.PREDATES_RECORDED_HISTORY)


def resolved_mode(as_of: str | None, mode: Mode | None) -> Mode:
    if mode is None and as_of is not None:
        raise AttributeModeUnstated(as_of=as_of)
    return mode or Mode.CURRENT


def hydrate(ids: DataFrame, mode: Mode, concepts: DataFrame | None = None, log: DataFrame | None = None, ts: str | None = None) -> DataFrame:
    """``id, title, content, embedding_model`` for ``ids`` (``id``), which come once each.

    Current attributes are those of live concepts; those of an instant come
    from the newest log row up to it and are left out where it retired the
    concept; OMIT returns no rows.
    """
    names = ["id", "title", "content", "embedding_model"]
    if mode is Mode.OMIT:
        return ids.select("id", *[F.lit(None).cast("string").alias(n) for n in names[1:]]).where(F.lit(False))
    if mode is Mode.CURRENT:
        return concepts.where("not retired").join(ids.select("id"), "id").select(*names)
    own = log.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return concept_rows(newest_log_rows(own, ts, table="concepts")).where("not retired").select(*names)


def concepts_of(log: DataFrame) -> DataFrame:
    """The live row of each concept, from the log."""
    rows = newest_log_rows(log, table="concepts").withColumn("p", F.from_json("payload", CONCEPT_PAYLOAD))
    return rows.select(
        F.col("entity_id").alias("id"), F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.content", F.lit("")).alias("content"),
        "p.embedding_model", parsed("p.valid_from").alias("valid_from"), parsed("p.valid_to").alias("valid_to"),
        F.coalesce("p.retired", F.lit(False)).alias("retired"), "recorded_at",
    )


def chain_difference(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``kind, key, side`` of concepts and edges in which two states differ."""
    out = None
    for kind, x, y in (("concept", a[0], b[0]), ("edge", a[1], b[1])):
        x, y = x.select(*sorted(x.columns)), y.select(*sorted(x.columns))
        for side, d in (("composed", x.subtract(y)), ("folded", y.subtract(x))):
            rows = d.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*d.columns)).alias("key"), F.lit(side).alias("side"))
            out = rows if out is None else out.unionByName(rows)
    return out
