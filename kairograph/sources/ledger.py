"""The ledger on a folder of Parquet files.

Files are never changed.  A commit writes new files and then one JSON row that
lists the files of every table; readers see the tables of the newest row.  Concepts
are derived from the log; current belief and the keyword index can be stored
and are always made anew from the assertions and the log.  One writer at a time
is assumed; a second one fails on the number of its commit.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph import types as T
from kairograph.errors import DimMismatch, ModelNotRegistered, NotFound, SchemaVersion, SnapshotIncompatible
from kairograph.functions.columns import formatted, instant, parsed, reading
from kairograph.functions.scalars import Clock, check_id, check_model, to_canonical
from kairograph.operators import archive as arch
from kairograph.operators import graph, integrity, retrieval, temporal
from kairograph.operators.numbering import numbered

TABLES = {
    "links": T.LINK, "log": T.LOG, "embeddings": T.EMBEDDING, "annotations": T.ANNOTATION,
    "links_current": T.LINK, "postings": "term string, id string, length int, tf bigint",
    "cold_links": T.LINK, "cold_log": T.LOG, "cold_concepts": T.CONCEPT,
}


class Ledger:
    """A bitemporal graph under ``root``."""

    def __init__(self, spark: SparkSession, root: str, clock: Clock | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.clock = clock or Clock()
        #: By kind of commit: how many there were, and seconds in total and of the longest.
        self.metrics: dict[str, list[float]] = {}
        self._state = self._newest()
        if self._state["schema_version"] != T.SCHEMA_VERSION:
            raise SchemaVersion(got=self._state["schema_version"], expected=T.SCHEMA_VERSION)
        if floor := self._last_stamp():
            self.clock.raise_floor(floor)

    # commits

    def _newest(self) -> dict:
        path = self._path("commits")
        if not self._fs(path).exists(path):
            return {"n": 0, "schema_version": T.SCHEMA_VERSION, "models": {}, "snapshots": [], "current_of": 0, "postings_at": 0, "files": {t: [] for t in TABLES}}
        newest = max(f.getPath().getName() for f in self._fs(path).listStatus(path))
        return json.loads(self.spark.read.text(f"{self.root}/commits/{newest}").first()["value"])

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, name: str) -> None:
        path = self._path(name)
        self._fs(path).delete(path, True)

    def _publish(self, state: dict) -> None:
        """The commit's one file, which must not be there yet."""
        path = self._path(f"commits/{state['n']:09d}.json")
        out = self._fs(path).create(path, False)
        try:
            out.writeBytes(json.dumps(state) + "\n")
        finally:
            out.close()

    def _commit(self, appended: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None, **changes) -> None:
        begun, kind = time.monotonic(), "+".join(sorted([*(appended or {}), *(replaced or {}), *changes]))
        state = json.loads(json.dumps(self._state)) | changes
        state["n"] += 1
        written: list[str] = []
        for table, df, fresh in [*((t, d, False) for t, d in (appended or {}).items()), *((t, d, True) for t, d in (replaced or {}).items())]:
            name = f"{table}/{state['n']:09d}-{uuid.uuid4().hex[:8]}"
            written.append(name)
            df.select(*self._fields(table)).write.parquet(f"{self.root}/{name}")
            state["files"][table] = [name] if fresh else [*state["files"][table], name]
        try:
            self._publish(state)
        except Exception:
            for name in written:
                self._delete(name)
            raise
        self._state = state
        n, total, longest = self.metrics.get(kind, [0, 0.0, 0.0])
        took = time.monotonic() - begun
        self.metrics[kind] = [n + 1, total + took, max(longest, took)]

    def _fields(self, table: str) -> list[str]:
        return [part.strip().split()[0] for part in TABLES[table].split(",")]

    def table(self, name: str) -> DataFrame:
        """A stored table as of the newest commit of this handle."""
        files = self._state["files"][name]
        reader = self.spark.read.schema(TABLES[name])
        return reader.parquet(*[f"{self.root}/{f}" for f in files]) if files else self.spark.createDataFrame([], TABLES[name])

    def refresh(self) -> None:
        self._state = self._newest()

    @property
    def version(self) -> int:
        return self._state["n"]

    def _last_stamp(self) -> str | None:
        last = self.table("log").agg(reading(F.max("recorded_at")).alias("t")).first()
        return last["t"]

    def close(self) -> None:
        """Leave a snapshot of the newest state behind, if anything is logged."""
        if (last := self._last_stamp()) is not None:
            self.save_snapshot(last)

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # reading

    def links(self) -> DataFrame:
        return self.table("links")

    def log(self) -> DataFrame:
        return self.table("log")

    def current(self) -> DataFrame:
        """Current belief: the stored projection, if there is one, with the assertions that came since."""
        done = self._state["current_of"]
        if not done:
            return temporal.latest_belief(self.links())
        fresh = self._state["files"]["links"][done:]
        stored = self.table("links_current")
        if not fresh:
            return stored
        return temporal.latest_belief(stored.unionByName(self.spark.read.schema(T.LINK).parquet(*[f"{self.root}/{f}" for f in fresh])))

    def rebuild_current(self) -> None:
        """Store current belief anew from the assertions, in the order of sources so that scans of few sources skip files."""
        told = temporal.latest_belief(self.links())
        ordered = told.repartitionByRange("source_id").sortWithinPartitions("source_id", "target_id")
        self._commit(replaced={"links_current": ordered}, current_of=len(self._state["files"]["links"]))

    def rebuild_index(self) -> None:
        """Store the keyword index of the concepts as they are."""
        self._commit(replaced={"postings": retrieval.postings(self.concepts())}, postings_at=self._state["n"] + 1, postings_of=self._texts())

    def index(self) -> DataFrame | None:
        """The stored keyword index while no commit of log rows or archived concepts came after it."""
        fresh = self._state["postings_at"] and self._state.get("postings_of") == self._texts()
        return self.table("postings") if fresh else None

    def _texts(self) -> list[str]:
        return [*self._state["files"]["log"], *self._state["files"]["cold_concepts"]]

    def concepts(self) -> DataFrame:
        """Live row of each concept that isn't archived."""
        cold = self.table("cold_concepts").select("id", F.col("recorded_at").alias("_c"))
        rows = temporal.concepts_of(self.log())
        return rows.join(cold, (rows["id"] == cold["id"]) & (rows["recorded_at"] <= cold["_c"]), "left_anti")

    def embeddings(self, model: str) -> DataFrame:
        if model not in self._state["models"]:
            raise ModelNotRegistered(model=model)
        rows = self.table("embeddings").where(F.col("model") == model)
        return rows.select("concept_id", "embedding")

    def annotations(self) -> DataFrame:
        return self.table("annotations")

    def sql(self, query: str, **args) -> DataFrame:
        """Any query over the views concepts, links, links_current, transaction_log, embeddings, annotations."""
        views = {
            "concepts": self.concepts(), "links": self.links(), "links_current": self.current(), "transaction_log": self.log(),
            "embeddings": self.table("embeddings"), "annotations": self.annotations(),
        }
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(query, args=args or None)

    def explain(self, query: str) -> str:
        return self.sql(f"EXPLAIN FORMATTED {query}").first()[0]

    # writing

    def _frame(self, rows: DataFrame | Iterable, kind: type, now: str) -> DataFrame:
        """Rows as the table's columns with one stamp; instants may be texts or timestamps."""
        if not isinstance(rows, DataFrame):
            rows = [dataclasses.asdict(r) for r in rows]
            schema = ", ".join(f"{f.name} {'boolean' if f.type == 'bool' else 'double' if f.type == 'float' else 'string'}" for f in dataclasses.fields(kind))
            rows = self.spark.createDataFrame([tuple(r[f.name] for f in dataclasses.fields(kind)) for r in rows], schema)
        for c in ("valid_from", "valid_to"):
            if dict(rows.dtypes)[c] == "string":
                rows = rows.withColumn(c, parsed(c))
        return rows.withColumn("recorded_at", instant(now))

    def _log_rows(self, rows: DataFrame, table: str) -> DataFrame:
        last = self.log().agg(F.max("seq_id")).first()[0] or 0
        last = max(last, self.table("cold_log").agg(F.max("seq_id")).first()[0] or 0)
        numbered_rows = numbered(rows, "entity_id", last, "seq_id")
        return numbered_rows.select("seq_id", F.lit(table).alias("table_name"), "entity_id", "operation", "payload", "recorded_at")

    def _payload(self, rows: DataFrame, version: int, columns: list[str]):
        parts = [formatted(c).alias(c) if c in ("valid_from", "valid_to") else F.col(c) for c in columns]
        return F.to_json(F.struct(F.lit(version).alias("v"), *parts), {"ignoreNullFields": "false"})

    def write_concepts(self, rows: DataFrame | Iterable[T.ConceptUpsert]) -> None:
        """Replace concepts as whole rows, all or none."""
        new = self._frame(rows, T.ConceptUpsert, self.clock.now())
        live = self.concepts()
        integrity.check_concepts(new, live)
        names = ["title", "content", "embedding_model", "valid_from", "valid_to", "retired"]
        seen = temporal.newest_log_rows(self.log(), table="concepts").select(F.col("entity_id").alias("_id"))
        logged = new.join(seen, F.col("id") == F.col("_id"), "left").select(
            F.col("id").alias("entity_id"), F.when(F.col("_id").isNull(), "I").otherwise("U").alias("operation"),
            self._payload(new, T.CONCEPT_PAYLOAD_VERSION, names).alias("payload"), "recorded_at",
        )
        self._commit({"log": self._log_rows(logged, "concepts")})

    def assert_edges(self, rows: DataFrame | Iterable[T.EdgeAssertion]) -> None:
        """Append assertions, all or none, after the checks of :func:`kairograph.operators.integrity.check_edges`."""
        new = self._frame(rows, T.EdgeAssertion, self.clock.now())
        integrity.check_edges(new, self.current(), self.concepts())
        self._append(new)

    def bulk_import(self, rows: DataFrame, slices: int = 1) -> None:
        """Assert edges in ``slices`` commits with a stamp each; every one is all or none."""
        for k in range(slices):
            part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("source_id", "target_id", "edge_type"), F.lit(slices)) == k)
            self.assert_edges(part)

    def _append(self, new: DataFrame) -> None:
        names = ["source_id", "target_id", "edge_type", "valid_from", "valid_to", "weight", "properties"]
        key = F.concat_ws("|", "source_id", "target_id", "edge_type", formatted("valid_from"))
        logged = new.select(key.alias("entity_id"), F.lit("I").alias("operation"), self._payload(new, T.LINK_PAYLOAD_VERSION, names).alias("payload"), "recorded_at")
        self._commit({"links": new, "log": self._log_rows(logged, "links")})

    def retire_edges(self, rows: DataFrame) -> None:
        """Give current edges (``source_id, target_id, edge_type, valid_from``) another ``valid_to``; weight and properties stay."""
        now = self.clock.now()
        asked = rows.select(*T.BELIEF_KEY, F.col("valid_to").alias("_to"))
        for c in ("valid_from", "_to"):
            if dict(asked.dtypes)[c] == "string":
                asked = asked.withColumn(c, parsed(c))
        current = self.current()
        missing = asked.join(current, list(T.BELIEF_KEY), "left_anti").first()
        if missing is not None:
            raise NotFound(id=f"{missing['source_id']} -> {missing['target_id']}")
        new = current.join(asked, list(T.BELIEF_KEY)).withColumns({"valid_to": F.col("_to"), "recorded_at": instant(now)})
        self._append(new.drop("_to"))

    def register_model(self, model: str, dim: int) -> None:
        check_model(model)
        if dim <= 0:
            raise DimMismatch(got=dim, expected=1, model=model)
        known = self._state["models"].get(model)
        if known is None:
            self._commit(models=self._state["models"] | {model: dim})
        elif known != dim:
            raise DimMismatch(got=dim, expected=known, model=model)

    def registered_models(self) -> dict[str, int]:
        return dict(sorted(self._state["models"].items()))

    def upsert_embeddings(self, model: str, rows: DataFrame) -> None:
        """Replace the vectors (``concept_id, embedding``) of one model; one of another length refuses the batch."""
        if (dim := self._state["models"].get(model)) is None:
            raise ModelNotRegistered(model=model)
        bad = rows.where(F.size("embedding") != dim).select(F.size("embedding").alias("n")).first()
        if bad is not None:
            raise DimMismatch(got=bad["n"], expected=dim, model=model)
        lost = integrity.unknown_ends(rows.select(F.col("concept_id").alias("source_id"), F.col("concept_id").alias("target_id")), self.concepts()).first()
        if lost is not None:
            raise NotFound(id=lost["id"])
        new = rows.select(F.lit(model).alias("model"), "concept_id", F.col("embedding").cast("array<float>").alias("embedding"))
        kept = self.table("embeddings").join(new.select("model", "concept_id"), ["model", "concept_id"], "left_anti")
        self._commit(replaced={"embeddings": kept.unionByName(new)})

    def write_annotations(self, rows: DataFrame) -> None:
        """Replace annotations (``concept_id, label, value``) by concept and label."""
        new = rows.select("concept_id", "label", F.col("value").cast("string").alias("value"), instant(self.clock.now()).alias("computed_at"))
        kept = self.annotations().join(new.select("concept_id", "label"), ["concept_id", "label"], "left_anti")
        self._commit(replaced={"annotations": kept.unionByName(new)})

    # time

    def as_of(self, ts: str | dt.datetime | None = None, include_cold: bool = False) -> DataFrame:
        """Edges valid at ``ts`` (None: now) by current belief; those in the cold tier only on demand."""
        told = temporal.latest_belief(self.links().unionByName(self.table("cold_links"))) if include_cold else self.current()
        return temporal.as_of_edges(told, self.clock.now() if ts is None else to_canonical(ts))

    def _cold(self) -> DataFrame | None:
        return self.table("cold_log") if self._state["files"]["cold_log"] else None

    def reconstruct(self, ts: str, use_snapshots: bool = True) -> tuple[DataFrame, DataFrame, T.Meta]:
        """State of belief at ``ts``, from the newest snapshot up to it where there is one."""
        ts = to_canonical(ts)
        fit = [s for s in self._state["snapshots"] if s["timestamp"] <= ts] if use_snapshots else []
        if not fit:
            return temporal.reconstruct(self.log(), ts, self._cold())
        best = max(fit, key=lambda s: s["seq"])
        if best.get("schema_version") != T.SCHEMA_VERSION:
            raise SnapshotIncompatible(path=best["path"], reason=f"schema {best.get('schema_version')}, not {T.SCHEMA_VERSION}")
        base = tuple(self.spark.read.parquet(f"{self.root}/{best['path']}/{part}") for part in ("concepts", "edges"))
        return temporal.reconstruct(self.log(), ts, self._cold(), base, best["seq"])

    def save_snapshot(self, ts: str) -> None:
        """Store the state at ``ts`` with the log position that it covers."""
        ts = to_canonical(ts)
        concepts, edges, _ = self.reconstruct(ts)
        seq = self.log().where(F.col("recorded_at") <= instant(ts)).agg(F.max("seq_id")).first()[0]
        if seq is None:
            return
        path = f"snapshots/{seq:019d}-{uuid.uuid4().hex[:8]}"
        concepts.write.parquet(f"{self.root}/{path}/concepts")
        edges.write.parquet(f"{self.root}/{path}/edges")
        others = [s for s in self._state["snapshots"] if s["seq"] != seq]
        kept = retained([*others, {"seq": seq, "timestamp": ts, "path": path, "schema_version": T.SCHEMA_VERSION}])
        gone = {s["path"] for s in self._state["snapshots"]} - {s["path"] for s in kept}
        self._commit(snapshots=kept)
        for name in gone:
            self._delete(name)

    def maybe_snapshot(self, every: int = 10_000) -> bool:
        """Store a snapshot if ``every`` log rows came since the last one."""
        last = self.log().agg(F.max("seq_id").alias("seq"), formatted(F.max("recorded_at")).alias("at")).first()
        done = max((s["seq"] for s in self._state["snapshots"]), default=0)
        if last["seq"] is None or last["seq"] - done < every:
            return False
        self.save_snapshot(last["at"])
        return True

    def verify_snapshot_chain(self, ts: str) -> DataFrame:
        """What differs between the state from snapshots and the fold from the beginning; empty if nothing."""
        a, b = self.reconstruct(ts), self.reconstruct(ts, use_snapshots=False)
        return temporal.chain_difference(a[:2], b[:2])

    # tiers

    def archive(self, cutoff: str) -> T.ArchiveReport:
        """Move what ``cutoff`` allows to the cold tier: links, then concepts no hot link names, then log rows."""
        cutoff = to_canonical(cutoff)
        links, log = self.links(), self.log()
        moved = arch.archivable_links(links, cutoff)
        hot = arch.without(links, moved, [*T.BELIEF_KEY, "recorded_at"])
        gone = arch.archivable_concepts(self.concepts(), hot, cutoff)
        rows = arch.archivable_log(log, cutoff)
        report = T.ArchiveReport(moved.count(), gone.count(), rows.count())
        self._commit(
            {"cold_links": moved, "cold_log": rows, "cold_concepts": gone},
            {
                "links": hot,
                "log": log.join(rows.select("seq_id"), "seq_id", "left_anti"),
                "embeddings": self.table("embeddings").join(gone.select(F.col("id").alias("concept_id")), "concept_id", "left_anti"),
                "annotations": self.annotations().join(gone.select(F.col("id").alias("concept_id")), "concept_id", "left_anti"),
                "links_current": temporal.latest_belief(hot),
            },
            current_of=1,
        )
        return report

    def archive_windowed(self, cutoff: str, window: dt.timedelta) -> T.ArchiveReport:
        """:meth:`archive` in sessions of ``window`` each, from the oldest log row on."""
        oldest = self.log().agg(formatted(F.min("recorded_at"))).first()[0]
        if oldest is None or oldest >= to_canonical(cutoff):
            return T.ArchiveReport()
        reports = [self.archive(c) for c in arch.boundaries(oldest, to_canonical(cutoff), window)]
        return T.ArchiveReport(*(sum(getattr(r, f) for r in reports) for f in ("links", "concepts", "log_rows")), sessions=len(reports))

    def rehydrate(self, ids: Iterable[str]) -> int:
        """Bring archived concepts back, without a log row; ids that aren't archived are passed over."""
        asked = self.spark.createDataFrame([(check_id(i),) for i in ids], "id string").distinct()
        cold = self.table("cold_concepts")
        back = cold.join(asked, "id", "left_semi").count()
        if back:
            self._commit(replaced={"cold_concepts": cold.join(asked, "id", "left_anti")})
        return back

    # graph and retrieval

    def traverse_ids(self, start: Iterable[str], how: graph.Traversal | None = None) -> DataFrame:
        ids = self.spark.createDataFrame([(i,) for i in start], "id string")
        return graph.traverse_ids(how or graph.Traversal(), ids, self.current(), self.concepts(), self.clock.now())

    def traverse(self, start: Iterable[str], how: graph.Traversal | None = None) -> DataFrame:
        how = how or graph.Traversal()
        if how.attribute_mode is temporal.Mode.OMIT:
            raise ValueError("traverse returns attributes; use traverse_ids")
        ids = self.spark.createDataFrame([(i,) for i in start], "id string")
        return graph.traverse(how, ids, self.current(), self.concepts(), self.log(), self.clock.now())

    def load_subgraph(self, start: Iterable[str], how: graph.Traversal | None = None, budget: int | None = None) -> graph.Subgraph:
        ids = self.spark.createDataFrame([(i,) for i in start], "id string")
        return graph.load_subgraph(how or graph.Traversal(min_weight=None), ids, self.current(), self.concepts(), self.clock.now(), budget)

    def search_vector(self, model: str, query: list[float], k: int) -> DataFrame:
        return retrieval.search_vector(self.embeddings(model), query, k)

    def keyword_search(self, text: str, k: int) -> DataFrame:
        index, concepts = self.index(), self.concepts()
        return retrieval.keyword_scan(concepts, text, k) if index is None else retrieval.keyword_search(index, concepts, text, k)

    def hybrid_search(self, model: str, query: list[float], text: str, k: int, depth: int | None = None) -> DataFrame:
        concepts = self.concepts()
        return retrieval.hybrid_search(self.embeddings(model), self.index(), concepts, query, text, k, depth)

    def filtered_search(self, model: str, query: list[float], start: Iterable[str], k: int, how: graph.Traversal | None = None):
        return retrieval.FilteredSearch(k).run(self.embeddings(model), self.traverse_ids(start, how), query)

    # integrity

    def audit(self, current: DataFrame | None = None) -> None:
        """Raise if current belief as this handle gives it, or ``current``, differs from the assertions' projection."""
        integrity.audit(self.current() if current is None else current, self.links())


def retained(snapshots: list[dict], newest: int = 5, days: int = 30) -> list[dict]:
    """The newest snapshots by position, and the newest of each of the last days."""
    order = sorted(snapshots, key=lambda s: s["seq"])
    if not order:
        return []
    kept = {s["seq"] for s in order[-newest:]}
    last = dt.date.fromisoformat(order[-1]["timestamp"][:10])
    by_day = {s["timestamp"][:10]: s["seq"] for s in order}
    kept |= {seq for day, seq in by_day.items() if (last - dt.date.fromisoformat(day)).days < days}
    return [s for s in order if s["seq"] in kept]
