"""Scenarios of the ledger: writing, both clocks, archive, snapshots, retrieval."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kairograph import errors as E
from kairograph.functions.columns import formatted
from kairograph.functions.scalars import Clock, FakeClock, coerce_vector, encode_vector, from_canonical, generate_id, is_ulid, normalize, to_canonical
from kairograph.operators import graph
from kairograph.operators.temporal import Mode, Reach, reach
from kairograph.plans.planner import CostEstimator, Strategy
from kairograph.sources.ledger import Ledger, retained
from kairograph.types import OPEN, ConceptUpsert, EdgeAssertion

DAY = "2026-01-{:02d}T00:00:00.000000Z"


@pytest.fixture
def book(spark, tmp_path):
    clock = FakeClock(DAY.format(5))
    ledger = Ledger(spark, str(tmp_path / "book"), clock)
    ledger.write_concepts([ConceptUpsert(x, f"Title {x}", f"text of {x}") for x in "abc"])
    return ledger, clock


def edge(s, t, a=1, b=None, **more):
    return EdgeAssertion(s, t, "KNOWS", DAY.format(a), OPEN if b is None else DAY.format(b), **more)


def pairs(df):
    return sorted((r.source_id, r.target_id) for r in df.collect())


def test_title_of_monday_and_wednesday(book):
    ledger, clock = book
    clock.set(DAY.format(7))
    ledger.write_concepts([ConceptUpsert("a", "Wednesday")])
    how = graph.Traversal(max_depth=0)
    assert ledger.traverse(["a"], how).first()["title"] == "Wednesday"
    then = how.within(as_of=DAY.format(6), attribute_mode=Mode.AT_TIME)
    assert ledger.traverse(["a"], then).first()["title"] == "Title a"
    with pytest.raises(E.AttributeModeUnstated):
        ledger.traverse(["a"], how.within(as_of=DAY.format(6)))
    with pytest.raises(ValueError):
        ledger.traverse(["a"], how.within(attribute_mode=Mode.OMIT))


def test_two_clocks_differ_after_a_retirement(book, spark):
    ledger, clock = book
    ledger.assert_edges([edge("a", "b", weight=0.8, properties='{"k": 1}')])
    clock.set(DAY.format(9))
    ledger.retire_edges(spark.createDataFrame([("a", "b", "KNOWS", DAY.format(1), DAY.format(3))], "source_id string, target_id string, edge_type string, valid_from string, valid_to string"))
    assert ledger.as_of(DAY.format(4)).count() == 0
    assert ledger.as_of(DAY.format(2)).count() == 1
    believed = ledger.reconstruct(DAY.format(6))[1].withColumn("valid_to", formatted("valid_to")).first()
    assert believed["valid_to"] == OPEN
    now = ledger.current().first()
    assert (now["weight"], now["properties"]) == (0.8, '{"k": 1}')
    assert ledger.links().count() == 2


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        ([edge("a", "b"), edge("a", "b")], E.DuplicateAssertion),
        ([edge("a", "b", 1), edge("a", "b", 2)], E.SingleOpenViolation),
        ([edge("a", "b", 1, 4), edge("a", "b", 3, 6)], E.OverlappingInterval),
        ([edge("a", "nobody")], E.NotFound),
        ([edge("a", "b|c")], E.InvalidId),
        ([EdgeAssertion("a", "b", "knows", DAY.format(1))], E.InvalidEdgeType),
        ([edge("a", "b", weight=float("nan"))], E.InvalidWeight),
        ([edge("a", "b", weight=-1.0)], E.InvalidWeight),
        ([EdgeAssertion("a", "b", "KNOWS", "yesterday")], E.InvalidTimestamp),
    ],
)
def test_a_batch_is_refused_whole(book, rows, error):
    ledger, _ = book
    before = ledger.version
    with pytest.raises(error):
        ledger.assert_edges([edge("b", "c"), *rows])
    assert (ledger.version, ledger.links().count()) == (before, 0)


def test_abutting_intervals_and_supersession_are_no_overlap(book):
    ledger, clock = book
    ledger.assert_edges([edge("a", "b", 1, 4), edge("a", "b", 4, 6)])
    clock.set(DAY.format(8))
    ledger.assert_edges([edge("a", "b", 4, 9, weight=2.0)])
    assert ledger.current().count() == 2
    assert ledger.as_of(DAY.format(8)).count() == 1
    with pytest.raises(E.OverlappingInterval):
        ledger.assert_edges([edge("a", "b", 8, 10)])


def test_every_write_is_logged_once_and_the_fold_is_the_state(book):
    ledger, clock = book
    clock.set(DAY.format(8))
    ledger.write_concepts([ConceptUpsert("b", "B2", embedding_model="m"), ConceptUpsert("c", "C", retired=True), ConceptUpsert("d", "D")])
    ledger.assert_edges([edge("a", "b"), edge("b", "d", weight=2.0)])
    log = ledger.log()
    assert sorted(r.seq_id for r in log.collect()) == list(range(1, 9))
    assert {(r.entity_id, r.operation) for r in log.where("seq_id > 3 and table_name = 'concepts'").collect()} == {("b", "U"), ("c", "U"), ("d", "I")}
    concepts, edges, meta = ledger.reconstruct(DAY.format(9))
    assert sorted((r.id, r.title) for r in concepts.collect()) == [("a", "Title a"), ("b", "B2"), ("d", "D")]
    assert pairs(edges) == pairs(ledger.current())
    assert not meta.predates_recorded_history
    assert ledger.reconstruct(DAY.format(1))[2].predates_recorded_history


def test_retired_concepts_are_walked_through(book):
    ledger, clock = book
    ledger.assert_edges([edge("a", "b"), edge("b", "c"), edge("c", "a")])
    clock.set(DAY.format(9))
    ledger.write_concepts([ConceptUpsert("b", "gone", retired=True)])
    assert {r.id for r in ledger.traverse_ids(["a"]).collect()} == {"a", "c"}
    loaded = ledger.load_subgraph(["a"])
    assert pairs(loaded.edges) == [("c", "a")] and loaded.is_closed()
    with pytest.raises(E.SubgraphTooLarge):
        ledger.load_subgraph(["a"], budget=10)


def test_a_subgraph_reaches_a_step_further_than_its_walk(book):
    ledger, _ = book
    ledger.assert_edges([edge("a", "b"), edge("b", "c")])
    assert pairs(ledger.load_subgraph(["a"], graph.Traversal(max_depth=0)).edges) == [("a", "b")]
    assert {r.id for r in ledger.traverse_ids(["a"], graph.Traversal(max_depth=0)).collect()} == {"a"}


def test_snapshots_compose_to_the_fold(book):
    ledger, clock = book
    ledger.assert_edges([edge("a", "b")])
    ledger.save_snapshot(DAY.format(6))
    clock.set(DAY.format(8))
    ledger.write_concepts([ConceptUpsert("b", "B2"), ConceptUpsert("c", "C", retired=True)])
    ledger.assert_edges([edge("a", "c", 2, 3)])
    assert ledger.verify_snapshot_chain(DAY.format(9)).count() == 0
    assert ledger.reconstruct(DAY.format(9))[2].seq_anchor == 4
    assert ledger.reconstruct(DAY.format(5))[2].seq_anchor == 0
    assert not ledger.maybe_snapshot(every=100) and ledger.maybe_snapshot(every=2)


def test_archive_moves_only_what_every_clause_allows(book):
    ledger, clock = book
    past = DAY.format(2)
    rows = [("gone", past, True), ("live", past, False), ("unexpired", OPEN, True), ("target", past, True)]
    ledger.write_concepts([ConceptUpsert(i, i, valid_to=to, retired=r) for i, to, r in rows])
    ledger.assert_edges([edge("live", "target"), edge("a", "b", 1, 3), edge("b", "c")])
    clock.set(DAY.format(20))
    ledger.write_concepts([ConceptUpsert("a", "newer")])
    before = ledger.reconstruct(DAY.format(6))
    report = ledger.archive(DAY.format(10))
    assert (report.links, report.concepts, report.log_rows) == (1, 1, 1)
    assert {r.id for r in ledger.concepts().collect()} == {"a", "b", "c", "live", "unexpired", "target"}
    after = ledger.reconstruct(DAY.format(6))
    assert sorted(before[0].collect()) == sorted(after[0].collect()) and pairs(before[1]) == pairs(after[1])
    assert ledger.as_of(DAY.format(2)).count() == 2 and ledger.as_of(DAY.format(2), include_cold=True).count() == 3
    assert ledger.rehydrate(["gone", "unknown"]) == 1 and "gone" in {r.id for r in ledger.concepts().collect()}
    assert ledger.archive_windowed(DAY.format(10), dt.timedelta(days=2)).sessions == 3
    with pytest.raises(E.ArchiveWindow):
        ledger.archive_windowed(DAY.format(10), dt.timedelta(0))


def test_reach_of_a_log_without_its_beginning(book):
    ledger, _ = book
    log = ledger.log()
    assert reach(log, DAY.format(1), False) is Reach.PREDATES_RECORDED_HISTORY
    assert reach(log.where("seq_id > 1"), DAY.format(1), False) is Reach.NEEDS_ARCHIVE
    assert reach(log, DAY.format(6), False) is Reach.COVERS


def test_models_and_vectors(book, spark):
    ledger, _ = book
    ledger.register_model("m", 2)
    ledger.register_model("m", 2)
    with pytest.raises(E.DimMismatch):
        ledger.register_model("m", 3)
    with pytest.raises(E.InvalidModelName):
        ledger.register_model("M!", 3)
    with pytest.raises(E.ModelNotRegistered):
        ledger.embeddings("other")
    frame = lambda rows: spark.createDataFrame(rows, "concept_id string, embedding array<float>")
    ledger.upsert_embeddings("m", frame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])]))
    ledger.upsert_embeddings("m", frame([("b", [1.0, 1.0]), ("c", [1.0, 1.0])]))
    with pytest.raises(E.DimMismatch):
        ledger.upsert_embeddings("m", frame([("a", [1.0])]))
    with pytest.raises(E.NotFound):
        ledger.upsert_embeddings("m", frame([("nobody", [1.0, 0.0])]))
    assert [r.concept_id for r in ledger.search_vector("m", [1.0, 1.0], 2).collect()] == ["b", "c"]
    with pytest.raises(E.DimMismatch):
        ledger.search_vector("m", [1.0], 2)
    assert ledger.search_vector("m", [1.0, 1.0], 0).count() == 0


def test_hybrid_search_puts_what_both_arms_find_first(book, spark):
    import math

    ledger, clock = book
    clock.set(DAY.format(6))
    names = {"semantic": 0, "middle": 4, "lexical": 12, "filler1": 6, "filler2": 8, "both": 2}
    ledger.write_concepts([ConceptUpsert(n, n, "zygomorphic petals" if n in ("lexical", "both") else "plain words") for n in names])
    ledger.register_model("m", 2)
    rows = [(n, [math.cos(k * math.pi / 16), math.sin(k * math.pi / 16)]) for n, k in names.items()]
    ledger.upsert_embeddings("m", spark.createDataFrame(rows, "concept_id string, embedding array<float>"))
    found = [r.id for r in ledger.hybrid_search("m", [1.0, 0.0], "Zygomorphic!", 4).collect()]
    assert found[0] == "both" and {"lexical", "semantic"} <= set(found)
    assert ledger.keyword_search("  ?! ", 5).count() == 0
    assert {r.id for r in ledger.keyword_search("zygomorphic petals", 5).collect()} == {"lexical", "both"}


def test_both_filter_strategies_agree(spark):
    from kairograph.operators.retrieval import FilteredSearch

    vectors = spark.createDataFrame([(f"c{i:03d}", [float(i), 50.0 - i]) for i in range(50)], "concept_id string, embedding array<float>")
    ids = spark.createDataFrame([(f"c{i:03d}",) for i in range(0, 50, 7)] + [("not embedded",)], "id string")
    both = [[tuple(r) for r in FilteredSearch(4, strategy=s).run(vectors, ids, [1.0, 0.0])[0].collect()] for s in Strategy]
    assert both[0] == both[1] and len(both[0]) == 4


def test_cost_estimates():
    e = CostEstimator(1 << 20, 1000, 32)
    assert (e.k_prime(10, 100), e.k_prime(10, 0), e.k_prime(10, 2000), e.k_prime(10, 1)) == (100, 10, 10, 1000)
    assert e.estimate(10, 100).strategy is Strategy.POST_FILTER
    assert e.estimate(10, 20).strategy is Strategy.PRE_FILTER
    with pytest.raises(E.SubgraphTooLarge):
        CostEstimator(10, 1000, 32).estimate(1, 100)


def test_annotations_are_replaced_by_concept_and_label(book, spark):
    ledger, _ = book
    write = lambda v: ledger.write_annotations(spark.createDataFrame(v, "concept_id string, label string, value string"))
    write([("a", "x", "1"), ("b", "x", "1")])
    write([("a", "x", "2"), ("a", "y", "3")])
    assert sorted((r.concept_id, r.label, r.value) for r in ledger.annotations().collect()) == [("a", "x", "2"), ("a", "y", "3"), ("b", "x", "1")]
    assert ledger.log().count() == 3


def test_handles_see_commits_and_a_second_writer_fails(book, spark):
    ledger, _ = book
    other = Ledger(spark, ledger.root)
    ledger.assert_edges([edge("a", "b")])
    assert other.links().count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        other.write_concepts([ConceptUpsert("z", "Z")])
    other.refresh()
    assert other.links().count() == 1
    assert ledger.sql("select count(*) n from links_current where weight >= :w", w=0.5).first()["n"] == 1
    assert "Physical Plan" in ledger.explain("select * from concepts")
    ledger.audit()
    with pytest.raises(E.CurrentDrift):
        ledger.audit(ledger.current().withColumn("weight", F.lit(9.0)))


def test_snapshot_retention():
    shots = [{"seq": i, "timestamp": f"2026-01-{1 + i // 4:02d}T0{i % 4}:00:00.000000Z"} for i in range(40)]
    assert [s["seq"] for s in retained(shots)] == [3, 7, 11, 15, 19, 23, 27, 31, 35, 36, 37, 38, 39]
    assert retained([]) == []


def test_timestamps():
    assert normalize("2026-01-01T00:00:00Z") == "2026-01-01T00:00:00.000000Z"
    for bad in ("2026-02-30T00:00:00Z", "2026-01-01", "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:60Z"):
        with pytest.raises(E.InvalidTimestamp):
            normalize(bad)
    assert to_canonical(None) == OPEN and from_canonical(OPEN) is None
    zone = dt.timezone(dt.timedelta(hours=2))
    assert to_canonical(dt.datetime(2026, 1, 1, 2, tzinfo=zone)) == "2026-01-01T00:00:00.000000Z"
    for bad in (dt.datetime(2026, 1, 1), dt.date(2026, 1, 1)):
        with pytest.raises(E.InvalidTimestamp):
            to_canonical(bad)
    clock = Clock(floor="2090-01-01T00:00:00Z")
    assert "2090-01-01T00:00:00.000000Z" < clock.now() < clock.now()


def test_ids_and_vectors():
    assert is_ulid(generate_id()) and not is_ulid("x")
    assert coerce_vector(encode_vector([1.0, 2.5]), 2) == [1.0, 2.5]
    assert coerce_vector([1, 2], 2) == [1.0, 2.0]
    with pytest.raises(E.DimMismatch):
        coerce_vector(b"\0" * 4, 2)
    with pytest.raises(TypeError):
        coerce_vector("12", 2)


def test_log_as_a_stream(book, tmp_path, spark):
    from kairograph.streaming import maintain

    ledger, clock = book
    clock.set(DAY.format(8))
    ledger.write_concepts([ConceptUpsert("a", "later"), ConceptUpsert("b", "gone", retired=True)])
    path = f"{ledger.root}/log/*"
    maintain.follow_concepts(maintain.log_stream(spark, path), str(tmp_path / "derived"), str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.id, r.title) for r in maintain.newest(spark, str(tmp_path / "derived")).collect())
    assert got == [("a", "later"), ("c", "Title c")]
    q = maintain.activity(maintain.log_stream(spark, path)).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").agg(F.sum("rows")).first()[0] == 5


def test_stored_current_belief_follows_and_can_be_rebuilt(book):
    ledger, clock = book
    ledger.bulk_import(ledger.spark.createDataFrame([("a", "b", "X", DAY.format(1), OPEN, 1.0, "{}"), ("b", "c", "X", DAY.format(1), OPEN, 1.0, "{}")], "source_id string, target_id string, edge_type string, valid_from string, valid_to string, weight double, properties string"), slices=2)
    ledger.rebuild_current()
    clock.set(DAY.format(8))
    ledger.assert_edges([EdgeAssertion("a", "b", "X", DAY.format(1), DAY.format(4), 5.0), edge("c", "a")])
    assert sorted((r.source_id, r.weight) for r in ledger.current().collect()) == [("a", 5.0), ("b", 1.0), ("c", 1.0)]
    ledger.audit()
    ledger.rebuild_index()
    assert ledger.keyword_search("title a", 3).first()["id"] == "a"
    ledger.archive(DAY.format(9))
    ledger.audit()
    assert ledger.current().count() == 2 and ledger.metrics["links+log"][0] >= 2


def test_edges_from_before_1970_stay_apart(book):
    ledger, clock = book
    rows = [EdgeAssertion("a", "b", "KNOWS", f"{y}-01-01T00:00:00.000000Z", f"{y + 5}-01-01T00:00:00.000000Z") for y in (1950, 1960)]
    ledger.assert_edges(rows)
    edges = ledger.reconstruct(DAY.format(9))[1].withColumns({c: formatted(c) for c in ("valid_from", "valid_to")}).collect()
    assert sorted((r.valid_from[:4], r.valid_to[:4]) for r in edges) == [("1950", "1955"), ("1960", "1965")]
    assert ledger.as_of("1962-01-01T00:00:00Z").count() == 1


def test_instants_far_ahead_see_open_edges(book, spark):
    from kairograph.operators import temporal

    ledger, _ = book
    ledger.assert_edges([edge("a", "b"), edge("b", "c", 1, 3), edge("a", "c", 2, 3)])
    asked = spark.sql("SELECT CAST(t AS timestamp) AS ts FROM VALUES ('2300-01-01'), ('2026-01-02'), ('2026-01-03'), ('1900-01-01'), ('9999-12-31') AS v(t)")
    got = sorted((str(r.ts)[:10], r.source_id, r.target_id) for r in temporal.as_of_many(ledger.current(), asked).collect())
    assert got == [("2026-01-02", *p) for p in (("a", "b"), ("a", "c"), ("b", "c"))] + [(d, "a", "b") for d in ("2026-01-03", "2300-01-01", "9999-12-31")]


def test_a_log_that_cannot_be_read_is_refused(book, spark):
    from kairograph.operators import temporal

    ledger, _ = book
    log = ledger.log()
    newer = log.where("seq_id = 1").withColumns({"seq_id": F.lit(9).cast("long"), "payload": F.lit('{"v": 9}')})
    with pytest.raises(E.PayloadVersion):
        temporal.reconstruct(log.unionByName(newer), DAY.format(9))
    gone = newer.withColumns({"operation": F.lit("D"), "payload": F.lit("{}")})
    with pytest.raises(E.ReplayCorrupt):
        temporal.reconstruct(log.unionByName(gone), DAY.format(9))
    # one that a later row replaces isn't read
    later = log.where("seq_id = 1").withColumn("seq_id", F.lit(10).cast("long"))
    assert temporal.reconstruct(log.unionByName(newer).unionByName(later), DAY.format(9))[0].count() == 3


def test_keyword_search_without_texts_and_by_scan(spark, tmp_path):
    from kairograph.operators import retrieval

    empty = Ledger(spark, str(tmp_path / "none"), FakeClock(DAY.format(5)))
    assert empty.keyword_search("word", 5).count() == 0
    empty.rebuild_index()
    assert empty.keyword_search("word", 5).count() == 0
    rows = [("a", "Été", "l'école est là, là", False), ("b", "", "École école", False), ("c", "école", "", True), ("d", None, None, False)]
    concepts = spark.createDataFrame(rows, "id string, title string, content string, retired boolean")
    by = [retrieval.keyword_search(retrieval.postings(concepts), concepts, q, 5).collect() for q in ("ÉCOLE", "là école", "nothing")]
    scan = [retrieval.keyword_scan(concepts, q, 5).collect() for q in ("ÉCOLE", "là école", "nothing")]
    assert [[(r.id, round(r.score, 9)) for r in x] for x in by] == [[(r.id, round(r.score, 9)) for r in x] for x in scan]
    assert [[r.id for r in x] for x in scan] == [["b", "a"], ["a"], []]


def test_a_snapshot_of_another_schema_is_refused_and_old_ones_are_deleted(book):
    import os

    ledger, clock = book
    paths = []
    for k in range(8):
        clock.set(DAY.format(6) if k == 0 else f"2026-01-06T0{k}:00:00.000000Z")
        ledger.write_concepts([ConceptUpsert("a", f"title {k}")])
        assert ledger.maybe_snapshot(every=1)
        paths = [s["path"] for s in ledger._state["snapshots"]]
    assert len(paths) == 5 and sorted(os.listdir(f"{ledger.root}/snapshots")) == sorted(p.split("/")[1] for p in paths)
    ledger._state["snapshots"][-1]["schema_version"] = 99
    with pytest.raises(E.SnapshotIncompatible):
        ledger.reconstruct(DAY.format(9))


def test_a_failed_commit_leaves_no_files(book, spark):
    import os

    ledger, _ = book
    other = Ledger(spark, ledger.root, FakeClock(DAY.format(6)))
    ledger.write_concepts([ConceptUpsert("z", "Z")])
    before = sorted(os.listdir(f"{ledger.root}/log"))
    with pytest.raises(Exception, match="(?i)exist"):
        other.write_concepts([ConceptUpsert("y", "Y")])
    assert sorted(os.listdir(f"{ledger.root}/log")) == before
