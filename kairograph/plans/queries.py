"""A query for each operator over the test tables, named by what it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions.columns import cosine_distance, edge_filter, edge_key, edge_type_ok, formatted, id_ok, instant, is_open, normalized, overlaps, parsed, tokens, valid_at, weight_ok
from kairograph.operators import archive, graph, integrity, retrieval, temporal
from kairograph.plans.planner import Strategy
from kairograph.plans.testdata import Data

INSTANT = "2024-01-15T00:00:00.000000Z"
LINK_CUTOFF = "1998-06-01T00:00:00.000000Z"
LOG_CUTOFF = "2024-01-20T00:00:00.000000Z"
ANCHOR = "2024-01-10T00:00:00.000000Z"
NOW = "2020-01-01T00:00:00.000000Z"
#: Edge ends that a node of the core has at least.
CORE = 24

_all: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    _all[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all)


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as canonical texts."""
    return df.withColumns({c: formatted(c) for c in columns})


@_query
def t01_as_of_edges(d: Data) -> DataFrame:
    return _texts(temporal.as_of_edges(d.intervals(), INSTANT), "valid_from", "valid_to")


@_query
def p01_valid_time_stab(d: Data) -> DataFrame:
    return d.intervals().groupBy("edge_type").agg(F.sum(valid_at(instant(INSTANT)).cast("long")).alias("valid"), F.count(F.lit(1)).alias("all_rows"))


@_query
def p02_interval_overlap(d: Data) -> DataFrame:
    a, b = instant("2024-01-05T00:00:00Z"), instant("2024-01-06T00:00:00Z")
    hit = overlaps(F.col("valid_from"), F.col("valid_to"), a, b)
    return d.intervals().where(hit).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum(is_open().cast("long")).alias("open_rows"))


@_query
def p03_p04_edge_filter(d: Data) -> DataFrame:
    kept = d.places().where(edge_filter(0.5, ["HASNATION", "HASCUSTOMER"]))
    return kept.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"))


@_query
def p05_retired_filter(d: Data) -> DataFrame:
    return d.trade_concepts().where("not retired").select("id", "title")


@_query
def p06_f01_canonical_timestamps(d: Data) -> DataFrame:
    """Forms of a timestamp: canonical, of whole seconds, with a zone, with a space."""
    ts = F.col("ts").cast("timestamp")
    form = F.pmod(F.col("event_id"), F.lit(4))
    text = (
        F.when(form == 0, formatted(ts))
        .when(form == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    return d.table("events").select("event_id", normalized(text).alias("canonical"), parsed(text).isNotNull().alias("valid"))


@_query
def p07_p08_p09_validation(d: Data) -> DataFrame:
    li = d.table("lineitem")
    weight = F.when(F.col("l_linenumber") == 1, -F.col("l_quantity")).when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(F.col("l_linenumber") == 3, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    kind = F.concat(F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "-").otherwise("1"))
    name = F.when(F.col("l_linenumber") == 4, F.lit("")).when(F.col("l_linenumber") == 5, F.lit("a|b")).otherwise(F.lit("x"))
    return li.groupBy("l_linenumber", "l_linestatus").agg(
        F.sum(weight_ok(weight).cast("long")).alias("weights"), F.sum(edge_type_ok(kind).cast("long")).alias("types"), F.sum(id_ok(name).cast("long")).alias("ids")
    )


@_query
def p11_column_pruning(d: Data) -> DataFrame:
    return d.documents().where("not retired").select("id", "title")


@_query
def p12_hydrate_current(d: Data) -> DataFrame:
    ids = d.table("events").where("event_type = 'purchase'").select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id")).distinct()
    return temporal.hydrate(ids, temporal.Mode.CURRENT, temporal.concepts_of(d.log())).select("id", "title", "content")


@_query
def p13_hydrate_at_time(d: Data) -> DataFrame:
    ids = d.log().select(F.col("entity_id").alias("id")).distinct()
    return temporal.hydrate(ids, temporal.Mode.AT_TIME, log=d.log(), ts=ANCHOR).select("id", "title", "content")


@_query
def p14_hydrate_omit(d: Data) -> DataFrame:
    return temporal.hydrate(d.trade_concepts().select("id"), temporal.Mode.OMIT).select("id", "title")


@_query
def j05_superseded_assertions(d: Data) -> DataFrame:
    links = d.assertions()
    newest = temporal.latest_belief(links).select("source_id", "target_id", F.col("recorded_at").alias("_last"))
    old = links.join(newest, ["source_id", "target_id"]).where("recorded_at < _last")
    return old.groupBy("source_id").agg(F.count(F.lit(1)).alias("superseded"))


@_query
def j06_unnamed_concepts(d: Data) -> DataFrame:
    ends = d.supply()
    named = ends.select(F.col("source_id").alias("id")).union(ends.select("target_id")).distinct()
    return d.all_concepts().join(named, "id", "left_anti").select("id")


@_query
def j10_overlapping_intervals(d: Data) -> DataFrame:
    """Events that last two days each, against each other."""
    i = d.intervals().withColumn("valid_to", F.col("valid_from") + F.expr("interval 2 days"))
    none = i.where(F.lit(False))
    return _texts(integrity.overlapping(i, none), "valid_from", "other_from").select("source_id", "target_id", "valid_from", "other_from")


@_query
def j11_as_of_join(d: Data) -> DataFrame:
    days = d.table("events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).distinct()
    days = days.union(d.spark.range(1).select(F.lit("2300-01-01T00:00:00Z").cast("timestamp")))
    return temporal.as_of_many(d.intervals(), days).groupBy(formatted("ts").alias("ts")).agg(F.count(F.lit(1)).alias("edges"))


@_query
def a01_corpus_counts(d: Data) -> DataFrame:
    return d.trade_concepts().groupBy("retired").agg(F.count(F.lit(1)).alias("n"))


@_query
def a02_log_bounds(d: Data) -> DataFrame:
    return _texts(temporal.log_bounds(d.log()), "first_at", "last_at")


@_query
def a03_clock_floor(d: Data) -> DataFrame:
    both = d.trade_concepts().select("recorded_at").union(d.assertions().select("recorded_at"))
    return both.agg(formatted(F.max("recorded_at")).alias("floor"))


@_query
def a04_degrees(d: Data) -> DataFrame:
    return _trade(d).degrees()


@_query
def a06_t02_latest_belief(d: Data) -> DataFrame:
    return _texts(temporal.latest_belief(d.assertions()), "recorded_at", "valid_to").select("source_id", "target_id", "weight", "recorded_at", "valid_to")


@_query
def a08_log_head(d: Data) -> DataFrame:
    return d.log().where(F.col("seq_id") > 100).agg(F.max("seq_id").alias("seq"), F.count(F.lit(1)).alias("since"), formatted(F.max("recorded_at")).alias("at"))


@_query
def w01_newest_log_rows(d: Data) -> DataFrame:
    return temporal.newest_log_rows(d.log()).select("entity_id", "seq_id", "operation")


@_query
def t03_reconstruct_concepts(d: Data) -> DataFrame:
    return temporal.fold_log(d.log(), INSTANT)[0].select("id", "title", "content")


def _link_log(a: DataFrame) -> DataFrame:
    """Assertions as log rows."""
    payload = F.to_json(F.struct(F.lit(1).alias("v"), "source_id", "target_id", "edge_type", formatted("valid_from").alias("valid_from"), formatted("valid_to").alias("valid_to"), "weight"))
    return a.select(F.unix_micros("recorded_at").alias("seq_id"), F.lit("links").alias("table_name"), edge_key().alias("entity_id"), F.lit("I").alias("operation"), payload.alias("payload"), "recorded_at")


@_query
def t03_reconstruct_edges(d: Data) -> DataFrame:
    return _texts(temporal.fold_log(_link_log(d.assertions()), LINK_CUTOFF)[1], "valid_from", "valid_to")


@_query
def t03_edges_before_1970(d: Data) -> DataFrame:
    """The supply assertions, valid 35 years before they were recorded."""
    early = d.assertions().withColumn("valid_from", F.date_trunc("day", F.col("recorded_at")) - F.expr("interval 12784 days"))
    return _texts(temporal.link_rows(temporal.newest_log_rows(_link_log(early))), "valid_from", "valid_to")


@_query
def t04_anchored_fold(d: Data) -> DataFrame:
    log = d.log()
    anchor = log.where(F.col("recorded_at") <= instant(ANCHOR)).agg(F.max("seq_id")).first()[0]
    return temporal.compose(temporal.fold_log(log, ANCHOR), log, INSTANT, anchor)[0].select("id", "title", "content")


@_query
def t05_cold_fold(d: Data) -> DataFrame:
    log = d.log()
    cold = archive.archivable_log(log, LOG_CUTOFF)
    hot = log.join(cold.select("seq_id"), "seq_id", "left_anti").select(*log.columns)
    return temporal.reconstruct(hot, ANCHOR, cold.select(*log.columns))[0].select("id", "title", "content")


@_query
def t06_reach(d: Data) -> DataFrame:
    log = d.log()
    cases = [("all", log), ("late", log.where("seq_id > 50")), ("none", log.where(F.lit(False)))]
    rows = [(name, ts, cold, temporal.reach(rows_, ts, cold).value) for name, rows_ in cases for ts in ("2020-01-01T00:00:00.000000Z", "2030-01-01T00:00:00.000000Z") for cold in (False, True)]
    return d.spark.createDataFrame(rows, "log string, ts string, has_cold boolean, reach string")


@_query
def t07_log_intact(d: Data) -> DataFrame:
    b = temporal.log_bounds(d.log())
    return b.select(((F.col("n") == 0) | ((F.col("first_seq") == 1) & (F.col("n") == F.col("last_seq")))).alias("intact"), (F.col("last_seq") - F.col("n")).alias("removed"))


@_query
def t10_chain_difference(d: Data) -> DataFrame:
    log = d.log()
    a, b = temporal.fold_log(log, ANCHOR), temporal.fold_log(log, INSTANT)
    return temporal.chain_difference(a, b).groupBy("kind", "side").agg(F.count(F.lit(1)).alias("n"))


@_query
def t14_links_archivable(d: Data) -> DataFrame:
    return _texts(archive.archivable_links(d.assertions(), LINK_CUTOFF), "recorded_at").select("source_id", "target_id", "recorded_at")


@_query
def t15_log_archivable(d: Data) -> DataFrame:
    return archive.archivable_log(d.log(), LOG_CUTOFF).select("seq_id", "entity_id")


@_query
def t16_concepts_archivable(d: Data) -> DataFrame:
    ended = d.all_concepts().withColumn("valid_to", F.when(F.col("retired"), instant("1997-01-01T00:00:00Z")).otherwise(F.col("valid_to")))
    links = d.assertions()
    return archive.archivable_concepts(ended, links, LINK_CUTOFF).select("id")


@_query
def t18_archive_windows(d: Data) -> DataFrame:
    import datetime as dt

    marks = archive.boundaries("2024-01-01T00:00:00.000000Z", LOG_CUTOFF, dt.timedelta(days=4))
    log = archive.archivable_log(d.log(), LOG_CUTOFF)
    session = F.lit(0)
    for mark in marks[:-1]:
        session = session + (F.col("recorded_at") >= instant(mark)).cast("int")
    return log.groupBy(session.alias("session")).agg(F.count(F.lit(1)).alias("n"))


@_query
def u03_current_drift(d: Data) -> DataFrame:
    """Current belief in which weights over 45 were changed and small ones lost."""
    links = d.assertions()
    bent = temporal.latest_belief(links).where("weight > 3").withColumn("weight", F.when(F.col("weight") > 45, 0.0).otherwise(F.col("weight")))
    return integrity.drift(bent, links)


def _trade(d: Data) -> graph.Subgraph:
    nodes = d.trade_concepts()
    return graph.Subgraph(nodes, d.supply())


@_query
def g01_walk(d: Data) -> DataFrame:
    start = d.trade_concepts().where("id = 's1'")
    return graph.walk(start, graph.valid_edges(d.both_ways(), NOW, 30.0), 3)


@_query
def g01_walk_unthinned(d: Data) -> DataFrame:
    return graph.walk(d.trade_concepts().where("id = 's1'"), graph.valid_edges(d.both_ways(), NOW), 3)


@_query
def g02_traverse_ids(d: Data) -> DataFrame:
    how = graph.Traversal(max_depth=2, edge_types=("SUPPLIES", "SUPPLIEDBY"), min_weight=49.0)
    return graph.traverse_ids(how, d.trade_concepts().where("id = 's1'"), d.both_ways(), d.trade_concepts(), NOW)


@_query
def g03_traverse(d: Data) -> DataFrame:
    how = graph.Traversal(max_depth=2, min_weight=49.0)
    return graph.traverse(how, d.trade_concepts().where("id = 's2'"), d.both_ways(), d.trade_concepts(), d.log(), NOW).select("id", "title")


@_query
def g05_subgraph(d: Data) -> DataFrame:
    g = graph.load_subgraph(graph.Traversal(max_depth=1, min_weight=45.0), d.trade_concepts().where("id = 's3'"), d.both_ways(), d.trade_concepts(), NOW)
    return g.edges.select("source_id", "target_id", "edge_type", "weight")


@_query
def g08_closed_edges(d: Data) -> DataFrame:
    live = d.trade_concepts().where("not retired")
    return graph.closed(live, d.supply()).groupBy("source_id").agg(F.count(F.lit(1)).alias("edges"))


@_query
def g09_out_edges(d: Data) -> DataFrame:
    return _trade(d).out_edges("s7").select("target_id", "weight")


@_query
def g10_dijkstra(d: Data) -> DataFrame:
    nodes = d.places().select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return graph.dijkstra(graph.Subgraph(nodes, d.places()), "r1")


@_query
def g10_dijkstra_cyclic(d: Data) -> DataFrame:
    return graph.dijkstra(graph.Subgraph(d.trade_concepts(), d.both_ways()), "s1")


@_query
def g11_shortest_path(d: Data) -> DataFrame:
    """From a region to the last order below it, and back, where no way leads."""
    nodes = d.places().select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    whole = graph.Subgraph(nodes, d.places())
    goal = graph.walk(nodes.where("id = 'r1'"), d.places(), 3).where("id like 'o%'").agg(F.max("id")).first()[0]
    rows = [(a, b, *(graph.shortest_path(whole, a, b) or (None, None))) for a, b in (("r1", goal), (goal, "r1"))]
    return d.spark.createDataFrame([(a, b, cost, path and ",".join(path)) for a, b, cost, path in rows], "start string, goal string, cost double, path string")


def _ring(d: Data) -> graph.Subgraph:
    """The orders of each customer in a ring."""
    from pyspark.sql import Window

    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = d.table("orders")
    after = F.coalesce(F.lead("o_orderkey").over(own), F.min("o_orderkey").over(Window.partitionBy("o_custkey")))
    ring = o.select(F.col("o_orderkey").alias("a"), after.alias("b"))
    name = lambda c: F.concat(F.lit("o"), F.lpad(F.col(c).cast("string"), 9, "0"))
    edges = ring.select(name("a").alias("source_id"), name("b").alias("target_id"), F.lit("NEXT").alias("edge_type"), F.lit(1.0).alias("weight"))
    return graph.Subgraph(o.select(name("o_orderkey").alias("id")), edges)


@_query
def g12_scc(d: Data) -> DataFrame:
    return graph.scc(_ring(d))


@_query
def g13_k_core(d: Data) -> DataFrame:
    return graph.k_core(_trade(d), CORE)


@_query
def g12_scc_supply(d: Data) -> DataFrame:
    """Supply both ways, which hangs together, and parts that nobody supplies."""
    return graph.scc(graph.Subgraph(d.trade_concepts(), d.both_ways()))


@_query
def g12_scc_places(d: Data) -> DataFrame:
    """A forest: every node is a component."""
    nodes = d.places().select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return graph.scc(graph.Subgraph(nodes, d.places()))


@_query
def g14_modularity(d: Data) -> DataFrame:
    g = graph.Subgraph(d.trade_concepts(), d.supply())
    part = g.nodes.select("id", F.pmod(F.substring("id", 2, 9).cast("int"), F.lit(4)).alias("community"))
    return graph.modularity(g, part).select(F.round("modularity", 9).alias("modularity"))


@_query
def g15_louvain(d: Data) -> DataFrame:
    """Orders in rings of one customer each."""
    return graph.louvain(_ring(d))


@_query
def weak_components(d: Data) -> DataFrame:
    return graph.components(_ring(d))


@_query
def weak_components_places(d: Data) -> DataFrame:
    """A tree for each region, named by its smallest node."""
    nodes = d.places().select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return graph.components(graph.Subgraph(nodes, d.places()))


@_query
def m06_g16_annotations(d: Data) -> DataFrame:
    g = graph.Subgraph(d.trade_concepts(), d.supply())
    return _texts(graph.annotations_of(g.degrees().select("id", F.col("degree").alias("value")), "degree", INSTANT), "computed_at")


@_query
def v04_f09_vector_search(d: Data) -> DataFrame:
    hits = retrieval.search_vector(d.vectors(), d.vector(1), 10)
    return hits.select("concept_id", (F.round("score", 6) + 0.0).alias("score"))


@_query
def f09_distances(d: Data) -> DataFrame:
    v = d.vectors()
    asked = F.array(*[F.lit(float(x)) for x in d.vector(7)])
    return v.select("concept_id", (F.round(cosine_distance("embedding", asked), 6) + 0.0).alias("distance"))


@_query
def f08_tokens(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", F.size(tokens("text")).cast("long").alias("n"))


@_query
def v05_f10_keyword_search(d: Data) -> DataFrame:
    hits = retrieval.keyword_scan(d.documents(), "The, ING!", 50)
    return hits.select("id", F.round("score", 6).alias("score"))


@_query
def v07_rank_fusion(d: Data) -> DataFrame:
    a = retrieval.ranked(retrieval.search_vector(d.vectors(), d.vector(1), 60), "concept_id")
    b = retrieval.ranked(retrieval.search_vector(d.vectors(), d.vector(2), 60), "concept_id")
    return retrieval.reciprocal_rank_fusion(a, b).select("id", F.round("score", 9).alias("score"))


@_query
def v08_hybrid_search(d: Data) -> DataFrame:
    found = retrieval.hybrid_search(d.vectors(), None, d.documents(), d.vector(1), "the of", 10)
    return found.select("id", F.round("score", 9).alias("score"), F.col("vector_rank").cast("long").alias("vector_rank"), F.col("keyword_rank").cast("long").alias("keyword_rank"))


def _filtered(d: Data, strategy: Strategy | None) -> DataFrame:
    ids = d.table("embeddings").where("label in (1, 2)").select(F.col("vec_id").cast("string").alias("id"))
    v = d.vectors().withColumn("concept_id", F.col("concept_id").cast("string"))
    hits, _ = retrieval.FilteredSearch(10, strategy=strategy).run(v, ids, d.vector(3))
    return hits.select("concept_id", (F.round("score", 6) + 0.0).alias("score"))


@_query
def v09_v10_filtered_search(d: Data) -> DataFrame:
    return _filtered(d, Strategy.PRE_FILTER)


@_query
def v11_post_filter(d: Data) -> DataFrame:
    return _filtered(d, Strategy.POST_FILTER)


@_query
def m02_retire_edges(d: Data) -> DataFrame:
    """Current belief after edges of more than 48 were closed."""
    links = d.assertions()
    current = temporal.latest_belief(links)
    closing = current.where("weight > 48").withColumns({"valid_to": instant("1999-01-01T00:00:00Z"), "recorded_at": instant("2002-01-01T00:00:00Z")})
    after = temporal.latest_belief(links.unionByName(closing))
    return after.groupBy(formatted("valid_to").alias("valid_to")).agg(F.count(F.lit(1)).alias("n"))


@_query
def m08_second_open(d: Data) -> DataFrame:
    """Edges asserted anew from another start while an interval is open."""
    current = temporal.latest_belief(d.assertions())
    new = current.where("weight > 47").withColumns({"valid_from": instant("1996-01-01T00:00:00Z"), "valid_to": instant(None)})
    return integrity.second_open(new, current)


@_query
def m14_unknown_ends(d: Data) -> DataFrame:
    return integrity.unknown_ends(d.supply(), d.trade_concepts().where("not retired"))


@_query
def i02_rebuild_current(d: Data) -> DataFrame:
    """Current belief of the log against that of the assertions: how many there are, how many are open, how many differ."""
    links = d.assertions()
    told = temporal.latest_belief(links).select("source_id", "target_id", "edge_type", "valid_from", "valid_to")
    replayed = temporal.link_rows(temporal.newest_log_rows(_link_log(d.assertions())))
    sides = told.withColumn("_s", F.lit(1)).unionByName(replayed.withColumn("_s", F.lit(2)))
    both = sides.groupBy("source_id", "target_id", "edge_type", "valid_from", "valid_to").agg(F.sum("_s").alias("_s"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(is_open().cast("long")).alias("open_rows"), F.sum((F.col("_s") != 3).cast("long")).alias("drift"))
