"""Graph analytics against plain searches on small random graphs and known shapes."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from kairograph.errors import SubgraphTooLarge
from kairograph.operators import graph, sweeps

EDGE = "source_id string, target_id string, edge_type string, weight double"


def make(spark, n, edges):
    nodes = spark.createDataFrame([(f"c{i}",) for i in range(n)], "id string")
    return graph.Subgraph(nodes, spark.createDataFrame([(f"c{a}", f"c{b}", "X", w) for a, b, w in edges], EDGE))


def draw(seed, n=7):
    rng = random.Random(seed)
    return n, [(rng.randrange(n), rng.randrange(n), rng.choice([0.25, 0.5, 1, 2, 4]) * 1.0) for _ in range(rng.randint(0, 2 * n))]


def nearest(n, edges, start):
    best, heap = {}, [(0.0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = d
        for a, b, w in edges:
            if a == x:
                heapq.heappush(heap, (d + w, b))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    n, edges = draw(seed)
    g = make(spark, n, edges)
    best = nearest(n, edges, 0)
    assert {r.id: r.distance for r in graph.dijkstra(g, "c0").collect()} == {f"c{x}": d for x, d in best.items()}
    found = graph.shortest_path(g, "c0", "c3")
    assert (found is None) == (3 not in best)
    if found:
        cost, path = found
        least = {}
        for a, b, w in edges:
            least[f"c{a}", f"c{b}"] = min(w, least.get((f"c{a}", f"c{b}"), w))
        assert cost == best[3] == sum(least[s] for s in itertools.pairwise(path)) and path[0] == "c0" and path[-1] == "c3"
    reach = {x: set(nearest(n, edges, x)) for x in range(n)}
    want = {f"c{x}": "c" + str(min((y for y in range(n) if y in reach[x] and x in reach[y]), key=lambda y: f"c{y}")) for x in range(n)}
    assert {r.id: r.component for r in graph.scc(g).collect()} == want
    core = set(range(n))
    while small := {x for x in core if sum((a == x) + (b == x) for a, b, _ in edges if a in core and b in core) < 2}:
        core -= small
    assert {r.id for r in graph.k_core(g, 2).collect()} == {f"c{x}" for x in core}
    degree = {r.id: (r.degree, r.weighted_degree) for r in g.degrees().collect()}
    assert degree == {f"c{x}": (sum((a == x) + (b == x) for a, b, _ in edges), sum(((a == x) + (b == x)) * w for a, b, w in edges)) for x in range(n)}


def test_absent_ends(spark):
    g = make(spark, 2, [(0, 1, 1.0)])
    assert graph.dijkstra(g, "nobody").count() == 0
    assert graph.shortest_path(g, "c0", "nobody") is None
    assert graph.shortest_path(g, "c0", "c0") == (0.0, ["c0"])
    assert graph.shortest_path(g, "c1", "c0") is None


def test_a_lower_bound_prunes_but_keeps_the_answer(spark):
    from pyspark.sql import functions as F

    g = make(spark, 6, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 4, 0.5), (4, 5, 9.0), (5, 3, 9.0)])
    far = lambda c: F.when(c == "c5", 9.0).when(c == "c4", 15.0).otherwise(0.0)
    assert graph.shortest_path(g, "c0", "c3", far) == (3.0, ["c0", "c1", "c2", "c3"])


def test_cliques_are_communities(spark):
    edges = [(base + a, base + b, 1.0) for base in (0, 12, 24) for a in range(12) for b in range(12) if a != b]
    edges += [(10, 12, 1.0), (22, 24, 1.0)]
    g = make(spark, 36, edges)
    part = graph.louvain(g)
    groups = {}
    for r in part.collect():
        groups.setdefault(r.community, set()).add(int(r.id[1:]))
    assert sorted(map(sorted, groups.values())) == [list(range(k, k + 12)) for k in (0, 12, 24)]
    assert graph.modularity(g, part).first()[0] > 0.6
    empty = make(spark, 3, [])
    assert graph.modularity(empty, graph.louvain(empty)).first()[0] == 0.0
    assert graph.louvain(empty).count() == 3


def test_walk_forms_agree(spark):
    n, edges = draw(9, 12)
    g = make(spark, n, edges)
    start = spark.createDataFrame([("c0",)], "id string")
    one = sorted(map(tuple, graph.walk(start, g.edges, 3).collect()))
    assert one == sorted(map(tuple, graph.walk_sql(spark, start, g.edges, 3).collect()))


def test_components_of_a_long_chain(spark):
    g = make(spark, 60, [(i, i + 1, 1.0) for i in range(40)])
    roots = {r.id: r.root for r in graph.components(g).collect()}
    assert len({roots[f"c{i}"] for i in range(41)}) == 1 and len(set(roots.values())) == 20


def test_a_graph_as_a_plain_container(spark):
    g = make(spark, 3, [(0, 1, 1.0), (0, 1, 2.0), (1, 0, 4.0)])
    assert list(g) == ["c0", "c1", "c2"] and len(g) == 3 and "c2" in g and "c9" not in g
    assert g.node("c1").id == "c1" and g.node("c9") is None
    got = g.to_dict()
    assert list(got["nodes"]) == ["c0", "c1", "c2"]
    assert {k: sorted(e.weight for e in v) for k, v in got["out_adj"].items()} == {"c0": [1.0, 2.0], "c1": [4.0]}
    assert {k: sorted(e.weight for e in v) for k, v in got["in_adj"].items()} == {"c1": [1.0, 2.0], "c0": [4.0]}
    with pytest.raises(SubgraphTooLarge):
        g.to_dict(budget=10)
    empty = make(spark, 0, [])
    assert list(empty) == [] and len(empty) == 0 and empty and empty.to_dict() == {"nodes": {}, "out_adj": {}, "in_adj": {}}


def test_nodes_and_edges_are_added_and_the_graph_stays_closed(spark):
    g = make(spark, 2, [(0, 1, 1.0)])
    more = g.with_nodes(spark.createDataFrame([("c1",), ("c2",), ("c2",)], "id string"))
    assert list(more) == ["c0", "c1", "c2"] and len(g) == 2
    more = more.with_edges(spark.createDataFrame([("c1", "c2", "X", 3.0), ("c2", "c7", "X", 5.0)], EDGE))
    assert sorted((e.source_id, e.target_id, e.weight) for e in more.edges.collect()) == [("c0", "c1", 1.0), ("c1", "c2", 3.0)]
    assert more.is_closed()


def counted(spark, g):
    """The graph, and how many of its edges were made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    return graph.Subgraph(g.nodes, g.edges.mapInPandas(run, g.edges.schema)), made


def cuts(monkeypatch):
    """Counts of the rows that an iteration stores."""
    stored, plain = [], graph.cut

    def cut(df, what="cut"):
        out = plain(df, what)
        stored.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    return stored


def test_distances_make_the_edges_once(spark):
    g, made = counted(spark, make(spark, 8, [(i, i + 1, 1.0) for i in range(7)] + [(0, 1, 5.0)]))
    assert {r.id: r.distance for r in graph.dijkstra(g, "c0").collect()} == {f"c{i}": float(i) for i in range(8)}
    assert made.value == 8
    assert graph.shortest_path(g, "c0", "c7") == (7.0, [f"c{i}" for i in range(8)])
    assert made.value == 16


def test_strong_components_of_long_rings_take_few_rounds(spark, monkeypatch):
    ring = [(20 * r + i, 20 * r + (i + 1) % 20, 1.0) for r in range(3) for i in range(20)]
    g = make(spark, 62, [*ring, (61, 0, 1.0)])
    stored = cuts(monkeypatch)
    parts = {}
    for r in graph.scc(g).collect():
        parts.setdefault(r.component, set()).add(int(r.id[1:]))
    assert sorted(map(sorted, parts.values())) == [*(list(range(k, k + 20)) for k in (0, 20, 40)), [60], [61]]
    assert all(k == min(f"c{x}" for x in part) for k, part in parts.items())
    assert len(stored) < 20


def test_strong_components_that_are_not_even(spark, monkeypatch):
    # two rings of 60 with a way from one to the other, and a chord in each
    ring = [(60 * r + i, 60 * r + (i + 1) % 60, 1.0) for r in range(2) for i in range(60)]
    g = make(spark, 120, [*ring, (3, 65, 1.0), (7, 1, 1.0), (70, 62, 1.0)])
    stored = cuts(monkeypatch)
    parts = {}
    for r in graph.scc(g).collect():
        parts.setdefault(r.component, set()).add(int(r.id[1:]))
    assert sorted(map(sorted, parts.values())) == [list(range(60)), list(range(60, 120))]
    assert len(stored) < 150


@pytest.mark.parametrize("few", [0, 8])
def test_weak_components_shrink_from_round_to_round(spark, monkeypatch, few):
    n, edges = 300, [(i, i + 1, 1.0) for i in range(200)] + [(250, 251, 1.0), (251, 250, 1.0), (260, 260, 1.0)]
    g = make(spark, n, edges)
    monkeypatch.setattr(graph, "FEW_WAYS", few)
    stored = cuts(monkeypatch)
    roots = {r.id: r.root for r in graph.components(g).collect()}
    chain = {f"c{i}" for i in range(201)}
    assert roots == {f"c{i}": min(chain) if f"c{i}" in chain else "c250" if i == 251 else f"c{i}" for i in range(n)}
    assert sum(stored) < 9 * n  # 16 n when every round stored every node


@pytest.mark.parametrize("seed", range(3))
def test_keys_that_two_ids_share(spark, monkeypatch, seed):
    from pyspark.sql import functions as F

    n, edges = draw(seed)
    g = make(spark, n, [*edges, (0, n + 3, 1.0), (n + 3, 0, 1.0)])  # and an end that is no node
    want = [sorted(map(tuple, f(g).collect())) for f in (graph.components, graph.scc)]
    assert len(want[0]) == len(want[1]) == n
    monkeypatch.setattr(graph, "_key", lambda c: F.pmod(F.xxhash64(c), F.lit(2)))
    monkeypatch.setattr(graph, "FEW_WAYS", 0)
    assert [sorted(map(tuple, f(g).collect())) for f in (graph.components, graph.scc)] == want


def test_communities_make_the_edges_a_few_times(spark):
    ring = [(12 * r + i, 12 * r + (i + 1) % 12, 1.0) for r in range(4) for i in range(12)]
    g, made = counted(spark, make(spark, 49, ring))
    part = graph.louvain(g)
    assert part.count() == 49 and {r.community for r in part.where("id = 'c48'").collect()} == {"c48"}
    assert made.value <= 4 * len(ring)  # for the totals, the degrees and the ways; every sweep made them anew before
    assert graph.modularity(g, part).first()[0] > 0.4


def test_turns_are_those_of_spark(spark):
    rows = spark.range(200).selectExpr("concat('o', id) AS id", "cast(id % 7 AS int) AS sweep").selectExpr("xxhash64(id) AS k", "sweep", "pmod(xxhash64(id, sweep), 2L) = 0 AS turn").toPandas()
    for sweep, of in rows.groupby("sweep"):
        assert sweeps.turns(of["k"].to_numpy(), sweep).tolist() == of["turn"].tolist()


def rings(n, m, seed):
    """Edges of ``n`` rings of ``m`` nodes with chords, loops and ways that come twice."""
    rng = random.Random(seed)
    edges = [(m * r + i, m * r + (i + 1) % m, 1.0) for r in range(n) for i in range(m)]
    edges += [(m * r + rng.randrange(m), m * r + rng.randrange(m), rng.choice([0.25, 0.5, 2.0])) for r in range(n) for _ in range(m // 2)]
    return edges + edges[:3]


def test_a_component_in_one_task_moves_as_by_joins(spark):
    g = make(spark, 16, rings(1, 14, 0) + [(3, 99, 0.5), (98, 4, 0.5)])  # and ends that are no nodes
    want = sorted(map(tuple, graph.louvain(g, whole=0).collect()))
    assert sorted(map(tuple, graph.louvain(g).collect())) == want and len(want) == 16


def test_components_large_and_small(spark, monkeypatch):
    monkeypatch.setattr(sweeps, "PORTION", 7)
    g = make(spark, 60, rings(5, 9, 3) + [(45 + i, 46 + i, 1.0) for i in range(10)])
    whole, mixed = (graph.louvain(g, whole=limit) for limit in (1 << 17, 10))
    assert [(p.count(), p.select("id").distinct().count()) for p in (whole, mixed)] == [(60, 60), (60, 60)]
    # each component of a task keeps its own best state, so the whole isn't below one state for all large ones
    assert graph.modularity(g, whole).first()[0] >= graph.modularity(g, mixed).first()[0] - 1e-9
    monkeypatch.setattr(graph, "_key", lambda c: F.pmod(F.xxhash64(c), F.lit(2)))  # keys that ids share
    other = graph.louvain(g)
    assert other.select("id").distinct().count() == 60 == other.count() and graph.modularity(g, other).first()[0] > 0.4


def test_sweeps_of_small_components_store_nothing(spark, monkeypatch):
    g, stored = make(spark, 48, [(12 * r + i, 12 * r + (i + 1) % 12, 1.0) for r in range(4) for i in range(12)]), cuts(monkeypatch)
    assert graph.louvain(g).count() == 48
    assert len(stored) < 10  # two or more a sweep before
