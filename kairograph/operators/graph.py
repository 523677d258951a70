"""Traversal, subgraphs and graph analytics over edges as DataFrames.

Edges have ``source_id, target_id, edge_type, weight, valid_from, valid_to``.
Iterations move a frontier over joins; each round's frontier is written to the
shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from kairograph.errors import NegativeEdgeWeight, SubgraphTooLarge
from kairograph.functions.columns import edge_filter, instant, valid_at, weight_ok
from kairograph.operators import sweeps as arrays
from kairograph.operators.numbering import numbered
from kairograph.operators.temporal import Mode, hydrate, resolved_mode
from kairograph.sources.shared import bucketed, cut

DEFAULT_BYTE_BUDGET = 64 << 20
#: So many ways that are left of a contraction are joined in one task, which saves its last, small rounds.
FEW_WAYS = 1 << 17
#: Weak components of at most so many ways have their communities found in one task.
WHOLE_WAYS = 1 << 17


@dataclass(frozen=True)
class Traversal:
    """A bounded walk along edges that are valid at one instant.

    ``as_of`` None is the instant that the call gives as now.  An empty list of
    types lets all types through.
    """

    max_depth: int = 3
    edge_types: tuple[str, ...] = ()
    min_weight: float | None = 0.0
    as_of: str | None = None
    attribute_mode: Mode | None = None

    def within(self, **changes) -> Traversal:
        return replace(self, **changes)


def valid_edges(current: DataFrame, ts: str, min_weight: float | None = None, edge_types: Iterable[str] = ()) -> DataFrame:
    return current.where(valid_at(instant(ts)) & edge_filter(min_weight, edge_types))


def walk(start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """``id, depth`` of the nodes within ``max_depth`` steps of ``start`` (``id``), with the least depth.

    The frontier holds nodes that were not seen before, so parallel paths and
    cycles don't multiply.
    """
    seen = frontier = start.select("id").distinct().withColumn("depth", F.lit(0))
    ways = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("_to")).distinct()
    for depth in range(1, max_depth + 1):
        reached = frontier.join(ways, "id").select(F.col("_to").alias("id")).distinct()
        frontier = cut(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def walk_sql(spark, start: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """:func:`walk` as one recursive query, for shallow walks over small frontiers: the session limits its depth and rows."""
    start.select("id").createOrReplaceTempView("_walk_start")
    edges.select("source_id", "target_id").distinct().createOrReplaceTempView("_walk_edges")
    return spark.sql(f"""
      WITH RECURSIVE reached(id, depth) AS (
        SELECT id, 0 FROM _walk_start
        UNION ALL
        SELECT DISTINCT e.target_id, r.depth + 1 FROM reached r JOIN _walk_edges e ON e.source_id = r.id WHERE r.depth < {int(max_depth)}
      ) SELECT id, min(depth) AS depth FROM reached GROUP BY id""")


def traverse_ids(how: Traversal, start: DataFrame, current: DataFrame, concepts: DataFrame, now: str) -> DataFrame:
    """``id`` of the live concepts that the walk reaches, the start included.

    Retired concepts are walked through but not returned; whether one is
    retired is today's state whatever ``as_of`` is.
    """
    edges = valid_edges(current, how.as_of or now, how.min_weight, how.edge_types)
    reached = walk(start, edges, how.max_depth)
    return reached.select("id").join(concepts.where("not retired").select("id"), "id", "left_semi")


def traverse(how: Traversal, start: DataFrame, current: DataFrame, concepts: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """The reached concepts with their attributes."""
    mode = resolved_mode(how.as_of, how.attribute_mode)
    return hydrate(traverse_ids(how, start, current, concepts, now), mode, concepts, log, how.as_of or now)


@dataclass(frozen=True)
class Subgraph:
    """``nodes`` (id, ...) and ``edges`` whose ends are both nodes."""

    nodes: DataFrame
    edges: DataFrame

    def degrees(self) -> DataFrame:
        """``id, degree, weighted_degree`` of all nodes; a self-loop counts twice."""
        ends = self.edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), "weight")
        sums = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
        return self.nodes.select("id").join(sums, "id", "left").na.fill(0)

    def totals(self) -> DataFrame:
        """One row: ``edge_count, total_weight``."""
        return self.edges.agg(F.count(F.lit(1)).alias("edge_count"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))

    def out_edges(self, node: str) -> DataFrame:
        return self.edges.where(F.col("source_id") == node)

    def in_edges(self, node: str) -> DataFrame:
        return self.edges.where(F.col("target_id") == node)

    def node(self, node: str) -> Row | None:
        """The node's row, None where there is none."""
        return self.nodes.where(F.col("id") == node).first()

    def with_nodes(self, nodes: DataFrame) -> Subgraph:
        """Also with ``nodes``, whose rows take the place of those of the same id."""
        old = self.nodes.join(nodes.select("id"), "id", "left_anti")
        return replace(self, nodes=old.unionByName(nodes.dropDuplicates(["id"]), allowMissingColumns=True))

    def with_edges(self, edges: DataFrame) -> Subgraph:
        """Also with those of ``edges`` both ends of which are nodes."""
        return replace(self, edges=self.edges.unionByName(closed(self.nodes, edges), allowMissingColumns=True))

    def __contains__(self, node: str) -> bool:
        return self.node(node) is not None

    def __len__(self) -> int:
        """Number of nodes."""
        return self.nodes.count()

    def __bool__(self) -> bool:
        """A graph is one without nodes too; asking starts no job."""
        return True

    def __iter__(self) -> Iterator[str]:
        """Ids in order, fetched a partition at a time."""
        return (r["id"] for r in self.nodes.select("id").orderBy("id").toLocalIterator())

    def to_dict(self, budget: int = DEFAULT_BYTE_BUDGET) -> dict[str, dict]:
        """``nodes`` by id and rows of edges by source (``out_adj``) and target (``in_adj``), on the driver; more than ``budget`` bytes are refused."""
        if (n := self.estimated_bytes()) > budget:
            raise SubgraphTooLarge(n=n, budget=budget)
        out = {"nodes": {r["id"]: r for r in self.nodes.orderBy("id").collect()}, "out_adj": {}, "in_adj": {}}
        for r in self.edges.orderBy("source_id", "target_id", "edge_type").collect():
            out["out_adj"].setdefault(r["source_id"], []).append(r)
            out["in_adj"].setdefault(r["target_id"], []).append(r)
        return out

    def is_closed(self) -> bool:
        return self.edges.count() == closed(self.nodes, self.edges).count()

    def estimated_bytes(self) -> int:
        """Bytes of ids and of what comes with them, were the graph collected."""
        nodes = self.nodes.agg(F.sum(F.octet_length("id") + 48)).first()[0] or 0
        edges = self.edges.agg(F.sum(F.octet_length("source_id") + F.octet_length("target_id") + F.octet_length("edge_type") + 64)).first()[0] or 0
        return int(nodes + edges)


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both ends of which are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def load_subgraph(how: Traversal, start: DataFrame, current: DataFrame, concepts: DataFrame, now: str, budget: int | None = None) -> Subgraph:
    """The walk's nodes, all valid edges out of them, and the far ends of these.

    Edges are taken out of the last nodes too, so the graph reaches one step
    further than the walk.  Only live concepts are nodes.  ``as_of`` and the
    attribute mode don't matter here: a subgraph is of ``now``.
    """
    edges = valid_edges(current, now, how.min_weight, how.edge_types)
    reached = walk(start, edges, how.max_depth).select(F.col("id").alias("source_id"))
    out = edges.join(reached, "source_id", "left_semi").select("source_id", "target_id", "edge_type", "weight", "valid_from", "valid_to")
    bad = out.where(~weight_ok()).first()
    if bad is not None:
        raise NegativeEdgeWeight(source_id=bad["source_id"], target_id=bad["target_id"], weight=bad["weight"])
    ends = reached.select(F.col("source_id").alias("id")).union(out.select("target_id")).distinct()
    nodes = concepts.where("not retired").join(ends, "id", "left_semi")
    graph = Subgraph(nodes.select("id", "title", "embedding_model", "valid_from", "valid_to"), closed(nodes, out))
    if budget is not None and (n := graph.estimated_bytes()) > budget:
        raise SubgraphTooLarge(n=n, budget=budget)
    return graph


def dijkstra(graph: Subgraph, start: str) -> DataFrame:
    """``id, distance`` of the nodes that ``start`` reaches.

    Rounds of relaxation from the nodes that got nearer, over edges that are
    stored once and stay where they are; for weights that aren't negative their end has the distances of Dijkstra's algorithm, bit
    for bit, as rounded addition keeps the order.
    """
    best = frontier = cut(graph.nodes.where(F.col("id") == start).select("id").distinct().withColumn("distance", F.lit(0.0)), "dijkstra")
    ways = bucketed(graph.edges.select("source_id", "target_id", "weight"), "source_id", "dijkstra")
    while True:
        if frontier.isEmpty():
            return best
        near = (
            frontier.join(ways, frontier["id"] == ways["source_id"])
            .groupBy(F.col("target_id").alias("id"))
            .agg(F.min(F.col("distance") + F.col("weight")).alias("near"))
        )
        better = near.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("near") < F.col("distance")))
        frontier = cut(better.select("id", F.col("near").alias("distance")), "dijkstra")
        best = cut(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier), "dijkstra")


def shortest_path(graph: Subgraph, start: str, goal: str, heuristic: Callable[[Column], Column] | None = None) -> tuple[float, list[str]] | None:
    """Cost and nodes of a cheapest path, None without one.

    ``heuristic`` maps the id column to a lower bound of the way left; it prunes
    nodes that can't be on a path cheaper than the one found so far.  Of equal
    paths the one with the smallest ids, seen from the goal, is given.
    """
    ends = {r["id"] for r in graph.nodes.where(F.col("id").isin(start, goal)).select("id").collect()}
    if ends != {start, goal}:
        return None
    left = F.lit(0.0) if heuristic is None else heuristic(F.col("id"))
    ways = bucketed(graph.edges.select("source_id", "target_id", "weight"), "source_id", "path")
    best = frontier = cut(graph.nodes.where(F.col("id") == start).select("id").distinct().withColumn("distance", F.lit(0.0)), "path")
    cost = 0.0 if start == goal else float("inf")
    while True:
        if frontier.isEmpty():
            break
        near = frontier.join(ways, frontier["id"] == ways["source_id"]).groupBy(F.col("target_id").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("near"))
        better = near.where(F.col("near") + left <= cost).join(best, "id", "left").where(F.col("distance").isNull() | (F.col("near") < F.col("distance")))
        frontier = cut(better.select("id", F.col("near").alias("distance")), "path")
        best = cut(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier), "path")
        hit = frontier.where(F.col("id") == goal).first()
        cost = min(cost, hit["distance"]) if hit else cost
    if cost == float("inf"):
        return None
    path = [goal]
    at = cost
    while path[-1] != start:
        back = (
            ways.where(F.col("target_id") == path[-1])
            .join(best, ways["source_id"] == best["id"])
            .where((F.col("distance") + F.col("weight") == at) & ~F.col("id").isin(path))
            .orderBy("distance", "id")
            .select("id", "distance")
            .first()
        )
        path.append(back["id"])
        at = back["distance"]
    return cost, path[::-1]


def _key(node: str | Column) -> Column:
    """64-bit key of a node: the hash of its id."""
    return F.xxhash64(node)


def _keyed(graph: Subgraph, what: str) -> tuple[DataFrame, DataFrame]:
    """``k, id`` of the nodes and ``a, b`` of the ways between two of them, with keys in place of ids; a pair may come more than once."""
    nodes, ways = _hashed(graph.nodes, graph.edges.where("source_id != target_id").select("source_id", "target_id"), what)
    ways = cut(ways.where("a != b"), what)
    absent = cut(ways.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(nodes.select("k"), "k", "left_anti"), what)
    if not absent.isEmpty():
        ways = cut(_without(ways, absent), what)
    return nodes, ways


def _hashed(nodes: DataFrame, edges: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """``k, id`` of the nodes, and the edges with ``a, b``, the keys of their ends, in place of ids.

    Should two ids share a key, nodes are numbered and keys are hashes of
    numbers, of which no two are alike.  An end that isn't a node has a key that
    no node has, or null.
    """
    more = [c for c in edges.columns if c not in ("source_id", "target_id")]
    nodes = cut(nodes.select(_key("id").alias("k"), "id"), what)
    # a second hash tells ids of one key apart
    other = nodes.groupBy("k").agg(F.min(F.xxhash64(F.lit(1), "id")).alias("x"), F.max(F.xxhash64(F.lit(1), "id")).alias("y"))
    if other.where("x != y").isEmpty():
        return nodes, edges.select(_key("source_id").alias("a"), _key("target_id").alias("b"), *more)
    told = cut(numbered(nodes.select("id").distinct(), "id", 0, "n").select("id", F.xxhash64("n").alias("k")), what)
    nodes = cut(nodes.select("id").join(told, "id").select("k", "id"), what)
    return nodes, edges.join(told.toDF("source_id", "a"), "source_id", "left").join(told.toDF("target_id", "b"), "target_id", "left").select("a", "b", *more)


def _without(ways: DataFrame, gone: DataFrame) -> DataFrame:
    """Ways no end of which is in ``gone`` (k)."""
    return ways.join(gone.select(F.col("k").alias("a")), "a", "left_anti").join(gone.select(F.col("k").alias("b")), "b", "left_anti").select("a", "b")


def _contracted(ways: DataFrame, what: str) -> DataFrame:
    """``k, root`` of every end of ``ways`` (a, b): two nodes have one root if they hang together, whatever the ways' directions.

    In a round every node goes to the least of itself and its neighbours, and
    ways between nodes that went to one place fall away, so that a round is a
    fixed part smaller than the one before, however long chains are (Boegeholz
    et al., 2020).  Keys are hashes and each round takes other bits of them
    first, which makes its order one of chance.
    """
    levels: list[DataFrame] = []
    while (n := ways.count()) > FEW_WAYS:
        turn = 13 * len(levels) % 64
        both = ways.select("a", "b").union(ways.select("b", "a"))
        least = both.groupBy("a").agg(F.min(_spun("b", turn)).alias("m"))
        level = cut(least.select("a", _spun(F.least("m", _spun("a", turn)), 64 - turn).alias("r")), what)
        at_a, at_b = level.toDF("a", "x"), level.toDF("b", "y")
        moved = ways.join(at_a, "a").select("b", "x").join(at_b, "b").where("x != y")
        ways = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), what)
        levels.append(level)
    root = cut(ways.select("a", "b").coalesce(1).mapInPandas(_joined, "k long, root long"), what) if n else ways.select(F.col("a").alias("k"), F.col("b").alias("root"))
    while levels:
        level = levels.pop().toDF("k", "_r")
        root = cut(level.join(root.toDF("_r", "root"), "_r", "left").select("k", F.coalesce("root", "_r").alias("root")), what)
    return root


def _joined(batches):
    """Union-find over a few ways: every end and the least end it hangs together with."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    if up:
        yield pd.DataFrame({"k": list(up), "root": [top(x) for x in list(up)]}, dtype="int64")


def _spun(key: str | Column, bits: int) -> Column:
    """The key's 64 bits turned to the left."""
    c = F.col(key) if isinstance(key, str) else key
    return c if bits % 64 == 0 else F.shiftleft(c, bits).bitwiseOR(F.shiftrightunsigned(c, 64 - bits))


def _told(nodes: DataFrame, root: DataFrame, name: str, what: str) -> DataFrame:
    """``id`` of the nodes and, as ``name``, the smallest id of those with the same root; a node without a root is alone."""
    placed = cut(nodes.join(root, "k", "left").select("id", F.coalesce("root", "k").alias("_root")), what)
    return placed.join(placed.groupBy("_root").agg(F.min("id").alias(name)), "_root").select("id", name)


def components(graph: Subgraph) -> DataFrame:
    """``id, root``: weakly connected components, named by their smallest id."""
    nodes, ways = _keyed(graph, "components")
    return _told(nodes, _contracted(ways, "components"), "root", "components")


def _spread(label: DataFrame, ways: DataFrame) -> DataFrame:
    """Least mark that reaches each node along ``ways`` (a, b) without leaving the part, from ``label`` (k, part, mark), where a mark is its node's key."""
    while True:
        inside = ways.join(label, ways["a"] == label["k"]).select("b", F.col("part").alias("_part"), "mark")
        near = inside.groupBy("b", "_part").agg(F.min("mark").alias("near"))
        hop = cut(
            label.join(near, (label["k"] == near["b"]) & (label["part"] == near["_part"]), "left").select("k", "part", F.least("mark", F.coalesce("near", "mark")).alias("low"), F.col("mark").alias("was")),
            "scc",
        )
        if hop.where("low != was").isEmpty():
            return label
        # what reaches the mark's node reaches the node, which halves long ways
        jump = hop.select(F.col("k").alias("_at"), F.col("low").alias("_low"))
        label = cut(hop.join(jump, hop["low"] == jump["_at"]).select("k", "part", F.least("low", "_low").alias("mark")), "scc")


def scc(graph: Subgraph) -> DataFrame:
    """``id, component``: strongly connected components, named by their smallest id.

    Nodes without ways in or out are trimmed off.  Where every node of a weak
    component has as many ways in as out, a closed trail takes all of its ways,
    so it is a strong component as it stands.  In the rest, each part is
    coloured with the least key that reaches a node, and nodes from which that
    key's node can be reached back are its component.  What is left goes on in
    parts of equal colour.
    """
    nodes, ways = _keyed(graph, "scc")
    while True:
        ends = cut(_ends(ways), "scc")
        n, dead = ends.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.least("ins", "outs") == 0).cast("long")), F.lit(0))).first()
        if not dead:
            break
        ways = cut(_without(ways, ends.where("least(ins, outs) = 0")), "scc")
        if dead * 10 < n:
            ends = cut(_ends(ways), "scc")
            break
    root = _contracted(ways, "scc")
    uneven = ends.where("ins != outs").select("k")
    if not uneven.isEmpty():
        parts = cut(root.join(uneven, "k").select("root").distinct(), "scc")
        rest = cut(root.join(parts, "root").select("k", F.col("root").alias("part")), "scc")
        inner = ways.join(rest.select(F.col("k").alias("a")), "a", "left_semi").select("a", "b").distinct()
        root = root.join(parts, "root", "left_anti").select("k", "root").unionByName(_coloured(rest, cut(inner, "scc")))
    return _told(nodes, root, "component", "scc")


def _ends(ways: DataFrame) -> DataFrame:
    """``k, ins, outs``: numbers of ways into and out of each node."""
    each = ways.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("b").alias("k"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return each.groupBy("e.k").agg(F.sum("e.i").alias("ins"), F.sum("e.o").alias("outs"))


def _coloured(left: DataFrame, ways: DataFrame) -> DataFrame:
    """``k, root`` of the nodes of ``left`` (k, part) that aren't trimmed off, by colours."""
    done = left.where("false").select("k", F.col("part").alias("root"))
    while not left.isEmpty():
        inner = ways.join(left, ways["a"] == left["k"]).select("a", "b", F.col("part").alias("_p"))
        ways = cut(inner.join(left, (inner["b"] == left["k"]) & (inner["_p"] == left["part"])).select("a", "b"), "scc")
        both = ways.select(F.col("a").alias("k")).intersect(ways.select(F.col("b").alias("k")))
        rest = cut(left.join(both, "k", "left_semi"), "scc")
        colour = _spread(rest.withColumn("mark", F.col("k")), ways)
        start = colour.select("k", F.col("mark").alias("part"), F.col("k").alias("mark"))
        met = _spread(start, ways.select(F.col("b").alias("a"), F.col("a").alias("b")))
        done = done.unionByName(cut(met.where("mark = part").select("k", F.col("part").alias("root")), "scc"))
        left = cut(met.where("mark != part").select("k", "part"), "scc")
    return done


def k_core(graph: Subgraph, k: int) -> DataFrame:
    """``id`` of the largest node set in which each node has ``k`` edge ends or more."""
    nodes, edges = graph.nodes.select("id"), graph.edges.select("source_id", "target_id", "weight")
    while True:
        few = Subgraph(nodes, edges).degrees().where(F.col("degree") < k)
        small = cut(few.select("id"), "core")
        if small.isEmpty():
            return nodes
        nodes = cut(nodes.join(small, "id", "left_anti"), "core")
        edges = cut(closed(nodes, edges), "core")


def modularity(graph: Subgraph, partition: DataFrame) -> DataFrame:
    """One row ``modularity`` of ``partition`` (id, community); nodes without a community are left out, no weight gives 0."""
    part = partition.select("id", "community")
    total = graph.totals().first()["total_weight"]
    ends = part.join(graph.degrees(), "id").groupBy("community").agg(F.sum("weighted_degree").alias("deg"))
    a, b = part.toDF("source_id", "_ca"), part.toDF("target_id", "_cb")
    inner = graph.edges.join(a, "source_id").join(b, "target_id").where("_ca = _cb").groupBy(F.col("_ca").alias("_c")).agg(F.sum("weight").alias("inside"))
    joined = ends.join(inner, ends["community"] == inner["_c"], "left")
    if not total:
        return joined.agg(F.lit(0.0).alias("modularity"))
    term = F.coalesce("inside", F.lit(0.0)) / total - F.pow(F.col("deg") / (2 * total), 2)
    return joined.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("modularity"))


def louvain(graph: Subgraph, sweeps: int = 100, least_gain: float = 1e-12, whole: int = WHOLE_WAYS) -> DataFrame:
    """``id, community``: local moves that raise modularity, until none does.

    All nodes score their neighbours' communities at once, so only a part of
    them moves in a sweep (by a hash of node and sweep), as neighbours that swap
    places would undo each other.  The moves' order differs from a walk over the
    nodes one by one, and so may the partition; its modularity never falls below
    that of single nodes.  Communities are merged no further, which would join
    small true ones.

    Of the rest of the graph a move needs only the total weight, so weak
    components of ``whole`` ways at most are swept each in one task, many of them
    at once; the sweeps of larger ones are sets of joins.
    """
    total = graph.totals().first()["total_weight"]
    if not total:
        return graph.nodes.select("id", F.col("id").alias("community"))
    edges = graph.edges.select("source_id", "target_id", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    nodes, ways = _hashed(graph.nodes.where("id is not null"), edges, "louvain")
    ways = cut(ways, "louvain")
    root = _contracted(ways.where("a != b"), "louvain")
    placed = cut(nodes.join(root, "k", "left"), "louvain")
    tied = ways.select(F.coalesce("a", "b").alias("a"), F.when(F.col("a").isNotNull(), F.col("b")).alias("b"), "weight").join(root.toDF("a", "root"), "a")
    tied = cut(tied, "louvain")
    large = cut(tied.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("root"), "louvain")
    lone, inner = placed.where("root is null"), placed.where("root is not null")
    parts = [lone.select("id", F.col("id").alias("community"))]
    if not large.isEmpty():
        parts.append(_by_joins(Subgraph(inner.join(large, "root").select("id"), graph.edges), total, sweeps, least_gain))
        inner, tied = (part.join(large, "root", "left_anti") for part in (inner, tied))
    kind = F.when(F.col("b").isNull(), arrays.HALF).otherwise(arrays.WAY)
    rows = inner.select("root", "id", F.lit(arrays.NODE).alias("kind"), F.col("k").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("weight")).union(
        tied.select("root", F.lit(None).cast("string"), kind, "a", F.coalesce("b", F.lit(0)), "weight")
    )
    dealt = rows.repartition("root").sortWithinPartitions("root", "id")
    parts.append(cut(dealt.mapInPandas(arrays.communities(total, sweeps, least_gain), "id string, community string"), "louvain"))
    return reduce(DataFrame.union, parts)


def _by_joins(graph: Subgraph, total: float, sweeps: int, least_gain: float) -> DataFrame:
    """:func:`louvain` of nodes that are whole weak components of a graph of weight ``total``; every sweep is a set of joins."""
    # numbers in the order of ids, so that the smaller of two communities stays the one with the smaller name
    nodes = cut(graph.nodes.select("id").repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("k"), "id"), "louvain")
    state = cut(nodes.join(graph.degrees().select("id", F.col("weighted_degree").alias("deg")), "id").select("k", "id", "deg", F.col("k").alias("community")), "louvain")
    ways = graph.edges.select("source_id", "target_id", "weight").join(nodes.toDF("a", "source_id"), "source_id").join(nodes.toDF("b", "target_id"), "target_id").select("a", "b", "weight")
    ways = cut(ways, "louvain")
    loops = ways.where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    pair = ways.where("a != b")
    near = bucketed(pair.union(pair.select("b", "a", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "b", "louvain")
    best, best_score, quiet, top = state, None, 0, None
    for sweep in range(sweeps):
        if top is None:
            top, score = _rated(state, near, total, loops)
            if best_score is None or score > best_score:
                best, best_score = state, score
            wants = top.where((F.col("to") != F.col("was")) & (F.col("gain") > F.greatest(F.col("stay"), F.lit(0.0)) + least_gain))
            if wants.isEmpty():
                return _settled(nodes, best)
        turn = F.pmod(F.xxhash64("id", F.lit(sweep)), F.lit(2)) == 0
        moves = cut(wants.where(turn).select("k", "to"), "louvain")
        if moves.isEmpty():
            quiet += 1
            if quiet == 4:
                break
            continue
        quiet, top = 0, None
        state = cut(state.join(moves, "k", "left").select("k", "id", "deg", F.coalesce("to", "community").alias("community")), "louvain")
    if top is None and _rated(state, near, total, loops)[1] > best_score:
        best = state
    return _settled(nodes, best)


def _rated(state: DataFrame, near: DataFrame, total: float, loops: float) -> tuple[DataFrame, float]:
    """For each node (``k, id, was``) the community ``to`` of its neighbours that it would gain most by, that ``gain`` and what it gains where it is (``stay``); and the modularity as it is."""
    mass = cut(state.groupBy("community").agg(F.sum("deg").alias("mass")), "louvain")
    placed = state.join(mass, "community").select(F.col("k").alias("b"), "community", "mass")
    into = near.join(placed, "b").select("a", "community", "mass", "weight").repartition("a").groupBy("a", "community").agg(F.sum("weight").alias("w"), F.max("mass").alias("mass"))
    scored = into.join(state.select(F.col("k").alias("a"), "id", F.col("community").alias("was"), "deg"), "a")
    own = F.col("community") == F.col("was")
    outside = F.col("mass") - F.when(own, F.col("deg")).otherwise(0.0)
    scored = scored.withColumn("gain", F.col("w") / total - outside * F.col("deg") / (2.0 * total * total))
    top = scored.groupBy("a").agg(
        F.min(F.struct((-F.col("gain")).alias("loss"), F.col("community").alias("to"))).alias("best"),
        F.coalesce(F.max(F.when(own, F.col("gain"))), F.lit(0.0)).alias("stay"),
        F.coalesce(F.max(F.when(own, F.col("w"))), F.lit(0.0)).alias("inside"),
        F.first("was").alias("was"),
        F.first("id").alias("id"),
    )
    top = cut(top.select(F.col("a").alias("k"), "id", "was", "best.to", (-F.col("best.loss")).alias("gain"), "stay", "inside"), "louvain")
    inside = (top.agg(F.sum("inside")).first()[0] or 0.0) / 2 + loops
    return top, inside / total - (mass.agg(F.sum(F.pow(F.col("mass") / (2 * total), 2))).first()[0] or 0.0)


def _settled(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """Communities named by their smallest node, which has the smallest number."""
    part = state.select("id", "community")
    first = state.groupBy("community").agg(F.min("k").alias("k")).join(nodes, "k").select("community", F.col("id").alias("first"))
    return part.join(first, "community").select("id", F.col("first").alias("community"))


def annotations_of(values: DataFrame, label: str, computed_at: str) -> DataFrame:
    """Annotation rows of node values (``id, value``)."""
    return values.select(F.col("id").alias("concept_id"), F.lit(label).alias("label"), F.col("value").cast("string").alias("value"), instant(computed_at).alias("computed_at"))
