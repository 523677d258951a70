"""Vector, keyword and hybrid retrieval."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.errors import DimMismatch
from kairograph.functions.columns import cosine_distance, tokens
from kairograph.plans.planner import CostEstimate, CostEstimator, Strategy
from kairograph.sources.shared import cut

RRF_K = 60
#: Okapi's constants.
K1, B = 1.2, 0.75


def search_vector(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``concept_id, score``: the ``k`` nearest by cosine distance, ties to the smaller id.

    ``vectors`` has ``concept_id, embedding`` of one model.  Retired concepts
    are found too.  Each task keeps ``k`` rows, so little is shuffled.
    """
    first = vectors.select(F.size("embedding").alias("n")).first()
    if first is not None and first["n"] != len(query):
        raise DimMismatch(got=len(query), expected=first["n"], model="")
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("concept_id", cosine_distance("embedding", asked).alias("score")).where("score is not null")
    return scored.orderBy("score", "concept_id").limit(k)


def postings(concepts: DataFrame) -> DataFrame:
    """``term, id, tf, length`` of title and content; retired concepts count in the statistics."""
    words = concepts.select("id", tokens(F.concat_ws(" ", "title", "content")).alias("_t"))
    each = words.select("id", F.size("_t").alias("length"), F.explode("_t").alias("term"))
    return each.groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def keyword_search(index: DataFrame, concepts: DataFrame, query: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """``id, score``: live concepts that hold all of the query's words, by BM25, smaller is better.

    ``index`` is that of :func:`postings`.  A query without words finds nothing.
    """
    spark = index.sparkSession
    terms = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first()["t"]
    if not terms or k <= 0:
        return concepts.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    # concepts without words have no postings, but count; the lengths add up to the terms' frequencies
    total = index.agg(F.sum("tf")).first()[0] or 0
    n = concepts.count()
    own = index.where(F.col("term").isin(terms))
    seen = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a query word
    if len(seen) < len(terms):
        return concepts.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    idf = F.create_map(*[F.lit(x) for t, df in seen.items() for x in (t, _idf(n, df))])
    scored = own.groupBy("id").agg(F.sum(_part(idf[F.col("term")], "tf", total / n, k1, b)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    live = concepts.where("not retired").select("id")
    return scored.where(F.col("_n") == len(terms)).join(live, "id", "left_semi").select("id", (-F.col("_s")).alias("score")).orderBy("score", "id").limit(k)


def _idf(n: int, df: int) -> float:
    return math.log((n - df + 0.5) / (df + 0.5) + 1)


def _part(idf: Column, tf: str | Column, mean: float, k1: float, b: float) -> Column:
    tf = F.col(tf) if isinstance(tf, str) else tf
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))


def keyword_scan(concepts: DataFrame, query: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """:func:`keyword_search` where there is no index: the texts are read once, and only counts of the query's words are kept."""
    spark = concepts.sparkSession
    terms = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first()["t"]
    if not terms or k <= 0:
        return concepts.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    words = concepts.select("id", "retired", tokens(F.concat_ws(" ", "title", "content")).alias("_t"))
    times = lambda term: F.size(F.filter("_t", lambda w: w == term)).alias(f"tf{terms.index(term)}")
    counts = cut(words.select("id", "retired", F.size("_t").alias("length"), *[times(t) for t in terms]), "keywords")
    tf = [F.col(f"tf{i}") for i in range(len(terms))]
    got = counts.agg(F.count(F.lit(1)), F.sum("length"), *[F.sum((x > 0).cast("long")) for x in tf]).first()
    n, total, seen = got[0], got[1], list(got[2:])
    if not all(seen):
        return counts.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    score = sum((_part(F.lit(_idf(n, df)), x, total / n, k1, b) for x, df in zip(tf, seen, strict=True)), F.lit(0.0))
    hits = counts.where(~F.col("retired") & F.least(F.lit(1), *tf).cast("boolean"))
    return hits.select("id", (-score).alias("score")).orderBy("score", "id").limit(k)


def ranked(hits: DataFrame, id_: str = "id") -> DataFrame:
    """``id, rank`` of a list of hits (``score``), from 1; the list is short."""
    own = Window.orderBy("score", id_)
    return hits.select(F.col(id_).alias("id"), F.row_number().over(own).alias("rank"))


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, k: int = RRF_K) -> DataFrame:
    """``id, score, vector_rank, keyword_rank`` of two ranked lists (``id, rank``); larger is better."""
    x, y = a.toDF("id", "vector_rank"), b.toDF("_id", "keyword_rank")
    both = x.join(y, x["id"] == y["_id"], "full")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.select(F.coalesce("id", "_id").alias("id"), (part("vector_rank") + part("keyword_rank")).alias("score"), "vector_rank", "keyword_rank")


def hybrid_search(vectors: DataFrame, index: DataFrame | None, concepts: DataFrame, query: list[float], text: str, k: int, depth: int | None = None) -> DataFrame:
    """Fusion of both arms, each read to ``depth`` (5 k, 50 at least); without an ``index`` the texts are scanned."""
    depth = max(5 * k, 50) if depth is None else depth
    near = ranked(search_vector(vectors, query, depth), "concept_id")
    words = ranked(keyword_scan(concepts, text, depth) if index is None else keyword_search(index, concepts, text, depth))
    return reciprocal_rank_fusion(near, words).orderBy(F.desc("score"), "id").limit(k)


@dataclass(frozen=True)
class FilteredSearch:
    """Nearest vectors among the nodes that a traversal reaches.

    With a ``byte_budget`` more candidates than fit are refused; by default
    they are joined, however many they are.
    """

    k: int
    byte_budget: int | None = None
    strategy: Strategy | None = None

    def within(self, **changes) -> FilteredSearch:
        return replace(self, **changes)

    def run(self, vectors: DataFrame, candidates: DataFrame, query: list[float]) -> tuple[DataFrame, CostEstimate]:
        """``concept_id, score`` and the estimate. Both strategies are exact; post-filtering falls back where it comes up short."""
        n = candidates.count()
        estimate = CostEstimator(self.byte_budget, vectors.count(), 4 * len(query)).estimate(self.k, n)
        ids = candidates.select(F.col("id").cast("string").alias("concept_id"))
        if (self.strategy or estimate.strategy) is Strategy.POST_FILTER:
            deep = search_vector(vectors, query, estimate.k_prime)
            kept = deep.join(ids, "concept_id", "left_semi").orderBy("score", "concept_id").limit(self.k)
            if kept.count() == min(self.k, n):
                return kept, estimate
        return search_vector(vectors.join(ids, "concept_id", "left_semi"), query, self.k), estimate
