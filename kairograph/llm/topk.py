"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

The table is put in order of descending length once and stored in blocks, each
with its greatest length, its vectors, their leading coordinates after a
rotation by the singular vectors of the whole table, and the lengths of what is
left.  Queries come in groups.  The first block, which holds the longest
vectors, gives their first thresholds; blocks whose greatest length can't reach
the threshold of any query of the group (Cauchy-Schwarz) aren't read.  In a
block, a query whose threshold is out of reach is put aside; for the others the
leading coordinates are multiplied first, the rest is bounded by the product of
the residual lengths, and only pairs whose bound reaches the threshold get their
whole product, over the unrotated integers.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import shared_dir, stored

SCALE = 256
#: Vectors in a block, and in a step of the search.
BLOCK, TILE = 2048, 512
#: Pairs that are scored exactly at once.
PAIRS = 1 << 14

#: Room for rounding of the rotated products; survivors are scored exactly.
SLACK = 1e-9


def integer_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, norm``: floor(scale * x) of each component; vectors that are null or hold null, NaN or infinite components are left out."""
    raw = F.col("embedding").cast("array<double>")
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & fine)
    # floor() of a double is a long in Spark, which holds every whole double below 2^63
    v = F.transform(raw, lambda x: F.floor(x * float(scale)).cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, width))
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of the table, leading ones first, from the sum of its partitions' Gram matrices."""

    def gram(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            x = _matrix(pdf["v"], width)
            total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "g": total.ravel()})

    parts = vectors.select("v").mapInPandas(gram, "i int, j int, g double")
    sums = parts.groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()  # width x width numbers
    whole = np.zeros((width, width))
    whole[sums["i"], sums["j"]] = sums["g"]
    return np.linalg.eigh(whole)[1][:, ::-1]


def in_blocks(vectors: DataFrame, width: int, turn: np.ndarray, rows: int = BLOCK) -> DataFrame:
    """``top, ids, rows, x, lead, rest``: blocks of vectors in order of descending length, as packed arrays."""
    lead = max(1, width // 2)

    def pack(batches):
        left = None
        for pdf in batches:
            left = pdf if left is None or not len(left) else pd.concat([left, pdf], ignore_index=True)
            while len(left) >= rows:
                yield packed(left.iloc[:rows])
                left = left.iloc[rows:]
        if left is not None and len(left):
            yield packed(left)

    def packed(pdf):
        x = _matrix(pdf["v"], width)
        turned = x @ turn
        rest = np.sqrt((turned[:, lead:] ** 2).sum(axis=1))
        one = (float(pdf["norm"].iloc[0]), pdf["vec_id"].to_numpy(np.int64).tobytes(), pdf["row"].to_numpy(np.int64).tobytes(), x.tobytes(), np.ascontiguousarray(turned[:, :lead]).tobytes(), rest.tobytes())
        return pd.DataFrame([one], columns=["top", "ids", "rows", "x", "lead", "rest"])

    order = [F.desc("norm"), F.col("vec_id"), F.col("row")]
    ordered = vectors.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "row", "norm", "v")
    return stored(ordered.mapInPandas(pack, "top double, ids binary, rows binary, x binary, lead binary, rest binary"), "topk")


class Search:
    """The best that a group of queries has found so far."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int):
        self.queries, self.rows, self.least, self.k = queries, rows, floor.copy(), k
        self.lead = max(1, queries.shape[1] // 2)
        turned = queries @ turn
        self.turned = turned[:, : self.lead]
        self.rest = np.sqrt((turned[:, self.lead :] ** 2).sum(axis=1))
        self.norm = np.sqrt((queries * queries).sum(axis=1))
        shape = (len(queries), k)
        self.score, self.id, self.row = np.full(shape, -np.inf), np.full(shape, np.iinfo(np.int64).max), np.full(shape, np.iinfo(np.int64).max)

    def see(self, block) -> None:
        """Look through one block."""
        ids, rows = np.frombuffer(block.ids, np.int64), np.frombuffer(block.rows, np.int64)
        x, lead = np.frombuffer(block.x).reshape(len(ids), -1), np.frombuffer(block.lead).reshape(len(ids), -1)
        rest, norms = np.frombuffer(block.rest), np.sqrt((x * x).sum(axis=1))
        live = np.arange(len(self.queries))
        for at in range(0, len(x), TILE):
            tile = slice(at, at + TILE)
            live = live[self.norm[live] * norms[at] * (1 + SLACK) + SLACK >= self.least[live]]
            if not len(live):
                break
            bound = self.turned[live] @ lead[tile].T + self.rest[live, None] * rest[None, tile] + SLACK * (self.norm[live, None] * norms[None, tile] + 1)
            q, c = np.nonzero(bound >= self.least[live, None])
            q, c = live[q], at + c
            other = rows[c] != self.rows[q]
            q, c = q[other], c[other]
            if len(q):
                score = np.concatenate([np.einsum("ij,ij->i", self.queries[q[i : i + PAIRS]], x[c[i : i + PAIRS]]) for i in range(0, len(q), PAIRS)])
                self._keep(q, score, ids[c], rows[c])

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        rank = np.lexsort((rows, ids, -score, q))
        q, score, ids, rows = q[rank], score[rank], ids[rank], rows[rank]
        start = np.append(True, q[1:] != q[:-1])
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        short = place < self.k
        q, score, ids, rows, place = q[short], score[short], ids[short], rows[short], place[short]
        hit = np.unique(q)
        at = np.searchsorted(hit, q)
        both = []
        for had, new, none in ((self.score, score, -np.inf), (self.id, ids, np.iinfo(np.int64).max), (self.row, rows, np.iinfo(np.int64).max)):
            fresh = np.full((len(hit), self.k), none, had.dtype)
            fresh[at, place] = new
            both.append(np.hstack([had[hit], fresh]))
        rank = np.lexsort((both[2], both[1], -both[0]), axis=1)[:, : self.k]
        for had, now in zip((self.score, self.id, self.row), both, strict=True):
            had[hit] = np.take_along_axis(now, rank, 1)
        self.least[hit] = np.maximum(self.least[hit], self.score[hit, -1])

    def found(self, query_ids: np.ndarray) -> pd.DataFrame:
        q, r = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"query_id": query_ids[q], "query_row": self.rows[q], "vec_id": self.id[q, r], "row": self.row[q, r], "score": self.score[q, r].astype(np.int64)})


def top_k(table: DataFrame, every: int = 50, k: int = 5, group: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest integer inner products, exactly.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but the query's own, so of rows that repeat a vec_id each asks and
    each is found by the others.  Equal scores go to the smaller vec_id.  A job
    serves ``group`` queries, which are sent to its tasks; with that bound a
    table of any number of queries passes through the driver in parts.  Vectors
    of several lengths count as padded with zeros.  An empty table, or one
    without vectors that take part, gives an empty result.  Products are exact
    while they stay below 2^53.
    """
    vectors = stored(integer_vectors(table).withColumn("row", F.monotonically_increasing_id()), "topk")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 1  # where all are empty every score is 0
    spark = table.sparkSession
    turn = rotation(vectors, width)
    blocks = in_blocks(vectors, width, turn)
    longest = blocks.orderBy(F.desc("top")).first()
    found = "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint"
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    at, groups = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}", 0

    def search(rows: list) -> None:
        """One job: a group of queries against the blocks that can matter; its result is stored, so the driver holds one group at a time."""
        nonlocal groups
        ids, own = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["row"] for r in rows], np.int64)
        q = _matrix(pd.Series([np.array(r["v"]) for r in rows]), width)
        first = Search(q, own, np.full(len(q), -np.inf), turn, k)
        first.see(longest)
        # what ties with the threshold is kept: a smaller vec_id may stand elsewhere
        floor = first.score[:, -1]
        need = np.where(first.norm > 0, floor / np.maximum(first.norm, 1e-300), np.where(floor > 0, np.inf, 0.0)).min()
        sent = spark.sparkContext.broadcast((q, ids, own, floor, turn))

        def run(batches):
            q, ids, own, floor, turn = sent.value
            now = Search(q, own, floor, turn, k)
            for pdf in batches:
                for block in pdf.itertuples(index=False):
                    now.see(block)
            yield now.found(ids)

        read = blocks.where(F.col("top") * (1 + SLACK) + SLACK >= float(need)) if need > 0 else blocks
        kept = read.mapInPandas(run, found).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        kept.write.parquet(f"{at}/group={groups}")
        sent.destroy()
        groups += 1

    pending: list = []
    for row in vectors.where(F.col("vec_id") % every == 0).select("vec_id", "row", "v").toLocalIterator():
        pending.append(row)
        if len(pending) == group:
            search(pending)
            pending = []
    if pending:
        search(pending)
    whole = found + ", rank int"
    out = spark.read.schema(whole).parquet(at) if groups else spark.createDataFrame([], whole)
    return out.select("query_id", "rank", "vec_id", "score")
