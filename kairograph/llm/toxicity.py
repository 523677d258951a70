"""Toxicity by weak supervision.

1. *Voters*: single words of a fixed lexicon, words and word beginnings that
   labelled rows show to be toxic, and patterns (density, shouting, repetition).
2. *Label model*: a generative model of the votes alone, whose class means are
   the voters' accuracies and whose shared covariance holds their correlations,
   so that voters that vote together count once.  It starts from a plain count
   of votes and is refined by EM over all documents.
3. *Classifier*: a logistic regression over text features, fitted to the label
   model's posterior labels of documents, whether these have a label or not.

Labels only serve to find toxic words (of all rows that aren't held out); those of the
held-out third are never read.  lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import bucketed, packed, stored

#: Insults (fixed values).
LEXICON = (
    "clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron",
    "pathetic", "scum", "stupid", "trash", "vermin", "worthless",
)

#: Letters of a word beginning.
STEM = 7
#: Twice the log likelihood ratio from which a word's share of toxic rows isn't chance, which brings one word in some 200,000 so far.
SURE = 21.0
EM_ROUNDS = 3
THRESHOLD = 0.7

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_SHINGLE = 4


def fold() -> Column:
    """crc32(doc_id as text) mod 3; 1 is held out. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD).split()


def _distinct_words(batches):
    """Signature of the text (near copies mostly share it) and its distinct words, sorted and joined by spaces."""
    for pdf in batches:
        signs, bags = [], []
        for text in pdf["text"]:
            words = words_of(text.encode("utf-8", "surrogatepass"))
            shingles = set(zip(*(words[i:] for i in range(_SHINGLE)))) or {tuple(words)}  # noqa: B905
            hashes = [xxhash.xxh64_intdigest(b" ".join(s)) for s in shingles]
            signs.append(xxhash.xxh64_intdigest(f"{min(hashes)} {max(hashes)}") >> 1)
            bags.append(b" ".join(sorted(set(words))).decode("utf-8", "replace"))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "sign": np.array(signs, np.int64), "bag": bags})


def learned_terms(docs: DataFrame, labels: DataFrame, sure: float = SURE) -> dict[str, float]:
    """Words, and beginnings (``^``), that toxic rows hold more often than clean ones, with log odds.

    All of ``labels`` (``doc_id, toxic``) outside fold 1 count, and all words
    that are sure enough are kept: that many toxic words people's labels tell
    of, however many documents there are.  The distinct words of the rows are
    stored in buckets of doc_id, where labels come to them, so neither texts nor
    words are shuffled; of near copies the one with the smallest doc_id counts.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1)).select("doc_id", F.col("text").cast("string").alias("text"))
    bags = bucketed(rows.mapInPandas(_distinct_words, "doc_id bigint, sign bigint, bag string"), "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")), "toxicity")
    known = labels.where(fold() != 1)
    first = stored(bags.select("doc_id", "sign").join(known, "doc_id").groupBy("sign", "toxic").agg(F.min("doc_id").alias("doc_id")), "toxicity")
    same = F.col("sign").bitwiseXOR(F.col("_sign")) == 0  # an equality would be a key of the join, for which the buckets of doc_id would be shuffled
    once = stored(bags.join(first.withColumnRenamed("sign", "_sign"), "doc_id").where(same).groupBy("doc_id", "sign", "toxic").agg(F.min("bag").alias("bag")), "toxicity")
    sizes = once.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = float(sizes[0] or 0), float(sizes[1] - (sizes[0] or 0))
    if not toxic or not clean:
        return {}
    words = F.filter(F.split("bag", " "), lambda w: w != "")
    starts = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.concat(F.lit("^"), F.substring(w, 1, STEM))))
    counts = once.select("toxic", F.explode(F.concat(words, starts)).alias("term")).groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    odds = F.log((F.col("p") + 0.3) / (toxic + 1)) - F.log((F.col("n") + 0.3) / (clean + 1))
    part = lambda c, of: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (F.col("p") + F.col("n")) * ((toxic + clean) / of))).otherwise(0.0)
    ratio = 2 * (part("p", toxic) + part("n", clean))
    kept = counts.where("p >= 3").withColumn("odds", odds).where((F.col("odds") > 1.5) & (ratio > sure))
    return {r["term"]: min(r["odds"], 6.0) for r in kept.select("term", "odds").toLocalIterator()}


def voter_names() -> list[str]:
    return [f"word {w}" for w in LEXICON] + [
        "lexicon", "lexicon twice", "learned word", "learned words", "learned words, many", "learned beginning", "learned beginnings",
        "dense", "very dense", "strong evidence", "shouting", "repetition", "nothing found",
    ]


def describe(raw: bytes, learned: dict[bytes, float], stems: dict[bytes, float]) -> tuple[list[float], list[float]]:
    """Votes (1 toxic, -1 clean, 0 none) and features of a text."""
    words = words_of(raw)
    own = set(words)
    n = len(words)
    fixed = [w.encode() in own for w in LEXICON]
    hits = sum(fixed)
    odds = sorted((learned[w] for w in own if w in learned), reverse=True)
    starts = [stems[k] for w in own if (k := w.decode("utf-8", "replace")[:STEM].encode()) in stems] if stems else []
    strong = sum(x > 3 for x in odds)
    density = 100 * (hits + strong) / max(n, 20)
    shout = raw.count(b"!") / max(n, 1)
    upper = len(raw.translate(None, _NOT_UPPER)) / max(len(raw), 1)
    repeated = 1 - len(own) / max(n, 1)
    evidence = sum(odds) + 4 * hits
    votes = [float(x) for x in fixed] + [
        float(hits > 0), float(hits > 1), float(len(odds) > 0), float(len(odds) > 1), float(len(odds) > 3), float(len(starts) > 0), float(len(starts) > 1),
        float(density > 0.7), float(density > 2), float(evidence > 8), float(shout > 0.3), float(repeated > 0.9),
        -float(not hits and not odds and not starts),
    ]
    features = [
        float(hits > 0), np.log1p(hits), float(hits > 1), np.log1p(sum(odds)), odds[0] if odds else 0.0, float(strong > 0), np.log1p(strong), float(strong > 1),
        np.log1p(sum(starts)), np.log1p(len(starts)), np.log1p(density), np.log1p(evidence), shout, upper, repeated, np.log1p(n) / 5,
    ]
    return votes, features


def _describe(sent):
    def run(batches):
        terms = sent.value
        learned = {t.encode(): x for t, x in terms.items() if t[0] != "^" and t not in LEXICON}
        stems = {t[1:].encode(): x for t, x in terms.items() if t[0] == "^"}
        for pdf in batches:
            both = [describe(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"", learned, stems) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "votes": [x for x, _ in both], "features": [x for _, x in both]})

    return run


def _moments(weights: np.ndarray, bias: float):
    """Sums over a partition: class sizes, class sums of votes, products of votes."""

    def run(batches):
        total = None
        for pdf in batches:
            v = np.array(pdf["votes"].tolist(), float)
            p = posterior(v, weights, bias)
            now = np.concatenate([[p.sum(), len(p)], p @ v, (1 - p) @ v, (v.T @ v).ravel()])
            total = now if total is None else total + now
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

    return run


def posterior(votes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Chance that each row of votes is of a toxic text."""
    return 1 / (1 + np.exp(-np.clip(votes @ weights + bias, -30, 30)))


def _summed(votes: DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    m = len(voter_names())
    out = np.zeros(2 + 2 * m + m * m)
    for r in votes.mapInPandas(_moments(weights, bias), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # as many numbers as votes squared
        out[r["i"]] = r["x"]
    return out


def label_model(votes: DataFrame, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of the votes' log odds, from accuracies and correlations; ``votes`` has ``votes`` and no labels.

    At first a text is toxic where several voters say so.  Where a round leaves
    one class empty, the weights stay as they were.
    """
    m = len(voter_names())
    weights, bias = np.ones(m), -2.5
    for _ in range(rounds):
        s = _summed(votes, weights, bias)
        weights, bias = refined(s[0], s[1], s[2 : 2 + m], s[2 + m : 2 + 2 * m], s[2 + 2 * m :].reshape(m, m), weights, bias)
    return weights, bias


def refined(toxic: float, n: float, up: np.ndarray, down: np.ndarray, products: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """One round's weights and bias from the size of the toxic class and of all, class sums of votes and sums of products."""
    if toxic < 1 or n - toxic < 1:
        return weights, bias
    a, b = up / toxic, down / (n - toxic)
    cov = products / n - (toxic * np.outer(a, a) + (n - toxic) * np.outer(b, b)) / n
    cov += np.eye(len(a)) * (0.02 + 1 / n)
    weights = np.linalg.solve(cov, a - b)
    return weights, float(-0.5 * (a + b) @ weights + np.log(toxic / (n - toxic)))


def _newton(w: np.ndarray, weights: np.ndarray, bias: float):
    """Sums over a partition for a Newton step from ``w``: gradient and curvature, targets being posteriors of the votes."""

    def run(batches):
        total = None
        for pdf in batches:
            x = np.column_stack([np.array(pdf["features"].tolist(), float), np.ones(len(pdf))])
            target = posterior(np.array(pdf["votes"].tolist(), float), weights, bias)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            now = np.concatenate([x.T @ (target - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            total = now if total is None else total + now
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

    return run


def fit_logistic(rows: DataFrame, weights: np.ndarray, bias: float, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, bias of a logistic regression of ``features`` on the posteriors of ``votes``, by Newton steps over all ``rows``; none without rows."""
    w = None
    for _ in range(50):
        if w is None:
            one = rows.first()
            if one is None:
                return np.zeros(1)
            w = np.zeros(len(one["features"]) + 1)
            penalty = np.full(len(w), ridge)
            penalty[-1] = 1e-6
        sums = np.zeros(len(w) + len(w) ** 2)
        for r in rows.mapInPandas(_newton(w, weights, bias), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # as many numbers as features squared
            sums[r["i"]] = r["x"]
        step = np.linalg.solve(sums[len(w) :].reshape(len(w), len(w)) + np.diag(penalty), sums[: len(w)] - penalty * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """``doc_id, text_key, held_out, score, predicted`` of every row of ``docs``.

    ``labels`` has ``doc_id, toxic``; several labels of one doc_id count as
    toxic if one is, null labels and null doc_ids don't count.  Toxic words come
    from all labelled rows that aren't held out; the label model is made from
    the votes on all rows; all rows that aren't held out (``fit_rows`` of them by
    the order of a hash, if it is given) fit the classifier to its posterior
    labels.  Texts of any length are read
    whole.  Rows that repeat get the same score; null and empty texts get that
    of a text in which nothing was found.  Without labels the lexicon alone
    decides; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    terms = spark.sparkContext.broadcast(learned_terms(rows, known.where(fold() != 1)))
    described = stored(rows.mapInPandas(_describe(terms), "doc_id bigint, text_key bigint, votes array<double>, features array<double>"), "toxicity")
    weights, bias = label_model(described)
    fit = described.where(fold() != 1)
    if fit_rows is not None:
        fit = stored(fit.orderBy(F.xxhash64("doc_id", "text_key")).limit(fit_rows), "toxicity")
    model = fit_logistic(fit.select("votes", "features"), weights, bias)
    # one array of size + 1 numbers
    total = F.aggregate(F.zip_with("features", F.array(*[F.lit(float(w)) for w in model[:-1]]).cast("array<double>"), lambda a, b: a * b), F.lit(float(model[-1])), lambda t, x: t + x)
    score = 1 / (1 + F.exp(-total))
    return described.select("doc_id", "text_key", (fold() == 1).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns.

    Rows with null texts or ids are judged like others; repeated rows stay or
    go together; columns may have any names; an empty table gives none.
    """
    bad = scored(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key")).distinct()
    kept = packed(docs).join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_key") == F.col("_bad_key")), "left_anti")
    return kept.select("_row.*")
