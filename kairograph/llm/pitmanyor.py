"""A hierarchical Pitman-Yor language model whose restaurants are the words before.

Model.  Every word has a restaurant of the words that follow it; the first word
of a text follows the end of the one before.  All restaurants share the unigram
restaurant as parent, whose base is uniform over the training words and one
unknown word.  The tables of the restaurants are the parent's customers.
Seatings are sampled by blocked Gibbs draws: all customers of a word in a
restaurant are seated anew at once, or by sweeps where they are very many
(:mod:`kairograph.llm.seating`), and the predictive probabilities are those of
the averaged seatings.

Distribution.  Pairs of words are counted batch by batch and dealt to *buckets*
by the word; pairs of a frequent word are spread over all buckets by the word
before, so no bucket is hot.  Given the totals of its restaurants and the
parent's probabilities, a bucket's pairs are seated without looking at others.
These totals are kept by name at a word's *home* (a bucket number too).  A
*phase* tells the buckets what they need of them, seats and sweeps all pairs,
and brings the tables by restaurant and by dish home, where the parent's
customers are swept; the next phase starts from the new totals.  After the last
one every occurrence is scored in its bucket, and sums by text go back to the
batch it came from.

Buckets and homes are stored once, bucketed by their number, so that each phase
moves only arrays of totals.  Arrays travel as binary columns, their bytes by
place, which compresses well.
"""

from __future__ import annotations

import ctypes
import sys
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import bucketed, stored
from kairograph.llm.seating import mean_tables

DISCOUNT, STRENGTH = 0.8, 4.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 10.0
#: Rounds in which totals are renewed; sweeps over all customers in each, and how many of these are averaged.
PHASES, SWEEPS, KEPT = 3, 4, 2
#: Bytes of text that a bucket gets on average, and that a task takes at once.
BUCKET_BYTES, BATCH_BYTES = 8_000_000, 8_000_000
#: A word that fills more than this part of a bucket is spread over all buckets ...
SPREAD = 0.125
#: ... as told by one document of so many, which moves rows and no results.
SAMPLED = 400
#: Ends every text; no word holds a line feed.
END = b"\n"
SEED = 42


def held_out() -> Column:
    """crc32(doc_id as text) mod 7 is 2. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def _pack(x: np.ndarray, kind: str) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _open(raw: bytes | None, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw or b"", np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _join(parts, kind: str) -> np.ndarray:
    arrays = [_open(p, kind) for p in parts]
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _give_back() -> None:
    """Hand freed memory back to the system: a Python worker lives on, and what it holds is missing elsewhere."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, the end first; of each token its number, the number of the word before, and its text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string(), from_pandas=True).fill_null("")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # a split at either end of a text leaves an empty string
    sizes = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()]) + 1
    words = flat.filter(real).dictionary_encode()
    token = np.zeros(int(sizes.sum()), np.int32)  # the end has number 0
    inside = np.ones(len(token), bool)
    inside[np.cumsum(sizes) - 1] = False
    token[inside] = words.indices.to_numpy() + 1
    distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in chain((END,), distinct)), np.uint64, len(distinct) + 1)
    before = np.zeros_like(token)  # a text begins after an end
    before[1:] = token[:-1]
    return hashes, token, before, np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)


def _names(hashes: np.ndarray) -> np.ndarray:
    """What a restaurant is called: the lower half of its word's hash. Of n words about n / 4.3e9 share a name with another."""
    return hashes.astype(np.uint32)


def _portions(batches):
    """The rows in portions of about :data:`BATCH_BYTES` of text, however many come at once; a longer single text is a portion of its own."""
    held, size = [], 0
    for pdf in batches:
        each = np.array([len(t) if isinstance(t, str) else 0 for t in pdf["text"]], np.int64)
        part = (size + np.cumsum(each) - each) // BATCH_BYTES
        for k in np.unique(part):
            if k and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf[part == k])
        size += int(each.sum()) - int(part[-1]) * BATCH_BYTES if len(part) else 0
    if held:
        yield pd.concat(held, ignore_index=True)


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 256):
    """What is run inside sends fewer rows at a time to Python than the session would, as texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _rows(docs: DataFrame) -> DataFrame:
    """What is read of ``docs``, in an order that only depends on the rows of a partition, so a repeated task deals the same batches."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("null"),
        F.xxhash64("text").alias("key"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"),
    )
    return rows.sortWithinPartitions("id", "null", "key")


def _sampled_words(batches):
    for pdf in batches:
        hashes, token, _, _ = _tokens(pdf["text"])
        n = np.bincount(token, minlength=len(hashes))
        yield pd.DataFrame({"word": hashes.view(np.int64), "n": n})
    _give_back()


def frequent(docs: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of the words that are spread, in order; at most buckets / :data:`SPREAD` of them."""
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLED)) == 0)
    words = some.select("text").mapInPandas(_sampled_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    share = words.crossJoin(F.broadcast(words.agg(F.sum("n").alias("all")))).where(F.col("n") * buckets > F.col("all") * SPREAD)  # one row
    return np.sort(np.array([r["word"] for r in share.select("word").collect()], np.int64).view(np.uint64))


#: A batch's own row: doc_id, whether it is null, text hash and number of tokens of each text.
_HEAD = {"ids": "i8", "nulls": "u1", "keys": "i8", "tokens": "i4"}
#: What a batch says to a bucket: words, pairs of each, restaurant, training and all occurrences of each pair, text of each occurrence.
_DEAL = {"words": "u8", "pairs": "u4", "names": "u4", "train": "u4", "times": "u4", "docs": "u4"}
_DEALT = "bucket int, batch bigint, " + ", ".join(f"{c} binary" for c in (*_HEAD, *_DEAL))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _deal(buckets: int, spread: np.ndarray):
    """Pairs of a batch and the texts they stand in, a row for each bucket, and the batch's own row."""

    def run(batches):
        _give_back()
        for pdf in _portions(batches):
            hashes, token, before, doc = _tokens(pdf["text"])
            head = {"ids": pdf["id"], "nulls": pdf["null"], "keys": pdf["key"], "tokens": np.bincount(doc, minlength=len(pdf))}
            own = {c: _pack(head[c].to_numpy() if c != "tokens" else head[c], k) for c, k in _HEAD.items()}
            batch = xxhash.xxh64_intdigest(own["ids"] + own["keys"] + own["nulls"]) >> 1
            words, word_at = np.unique(hashes, return_inverse=True)
            names, name_at = np.unique(_names(hashes), return_inverse=True)
            wide = np.isin(words, spread)
            word, name = word_at.astype(np.int32)[token], name_at.astype(np.int32)[before]
            del token, before
            # the bucket, then the word, then the restaurant in one number
            pair = _names(words).astype(np.int64)[word]
            if wide.any():
                far = wide[word]
                pair[far] += names[name[far]]
            pair %= buckets
            for by, low in ((len(words), word), (len(names), name)):
                pair *= by
                pair += low
            del word, name
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            at = _runs(pair)
            kept = (~pdf["held_out"].to_numpy(bool)).astype(np.int32)[doc[order]]
            train, times, pair, doc = np.add.reduceat(kept, at), np.diff(np.append(at, len(order))), pair[at], doc[order]
            del order, kept
            name, word = pair % len(names), pair // len(names)
            bucket, word = word // len(words), word % len(words)
            rows, edge = [{"bucket": batch % buckets, "batch": batch, **own}], np.append(_runs(bucket), len(bucket))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                first = _runs(word[i:j])
                said = {
                    "words": words[word[i:j][first]], "pairs": np.diff(np.append(first, j - i)), "names": names[name[i:j]],
                    "train": train[i:j], "times": times[i:j], "docs": doc[at[i] : at[j] if j < len(at) else len(doc)],
                }
                rows.append({"bucket": int(bucket[i]), "batch": batch, **{c: _pack(x, _DEAL[c]) for c, x in said.items()}})
            out = pd.DataFrame(rows, columns=["bucket", "batch", *_HEAD, *_DEAL])
            del rows, pair, doc, train, times, name, word, bucket
            _give_back()
            yield out.astype(object).where(out.notna(), None)

    return run


#: A bucket: its words and the pairs of each; of each pair the restaurant's place among ``names`` and the training count;
#: batch by batch how many pairs and occurrences, the steps between the pairs' numbers, times and texts; heads of batches, with sizes.
_BUCKET = {"words": "u8", "pairs": "u4", "places": "u4", "counts": "i8", "names": "u4"}
_USES = {"batches": "i8", "n_pairs": "i8", "n_docs": "i8", "steps": "u4", "times": "u4", "docs": "u4"}
_HEADS = {"heads": "i8", "sizes": "i8", **_HEAD}
_BUCKETS = "bucket int, " + ", ".join(f"{c} binary" for c in (*_BUCKET, *_USES, *_HEADS))


def _gather_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the counts of all batches together, and what each batch has of its pairs."""
    _give_back()
    pdf = pdf.sort_values("batch", kind="stable")
    head, said = pdf[pdf["ids"].notna()], pdf[pdf["words"].notna()]
    parts = {c: [_open(x, k) for x in said[c]] for c, k in _DEAL.items()}
    flat = {c: np.concatenate(x) if x else np.zeros(0, _DEAL[c]) for c, x in parts.items()}
    words, word = np.unique(flat["words"], return_inverse=True)
    names, place = np.unique(flat["names"], return_inverse=True)
    key, at = np.unique(np.repeat(word, flat["pairs"]) * max(len(names), 1) + place, return_inverse=True)
    n_pairs = np.array([len(x) for x in parts["names"]], np.int64)
    begins = np.append(0, np.cumsum(n_pairs))[:-1]
    steps = np.diff(at, prepend=0)
    steps[begins] = at[begins]
    got = {
        "words": words, "pairs": np.bincount(key // max(len(names), 1), minlength=len(words)), "places": key % max(len(names), 1),
        "counts": np.rint(np.bincount(at, flat["train"], len(key))), "names": names,
        "batches": said["batch"].to_numpy(np.int64), "n_pairs": n_pairs, "n_docs": np.array([len(x) for x in parts["docs"]], np.int64),
        "steps": steps, "times": flat["times"], "docs": flat["docs"],
        "heads": head["batch"].to_numpy(np.int64), "sizes": np.array([len(x) for x in head["nulls"]], np.int64), **{c: _join(head[c], k) for c, k in _HEAD.items()},
    }
    kinds = _BUCKET | _USES | _HEADS
    return pd.DataFrame([{"bucket": int(pdf["bucket"].iloc[0]), **{c: _pack(x, kinds[c]) for c, x in got.items()}}])


class _Pairs:
    """A bucket's pairs, and the parts that are sampled: those of two customers or more."""

    def __init__(self, row):
        self.words, self.names = _open(row.words, "u8"), _open(row.names, "u4")
        self.place, self.count = _open(row.places, "u4").astype(np.int64), _open(row.counts, "i8")
        self.word = np.repeat(np.arange(len(self.words)), _open(row.pairs, "u4"))
        self.several = np.flatnonzero(self.count > 1)
        self.busy_names = np.bincount(self.place[self.several], minlength=len(self.names)) > 0
        self.busy_words = np.bincount(self.word[self.several], minlength=len(self.words)) > 0

    def by_name(self, x: np.ndarray, pairs=slice(None)) -> np.ndarray:
        return np.bincount(self.place[pairs], x, len(self.names))

    def by_word(self, x: np.ndarray, pairs=slice(None)) -> np.ndarray:
        return np.bincount(self.word[pairs], x, len(self.words))

    def homes(self, buckets: int):
        """(home, numbers of the names and of the words that belong there)."""
        name, word = self.names.astype(np.int64) % buckets, _names(self.words).astype(np.int64) % buckets
        by_name, by_word = np.argsort(name, kind="stable"), np.argsort(word, kind="stable")
        edge = np.arange(buckets + 1)
        a, b = np.searchsorted(name[by_name], edge), np.searchsorted(word[by_word], edge)
        for home in range(buckets):
            n, w = by_name[a[home] : a[home + 1]], by_word[b[home] : b[home + 1]]
            if len(n) or len(w):
                yield home, n, w


#: What a bucket says to a home at first: its names, whether they are sampled, customers, tables (one a pair) and those of single pairs; the same of words.
_FIRST = {"names": "u4", "busy": "u1", "customers": "i8", "tables": "i8", "single": "i8", "words": "u8", "word_busy": "u1", "counts": "i8", "dishes": "i8", "word_single": "i8"}


def _say_first(buckets: int):
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                p = _Pairs(row)
                there, single = (p.count > 0).astype(float), (p.count == 1).astype(float)
                by_name = {"names": p.names, "busy": p.busy_names, "customers": p.by_name(p.count), "tables": p.by_name(there), "single": p.by_name(single)}
                by_word = {"words": p.words, "word_busy": p.busy_words, "counts": p.by_word(p.count), "dishes": p.by_word(there), "word_single": p.by_word(single)}
                for home, n, w in p.homes(buckets):
                    said = {c: _pack(x[n], _FIRST[c]) for c, x in by_name.items()} | {c: _pack(x[w], _FIRST[c]) for c, x in by_word.items()}
                    yield pd.DataFrame([{"home": home, "bucket": row.bucket, **said}])

    return run


#: A home: the buckets that speak to it, how many names and words each, the steps between their places here, whether they are sampled; its totals.
_HOME = {
    "buckets": "i4", "n_names": "i8", "name_steps": "i4", "busy": "u1", "n_words": "i8", "word_steps": "i4", "word_busy": "u1",
    "customers": "i8", "tables": "i8", "single": "i8", "counts": "i8", "dishes": "i8", "word_single": "i8",
}
_HOMES = "home int, " + ", ".join(f"{c} binary" for c in _HOME) + ", tokens bigint, vocabulary bigint"


def _gather_home(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bucket", kind="stable")
    flat = {c: _join(pdf[c], k) for c, k in _FIRST.items()}
    names, name_at = np.unique(flat["names"], return_inverse=True)
    words, word_at = np.unique(flat["words"], return_inverse=True)
    name_sum = lambda c: np.rint(np.bincount(name_at, flat[c], len(names)))
    word_sum = lambda c: np.rint(np.bincount(word_at, flat[c], len(words)))
    counts = word_sum("counts")
    got = {
        "buckets": pdf["bucket"], "n_names": np.array([len(x) for x in pdf["busy"]]), "name_steps": np.diff(name_at, prepend=0), "busy": flat["busy"],
        "n_words": np.array([len(x) for x in pdf["word_busy"]]), "word_steps": np.diff(word_at, prepend=0), "word_busy": flat["word_busy"],
        "customers": name_sum("customers"), "tables": name_sum("tables"), "single": name_sum("single"),
        "counts": counts, "dishes": word_sum("dishes"), "word_single": word_sum("word_single"),
    }
    row = {"home": int(pdf["home"].iloc[0]), **{c: _pack(x, _HOME[c]) for c, x in got.items()}, "tokens": int(counts.sum()), "vocabulary": int((counts > 0).sum())}
    return pd.DataFrame([row])


class _Home:
    def __init__(self, row):
        self.row = {c: _open(getattr(row, c), k) for c, k in _HOME.items()}
        self.name_at, self.word_at = np.cumsum(self.row["name_steps"]), np.cumsum(self.row["word_steps"])
        self.busy, self.word_busy = self.row["busy"].astype(bool), self.row["word_busy"].astype(bool)

    def parts(self):
        """(bucket, places of its names, whether they are sampled, places of its words, whether they are sampled)."""
        n, w = np.append(0, np.cumsum(self.row["n_names"])), np.append(0, np.cumsum(self.row["n_words"]))
        for k, bucket in enumerate(self.row["buckets"]):
            i, j = slice(n[k], n[k + 1]), slice(w[k], w[k + 1])
            yield int(bucket), self.name_at[i], self.busy[i], self.word_at[j], self.word_busy[j]


#: What a home tells a bucket, of all names and words at the end, of those that are sampled before:
#: the restaurants' tables (at the end their customers, and how many more these are), the dishes' customers and tables in the parent
#: (and training counts); and at the end the bucket's own tables.  Numbers of tables are sums over the kept sweeps, so they are whole.
_TOLD = {"tables": "i8", "customers": "i8", "fewer": "i8", "dishes": "i8", "seats": "i8", "counts": "i8"}
_TELLS = "bucket int, home int, " + ", ".join(f"{c} binary" for c in _TOLD) + ", own binary, dishes_sum double, parent_tables double"


def _tell(home: int, h: _Home, tables: np.ndarray, dishes: np.ndarray, parent: dict, last: bool, seed: int) -> list[dict]:
    """Sample the parent's seating of the dishes and tell the buckets; ``tables`` and ``dishes`` are sums over the kept sweeps."""
    whole = np.rint(dishes / parent["kept"]).astype(np.int64)
    weight = (PARENT_STRENGTH + PARENT_DISCOUNT * parent["tables"]) / (parent["vocabulary"] + 1)
    seats = mean_tables(whole, np.full(len(whole), weight), PARENT_DISCOUNT, parent["sweeps"], parent["kept"], np.random.default_rng([seed, home, 1]))
    seats = np.minimum(seats, dishes)
    rows = [{"bucket": -1, "home": home, "dishes_sum": float(dishes.sum()) / parent["kept"], "parent_tables": float(seats.sum()) / parent["kept"]}]
    for bucket, name, busy, word, word_busy in h.parts():
        if not last:
            name, word = name[busy], word[word_busy]
        said = {"dishes": dishes[word], "seats": seats[word]}
        if last:
            customers = h.row["customers"][name]
            said |= {"customers": customers, "fewer": customers * parent["kept"] - tables[name], "counts": h.row["counts"][word]}
        else:
            said |= {"tables": tables[name]}
        rows.append({"bucket": bucket, "home": home, **{c: _pack(x, _TOLD[c]) for c, x in said.items()}})
    return rows


_TELL_COLUMNS = ["bucket", "home", *_TOLD, "own", "dishes_sum", "parent_tables"]


def _told(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_TELL_COLUMNS)
    return out.astype(object).where(out.notna(), None)


def _tell_first(parent: dict, seed: int):
    """The totals while each pair has one table."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                h = _Home(row)
                yield _told(_tell(row.home, h, h.row["tables"] * parent["kept"], h.row["dishes"] * parent["kept"], parent, False, seed))

    return run


def _spread_told(told: pd.DataFrame, p: _Pairs, buckets: int, column: str, busy: bool, words: bool) -> np.ndarray:
    """What the homes told of a bucket's names or words, in the bucket's order; zero where nothing was told."""
    by_home = dict(zip(told["home"], told[column], strict=True))
    chosen = p.busy_words if words else p.busy_names
    out = np.zeros(len(p.words if words else p.names), _TOLD[column])
    for home, n, w in p.homes(buckets):
        at = w if words else n
        out[at[chosen[at]] if busy else at] = _open(by_home.get(home), _TOLD[column])
    return out


def _below(told: pd.DataFrame, p: _Pairs, buckets: int, parent: dict, busy: bool) -> np.ndarray:
    """The parent's probability of each word of a bucket."""
    get = lambda c: _spread_told(told, p, buckets, c, busy, True) / parent["kept"]
    base = (PARENT_STRENGTH + PARENT_DISCOUNT * parent["tables"]) / (parent["vocabulary"] + 1)
    return (get("dishes") - PARENT_DISCOUNT * get("seats") + base) / (PARENT_STRENGTH + parent["dishes"])


def _say(buckets: int, parent: dict, last: bool, seed: int):
    """Seat and sweep a bucket's pairs, and say the tables to the homes."""

    def seated(told: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            p = _Pairs(row)
            tables, below = _spread_told(told, p, buckets, "tables", True, False) / parent["kept"], _below(told, p, buckets, parent, True)
            s = p.several
            weight = (STRENGTH + DISCOUNT * tables[p.place[s]]) * below[p.word[s]]
            seats = mean_tables(p.count[s], weight, DISCOUNT, parent["sweeps"], parent["kept"], np.random.default_rng([seed, int(row.bucket), 0]))
            by_name, by_word = np.rint(p.by_name(seats, s)), np.rint(p.by_word(seats, s))
            for home, n, w in p.homes(buckets):
                n, w = n[p.busy_names[n]], w[p.busy_words[w]]
                out.append({"home": home, "bucket": row.bucket, "tables": _pack(by_name[n], "i8"), "dishes": _pack(by_word[w], "i8"), "own": None})
            if last:
                # through any home that has a row, back to the bucket
                out[-1:] = [out[-1] | {"own": _pack(seats, "i8")}] if out else []
        return pd.DataFrame(out, columns=["home", "bucket", "tables", "dishes", "own"])

    def run(group, told: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        _give_back()
        out = seated(told, rows)
        _give_back()  # a worker that waits for its next group would hold what this one took
        return out

    return run


_SAYS = "home int, bucket int, tables binary, dishes binary, own binary"


def _total(parent: dict, last: bool, seed: int):
    """A home's new totals, told to the buckets."""

    def run(group, said: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            h = _Home(row)
            tables, dishes = h.row["single"] * parent["kept"], h.row["word_single"] * parent["kept"]
            by_bucket = {r.bucket: r for r in said.itertuples(index=False)}
            for bucket, name, busy, word, word_busy in h.parts():
                if bucket in by_bucket:
                    tables[name[busy]] += _open(by_bucket[bucket].tables, "i8")
                    np.add.at(dishes, word[word_busy], _open(by_bucket[bucket].dishes, "i8"))
            out += _tell(row.home, h, tables, dishes, parent, last, seed)
            out += [{"bucket": r.bucket, "home": row.home, "own": r.own} for r in said.itertuples(index=False) if r.own is not None]
        return _told(out)

    return run


class Model:
    """Buckets with what their last phase told them, and the bounded part: totals of the parent, and how it was swept."""

    def __init__(self, table: DataFrame, told: DataFrame, parent: dict, tokens: int, buckets: int):
        self.table, self.told, self.parent, self.tokens, self.buckets = table, told, parent, tokens, buckets
        self.vocabulary = parent["vocabulary"]


def _parent(told: DataFrame, parent: dict) -> dict:
    """The parent's totals of a phase: sums over one row of each home."""
    got = told.where("bucket = -1").agg(F.sum("dishes_sum").alias("dishes"), F.sum("parent_tables").alias("tables")).first()
    return parent | {"dishes": got["dishes"] or 0.0, "tables": got["tables"] or 0.0}


def train(docs: DataFrame, seed: int = 1, phases: int = PHASES, sweeps: int = SWEEPS, kept: int = KEPT) -> Model:
    """Fit the model to the rows of ``docs`` (``doc_id, text``) that aren't held out; its buckets keep the occurrences of all rows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, -(-size // BUCKET_BYTES)))
    with few_rows_at_once(docs.sparkSession):
        dealt = _rows(docs).mapInPandas(_deal(buckets, frequent(docs, buckets)), _DEALT)
        table = bucketed(dealt.groupBy("bucket").applyInPandas(_gather_bucket, _BUCKETS), "bucket", buckets, "pitmanyor")
    said = table.select("bucket", *_BUCKET).mapInPandas(_say_first(buckets), "home int, bucket int, " + ", ".join(f"{c} binary" for c in _FIRST))
    homes = bucketed(said.groupBy("home").applyInPandas(_gather_home, _HOMES), "home", buckets, "pitmanyor")
    sums = homes.agg(F.sum("tokens"), F.sum("vocabulary")).first()
    tokens, vocabulary = int(sums[0] or 0), int(sums[1] or 0)
    parent = {"vocabulary": vocabulary, "tables": float(vocabulary), "dishes": 0.0, "sweeps": sweeps, "kept": kept}
    told = stored(homes.mapInPandas(_tell_first(parent, seed), _TELLS), "pitmanyor")
    parent = _parent(told, parent)
    for phase in range(1, phases + 1):
        last = phase == phases
        pairs = table.select("bucket", *_BUCKET).groupBy("bucket")
        said = told.where("bucket >= 0").groupBy("bucket").cogroup(pairs).applyInPandas(_say(buckets, parent, last, seed + phase), _SAYS)
        told = stored(said.groupBy("home").cogroup(homes.groupBy("home")).applyInPandas(_total(parent, last, seed + phase), _TELLS), "pitmanyor")
        parent = _parent(told, parent)
    return Model(table, told, parent, tokens, buckets)


def shares(row, told: pd.DataFrame, parent: dict, buckets: int) -> tuple[_Pairs, np.ndarray, np.ndarray]:
    """A bucket's pairs, the predictive probability of each, and the training count of each word."""
    p = _Pairs(row)
    seats = np.where(p.count > 0, 1.0, 0.0)
    own = told[told["own"].notna()]
    if len(own):
        seats[p.several] = _open(own["own"].iloc[0], "i8") / parent["kept"]
    told = told[told["own"].isna()]
    get = lambda c, words: _spread_told(told, p, buckets, c, False, words).astype(float)
    customers, counts, below = get("customers", False), get("counts", True), _below(told, p, buckets, parent, False)
    tables = customers - get("fewer", False) / parent["kept"]
    back = STRENGTH + DISCOUNT * tables[p.place]
    share = (p.count - DISCOUNT * seats + back * below[p.word]) / (STRENGTH + customers[p.place])
    return p, share, counts


#: Sums of a batch's texts in one bucket: known tokens, base score and score, and the part of one in which they are counted.
_SUMS = {"known": "i8", "base": "i8", "score": "i8"}
_PARTS = {"known": 1, "base": 1 << 32, "score": 1 << 24}
_SCORED = "batch bigint, " + ", ".join(f"{c} binary" for c in (*_HEAD, *_SUMS))


def _score(buckets: int, parent: dict, base: float):
    def summed(told: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples(index=False):
            use = {c: _open(getattr(row, c), k) for c, k in (_USES | _HEADS).items()}
            ends = np.append(0, np.cumsum(use["sizes"]))
            for k, batch in enumerate(use["heads"]):
                out.append({"batch": int(batch), **{c: _pack(use[c][ends[k] : ends[k + 1]], kind) for c, kind in _HEAD.items()}})
            if not len(use["batches"]):
                continue
            p, share, counts = shares(row, told, parent, buckets)
            log, plain, known = np.log10(share), np.log10((counts + 1) * base)[p.word], (counts > 0)[p.word]
            i = j = 0
            for batch, pairs, docs in zip(use["batches"], use["n_pairs"], use["n_docs"], strict=True):
                at = np.repeat(np.cumsum(use["steps"][i : i + pairs], dtype=np.int64), use["times"][i : i + pairs])
                doc = use["docs"][j : j + docs].astype(np.int64)
                i, j = i + pairs, j + docs
                sums = {"known": np.bincount(doc, known[at]), "base": np.bincount(doc, plain[at]), "score": np.bincount(doc, log[at])}
                out.append({"batch": int(batch), **{c: _pack(np.rint(-x * _PARTS[c]), _SUMS[c]) for c, x in sums.items()}})
        frame = pd.DataFrame(out, columns=["batch", *_HEAD, *_SUMS])
        return frame.astype(object).where(frame.notna(), None)

    def run(group, told: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        _give_back()
        out = summed(told, rows)
        _give_back()
        return out

    return run


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of all buckets for the texts of one batch, which repeated rows may have made more than one."""
    _give_back()
    heads = rows[rows["ids"].notna()]
    out = {c: _open(heads[c].iloc[0], k) for c, k in _HEAD.items()}
    total = {c: np.zeros(len(out["ids"]), k) for c, k in _SUMS.items()}
    for r in rows[rows["known"].notna()].itertuples(index=False):
        for c, x in total.items():
            part = _open(getattr(r, c), _SUMS[c])
            x[: len(part)] += part
    frame = pd.DataFrame(out | {c: -x / (_PARTS[c] * len(heads)) for c, x in total.items()}).astype({"known": np.int64})
    return pd.concat([frame] * len(heads), ignore_index=True)


def score(model: Model) -> DataFrame:
    """``doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row that the model was made from.

    Scores are sums of log10 probabilities over all tokens, the end included.
    """
    base = 1 / (model.tokens + 1 * (model.vocabulary + 1))
    told = model.told.where("bucket >= 0").groupBy("bucket")
    parts = told.cogroup(model.table.groupBy("bucket")).applyInPandas(_score(model.buckets, model.parent, base), _SCORED)
    each = parts.groupBy("batch").applyInPandas(_gather, "ids bigint, nulls int, keys bigint, tokens bigint, known bigint, base double, score double")
    return each.withColumn("doc_id", F.when(F.col("nulls") == 0, F.col("ids"))).select(
        "doc_id",
        F.col("keys").alias("text_key"),
        held_out().alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def scored(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Train on the rows that aren't held out and score every row.

    Null and empty texts consist of the end alone; a text of any length is one
    row of one batch.  With nothing to train on, all words are unknown; an
    empty table gives an empty result.  Rows that repeat doc_id and text are
    scored alike.  Other columns are ignored.
    """
    return score(train(docs, seed))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity by ``held_out``: of the model and of the add-one base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
