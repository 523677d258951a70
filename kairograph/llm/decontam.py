"""Benchmark decontamination by suffix arrays over shards of the corpus.

A shard is one Arrow batch of whole documents.  Its words become integers (0
for a word that no benchmark item has), runs of known words that are shorter
than the shortest window are dropped, as no window can lie in them, and the
rest gets a suffix array.  Every suffix of every benchmark item is then found
in the array by binary search, all of them at once; the suffixes between its
two bounds are the places where its window stands, and each is compared
further for the longest verbatim match.  Documents are never split, so nothing
is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import packed, stored

WINDOW = 13

#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


@dataclass
class Items:
    """A block of benchmark items, as the searches need it."""

    vocabulary: dict[bytes, int]
    names: list[str]
    words: np.ndarray  #: of all items, a 0 after each
    starts: np.ndarray  #: of each window, in words
    lengths: np.ndarray  #: of each window
    owners: np.ndarray  #: item of each window
    shortest: int


def prepare(items: list[tuple[str, str | None]], window: int = WINDOW) -> Items:
    vocabulary: dict[bytes, int] = {}
    names, words, starts, lengths, owners = [], [], [], [], []
    at = 0
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        if not ids:
            continue
        size = min(window, len(ids))
        count = len(ids) - size + 1
        starts.extend(range(at, at + count))
        lengths.extend([size] * count)
        owners.extend([len(names)] * count)
        names.append(name)
        words.extend(ids)
        words.append(0)
        at += len(ids) + 1
    return Items(
        vocabulary, names, np.array(words, np.int32), np.array(starts, np.int64), np.array(lengths, np.int64),
        np.array(owners, np.int64), min(lengths, default=window),
    )


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``words`` in the order of their first ``depth`` words or more (prefix doubling)."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(words)
    while step < depth and n:
        second = np.zeros(n, np.int64)
        second[: max(n - step, 0)] = rank[step:] + 1
        both = rank * (n + 1) + second
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        if rank.max() == n - 1:
            break
        step *= 2
    return np.argsort(rank, kind="stable")


def search(words: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in ``order`` of the suffixes that begin with each window of ``items``."""
    width = int(items.lengths.max())
    padded = np.concatenate([words, np.full(width, -1, words.dtype)])
    asked = np.concatenate([items.words, np.zeros(width, items.words.dtype)])[items.starts[:, None] + np.arange(width)]
    inside = np.arange(width) < items.lengths[:, None]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(order), np.int64)
        while (open_ := low < high).any():
            q = np.nonzero(open_)[0]
            mid = (low[q] + high[q]) // 2
            there = padded[order[mid][:, None] + np.arange(width)]
            differs = (there != asked[q]) & inside[q]
            first = differs.argmax(axis=1)
            rows = np.arange(len(q))
            differ = differs[rows, first]
            less = differ & (there[rows, first] < asked[q][rows, first])
            right = less | ~differ if after else less
            low[q[right]] = mid[right] + 1
            high[q[~right]] = mid[~right]
        return low

    return bound(False), bound(True)


def matches(texts: list[str | None], items: Items):
    """Word counts of the texts, and by match: text, place in it, window, length of the longest match from there."""
    get = items.vocabulary.get
    counts = np.zeros(len(texts), np.int64)
    kept, owner, place = [], [], []
    for i, text in enumerate(texts):
        found = words_of(text)
        counts[i] = len(found)
        if len(found) < items.shortest or not len(items.starts):
            continue
        ids = np.fromiter(map(get, found, [0] * len(found)), np.int32, len(found))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= items.shortest:
                kept.append(np.append(ids[a:b], np.int32(0)))
                owner.append(np.full(b - a + 1, i))
                place.append(np.arange(a, b + 1))
    if not kept:
        return counts, *(np.zeros(0, np.int64) for _ in range(4))
    words, owner, place = np.concatenate(kept), np.concatenate(owner), np.concatenate(place)
    order = suffix_array(words, int(items.lengths.max()))
    low, high = search(words, order, items)
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    at = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    length = items.lengths[window].copy()
    ours = np.append(words, np.int32(-1))
    going = np.arange(len(at))
    while len(going):
        theirs = items.words[items.starts[window[going]] + length[going]]
        same = (theirs > 0) & (theirs == ours[np.minimum(at[going] + length[going], len(words))])
        going = going[same]
        length[going] += 1
    return counts, owner[at], place[at], window, length


def _pass(columns: list[str], block: list[tuple[str, str | None]], window: int):
    def run(batches):
        items = prepare(block, window)
        for pdf in batches:
            texts = pdf["text"].tolist()
            counts, owner, place, found, length = matches([t if isinstance(t, str) else None for t in texts], items)
            spans: list[list[int]] = [list(x) for x in pdf["_spans"]]
            names: list[list[str]] = [list(x) for x in pdf["_items"]]
            longest = pdf["_longest"].to_numpy().copy()
            order = np.lexsort((place, owner))
            owner, place, found, length = owner[order], place[order], found[order], length[order]
            for i in np.unique(owner):
                a, b = np.searchsorted(owner, [i, i + 1])
                starts, ends = place[a:b], place[a:b] + items.lengths[found[a:b]]
                reach = np.maximum.accumulate(ends)
                new = np.append(True, starts[1:] > reach[:-1])
                last = np.append(np.flatnonzero(new)[1:] - 1, b - a - 1)
                spans[i].extend(np.column_stack([starts[new], reach[last]]).ravel().tolist())
                names[i].extend(items.names[k] for k in np.unique(items.owners[found[a:b]]))
                longest[i] = max(longest[i], int(length[a:b].max()))
            out = pdf.assign(_spans=spans, _items=names, _longest=longest, _words=counts)
            yield out[columns]

    return run


def _finish(batches):
    for pdf in batches:
        hit, n_items, digest, spans = [], [], [], []
        for flat, names in zip(pdf["_spans"], pdf["_items"], strict=True):
            merged: list[list[int]] = []
            for a, b in sorted(zip(map(int, flat[::2]), map(int, flat[1::2]), strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            own = sorted(set(names))
            hit.append(sum(b - a for a, b in merged))
            n_items.append(len(own))
            digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            spans.append(",".join(f"{a}-{b}" for a, b in merged))
        out = pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "n_words": pdf["_words"], "n_hit": hit, "n_items": n_items, "items_sha256": digest})
        yield out.assign(spans=spans, longest_match=pdf["_longest"])


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about ``block_bytes`` each, one at a time; a longer single item is a block of its own."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").distinct()
    block, size = [], 0
    for name, text in rows.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((name or "", text))
        size += len(text)
    yield block


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """How much of each document stands verbatim in ``benchmark``.

    Returns ``doc_id, text_key, n_words, n_hit`` (words inside occurrences of
    windows), ``n_items, items_sha256, spans`` (hit words as from-to pairs) and
    ``longest_match`` (words) for every row of ``docs``.  The benchmark is the
    query set: it goes to the tasks in blocks of ``block_bytes``, each a pass
    over the documents, so neither a task nor the driver has to hold all of it.

    Null and empty texts have no words.  Items without words are ignored; a
    null item_id counts as the empty string; rows that repeat an item_id are
    one item.  An empty benchmark hits nothing.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("text_key"),
        F.array().cast("array<bigint>").alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
        F.lit(0).cast("long").alias("_longest"),
        F.lit(0).cast("long").alias("_words"),
    )
    schema = "doc_id bigint, text string, text_key bigint, _spans array<bigint>, _items array<string>, _longest bigint, _words bigint"
    blocks = benchmark_blocks(benchmark, block_bytes)
    found = rows.mapInPandas(_pass(rows.columns, next(blocks), window), schema).drop("text")
    more = next(blocks, None)
    if more is not None:
        # A large benchmark: each block's result is stored, so that the driver holds one block at a time.
        parts = 1
        found = stored(found, "decontam")
        while more is not None:
            found = found.unionByName(stored(rows.mapInPandas(_pass(rows.columns, more, window), schema).drop("text"), "decontam"))
            more, parts = next(blocks, None), parts + 1
        found = (
            found.groupBy("doc_id", "text_key")
            .agg(
                F.flatten(F.collect_list("_spans")).alias("_spans"),
                F.flatten(F.collect_list("_items")).alias("_items"),
                F.max("_longest").alias("_longest"),
                F.max("_words").alias("_words"),
                (F.count(F.lit(1)) / parts).cast("int").alias("_rows"),
            )
            .withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
            .drop("_rows", "_row")
        )
    return found.mapInPandas(
        _finish,
        "doc_id bigint, text_key bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans string, longest_match bigint",
    )


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """:func:`overlaps` and ``contaminated``: one word in ``share`` or more is hit."""
    return overlaps(docs, benchmark, window).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns.

    Rows with null or empty texts stay; rows of null doc_id are judged by their
    text; repeated rows stay or go together; an empty table gives none.
    """
    marked = judged(docs, benchmark, window, share).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key")).distinct()
    kept = packed(docs).join(marked, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_key") == F.col("_bad_key")), "left_anti")
    return kept.select("_row.*")
