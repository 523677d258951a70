"""SimHash near-duplicates found through the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect
Golay code of length 23 decodes every 23-bit word to one of 4,096 codewords, so
words that differ in one bit meet in the codeword of one or the other: the
*near* codewords of a word are those of the word itself and of all words one
bit away (one codeword or six).  If two fingerprints differ in three bits at
most, the bits lie in the segments in one of two ways:

* one segment is equal and another differs in one bit at most: a key of the
  first segment as it is and a codeword of the second (six pairs of segments);
* each segment differs in one bit: codewords of the first two segments and one
  half of the third, which is equal for one of the two halves.

So a few keys of 30 to 35 bits each find every link, and the join verifies it.
Documents with equal fingerprints are one node throughout.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import ASCII_LOWER, NULL_ID, packed, stored
from kairograph.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3

#: Generator polynomial of the binary Golay code (fixed value): x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY_POLYNOMIAL = 0b101011100011
GOLAY_LENGTH = 23

#: First bit and number of bits of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
HALF = 9


@cache
def golay_decoder() -> np.ndarray:
    """Index of the nearest codeword of each 23-bit word."""
    message = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        code ^= np.where(message >> bit & 1, GOLAY_POLYNOMIAL << bit, 0)
    bits = [1 << i for i in range(GOLAY_LENGTH)]
    errors = [0, *bits]
    errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table = np.zeros(1 << GOLAY_LENGTH, np.int16)
    for error in errors:
        table[code ^ error] = message
    return table


def near_codewords(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of the word, codeword index): those of each word and of the words one bit away in its first ``width`` bits."""
    table = golay_decoder()
    all_ = np.stack([table[words], *(table[words ^ (1 << i)] for i in range(width))], axis=1).astype(np.int64)
    all_.sort(axis=1)
    new = np.ones(all_.shape, bool)
    new[:, 1:] = all_[:, 1:] != all_[:, :-1]
    row = np.nonzero(new)[0]
    return row, all_[new]


def link_keys(prints: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the index side and of the probe side; linked fingerprints share a key between the sides."""
    table = golay_decoder()
    u = prints.view(np.uint64)
    seg = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [table[s].astype(np.int64) for s in seg]
    near = [near_codewords(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    every = np.arange(len(prints))
    index, probe, family = [], [], 0
    for x in range(3):
        for y in range(3):
            if x != y:
                base = np.int64(family) << 40
                index.append((every, base | seg[x] << 12 | own[y]))
                row, code = near[y]
                probe.append((row, base | seg[x][row] << 12 | code))
                family += 1
    for half in (0, 1):
        base = np.int64(family) << 40
        third = seg[2] >> (half * HALF) & ((1 << HALF) - 1)
        row, code = near[0]
        index.append((row, base | (code << 12 | own[1][row]) << HALF | third[row]))
        row, code = near[1]
        probe.append((row, base | (own[0][row] << 12 | code) << HALF | third[row]))
        family += 1
    join = lambda parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return join(index), join(probe)


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles of a text, as an unsigned number; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]  # noqa: B905
    n = max(len(words) - SHINGLE + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(shingle, SEED) for shingle in shingles], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _fingerprints(batches):
    for pdf in batches:
        prints = [fingerprint(t if isinstance(t, str) else None) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "print": np.array(prints, np.uint64).view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print`` (the 64 bits as a signed number) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    return rows.mapInPandas(_fingerprints, "doc_id bigint, text_key bigint, print bigint")


def _keys(side: int):
    def run(batches):
        for pdf in batches:
            prints = pdf["print"].to_numpy()
            row, key = link_keys(prints)[side]
            yield pd.DataFrame({"key": key, "print": prints[row]})

    return run


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: pairs of different fingerprints at :data:`DISTANCE` bits or fewer, some of them more than once.

    Spark sizes the keys as if there were one a fingerprint, and would broadcast tens of millions of them; so it is told to merge.
    """
    index = prints.mapInPandas(_keys(0), "key bigint, print bigint").withColumnRenamed("print", "a")
    probe = prints.mapInPandas(_keys(1), "key bigint, print bigint").withColumnRenamed("print", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return index.join(probe.hint("merge"), (index["key"] == probe["key"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, print, component_id, first_key`` of every row.

    ``component_id`` is the smallest doc_id of the documents that can be
    reached over links, the row's own included; ``first_key`` is that
    document's text_key, so the two name one row.  Null and empty texts have
    fingerprint 0 and link like any other.  A null doc_id counts as larger
    than all others and comes back as null.  Texts of any length count whole;
    repeated rows come back each; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs), "simhash")
    nodes = stored(
        rows.groupBy("print").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("text_key").alias("key"))).alias("first")), "simhash"
    )
    roots = components(links(nodes.select("print")))
    placed = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("of"))
    classes = placed.join(firsts, "root").select(F.col("print").alias("_print"), "of")
    return rows.join(classes, F.col("print") == F.col("_print")).select(
        "doc_id",
        "text_key",
        "print",
        F.when(F.col("of.id") != NULL_ID, F.col("of.id")).alias("component_id"),
        F.col("of.key").alias("first_key"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id.

    Rows without words are near copies of one another; of rows that share the
    smallest doc_id the one of the smallest text hash stays, of repeated rows
    one; rows of null doc_id only stay where the component has no other; an
    empty table gives none.
    """
    firsts = near_duplicates(docs).select(F.coalesce("component_id", F.lit(NULL_ID)).alias("_first"), F.col("first_key").alias("_first_key")).distinct()
    keyed = packed(docs).withColumn("_id", F.coalesce("_id", F.lit(NULL_ID)))
    kept = keyed.join(firsts, (F.col("_id") == F.col("_first")) & (F.col("_key") == F.col("_first_key")), "left_semi")
    return kept.dropDuplicates(["_id", "_key"]).select("_row.*")
