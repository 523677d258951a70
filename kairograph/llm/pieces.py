"""Token counts by the linear longest-match automaton (Song et al., 2021).

Greedy longest-match-first word pieces, without building the pieces: the
vocabulary is a trie of bytes; where no byte leads on, a node's *failure link*
names the node of what is left after the longest pieces have been cut off, and
a precomputed number says how many were cut.  Each byte of a word is looked at
once, whatever the lengths of the pieces.  Words that come again are answered
from memory.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files of public tokenizers; a parameter of :func:`vocabulary`.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: What a vocabulary may take up when it is sent to the tasks.
MOST_BYTES = 64 << 20

#: Words whose counts a task keeps in memory.
MEMORY_WORDS = 1 << 19

_SPLIT = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
_MARKS = bytes(c for c in range(256) if _SPLIT[c] == 32 and c not in b" \t\n\x0b\x0c\r")
_SPACES = b" \t\n\x0b\x0c\r"
_LETTERS = bytes(c for c in range(256) if _SPLIT[c] != 32)


def vocabulary(path: str = VOCABULARY) -> tuple[frozenset[bytes], frozenset[bytes]]:
    """Pieces that begin a word and pieces that continue one.

    The file is a rank file, a token in base64 and its rank by line.  A token
    with a leading space begins a word; one without continues it.  Single bytes
    do both, so every word has pieces.
    """
    with open(path, "rb") as lines:
        tokens = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    single = {bytes([c]) for c in range(256)}
    first = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and not t[1:].isspace()}
    return frozenset(first | single), frozenset({t for t in tokens if t.strip() and not t[:1].isspace()} | single)


class Automaton:
    """Counts the pieces of a word in one pass over its bytes."""

    def __init__(self, first: frozenset[bytes], rest: frozenset[bytes]):
        self.step: list[dict[int, int]] = [{}, {}]  # node 0 begins a word, node 1 continues one
        ends = [False, False]
        depth = [0, 0]
        order: list[tuple[int, int, int]] = []  # parent, byte, node
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    after = self.step[node].get(byte)
                    if after is None:
                        after = len(self.step)
                        self.step.append({})
                        ends.append(False)
                        depth.append(depth[node] + 1)
                        self.step[node][byte] = after
                        order.append((node, byte, after))
                    node = after
                ends[node] = True
        order.sort(key=lambda x: depth[x[2]])
        self.fail = [-1] * len(self.step)
        self.popped = [0] * len(self.step)
        for parent, byte, node in order:
            if ends[node]:
                self.fail[node], self.popped[node] = 1, 1
                continue
            back, count = self.fail[parent], self.popped[parent]
            while back >= 0 and byte not in self.step[back]:
                count += self.popped[back]
                back = self.fail[back]
            if back >= 0:
                self.fail[node], self.popped[node] = self.step[back][byte], count

    def count(self, word: bytes) -> int:
        """Number of pieces; 1 (an unknown word) where pieces can't cover it."""
        step, fail, popped = self.step, self.fail, self.popped
        node = count = 0
        for byte in word:
            while byte not in step[node]:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = step[node][byte]
        while node > 1:
            count += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return count


def words_and_marks(text: bytes) -> tuple[list[bytes], int]:
    """Words (runs of letters, digits and bytes from 128 on) and the number of other signs, each a word of its own."""
    return text.translate(_SPLIT).split(), len(text.translate(None, _SPACES + _LETTERS))


@cache
def _automaton(first: frozenset[bytes], rest: frozenset[bytes]) -> Automaton:
    return Automaton(first, rest)


def _counts(pieces):
    def run(batches):
        machine = _automaton(*pieces.value)
        known: dict[bytes, int] = {}
        marks = [machine.count(bytes([c])) for c in range(256)]
        plain = all(marks[c] == 1 for c in _MARKS)
        for pdf in batches:
            words, tokens = [], []
            for text in pdf["text"]:
                raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                found, signs = words_and_marks(raw)
                if len(known) > MEMORY_WORDS:
                    known.clear()
                for word in set(found).difference(known):
                    known[word] = machine.count(word)
                total = sum(map(known.__getitem__, found))
                total += signs if plain else sum(marks[c] for c in raw.translate(None, _SPACES + _LETTERS))
                words.append(len(found) + signs)
                tokens.append(total)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_words": np.array(words, np.int64), "n_tokens": np.array(tokens, np.int64)})

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, n_words, n_tokens`` of every row, in one pass without a shuffle.

    Texts and words of any length count whole; repeated rows come back each; an
    empty table gives an empty result.

    Letters keep their case.  Null and empty texts have no tokens.  The
    vocabulary is read by the driver and sent to the tasks, at most
    :data:`MOST_BYTES` of it.
    """
    first, rest = vocabulary(path)
    if sum(map(len, first)) + sum(map(len, rest)) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    pieces = docs.sparkSession.sparkContext.broadcast((first, rest))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return rows.mapInPandas(_counts(pieces), "doc_id bigint, n_bytes bigint, n_words bigint, n_tokens bigint")
