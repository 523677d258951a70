"""Each operator against a plain version, on documents with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kairograph.llm import common, components, decontam, licenses, linededup, mixing, pieces, pitmanyor, sharding, simhash, topk, toxicity
from tests.llm.conftest import SCHEMA, odd_rows

DOCS = [(r[0], r[1], r[3]) for r in odd_rows()]


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def as_counts(rows):
    return collections.Counter(map(tuple, rows))


# sharding


def jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one_and_moves_only_into_the_new_shard():
    keys = np.array([0, 1, 2, 10, -5, 2**62, *range(1000, 3000)], np.int64)
    got, grown = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert got.tolist() == [jump(int(k), 16) for k in keys]
    assert all(a == b or b == 16 for a, b in zip(got, grown, strict=True))


def test_shards(odd, none):
    got = sharding.assign_slots(odd).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, 16), jump(i or 0, 17)) for i, t, _ in DOCS]
    assert as_counts((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == as_counts(want)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_slots(none).count() == 0


# mixing


def targets(sizes):
    """Water filling, a source at a time."""
    total = 1.5 * sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, left = {}, dict(weight)
    while left:
        level = (total - sum(full.values())) / sum(left.values())
        over = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in left}
        for s in over:
            full[s] = 2.0 * sizes[s]
            del left[s]
    return full


def test_mix(odd, none):
    got = mixing.mix_summary(mixing.mix(odd)).collect()
    sizes = collections.Counter()
    for _, t, s in DOCS:
        sizes[s] += len(split(t))
    assert as_counts((r.doc_id, r["size"], r.source_size) for r in got) == as_counts((i, len(split(t)), sizes[s]) for i, t, s in DOCS)
    want = targets(sizes)
    own = {(i, len(split(t))): s for i, t, s in DOCS}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        source = own[r.doc_id, r["size"]]
        assert math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
        largest[source] = max(largest[source], r["size"])
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 2 * max(largest.values()) for s in want)
    assert as_counts(got) == as_counts(mixing.mix_summary(mixing.mix(odd)).collect())
    assert mixing.mix_summary(mixing.mix(none)).count() == 0


def test_mixed_rows_are_the_taken_copies(odd):
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    words = sum(len(split(r.text)) for r in rows.collect())
    assert words == mixing.mix_summary(mixing.mix(odd)).agg(F.sum("taken")).first()[0]


def test_mix_many_small_documents_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), f"s{rng.choice('aaaaaab')}" if i % 7 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = mixing.mix(docs).where("taken").groupBy("source").agg(F.sum("size").alias("w"), F.first("target").alias("t")).collect()
    assert len(sums) == 3
    assert all(abs(r.w - r.t) <= 30 for r in sums)


# decontamination


def contamination(texts, items, window=13):
    want = []
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = collections.defaultdict(set)
    for name, text in items:
        w = tokens(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(name)
    lengths = {len(w) for w in wins}
    for i, t, _ in texts:
        w = tokens(t)
        hit, names = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return want


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, odd, none, block):
    base = next(t for _, t, _ in DOCS if t and len(t.split()) == 61)
    items = [(1, base[10:260]), (2, "two, WORDS"), (2, "one"), (3, None), (4, ""), (5, "never to be found in there"), (60, " ".join(base.split()[5:40]) + " other end"), (7, "l1 l2 l3 l1")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, spans string")
    got = decontam.overlaps(odd, bench, block_bytes=block).withColumn("bad", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).collect()
    want = contamination(DOCS, [(str(a), b) for a, b in items])
    assert as_counts((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.bad) for r in got) == as_counts(want)
    kept = decontam.decontaminated(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not w[-1] for w in want)
    assert decontam.judged(none, bench).count() == 0
    assert decontam.judged(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_suffix_array_and_search_find_all_places():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 300).astype(np.int32)
    order = decontam.suffix_array(words, 13)
    assert [tuple(words[i : i + 13]) for i in order] == sorted(tuple(words[i : i + 13]) for i in range(300))
    items = decontam.prepare([("a", "x y x x y"), ("b", "y x")], 3)
    low, high = decontam.search(np.array([1, 2, 1, 0, 2, 1, 1, 2], np.int32), decontam.suffix_array(np.array([1, 2, 1, 0, 2, 1, 1, 2], np.int32), 3), items)
    assert (high - low).tolist() == [1, 1, 1, 2]


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(5, 45)) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, text)], "item_id long, text string")
    row = decontam.overlaps(docs, bench).first()
    assert (row.longest_match, row.spans, row.n_hit) == (40, "2-42", 40)


# simhash


def slow_print(text):
    w = split(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_golay_code_is_perfect():
    table = simhash.golay_decoder()
    assert np.bincount(table).tolist() == [2048] * 4096


def test_every_link_has_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(-(2**63), 2**63 - 1, 4000)
    b = a.copy()
    for k in range(3):
        flip = rng.integers(0, 64, 4000).astype(np.uint64)
        b = np.where(rng.random(4000) < 0.8, (b.view(np.uint64) ^ (np.uint64(1) << flip)).view(np.int64), b)
    sides = [(simhash.link_keys(x)[0], simhash.link_keys(y)[1]) for x, y in ((a, b), (b, a))]
    for (r0, k0), (r1, k1) in sides:
        index, probe = collections.defaultdict(set), collections.defaultdict(set)
        for r, k in zip(r0, k0, strict=True):
            index[r].add(k)
        for r, k in zip(r1, k1, strict=True):
            probe[r].add(k)
        assert all(index[i] & probe[i] for i in range(4000))


def test_near_duplicates(odd, none):
    got = simhash.near_duplicates(odd).collect()
    prints = [slow_print(t) for _, t, _ in DOCS]
    assert as_counts((r.doc_id, r["print"] % (1 << 64)) for r in got) == as_counts((d[0], p) for d, p in zip(DOCS, prints, strict=True))
    root = classes(len(DOCS), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    first = {}
    for d, r in zip(DOCS, root, strict=True):
        first[r] = min(first.get(r, math.inf), math.inf if d[0] is None else d[0])
    want = as_counts((d[0], None if first[r] == math.inf else first[r]) for d, r in zip(DOCS, root, strict=True))
    assert as_counts((r.doc_id, r.component_id) for r in got) == want
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(set(root))
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_close_fingerprints_are_whole(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "print long")).distinct().collect()}
    want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert got == want


def test_keys_of_links_are_not_broadcast(spark):
    prints = spark.range(1000).select(F.xxhash64("id").alias("print"))
    found = simhash.links(prints)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # Spark takes the 66 keys of a fingerprint for one


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    linked = {frozenset(e) for e in edges}
    root = classes(len(nodes), lambda a, b: frozenset((nodes[a], nodes[b])) in linked)
    assert got == {n: nodes[r] for n, r in zip(nodes, root, strict=True)}


# line dedup


def slow_lines(docs):
    seen, out = set(), []
    order = sorted({(d[0], d[1]) for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    cut = {}
    for i, t in order:
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        cut[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    for i, t, _ in docs:
        out.append((i, t.count("\n") + 1 if t is not None else 0, cut.get((i, t)) if t is not None else None))
    return out


def test_line_dedup(spark, odd, none):
    got = linededup.dedup_lines(odd).collect()
    assert as_counts((r.doc_id, r.n_lines, r.text) for r in got) == as_counts(slow_lines(DOCS))
    assert linededup.dedup_lines(none).count() == 0
    rng = random.Random(8)
    docs = [(i, "\n".join(rng.choice("ab") for _ in range(rng.randint(0, 14))), None) for i in range(60)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, b string")).collect()
    assert as_counts((r.doc_id, r.n_lines, r.text) for r in got) == as_counts(slow_lines(docs))


# licences


def test_licences(spark, odd, none):
    apache = "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n//\n"
    texts = ["Body.\nReleased under the MIT License.", apache, "SPDX-License-Identifier: MIT\nAll rights reserved.", "see the license", None, ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].licenses == "MIT" and got[0].n_known == 1 and not got[0].unmatched
    assert got[1].licenses == "Apache-2.0"
    assert got[2].sentence_ids.startswith("SPDX") or got[2].n_known >= 1
    assert [got[i].licenses for i in (3, 4, 5)] == ["", "", ""]
    assert licenses.scan(odd).count() == len(DOCS)
    assert licenses.scan(none).count() == 0


def test_rules_take_the_longest_sequence_first(spark):
    known = (("A", "a"), ("B", "b"), ("C", "c"))
    rules = (("long", ("A", "B")), ("short", ("A",)), ("c", ("C", "C")))
    texts = ["a. b. a.", "a. x. b.", "c. c. c.", "b."]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known, rules).collect()}
    assert got == {0: ("long,short", False), 1: ("short", True), 2: ("c", True), 3: ("", True)}


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE
""",
    "GPL-3.0-or-later": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */""",
    "GPL-2.0-or-later": """# This program is free software; you can redistribute it and/or modify it
# under the terms of the GNU General Public License as published by the Free
# Software Foundation; either version 2 of the License, or (at your option)
# any later version.""",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this""",
    "Apache-2.0": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
// See the License for the specific language governing permissions and
// limitations under the License.""",
}


def test_published_notices_are_found_as_they_are_wrapped(spark):
    texts = [*NOTICES.values(), "// SPDX-License-Identifier: MIT\npackage main\n", "# SPDX-License-Identifier: Apache-2.0\n", "/* SPDX-License-Identifier: GPL-3.0-or-later */\nint x;", "SPDX-License-Identifier: MIT OR X"]
    texts.append(re.sub(r"3\. Neither.*?permission\.\n", "", NOTICES["BSD-3-Clause"], flags=re.S))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(len(texts))] == [*NOTICES, "MIT", "Apache-2.0", "GPL-3.0-or-later", "", "BSD-2-Clause"]
    assert got[0].sentence_ids == "MITTitle,MITGrant,MITNotice,AsIs,MITLiable"
    assert got[1].sentence_ids == "BSDRedistribute,BSDSource,BSDBinary,BSDEndorse,BSDAsIs"
    assert got[2].sentence_ids == "GPLFree,GPLHope,GPLSee"
    assert got[5].sentence_ids == "ApacheHead,ApacheUse,ApacheCopy,ApacheWarranty,ApacheSee" and not got[5].unmatched
    assert got[6].sentence_ids == "SPDXMIT" and not got[6].unmatched


def test_every_sentence_and_rule_fires_in_any_wrapping(spark):
    own = {ident: sentence for ident, sentence in licenses.SENTENCES}
    cases = [(ident, s) for ident, s in licenses.SENTENCES] + [(licence, ".\n\n".join(own[x] for x in ids)) for licence, ids in licenses.RULES]
    rng = random.Random(12)
    texts = []
    for _, s in cases:
        shout = lambda w: w.upper() if rng.random() < 0.5 else w
        texts.append("Body.\n\n" + "\n\n".join("".join(shout(w) + rng.choice([" ", " ", "\n", ": ", "; "]) for w in part.split()) for part in s.split("\n\n")) + "\n")
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = len(licenses.SENTENCES)
    assert [got[i].sentence_ids for i in range(n)] == [ident for ident, _ in cases[:n]]
    assert [got[i].licenses for i in range(n, len(cases))] == [licence for licence, _ in cases[n:]]


# token counts


def greedy(word, first, rest):
    count, at = 0, 0
    while at < len(word):
        pool = first if at == 0 else rest
        for end in range(len(word), at, -1):
            if word[at:end] in pool:
                break
        else:
            return 1
        count, at = count + 1, end
    return count


def test_automaton_counts_as_greedy_matching():
    rng = random.Random(1)
    for _ in range(200):
        make = lambda: frozenset(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12)))
        first, rest = make(), make()
        machine = pieces.Automaton(first, rest)
        for _ in range(50):
            word = bytes(rng.choice(b"abcd"[: rng.choice((3, 4))]) for _ in range(rng.randint(1, 12)))
            assert machine.count(word) == greedy(word, first, rest), (word, first, rest)


def test_token_counts(odd, none):
    first, rest = pieces.vocabulary()
    got = pieces.token_counts(odd).collect()
    want = []
    for i, t, _ in DOCS:
        units = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]", (t or "").encode())
        memory = {u: greedy(u, first, rest) for u in set(units) if len(u) < 5000}
        machine = pieces.Automaton(first, rest) if any(len(u) >= 5000 for u in units) else None
        want.append((i, len((t or "").encode()), len(units), sum(memory.get(u) or machine.count(u) for u in units)))
    assert as_counts((r.doc_id, r.n_bytes, r.n_words, r.n_tokens) for r in got) == as_counts(want)
    assert pieces.token_counts(none).count() == 0


# top-k


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vecs = [(i, (rng.normal(size=16) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist()) for i in range(700)]
    vecs[10] = (10, None)
    vecs[20] = (20, [float("nan")] * 16)
    vecs[30] = (30, [None] * 16)
    vecs[40] = (40, vecs[41][1])
    vecs[50] = (50, [float("inf")] + [0.0] * 15)
    vecs[60] = (60, [0.0] * 16)
    vecs += [vecs[70], vecs[70], (80, vecs[81][1]), (90, [0.0] * 16), (5, vecs[70][1]), (None, vecs[71][1])]
    df = spark.createDataFrame([(*v, "c") for v in vecs], "vec_id long, embedding array<float>, score string").repartition(5)
    ok = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in vecs if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for at, (q, x) in enumerate(ok):
        if q % 10 == 0:
            best = sorted((-int(x @ y), i) for k, (i, y) in enumerate(ok) if k != at)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    blocks = topk.in_blocks
    monkeypatch.setattr(topk, "in_blocks", lambda *a: blocks(*a, rows=32))
    for group in (16, 1000):
        assert as_counts(topk.top_k(df, every=10, k=5, group=group).collect()) == as_counts(want)
    assert topk.top_k(df.where("false")).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 65536)]


def test_short_blocks_are_not_read(spark, monkeypatch):
    """Vectors along one line: after the first block every other one is out of reach."""
    rows = [(i, [float(2000 - i), 0.0, 1.0]) for i in range(2000)]
    seen = []
    blocks = topk.in_blocks
    monkeypatch.setattr(topk, "in_blocks", lambda *a: seen.append(blocks(*a, rows=50)) or seen[-1])
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.count() == 200 and {r.vec_id for r in got.collect()} <= set(range(6))
    assert seen[0].count() >= 40 and seen[0].where(F.col("top") >= 256 * 1995).count() <= 2


# language model


def test_scores(spark, odd, none):
    got = pitmanyor.scored(odd)
    assert got.count() == len(DOCS)
    tokens = [[w.encode() for w in split(lower(t))] + [b"\n"] for _, t, _ in DOCS]
    out = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _, _ in DOCS]
    counts = collections.Counter(w for t, h in zip(tokens, out, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = as_counts((d[0], h, len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t, h in zip(DOCS, tokens, out, strict=True))
    assert as_counts((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()) == want
    assert pitmanyor.scored(none).count() == 0
    only = pitmanyor.scored(odd.where(pitmanyor.held_out())).collect()
    assert only and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in only)


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(9)
    after = {a: [rng.choice("abcdefghijklmnop") for _ in range(2)] for a in "abcdefghijklmnop"}
    rows = []
    for i in range(400):
        w = ["a"]
        for _ in range(40):
            w.append(rng.choice(after[w[-1]]))
        rows.append((i, " ".join(w)))
    row = pitmanyor.perplexity(pitmanyor.scored(spark.createDataFrame(rows, "doc_id long, text string"))).where("held_out").first()
    assert row.perplexity < 0.5 * row.base_perplexity


# toxicity


def toxic_rows(n=1500):
    rng = random.Random(11)
    plain = ["w" + "".join(chr(97 + i // 26**k % 26) for k in range(2)) for i in range(400)]
    bad = [f"schimpf{c}" for c in "abcdef"] + ["idiot", "moron"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), int(toxic)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxic_text_is_found_in_held_out_rows(spark):
    docs, labels = toxic_rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string, truth int")
    got = toxicity.scored(frame.drop("truth"), spark.createDataFrame(labels, "doc_id long, toxic int")).join(frame, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = sum(r.predicted == r.truth for r in got)
    assert right > 0.97 * len(got)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_all_labelled_rows_count_whatever_the_classifier_is_fitted_on(spark, monkeypatch):
    docs, labels = toxic_rows(900)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    rare = [i for i in range(10_000, 10_060) if fold(i) != 2][:24]
    more = [(i, docs[i - 10_000][1].replace("schimpf", "w") + " raregift", 1) for i in rare]
    frame = spark.createDataFrame([d[:2] for d in docs + more], "doc_id long, text string")
    labels += [(i, 1) for i in rare if fold(i) == 0]
    voted, terms = [], []
    model, learn = toxicity.label_model, toxicity.learned_terms
    monkeypatch.setattr(toxicity, "label_model", lambda votes: voted.append((votes.count(), votes.columns)) or model(votes))
    monkeypatch.setattr(toxicity, "learned_terms", lambda *a: terms.append(learn(*a)) or terms[-1])
    got = toxicity.scored(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), fit_rows=30).collect()
    assert len(got) == len(docs) + len(more)
    assert voted == [(len(got), ["doc_id", "text_key", "votes", "features"])]
    assert {"raregift", "^raregif"} <= set(terms[0])


def test_label_model_is_that_of_whole_arrays(spark):
    """EM over one array: classes by their mean votes, one covariance for both, no labels."""
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.15
    m = len(toxicity.voter_names())
    rates = np.where(truth[:, None], rng.random(m) * 0.8, rng.random(m) * 0.05)
    votes = (rng.random((3000, m)) < rates).astype(float)
    votes[:, 1] = votes[:, 0]  # two that always vote together
    weights, bias = np.ones(m), -2.5
    for _ in range(toxicity.EM_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(votes @ weights + bias, -30, 30)))
        a, b = p @ votes / p.sum(), (1 - p) @ votes / (1 - p).sum()
        cov = sum((w[:, None] * (votes - c)).T @ (votes - c) for w, c in ((p, a), (1 - p, b))) / len(votes)
        cov += np.eye(m) * (0.02 + 1 / len(votes))
        weights = np.linalg.solve(cov, a - b)
        bias = -0.5 * (a + b) @ weights + np.log(p.sum() / (1 - p).sum())
    frame = spark.createDataFrame([(v.tolist(),) for v in votes], "votes array<double>").repartition(3)
    got, got_bias = toxicity.label_model(frame)
    assert np.allclose(got, weights, rtol=1e-6, atol=1e-8) and math.isclose(got_bias, bias, rel_tol=1e-6)
    assert ((toxicity.posterior(votes, got, got_bias) > 0.5) == truth).mean() > 0.97


def test_held_out_labels_are_never_read(spark):
    docs, labels = toxic_rows(400)
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    one, two = (sorted(map(tuple, toxicity.scored(frame, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", F.round("score", 9)).collect())) for x in (labels, turned))
    assert one == two


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (None, 1), (7, None), (17, 1)], "doc_id long, toxic int")
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.accepted(odd, labels.where("false"))
    assert kept.columns == odd.columns
    assert toxicity.scored(none, labels).count() == 0
    assert toxicity.scored(odd, labels.where("false")).count() == len(DOCS)


def test_stored_tables_go_on_release(spark):
    one = common.stored(spark.range(5).toDF("a"), "test")
    assert one.count() == 5
    common.release(spark)
    assert not common._written
    with pytest.raises(Exception, match="(?i)not_found|not exist|FileNotFound|FILE_NOT_EXIST"):
        spark.read.schema("a long").parquet(one.inputFiles()[0]).count()


def test_schema_of_odd_rows_has_clashing_names():
    assert SCHEMA.count("_key") and SCHEMA.count("_row")


def test_words_and_classifier_come_from_all_rows_that_are_not_held_out(spark, monkeypatch):
    docs, labels = toxic_rows(900)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    rare = [i for i in range(10_000, 10_060) if fold(i) == 2][:12]
    more = [(i, docs[i - 10_000][1].replace("schimpf", "w") + f" raregift w{i}", 1) for i in rare]
    frame = spark.createDataFrame([d[:2] for d in docs + more], "doc_id long, text string")
    labels += [(i, 1) for i in rare]
    terms, fitted = [], []
    learn, fit = toxicity.learned_terms, toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "learned_terms", lambda *a: terms.append(learn(*a)) or terms[-1])
    monkeypatch.setattr(toxicity, "fit_logistic", lambda rows, *a: fitted.append(rows.count()) or fit(rows, *a))
    assert toxicity.scored(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == len(docs) + len(more)
    assert fitted == [sum(fold(d[0]) != 1 for d in docs + more)]
    assert "raregift" in terms[0]


def test_words_of_rows_stay_in_their_buckets(spark, monkeypatch):
    """Labels come to the words by doc_id alone; a second key would send all words through a shuffle."""
    docs, labels = toxic_rows(90)
    twice = [(docs[0][0], "another text of a labelled row"), (docs[1][0], docs[1][1])]  # one doc_id with two texts, one row twice
    frame = spark.createDataFrame([d[:2] for d in docs] + twice, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id is not null")
    plans, store = [], toxicity.stored

    def watched(df, what):
        if "bag" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, what)

    monkeypatch.setattr(toxicity, "stored", watched)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.learned_terms(frame, known)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    moved = [line for line in plans[0].splitlines() if "Exchange" in line]
    assert len(plans) == 1 and len(moved) == 1 and "SortMergeJoin" in plans[0]
