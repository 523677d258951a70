"""The language model against a sampler that seats one customer after another."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from kairograph.llm import pitmanyor as lm
from kairograph.llm import seating


def seat(sizes, weight, discount, rng):
    """Seat a customer; true where it opens a table."""
    at = rng.random() * (sum(sizes) - discount * len(sizes) + weight)
    for k, n in enumerate(sizes):
        at -= n - discount
        if at < 0:
            sizes[k] += 1
            return False
    sizes.append(1)
    return True


def leave(sizes, rng):
    """Take a random customer away; true where its table is gone."""
    at = rng.randrange(sum(sizes))
    for k, n in enumerate(sizes):
        at -= n
        if at < 0:
            sizes[k] -= 1
            if not sizes[k]:
                del sizes[k]
                return True
            return False


@pytest.mark.parametrize(("count", "weight"), [(2, 0.3), (5, 3.0), (20, 0.5), (32, 4.0), (60, 5.0)])
def test_tables_of_a_group_are_those_of_one_by_one_sampling(count, weight):
    rng, sizes, total = random.Random(1), [], 0
    for _ in range(count):
        seat(sizes, weight, 0.8, rng)
    rounds = 40_000 // count
    for k in range(rounds + rounds // 4):
        for _ in range(count):
            leave(sizes, rng)
            seat(sizes, weight, 0.8, rng)
        total += len(sizes) if k >= rounds // 4 else 0
    got = seating.mean_tables(np.full(2000, count), np.full(2000, weight), 0.8, 8, 4, np.random.default_rng(2)).mean() / 4
    assert math.isclose(got, total / rounds, rel_tol=0.06)


@pytest.mark.parametrize(("count", "weight"), [(5, 0.1), (40, 0.5), (200, 2.0), (200, 30.0)])
def test_tables_of_a_group_are_those_of_the_recursion(count, weight):
    """The chance of t tables goes with weight ** t times the ways to seat the customers at t tables."""
    ways = np.append([0.0, 1.0], np.zeros(count))
    for n in range(1, count):
        ways[1:] = ways[:-1] + np.maximum(n - 0.8 * np.arange(1, count + 2), 0) * ways[1:]
        ways /= ways.max()
    chance = ways * np.exp((np.arange(count + 2) - count / 2) * math.log(weight))
    want = (chance * np.arange(count + 2)).sum() / chance.sum()
    got = seating.mean_tables(np.full(3000, count), np.full(3000, weight), 0.8, lm.SWEEPS, lm.KEPT, np.random.default_rng(2)).mean() / lm.KEPT
    assert math.isclose(got, want, rel_tol=0.06)


@pytest.mark.parametrize(("count", "weight"), [(12, 1.0), (200, 2.0), (200, 30.0), (1000, 5.0)])
def test_one_draw_has_the_whole_distribution(count, weight):
    """Nothing need settle: the first draw is as good as any."""
    ways = np.append([0.0, 1.0], np.zeros(count))
    for n in range(1, count):
        ways[1:] = ways[:-1] + np.maximum(n - 0.8 * np.arange(1, count + 2), 0) * ways[1:]
        ways /= ways.max()
    with np.errstate(divide="ignore"):
        chance = np.log(ways) + np.arange(count + 2) * math.log(weight)
    chance = np.exp(chance - chance.max())
    got = np.bincount(seating.mean_tables(np.full(20_000, count), np.full(20_000, weight), 0.8, 1, 1, np.random.default_rng(2)), minlength=count + 2) / 20_000
    assert np.abs(got - chance / chance.sum()).sum() / 2 < 0.025


def test_groups_with_many_tables_are_swept_and_stay_in_their_places():
    count, weight = np.array([400, 2, 4097, 400, 300]), np.array([1e9, 1e9, 1e-9, 1e-9, 1e9])
    assert (seating.mean_tables(count, weight, 0.8, 4, 2, np.random.default_rng(2)) / 2).round().tolist() == [400, 2, 1, 1, 300]


def test_groups_of_all_sizes_come_back_in_their_places():
    rng = np.random.default_rng(3)
    count = rng.permutation(np.concatenate([np.zeros(5, int), np.ones(50, int), rng.integers(2, 40, 400), [10_000, 500, 64]]))
    weight = np.where(count % 2 == 0, 1e-9, 1e9)
    got = seating.mean_tables(count, weight, 0.8, 4, 2, rng) / 2
    assert np.array_equal(got[count <= 1], count[count <= 1])
    even, odd = (count > 1) & (count % 2 == 0), (count > 1) & (count % 2 == 1)
    assert (got[even] < 1.5).all() and (got[odd] == count[odd]).all()


def corpus(n=150, words=30):
    rng = random.Random(5)
    after = {w: [f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(4)] for w in ["\n", *(f"w{k}" for k in range(words))]}
    rows = []
    for i in range(n):
        text, last = [], "\n"
        for _ in range(rng.randint(5, 40)):
            last = rng.choice(after[last]) if rng.random() < 0.8 else f"w{rng.randrange(words)}"
            text.append(last)
        rows.append((i, " ".join(text)))
    return rows


def plain_model(rows, sweeps=60, burn=20):
    """Predictive probabilities of a hierarchy of restaurants, every customer moved alone, the parent's with it."""
    rng = random.Random(7)
    d, s, d0, s0 = lm.DISCOUNT, lm.STRENGTH, lm.PARENT_DISCOUNT, lm.PARENT_STRENGTH
    pairs = collections.Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = [*text.split(), "\n"]
            pairs.update(zip(["\n", *w[:-1]], w, strict=True))
    vocabulary = {w for _, w in pairs}
    base = 1 / (len(vocabulary) + 1)
    tables, own = collections.defaultdict(list), collections.defaultdict(int)
    parent, parent_tables, dishes = collections.defaultdict(list), 0, 0

    def below(w):
        return (sum(parent[w]) - d0 * len(parent[w]) + (s0 + d0 * parent_tables) * base) / (s0 + dishes)

    def come(u, w):
        nonlocal parent_tables, dishes
        if seat(tables[u, w], (s + d * own[u]) * below(w), d, rng):
            own[u] += 1
            parent_tables += seat(parent[w], (s0 + d0 * parent_tables) * base, d0, rng)
            dishes += 1

    def go(u, w):
        nonlocal parent_tables, dishes
        if leave(tables[u, w], rng):
            own[u] -= 1
            parent_tables -= leave(parent[w], rng)
            dishes -= 1

    for (u, w), n in pairs.items():
        for _ in range(n):
            come(u, w)
    customers = collections.Counter()
    for (u, _), n in pairs.items():
        customers[u] += n
    seats, backs, lower, kept = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for k in range(sweeps):
        for (u, w), n in pairs.items():
            for _ in range(n):
                go(u, w)
                come(u, w)
        if k >= burn:
            kept += 1
            for p in pairs:
                seats[p] += len(tables[p])
            for u in customers:
                backs[u] += own[u]
            for w in [*vocabulary, None]:
                lower[w] += below(w)

    def prob(u, w):
        p0 = lower[w if w in vocabulary else None] / kept
        mine = pairs[u, w] - d * seats[u, w] / kept if (u, w) in pairs else 0.0
        return (mine + (s + d * backs[u] / kept) * p0) / (s + customers[u])

    return prob, {p: n / kept for p, n in seats.items()}, pairs


def test_scores_and_tables_are_those_of_one_by_one_sampling(spark):
    """On few words whose pairs come again and again the totals settle late, so more phases and sweeps are averaged here."""
    rows = corpus()
    prob, seats, pairs = plain_model(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs, phases=14, sweeps=10, kept=8)
    got = {r.doc_id: r.score for r in lm.score(model).collect()}
    want = {}
    for i, text in rows:
        w = [*text.split(), "\n"]
        want[i] = sum(math.log10(prob(u, x)) for u, x in zip(["\n", *w[:-1]], w, strict=True))
    assert all(math.isclose(got[i], want[i], rel_tol=0.02, abs_tol=0.5) for i in want)
    assert math.isclose(sum(got.values()), sum(want.values()), rel_tol=0.004)
    assert math.isclose(model.parent["dishes"], sum(seats.values()), rel_tol=0.08)


def test_probabilities_after_a_word_sum_to_one(spark):
    model = lm.train(spark.createDataFrame(corpus(60), "doc_id long, text string"))
    told, buckets = model.told.toPandas(), model.table.toPandas()
    parent = model.parent
    base = (lm.PARENT_STRENGTH + lm.PARENT_DISCOUNT * parent["tables"]) / (parent["vocabulary"] + 1) / (lm.PARENT_STRENGTH + parent["dishes"])
    share, below, count, tables = {}, {}, collections.Counter(), collections.Counter()
    for row in buckets.itertuples(index=False):
        own = told[told["bucket"] == row.bucket]
        p, own_share, counts = lm.shares(row, own, parent, model.buckets)
        own = own[own["own"].isna()]
        names, customers = p.names[p.place], lm._spread_told(own, p, model.buckets, "customers", False, False)
        below |= dict(zip(p.words.tolist(), lm._below(own, p, model.buckets, parent, False).tolist(), strict=True))
        share |= dict(zip(zip(names.tolist(), p.words[p.word].tolist(), strict=True), own_share.tolist(), strict=True))
        told_tables = customers - lm._spread_told(own, p, model.buckets, "fewer", False, False) / parent["kept"]
        count |= dict(zip(p.names.tolist(), customers.tolist(), strict=True))
        tables |= dict(zip(p.names.tolist(), told_tables.tolist(), strict=True))
        assert counts.sum() >= 0
    assert math.isclose(sum(v for w, v in below.items()) + base, 1 + base * sum(v == base for v in below.values()), rel_tol=1e-5)
    known = {w for w, v in below.items() if v > base * 1.000001}
    for u in list(count)[:20]:
        own = {w: v for (x, w), v in share.items() if x == u and w in known}
        rest = 1 - sum(below[w] for w in own)
        back = (lm.STRENGTH + lm.DISCOUNT * tables[u]) / (lm.STRENGTH + count[u])
        assert math.isclose(sum(own.values()) + back * rest, 1, rel_tol=1e-4)


def test_a_frequent_word_is_spread_and_changes_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "a", f"x{i % 9}"]) for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r for r in lm.scored(docs).collect()}
    hashes = np.sort(np.array([xxhash.xxh64_intdigest(w, lm.SEED) for w in (b"the", b"a", lm.END)], np.uint64))
    monkeypatch.setattr(lm, "frequent", lambda docs, buckets: hashes)
    spread = {r.doc_id: r for r in lm.scored(docs).collect()}
    for i, r in plain.items():
        s = spread[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (s.n_tokens, s.n_known, s.train_tokens, pytest.approx(s.base_score))
        assert math.isclose(r.score, s.score, rel_tol=0.03, abs_tol=0.5)


def test_sampling_finds_the_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLED", 1)
    docs = spark.createDataFrame([(i, "the " * 8 + f"w{i} v{i}") for i in range(50)], "doc_id long, text string")
    assert lm.frequent(docs, 8).tolist() == sorted(xxhash.xxh64_intdigest(w, lm.SEED) for w in (b"the", lm.END))


def test_repeated_rows_and_long_texts_are_scored_alike(spark):
    long = "word other " * 60_000
    rows = [(1, "a b a b"), (1, "a b a b"), (1, "a b a b"), (2, long), (2, long), (None, "a b"), (3, None), (4, "")]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id == 2}) == 1
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id or 0) if r.doc_id in (3, 4)] == [1, 1]


def test_portions_do_not_depend_on_how_rows_arrive(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(lm, "BATCH_BYTES", 100)
    rng = random.Random(3)
    texts = [rng.choice([None, "", "x" * 250]) if rng.random() < 0.3 else "y" * rng.randint(1, 60) for _ in range(200)]
    frame = pd.DataFrame({"text": texts, "id": range(200)})
    cut = lambda step: [p["id"].tolist() for p in lm._portions(frame.iloc[a : a + step] for a in range(0, 200, step))]
    whole = cut(200)
    assert sum(whole, []) == list(range(200)) and len(whole) > 20
    assert cut(1) == cut(7) == whole
