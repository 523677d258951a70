"""Every stage of the pipeline against plain versions, on documents with every odd case."""

import collections
import zlib

import pytest

import corpus_pipeline as pipeline
from kairograph.llm import mixing, simhash, toxicity
from tests.llm.conftest import odd_rows
from tests.llm.test_operators import DOCS, classes, contamination, jump, slow_print, split

OWN = [(i, t, s) for i, t, s in DOCS]


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    odd.write.parquet(f"{at}/documents.parquet")
    long = next(t for _, t, _ in DOCS if t and len(split(t)) == 60)
    spark.createDataFrame([(1, " ".join(split(long)[10:40])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(17, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def counted(rows):
    return collections.Counter((r.doc_id, r.text, r.source) for r in rows)


def test_toxic_rows_go(spark, docs, folder):
    got = pipeline.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns
    bad = {(r.doc_id, r.text_key) for r in toxicity.scored(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1").collect()}
    keyed = docs.selectExpr("doc_id", "text", "source", "xxhash64(text) AS k").collect()
    assert counted(got.collect()) == counted(r for r in keyed if (r.doc_id, r.k) not in bad)


def test_one_of_each_group_of_copies_stays(spark, docs, folder):
    got = pipeline.near_dedup(spark, docs, folder)
    assert got.columns == docs.columns
    prints = [slow_print(t) for _, t, _ in DOCS]
    root = classes(len(DOCS), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for (i, _, _), r in zip(DOCS, root, strict=True):
        least[r] = min(least.get(r, 2**63), 2**63 if i is None else i)
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((v == 2**63, 0 if v == 2**63 else v) for v in least.values())
    assert set(counted(rows)) <= set(OWN)


def test_no_keys_of_near_copies_go_to_the_driver(spark, docs, folder, monkeypatch):
    plans, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or components(links))
    pipeline.near_dedup(spark, docs, folder)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_contaminated_rows_go(spark, docs, folder):
    got = pipeline.decontaminate(spark, docs, folder)
    assert got.columns == docs.columns
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = contamination(DOCS, items)
    assert any(b[-1] for b in bad)
    assert counted(got.collect()) == collections.Counter(d for d, b in zip(OWN, bad, strict=True) if not b[-1])


def test_the_mix_is_taken_in_its_order(spark, docs, folder):
    got = pipeline.mix_sources(spark, docs, folder)
    assert got.columns == docs.columns
    taken = mixing.mix(docs).where("taken").orderBy("finish").collect()
    rows = got.collect()
    assert collections.Counter((r.doc_id, r.source) for r in rows) == collections.Counter((r.doc_id, r.source) for r in taken)
    finish = collections.defaultdict(list)
    for r in taken:
        finish[r.doc_id, r.source, r["size"]].append(r.finish)
    order = [finish[r.doc_id, r.source, len(split(r.text))].pop(0) for r in rows]
    assert order == sorted(order)


def test_shards_keep_rows_whole_and_in_order(spark, docs, folder):
    got = pipeline.shard(spark, docs, folder).collect()
    assert counted(got) == collections.Counter(OWN)
    stored = docs.selectExpr("doc_id", "text", "_metadata.file_path AS f", "_metadata.row_index AS n").collect()
    want = collections.defaultdict(list)
    for r in sorted(stored, key=lambda r: (r.f, r.n)):
        want[jump(r.doc_id or 0, 16)].append((r.doc_id, r.text))
    have = collections.defaultdict(dict)
    for r in got:
        assert (r["size"], r.text_crc32, r.grown_shard) == (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), jump(r.doc_id or 0, 17))
        have[r.shard][r.slot] = (r.doc_id, r.text)
    assert {s: [x[k] for k in range(len(x))] for s, x in have.items()} == dict(want)


def test_all_stages_after_one_another(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    assert rows and set(counted(rows)) <= set(OWN)
    prints = collections.defaultdict(set)
    for r in rows:
        prints[slow_print(r.text)].add(r.doc_id)
    assert all(len(x) == 1 for x in prints.values())
    assert max(counted(rows).values()) <= 2
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_tables(spark, none, folder, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(odd_rows()) == len(OWN)
