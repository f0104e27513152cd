import json
import os

import pytest
from pyspark.sql import functions as F

from dragoman.functions import text as X
from dragoman.functions.arrow import hash_vector
from dragoman.operators import ranking, search
from dragoman.sources.store import ChunkStore, Conflict, Stale, bucket, create_store

SCHEMA = "chunk_id string, doc_name string, text string, category string"


def table(spark, docs, version=0, chunks=3):
    rows = [(f"{d}_c{i}", d, f"text {i} of {d} v{version}", "x") for d in docs for i in range(chunks)]
    return spark.createDataFrame(rows, SCHEMA)


def content(store):
    return {(r.doc_name, r.chunk_id): r.text for r in store.chunks().collect()}


def model(rows):
    return {(r.doc_name, r.chunk_id): r.text for r in rows.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return create_store(table(spark, [f"d{i}" for i in range(20)]), str(tmp_path / "store"), buckets=5)


def test_changes_touch_their_buckets_only(spark, store):
    want = content(store)
    changed = table(spark, ["d3", "new"], 1, 5)
    mine = {str(r[0]) for r in changed.select(bucket(5)).distinct().collect()}
    after = store.upsert(changed)
    want |= model(changed)
    assert content(after) == want
    for b, part in after.manifest["parts"].items():
        assert (part != store.manifest["parts"].get(b)) == (b in mine)
    gone = after.delete(spark.createDataFrame([("d4",), ("d3",), (None,), ("unknown",)], "doc_name string"))
    want = {k: v for k, v in want.items() if k[0] not in ("d3", "d4")}
    assert content(gone) == want
    back = gone.upsert(table(spark, ["d4"], 2, 1))
    want |= model(table(spark, ["d4"], 2, 1))
    assert content(back) == want
    shrunk = back.reingest(table(spark, ["d5", "d6"], 3, 1))
    want = {k: v for k, v in want.items() if k[0] not in ("d5", "d6")} | model(table(spark, ["d5", "d6"], 3, 1))
    assert content(shrunk) == want
    small = shrunk.compact()
    assert content(small) == want and all(len(p["rows"]) == 1 and not p["gone"] for p in small.manifest["parts"].values())
    assert small.compact() is small
    one = next(iter(small.manifest["parts"]))
    assert content(small.compact([one])) == want


def test_readers_keep_the_version_they_opened(spark, store):
    before, want = store.chunks(), content(store)
    after = store.upsert(table(spark, ["d1"], 9)).compact()
    assert model(before) == want
    assert content(ChunkStore(spark, store.root, 1)) == want
    assert content(ChunkStore(spark, store.root)) == content(after) != want
    after.vacuum()
    assert content(ChunkStore(spark, store.root)) == content(after)
    with pytest.raises(FileNotFoundError):
        ChunkStore(spark, store.root, 1)


def test_failed_and_rival_writes_change_nothing(spark, store, monkeypatch):
    want = content(store)
    broken = table(spark, ["d1"], 5).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken)
    monkeypatch.setattr(ChunkStore, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("down before the rename")))
    with pytest.raises(RuntimeError):
        store.upsert(table(spark, ["d1"], 6))
    monkeypatch.undo()
    assert content(ChunkStore(spark, store.root)) == want
    first = store.upsert(table(spark, ["d1"], 7))
    with pytest.raises(Conflict):
        store.upsert(table(spark, ["d2"], 8))
    assert content(ChunkStore(spark, store.root)) == content(first)
    with pytest.raises(Conflict):
        create_store(table(spark, ["d1"]), store.root)
    manifests = os.listdir(f"{store.root}/manifests")
    assert all(json.load(open(f"{store.root}/manifests/{m}")) for m in manifests if m.endswith(".json"))


def test_empty_changes_and_repeated_ids(spark, tmp_path):
    none = create_store(table(spark, []), str(tmp_path / "none"))
    assert content(none) == {} and none.chunks().columns == ["chunk_id", "doc_name", "text", "category"]
    twice = table(spark, ["d1"]).unionByName(table(spark, ["d1"], 1))
    kept = none.upsert(twice)
    assert kept.chunks().count() == 3
    assert content(kept.delete(spark.createDataFrame([], "doc_name string"))) == content(kept)


def test_search_of_the_store_equals_search_of_the_texts(spark, tmp_path):
    rows = [(f"c{i}", f"d{i // 2}", f"red fox number{i % 5} runs over hill{i}", "x") for i in range(40)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    asks = spark.createDataFrame([(1, "red hill7"), (2, "number3"), (3, "none")], "query_id long, text string")
    store = create_store(chunks.filter("chunk_id <> 'c7'"), str(tmp_path / "store"))
    with pytest.raises(Stale):
        store.search(asks)
    store = store.refresh()
    assert store.search(asks, 5).count()
    store = store.upsert(chunks.filter("chunk_id = 'c7'"))
    with pytest.raises(Stale):
        store.search(asks)
    store = store.refresh().compact()  # compaction leaves the chunks, and so the search tables, as they are
    got = store.search(asks, 5).collect()
    vectors = chunks.select("chunk_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding"))
    near = search.vector_topk(vectors, asks.select("query_id", hash_vector(X.search_terms(F.col("text"))).alias("embedding")), 5)
    want = ranking.merge_candidates(search.bm25_topk(chunks, asks, 5), near).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
