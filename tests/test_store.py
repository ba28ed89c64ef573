"""The chunk store's versions, replacement and index."""

import pytest
from pyspark.sql import functions as F

from lodestack.errors import CONFLICT, AppError, is_kind
from lodestack.sources.store import ChunkStore


def rows(spark, *data):
    df = spark.createDataFrame(data, "id string, file_path string, content string")
    none = F.array().cast("array<string>")
    return df.select("id", "file_path", F.lit("go").alias("language"), "content", F.lit("other").alias("chunk_type"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.create_map().cast("map<string,string>").alias("metadata"), none.alias("dependencies"))


def test_versions(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), dim=3, buckets=4)
    assert store.chunks().count() == 0 and store.postings().count() == 0
    store.upsert(rows(spark, ("1", "a.go", "alpha beta"), ("2", "a.go", "beta"), ("3", "b.go", "gamma")))
    before = store.chunks()  # a reader of the old state
    store.upsert(rows(spark, ("4", "a.go", "delta delta")))
    assert sorted(r.id for r in store.chunks().collect()) == ["3", "4"] and sorted(r.id for r in before.collect()) == ["1", "2", "3"]
    assert {(r.term, r.id): r.tf for r in store.postings().collect()} == {("gamma", "3"): 1, ("delta", "4"): 2}
    assert {r.id: r.dl for r in store.docs().collect()} == {"3": 1, "4": 2}
    store.delete_files(spark.createDataFrame([("b.go",), ("missing.go",)], "file_path string"))
    assert [r.id for r in store.chunks().collect()] == ["4"] and store.docs().count() == 1
    again = ChunkStore(spark, str(tmp_path / "s"), dim=3)
    assert again.buckets == 4 and again.get("4").content == "delta delta"
    with pytest.raises(AppError):
        ChunkStore(spark, str(tmp_path / "s"), dim=5)
    store.clear()
    assert store.chunks().count() == 0


def test_two_writers_conflict_and_vacuum(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=2)
    head = store._load()
    store.upsert(rows(spark, ("1", "a.py", "one")))
    with pytest.raises(AppError) as e:
        store._save(head)  # a writer that started from the state before
    assert is_kind(e.value, CONFLICT)
    state = store.state()
    for n in range(5):
        store.upsert(rows(spark, ("1", "a.py", f"text {n}")))
    assert store.state() != state and store.vacuum(keep=2) > 0
    assert [r.content for r in store.chunks().collect()] == ["text 4"] and len(store._pointers()) == 2
    assert sorted(p.name[:2] for p in (tmp_path / "s").iterdir() if p.name.startswith("v-")) == ["v-", "v-"]
    again = ChunkStore(spark, str(tmp_path / "s"), buckets=9)
    assert again.buckets == 2 and again.chunks().count() == 1


def test_a_large_bucket_is_indexed_by_several_tasks(spark, tmp_path, monkeypatch):
    from lodestack.sources import store as module

    monkeypatch.setattr(module, "PART_BYTES", 1 << 10)
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=2)
    data = [(str(i), "a.go", f"alpha word{i} " * 3) for i in range(200)] + [("empty", "a.go", "")]
    store.upsert(rows(spark, *data))
    posts = store.postings().withColumn("file", F.input_file_name())
    assert posts.select("file").distinct().count() > 1
    assert posts.groupBy("id").agg(F.count_distinct("file").alias("n")).filter("n > 1").count() == 0
    assert {(r.term, r.id): r.tf for r in store.postings().collect()} == {(t, str(i)): 3 for i in range(200) for t in ("alpha", f"word{i}")}
    assert {r.id: r.dl for r in store.docs().collect()} == {str(i): 6 for i in range(200)} | {"empty": 0}
