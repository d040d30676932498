"""The committing index: versions, buckets and search by postings."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.operators import index_store, indexing, retrieval

FIELDS = ("chunk_id", "doc_name", "filename", "point_identity_key", "point_number", "heading_path_text", "text")


def chunks(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "x1", "the", "of"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(f"c{i}", rng.choice(["doc", "DOC", "rare name", None]), f"f{i % 7}.txt", rng.choice(["", f"k{i % 3}"]), str(i % 5), say(rng.randint(0, 2)), rng.choice([say(rng.randint(1, 9)), None, "whole text here", "the"])) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FIELDS)).repartition(3)


def questions(spark, seed=2):
    rng = random.Random(seed)
    asked = ["", None, "alpha", "beta THE", "the of", "gamma été x1", "rare name", "f3.txt", "doc", "nothing", "...", "  alpha  ", "whole text here"]
    some = {
        "doc_name": [["doc"], ["rare name", "none"]], "filename": [["f1.txt"], ["f1.txt", "f2.txt", "f3.txt"]], "point_number": [["1", "2"], ["9"]], "text": [["alpha the"], ["the", "whole text here"], ["..."], ["alpha alpha"]],
        "heading_path_text": [["beta"], ["Beta", "the"]], "chunk_id": [["c3"], ["c1", "c2", "c50"]], "point_identity_key": [["k1"]], "other": [["x"]],
    }
    rows = []
    for i in range(120):
        filters = {k: rng.choice(v) for k, v in some.items() if rng.random() < 0.18}
        rows.append((i, rng.choice(asked), filters or None, rng.choice([None, 0, 2, 5, 500])))
    return spark.createDataFrame(rows, "qid int, query string, filters map<string,array<string>>, limit int")


def listed(hits):
    return sorted(tuple(str(r[c]) for c in ("qid", "tool", "rank", "score", *retrieval.ITEM_FIELDS)) for r in hits.collect())


@pytest.mark.parametrize(("block", "rows", "parts"), [(1 << 15, 10_000, 3), (4, 50, 5)])
def test_indexed_search_gives_the_rows_of_payload_search(spark, tmp_path, monkeypatch, block, rows, parts):
    monkeypatch.setattr(index_store, "BLOCK", block)
    monkeypatch.setattr(index_store, "WORDS_NAMED", 5 if block == 4 else 1000)
    c, q, path = chunks(spark, 300), questions(spark), str(tmp_path / "index")
    index_store.write_version(index_store.chunk_records(c), path, bucket_rows=rows, parts=parts)
    want = listed(retrieval.payload_search(q, c))
    assert listed(index_store.indexed_search(q, path)) == want and len(want) > 300


def test_an_index_of_nothing(spark, tmp_path):
    q, path = questions(spark), str(tmp_path / "index")
    assert index_store.indexed_search(q, path).collect() == [] and index_store.manifest(spark, path) is None and index_store.vacuum(spark, path) == []
    index_store.write_version(index_store.chunk_records(chunks(spark, 0)), path)
    assert index_store.read_records(spark, path) is None and index_store.indexed_search(q, path).collect() == []
    index_store.write_version(index_store.chunk_records(chunks(spark, 5)), path)
    gone = chunks(spark, 5).select(ids.index_point_id(F.col("chunk_id")).alias("id"))
    index_store.write_version(index_store.chunk_records(chunks(spark, 0)), path, removed=gone)
    assert index_store.read_records(spark, path) is None and index_store.indexed_search(q, path).collect() == []


def state(spark, path, found=None):
    out = index_store.read_records(spark, path, found)
    return {r["chunk_id"]: r["text"] for r in out.select("payload.*").collect()}


def test_an_upsert_writes_only_what_its_ids_touch(spark, tmp_path):
    path, c = str(tmp_path / "index"), chunks(spark, 400)
    first = index_store.write_version(index_store.chunk_records(c), path, bucket_rows=25, parts=2)
    assert first["buckets"] == 16 and set(first["at"].values()) == {1}
    old = state(spark, path)
    new = c.where("chunk_id IN ('c3', 'c4')").withColumn("text", F.lit("zebra"))
    second = index_store.write_version(index_store.chunk_records(new), path, removed=c.where("chunk_id = 'c9'").select(ids.index_point_id(F.col("chunk_id")).alias("id")))
    touched = {r[0] for r in c.where("chunk_id IN ('c3', 'c4', 'c9')").select(index_store.bucket_of(ids.index_point_id(F.col("chunk_id")), 16)).collect()}
    assert {b for b, v in second["at"].items() if v == 2} == touched and len(touched) < 4
    for kind in ("records", "postings"):
        assert {p.name for p in (tmp_path / "index" / kind / "version=2").iterdir() if p.is_dir()} == {f"bucket={b}" for b in touched}
    assert state(spark, path) == {k: v for k, v in old.items() if k != "c9"} | {"c3": "zebra", "c4": "zebra"}
    assert state(spark, path, first) == old  # a reader of the first version still sees it whole
    asked = spark.createDataFrame([(1, "zebra", 9)], "qid int, query string, limit int").withColumn("filters", F.lit(None).cast("map<string,array<string>>"))
    assert {r["chunk_id"] for r in index_store.indexed_search(asked, path).collect()} == {"c3", "c4"}
    assert index_store.indexed_search(asked, path, version=1).collect() == []
    assert index_store.vacuum(spark, path) == [] and state(spark, path) == state(spark, path, second)
    index_store.write_version(index_store.chunk_records(c), path, rebuild=True)
    assert index_store.vacuum(spark, path) == [1, 2] and state(spark, path) == old


def test_only_the_parts_of_the_words_are_opened(spark, tmp_path):
    path = str(tmp_path / "index")
    found = index_store.write_version(index_store.chunk_records(chunks(spark, 300)), path, parts=16)
    asked = index_store.search_clauses(spark.createDataFrame([(1, "alpha", None, 9)], "qid int, query string, filters map<string,array<string>>, limit int"))
    parts = {r[0] for r in asked.select(index_store.part_of(F.col("field"), F.col("value"), 16)).collect()}
    blocks = index_store._asked_blocks(spark, path, found, asked)
    files = {r[0] for r in index_store.read_postings(spark, path, found, sorted(parts)).select("_metadata.file_path").distinct().collect()}
    assert len(parts) <= 4 and {int(f.split("part=")[1].split("/")[0]) for f in files} <= parts
    assert {(r["field"], r["value"]) for r in blocks.collect()} == {("text", "alpha"), ("heading_path_text", "alpha")}


def test_a_build_that_failed_can_be_repeated(spark, tmp_path):
    from textloom.functions import fixed

    path = str(tmp_path / "index")
    c = chunks(spark, 20).withColumn("text", F.lit("some text")).withColumn("payload_keys", F.array(*map(F.lit, fixed.REQUIRED_PAYLOAD)))

    def broken():
        def encode(texts):
            raise ValueError("no encoder")

        return encode

    assert indexing.build_index(c, indexing.word_encoder, path).isEmpty()
    before = index_store.manifest(spark, path)
    with pytest.raises(Exception, match="no encoder"):
        indexing.build_index(c, broken, path)
    assert index_store.manifest(spark, path) == before and indexing.read_index(spark, path).count() == 20
    assert indexing.build_index(c.where("chunk_id = 'c1'").withColumn("text", F.lit("new")), indexing.word_encoder, path).isEmpty()
    assert state(spark, path)["c1"] == "new" and indexing.read_index(spark, path).count() == 20


def test_two_writers_of_one_version(spark, tmp_path):
    path = str(tmp_path / "index")
    found = index_store.write_version(index_store.chunk_records(chunks(spark, 5)), path)
    with pytest.raises(Exception, match="(?i)exist"):
        index_store._commit(spark, path, found)
    assert index_store.manifest(spark, path) == found


def test_a_text_is_encoded_once(spark, tmp_path):
    from textloom.functions import fixed

    path, count = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def load():
        encode = indexing.word_encoder()

        def counted(texts):
            count.add(len(texts))
            return encode(texts)

        return counted

    keys = F.array(*map(F.lit, fixed.REQUIRED_PAYLOAD))
    c = chunks(spark, 60).withColumn("text", F.concat(F.lit("text "), F.conv(F.right("chunk_id", F.lit(1)), 36, 10))).withColumn("payload_keys", keys)
    assert indexing.build_index(c, load, path, encoder="words 1").isEmpty() and count.value == 10
    plain = str(tmp_path / "plain")
    indexing.build_index(c, indexing.word_encoder, plain)
    vectors = lambda p: sorted((r["id"], r["vector"]) for r in indexing.read_index(spark, p).collect())
    assert vectors(path) == vectors(plain)
    changed = c.withColumn("text", F.when(F.col("chunk_id") == "c7", "another text").otherwise(F.col("text")))
    assert indexing.build_index(changed, load, path, encoder="words 1").isEmpty() and count.value == 11
    assert indexing.build_index(changed, load, path, encoder="words 2").isEmpty() and count.value == 22
    assert state(spark, path)["c7"] == "another text" and indexing.read_index(spark, path).count() == 60
