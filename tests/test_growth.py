"""What moves and what is held while queries run, which must not grow faster than their input."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import index_store, indexing, quality, retrieval
from textloom.plans import queries
from textloom.sources.tables import staged


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator()
    total = 0
    while executors.hasNext():
        total += executors.next().totalShuffleWrite()
    return total


def test_lookup_by_several_fields_brings_no_pairs_that_one_of_them_parts(spark):
    n = 1500
    chunks = spark.range(n * 3).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("doc "), F.col("id") % n).alias("doc_name"), F.floor(F.col("id") / n).cast("string").alias("point_number"), F.lit("a text").alias("text"))
    filters = F.create_map(F.lit("doc_name"), F.array(F.concat(F.lit("doc "), "id")), F.lit("point_number"), F.array(F.lit("0"), F.lit("1"), F.lit("1")))
    asked = spark.range(n).select(F.col("id").alias("qid"), F.lit("").alias("query"), F.lit(3).alias("limit"), filters.alias("filters"))
    before, kept = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = retrieval.point_search(asked, chunks).select("qid", "chunk_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted(map(tuple, found)) == sorted((i, f"c{i + k * n}") for i in range(n) for k in (0, 1))
    assert shuffled(spark) - before < 10 << 20


def test_lookup_beyond_the_bound_on_combinations_compares_the_values(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"c{i}", f"D{i % 4}", f"f{i % 3}", str(i % 5), f"text {i % 2}") for i in range(60)], "chunk_id string, doc_name string, filename string, point_number string, text string")
    asked = spark.createDataFrame([(1, {"doc_name": ["d1", "d2"], "filename": ["f0", "f1"], "point_number": ["1", "2", "3"]}), (2, {"point_number": ["4"], "text": ["text 1", "text 0", "x"]}), (3, {"filename": ["f2"], "point_number": []}), (4, {"filename": ["f2"], "text": ["TEXT 1"]})], "qid int, filters map<string,array<string>>")
    asked = asked.select("qid", F.lit("").alias("query"), "filters", F.lit(100).alias("limit"))
    want = {1: {f"c{i}" for i in range(60) if i % 4 in (1, 2) and i % 3 < 2 and i % 5 in (1, 2, 3)}, 2: {f"c{i}" for i in range(60) if i % 5 == 4}, 4: {f"c{i}" for i in range(60) if i % 3 == 2 and i % 2 == 1}}
    for most in (256, 4, 1):
        monkeypatch.setattr(retrieval, "COMBINATIONS", most)
        found = {}
        for r in retrieval.payload_search(asked, chunks).collect():
            found.setdefault(r["qid"], set()).add(r["chunk_id"])
        assert found == want


def test_vector_search_holds_little_in_a_task():
    rng = np.random.default_rng(1)
    queries = rng.normal(size=(2000, 16))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    x = rng.normal(size=(6000, 16))
    x[3000:3010] = x[:10]
    batch = pa.RecordBatch.from_arrays([pa.array([f"v{i}" for i in range(len(x))]), pa.array(list(x)), pa.array(["0"] * len(x))], ["id", "v", "same"])
    out = pa.schema([("qid", pa.int64()), ("id", pa.string()), ("score", pa.float64())])
    shared = SimpleNamespace(value=(pa.array(range(len(queries)), pa.int64()), queries, ["0"] * len(queries)))
    tracemalloc.start()
    found = [r for b in retrieval._best_of(shared, 10, out, False)([batch]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    score = np.round(x @ queries.T / np.linalg.norm(x, axis=1)[:, None], 12)
    want = {q: [f"v{i}" for i in sorted(range(len(x)), key=lambda i: (-score[i, q], f"v{i}"))[:10]] for q in range(0, 2000, 500)}
    got = {q: [r["id"] for r in sorted((r for r in found if r["qid"] == q), key=lambda r: (-r["score"], r["id"]))] for q in want}
    assert got == want and len(found) == 20000
    assert peak < 64 << 20


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_split_once(spark, sf):
    chunks = queries.document_chunks(spark, sf)
    assert plan(chunks).count("(?<=[.!?])") == 1 and plan(chunks.select("filename").distinct()).count("(?<=[.!?])") == 1


def test_verification_passes_over_the_chunks_once(spark, sf):
    assert plan(indexing.verify_index(queries.document_chunks(spark, sf))).count("FileScan") == 1


def test_baseline_is_restricted_once(spark, sf):
    new, old = (staged(queries.document_chunks(spark, sf, most)) for most in (800, 1600))
    p = plan(quality.compare_quality(new, old))
    # What the report of the baseline reads is a table that is there, without the join with the new files.
    assert "__new" not in p and "__some" not in p


def frequent_words(spark, n=6000, asked=40):
    """Chunks that have all of twelve words and one of their own, and questions for all of these thirteen."""
    often = " ".join(f"often{i}" for i in range(12))
    c = spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("d").alias("doc_name"), F.lit("f").alias("filename"), F.lit("").alias("heading_path_text"), F.concat(F.lit(f"{often} own"), "id").alias("text"))
    q = spark.range(asked).select(F.col("id").alias("qid"), F.concat(F.lit(f"{often} own"), "id").alias("query"), F.create_map().cast("map<string,array<string>>").alias("filters"), F.lit(5).alias("limit"))
    return c, q


def test_postings_are_written_and_searched_without_moving_the_lists_of_frequent_words(spark, tmp_path, monkeypatch):
    c, q = frequent_words(spark)
    path = str(tmp_path / "index")
    moved = []
    write = index_store._write_postings

    def measured(*a):
        before = shuffled(spark)
        write(*a)
        moved.append(shuffled(spark) - before)

    monkeypatch.setattr(index_store, "_write_postings", measured)
    index_store.write_version(index_store.chunk_records(c), path, bucket_rows=1000)
    assert moved == [0]
    before = shuffled(spark)
    found = index_store.indexed_search(q, path).select("qid", "chunk_id").collect()
    assert sorted(map(tuple, found)) == [(i, f"c{i}") for i in range(40)]
    assert shuffled(spark) - before < 1 << 20


def test_blocks_that_come_apart_have_the_same_hits(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(f"c{i}", " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(rng.randint(0, 4))), f"f{i % 3}") for i in range(400)]
    c = spark.createDataFrame(rows, "chunk_id string, text string, filename string").withColumns({k: F.lit("") for k in ("doc_name", "heading_path_text")})
    q = spark.createDataFrame([(i, x, 100) for i, x in enumerate(["a", "b", "a b", "c d e", "f1", "a b c d", "zz", ""])], "qid int, query string, limit int").withColumn("filters", F.lit(None).cast("map<string,array<string>>"))
    monkeypatch.setattr(index_store, "HELD", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    path = str(tmp_path / "index")
    try:
        found = index_store.write_version(index_store.chunk_records(c), path, bucket_rows=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = ["bucket", "field", "value", "block"]
    blocks = index_store.read_postings(spark, path, found)
    assert blocks.count() > blocks.select(*key).distinct().count()
    assert blocks.where("n <> size(places) OR first <> places[0] OR last <> places[n - 1]").isEmpty()
    want = sorted((r["qid"], r["rank"], r["chunk_id"]) for r in retrieval.payload_search(q, c).collect())
    assert sorted((r["qid"], r["rank"], r["chunk_id"]) for r in index_store.indexed_search(q, path).collect()) == want and len(want) > 300


def test_cleaning_without_patterns_where_nothing_is_marked_gives_the_same(spark):
    white = spark.range(0x110000).where("id < 55296 OR id > 57343").where(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").rlike(r"(?U)^[\s\x1c-\x1f]$"))
    assert {chr(r[0]) for r in white.collect()} == set(T.WHITE)
    rng = random.Random(5)
    pieces = ["#", "##########", "*", "**", "***", "/", "//", "\\", " ", "  ", "\n", "\t", "\x1c", "\u2003", "\u2028", "\r\n", "a", "été", "b c"]
    rows = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))),) for _ in range(4000)] + [(None,)]
    t = F.coalesce("t", F.lit(""))
    old_strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    old_squeeze = lambda c: old_strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    old = F.regexp_replace(F.regexp_replace(t, r"(?U)^\s*(#{1,9}|\*{3}|//)\s*", ""), r"(?U)\s*(#{1,9}|\*{3}|\\)\s*$", "")
    old = old_squeeze(F.regexp_replace(old, r"\*{2,}", ""))
    out = spark.createDataFrame(rows, "t string").select(old.alias("a"), T.clean_marker_text(F.col("t")).alias("b"), old_squeeze(t).alias("c"), T.squeeze(t).alias("d"), old_strip(t).alias("e"), T.strip(t).alias("f"))
    assert [r for r in out.collect() if r["a"] != r["b"] or r["c"] != r["d"] or r["e"] != r["f"]] == []


def test_payload_search_moves_no_words(spark, monkeypatch):
    c, q = frequent_words(spark)
    c = staged(c)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most, blocks in ((1 << 20, 1), (100, 6)):
            monkeypatch.setattr(retrieval, "WORD_BLOCK", most, raising=False)
            before = shuffled(spark)
            found = retrieval.token_hits(q.select("qid", F.lit("text").alias("field"), "query"), c)
            p = plan(found)
            assert "Exchange hashpartitioning" not in p and p.count("(?U)[^\\w]+") == 2 * blocks
            assert sorted(map(tuple, found.collect())) == [(i, f"c{i}") for i in range(40)]
            assert shuffled(spark) - before < blocks * 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
