"""The registered queries: SQL oracles, and plain versions of the pipeline."""

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from textloom.llm import quality_rules, tokens
from textloom.llm._common import stored

from . import brute

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(map(repr, (tuple(r[c] for c in sorted(r)) for r in frame)))


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = rows_of(dict(zip(names, r)) for r in cursor.fetchall())
    assert rows_of(r.asDict() for r in __spark_entry__.queries()[name](spark, SF).collect()) == want and want


def test_contract_queries_on_the_given_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    q = __spark_entry__.queries()
    one = {r["doc_id"]: r for r in q["op1_secrets"](spark, SF).collect()}
    for d, t in docs:
        assert (*(one[d][c] for c in ("n_assign", "n_access", "n_hex")), one[d]["base_sha256"]) == brute.base_secrets(t)[:4]
    comp = brute.components(docs, 2)
    assert {r["doc_id"]: r["component_id"] for r in q["op3_near_duplicates"](spark, SF).collect()} == comp
    cut = brute.repeats(docs)
    six = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in q["op6_suffix_dedup"](spark, SF).collect()}
    assert six == {docs[i][0]: w[:3] for i, w in cut.items()}


def test_other_queries_on_the_given_table(spark):
    """op4, op7, op8, op9 and op10 against plain versions on all rows."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    q = {k: f(spark, SF).collect() for k, f in __spark_entry__.queries().items() if k in ("op4_decontamination", "op7_token_counts", "op8_quality_classifier", "op9_quality_rules", "op10_packing")}
    pairs = [(r["doc_id"], r["text"]) for r in docs]

    leaks = brute.leaks(pairs, items)
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["score"]) for r in q["op4_decontamination"]} == leaks and leaks

    have, known = set(tokens.vocabulary(public_tokenizers.path("word_bpe_49k.json"))), {}
    count = lambda w: known.setdefault(w, 0) or known.__setitem__(w, brute.greedy_pieces([*w.encode(), 256], have)) or known[w]
    cut = {d: re.findall(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+", (t or "").lower()) for d, t in pairs}
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in q["op7_token_counts"]} == {d: (len(w), sum(map(count, w))) for d, w in cut.items()}

    scores = brute.classifier_scores(pairs, labels, quality_rules.COMMON)
    assert {r["doc_id"]: pytest.approx(r["score"], abs=1e-6) for r in q["op8_quality_classifier"]} == scores
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in q["op8_quality_classifier"])

    nine = {r["doc_id"]: r for r in q["op9_quality_rules"]}
    for r, (counts, failed, kept) in zip(docs, brute.quality_verdicts([(r["text"], r["lang"]) for r in docs], quality_rules.COMMON), strict=True):
        got = nine[r["doc_id"]]
        assert (*(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), got["base_failed"], got["kept"]) == (*counts, failed, kept)

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(p for d, t in pairs for p in brute.pack_pieces(d, [*full.encode(t or "", add_special_tokens=False).ids, 0]))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in q["op10_packing"]) == want


def plain_pipeline(docs, items, encode):
    verdicts = brute.quality_verdicts([(r["text"], r["lang"]) for r in docs], quality_rules.COMMON)
    docs = [r for r, (_, _, kept) in zip(docs, verdicts) if kept]
    stages = [len(docs)]
    cut = brute.drop_lines([((1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in docs], 3)
    docs = [r | {"text": c[2]} for r, c in zip(docs, cut) if brute.words(c[2]) or not c[1]]
    stages.append(len(docs))
    comp = brute.components([(i, r["text"]) for i, r in enumerate(docs)], 5)
    order = lambda i: (docs[i]["doc_id"] is None, docs[i]["doc_id"] or 0)
    docs = [r for i, r in enumerate(docs) if i == min((j for j in comp if comp[j] == comp[i]), key=order)]
    stages.append(len(docs))
    docs = [r for r in docs if not brute.leaks([(0, r["text"])], list(enumerate(items)))]
    stages.append(len(docs))
    return stages, sorted((p for r in docs for p in brute.pack_pieces(r["doc_id"], [*encode(r["text"]), 0])), key=repr)


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    base = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 6000)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    more = spark.createDataFrame([(10_000, None, "en", "web", None), (10_001, "", None, None, 0), (10_002, f"{'good words in a row that no one has said ' * 1}{items[0]} {items[1]}", "en", "web", 1)], base.schema)
    good = base.where("length(text) > 800 AND doc_id > 20").orderBy("doc_id").first()
    bare = " ".join(reversed(good["text"].split()))  # words as common as in other texts, in an order that no other has
    more = more.union(spark.createDataFrame([(None, good["text"], good["lang"], "web", 5), (None, f"{good['text']} {items[2]}", good["lang"], "web", 5), (None, bare, good["lang"], "web", 5), (None, bare, good["lang"], "web", 5)], base.schema))
    base.unionByName(more).withColumn("kept", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    stages, want = plain_pipeline(docs, items, lambda t: full.encode(t, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got.collect()), key=repr) == want
    assert len({p[4] for p in want if p[0] is None}) == 1  # of the rows without an id, one of the two alike stays
    frame, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = frame.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stored(stage(spark, frame, str(tmp_path)), "test")
        assert sorted(frame.columns) == sorted(columns)
        counts.append(frame.count())
    assert counts == stages and len({len(docs), *stages}) >= 4


def test_pipeline_stages_bear_an_empty_table(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() == 0
