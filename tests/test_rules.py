"""Rules on literal inputs: headings, numbers, metadata, quality, filters, fusion, citations, understanding, sources, streams."""

import json
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.functions import fuzzy, ids
from textloom.functions import text as T
from textloom.operators import answers, chunking, evaluation, fusion, metadata, predicates, quality, retrieval, structure, understanding
from textloom.sources import tables
from textloom.streaming import upsert


def each(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expression(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def paragraphs(spark, docs):
    rows = [(d, i, *(p if isinstance(p, tuple) else (p, 10, ""))) for d, ps in docs.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "doc_key string, ord int, raw string, outline_level int, style_name string")


def test_point_numbers_and_skipped_paragraphs(spark):
    texts = ["{3} Требование", "3. Требование", "1.1 Настоящий стандарт", "пункт 3 должен", "Требование", None]
    assert each(spark, texts, T.extract_point_number) == ["3", "3", "1.1", "3", "", ""]
    assert each(spark, ["", "- 12 -", "Страница 4", "Переход к Содержанию документа осуществляется по ссылке", "12 норм"], T.should_skip_paragraph) == [True, True, True, True, False]


def test_heading_levels(spark):
    level = lambda v: T.infer_heading_level(v, F.lit(10), F.lit(""))
    texts = ["СО 34.20.185-94 Инструкция по эксплуатации", "Раздел II", "Статья 5. Права", "IV. Порядок", "ОБЩИЕ ПОЛОЖЕНИЯ РАБОТ", "обычный текст", "ПРИКАЗ N 5 ОТ 2003"]
    assert each(spark, texts, level) == [1, 1, 2, 1, 2, None, None]
    assert each(spark, ["x"], lambda v: T.infer_heading_level(v, F.lit(8), F.lit(""))) == [6]
    assert each(spark, ["x"], lambda v: T.infer_heading_level(v, F.lit(10), F.lit("Heading 3"))) == [3]


def test_units_follow_headings_and_numbers(spark):
    raw = paragraphs(spark, {"a": [("Глава 1", 1, ""), "Введение.", "1. Первое.", "Продолжение.", ("Статья 2", 2, ""), "2. Второе."], "b": ["Без заголовка."]})
    u = sorted((r["doc_key"], r["chunk_index"], r["text"], r["headings"], r["point_number"]) for r in structure.units(structure.make_paragraphs(raw)).collect())
    assert u == [("a", 0, "Введение.", ["Глава 1"], ""), ("a", 1, "1. Первое.\nПродолжение.", ["Глава 1"], "1"), ("a", 2, "2. Второе.", ["Глава 1", "Статья 2"], "2"), ("b", 0, "Без заголовка.", [], "")]


def test_splitting_keeps_sentences_and_cuts_long_ones(spark):
    parts = each(spark, ["Aa bb. Cc dd! Ee?", "x" * 25, "", None, "short"], lambda v: T.split_text(v, 10))
    assert parts == [["Aa bb.", "Cc dd! Ee?"], ["x" * 10, "x" * 10, "x" * 5], [], [], ["short"]]


def test_metadata_of_an_order_and_a_law(spark):
    raw = paragraphs(spark, {
        "order": ["ПРИКАЗ", "от 12.05.2010 № 345", "Об утверждении Правил работы с персоналом", "Текст приказа."],
        "law": ["ФЕДЕРАЛЬНЫЙ ЗАКОН", "Об электроэнергетике и правилах", "Текст закона.", "4 ноября 2007 года", "N 250-ФЗ"],
        "none": ["просто текст"],
    })
    m = {r["doc_key"]: r for r in metadata.extract_metadata(structure.make_paragraphs(raw)).collect()}
    assert m["order"]["doc_kind"] == "приказ" and m["order"]["doc_number"] == "345" and m["order"]["doc_date"] == "12.05.2010" and m["order"]["metadata_confidence"] == "high"
    assert m["law"]["doc_reg"].startswith("Федеральный закон от") and m["law"]["doc_kind"] == "федеральный закон"
    frame = metadata.extract_metadata(structure.make_paragraphs(raw))
    ok, bad = metadata.validated(frame, strict=False)
    assert ok.count() == 2 and [r["doc_key"] for r in bad.collect()] == ["none"]
    with pytest.raises(Exception, match="no title or registration"):
        metadata.validated(frame)[0].collect()


def test_chunks_of_a_structured_document(spark):
    raw = paragraphs(spark, {"order": ["ПРИКАЗ", "от 12.05.2010 № 345", "Об утверждении Правил работы с персоналом", ("Глава 1. Общие", 1, ""), "1. Первый пункт. " + "Слово. " * 400, "2. Второй."]})
    p = structure.make_paragraphs(raw)
    meta = metadata.extract_metadata(p).withColumns({"source_file": F.lit("/in/order.txt"), "filename": F.lit("order.txt")})
    c = chunking.build_chunks(structure.units(p), meta).orderBy("chunk_index", "part_index").collect()
    assert len({r["chunk_id"] for r in c}) == len(c) and all(len(r["text"]) <= 1600 for r in c)
    first = [r for r in c if r["point_number"] == "1"]
    assert len(first) == 2 and all(r["is_split"] and r["chapter_number"] == "1" and r["nearest_heading"].startswith("Глава 1") for r in first)


def test_ids(spark):
    rows = each(spark, ["chunk_1", "x"], ids.index_point_id)
    assert rows == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{ids.NAME_PREFIX}{c}")) for c in ("chunk_1", "x")]
    with pytest.raises(Exception, match="no index id"):
        each(spark, [""], ids.index_point_id)


def test_penalties_of_a_poor_chunk(spark):
    c = spark.createDataFrame([("", "", "", "Оборванный:", 0)], "doc_name string, heading_path_text string, point_number string, text string, ord int")
    r = quality.scored(c).first()
    codes = [p["code"] for p in r["penalties"]]
    assert {"missing_doc_name", "missing_heading_path_text", "looks_truncated", "missing_required_payload_keys"} <= set(codes)
    assert r["score"] == max(0, 100 - sum(p["points"] for p in r["penalties"]))


def test_filters():
    assert predicates.normalize_filters({"doc_name": " a ", "other": 1, "text": "", "point_number": 3, "chunk_id": ["x", " "]}) == {"doc_name": "a", "point_number": "3", "chunk_id": ["x"]}
    assert predicates.doc_name_variants("Name") == ["Name", "NAME"] and predicates.doc_name_variants("NAME") == "NAME"


def test_fusion_counts_repeats_and_skips_missing_ids(spark):
    h = spark.createDataFrame([("q", "point", 1, "a"), ("q", "point", 2, "b"), ("q", "payload", 1, "b"), ("q", "payload", 2, "c"), ("q", "payload", 3, ""), ("q", "payload", 4, None)], "qid string, tool string, rank int, chunk_id string")
    f = fusion.reciprocal_rank_fusion(h).orderBy("rank").collect()
    assert [r["chunk_id"] for r in f] == ["b", "a", "c"] and f[0]["rrf_score"] == round(1 / 62 + 1 / 61, 8) and f[0]["source_ranks"] == {"point": 2, "payload": 1}


def test_reranking_by_ids(spark):
    e = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, chunk_id string, rank int")
    r = spark.createDataFrame([("q", ["b", "z", "b", "a"])], "qid string, ids array<string>")
    assert [(x["chunk_id"], x["rerank"]) for x in fusion.order_by_ids(e, r).orderBy("rerank").collect()] == [("b", 1), ("a", 2)]


def test_search_finds_all_words_and_respects_filters(spark):
    c = spark.createDataFrame([("c1", "doc A", "Alpha beta gamma", "1.2", ""), ("c2", "doc B", "alpha beta", "3", "Part one"), ("c3", "DOC A", "delta", "1.2", "Part one")], "chunk_id string, doc_name string, text string, point_number string, heading_path_text string")
    q = spark.createDataFrame([(1, "BETA alpha", {}, 5), (2, "alpha beta", {"doc_name": ["doc B"]}, 5), (3, "", {}, 5), (4, "", {"doc_name": ["doc A"]}, 5), (5, "doc A", {}, 1), (6, "nothing here", {}, 5), (7, None, None, 5)], "qid int, query string, filters map<string,array<string>>, `limit` int")
    got = {}
    for r in retrieval.payload_search(q, c).collect():
        got.setdefault(r["qid"], set()).add(r["chunk_id"])
    assert got == {1: {"c1", "c2"}, 2: {"c2"}, 4: {"c1", "c3"}, 5: {"c1"}}
    p = spark.createDataFrame([(1, "", {"point_number": ["1.2"], "doc_name": ["doc a"]}, 5), (2, "", {"doc_name": ["doc A"]}, 5), (3, "", {"chunk_id": ["c2"], "point_number": ["9"]}, 5), (4, "", {"heading_path_text": ["one part"]}, 5), (5, "", {"point_number": ["1.2"], "doc_name": ["doc A"]}, 5)], q.schema)
    got = {}
    for r in retrieval.point_search(p, c).collect():
        got.setdefault(r["qid"], set()).add(r["chunk_id"])
    assert got == {1: {"c3"}, 3: {"c2"}, 4: {"c2", "c3"}, 5: {"c1", "c3"}}
    assert {r["qid"]: r["empty_reason"] for r in retrieval.empty_reasons(q, retrieval.payload_search(q, c)).collect()}[6] == "no_matches"


def test_vector_search_bears_nulls_zeros_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.1]), (11, None), (12, [0.0, 0.0])], "qid int, embedding array<double>")
    r = [(x["qid"], x["chunk_id"]) for x in retrieval.vector_search(q, v, limit=2).orderBy("qid", "rank").collect()]
    assert r == [(10, 1), (10, 2)]
    assert retrieval.vector_search(q.limit(0), v).count() == 0


def test_evaluation_of_empty_lists(spark):
    q = spark.createDataFrame([(1, ("Doc", "", None)), (2, ("", "5", "c"))], "qid int, expected struct<doc_name:string,point_number:string,chunk_id:string>")
    h = spark.createDataFrame([(1, "point", 2, "x", "DOC ", "")], "qid int, tool string, rank int, chunk_id string, doc_name string, point_number string")
    m = {r["qid"]: r for r in evaluation.match_metrics(q, h, ["point"]).collect()}
    assert (m[1]["top1_doc_match"], m[1]["top5_doc_match"], m[1]["top1_point_match"]) == (False, True, None) and (m[2]["top1_point_match"], m[2]["top5_chunk_match"]) == (False, False)


def test_answers_without_evidence(spark):
    q = spark.createDataFrame([(1, "why")], "qid int, query string")
    e = spark.createDataFrame([], "qid int, rank int, doc_name string, point_number string, text string")
    assert answers.evidence_summary(q, e).first()["answer"] == answers.NO_EVIDENCE


def test_understanding(spark):
    docs = spark.createDataFrame([("Правила устройства электроустановок", "pue.rtf"), ("Инструкция по ликвидации аварий", "приказ № 17.rtf"), ("Устав службы", "u.rtf")], "doc_name string, filename string")
    q = spark.createDataFrame([(1, "расскажи про ПУЭ по заземлению"), (2, "Покажи пункт 9 инструкции по ликвидации аварий"), (3, "приказ 17 о чем"), (4, ""), (5, "погода завтра")], "qid int, query string")
    cat = understanding.catalog(docs)
    found = understanding.catalog_candidates(q, cat)
    top = {r["qid"]: (r["doc_name"], r["score"]) for r in found.where("rank = 1").collect()}
    assert top[1][0].startswith("Правила устройства") and top[1][1] >= 0.55 and top[2][0].startswith("Инструкция") and 4 not in top
    res = {r["qid"]: r["resolved_name"] for r in understanding.resolve_document(found).collect()}
    assert res[1].startswith("Правила") and res[2].startswith("Инструкция")
    full = q.withColumn("filters", F.create_map().cast("map<string,array<string>>"))
    applied = understanding.apply_resolution(full, understanding.resolve_document(found))
    f = {r["qid"]: r["filters"] for r in applied.collect()}
    assert f[2]["point_number"] == ["9"] and f[2]["doc_name"][0].startswith("Инструкция") and f[5] == {}
    tools = {r["qid"]: r["tools"] for r in understanding.route_tools(applied).collect()}
    assert tools[2] == ["point", "payload", "vector"] and tools[5] == ["payload", "vector"] and tools[4] == []


def test_fuzzy_ratio_and_its_bound(spark):
    pairs = [("abcd", "bcde"), ("", "x"), (None, "x"), ("same", "same"), ("ab", "abcdefghij")]
    for a, b, r, m in spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.ratio(F.col("a"), F.col("b")), fuzzy.bound(F.col("a"), F.col("b"))).collect():
        assert r == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0) and (m >= r or not a)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("b.txt", "two"), ("a.txt", "one\nline"), ("~$a.txt", "lock")):
        (tmp_path / "in" / name).write_text(text)
    assert [r["filename"] for r in tables.text_files(spark, str(tmp_path / "in")).orderBy("filename").collect()] == ["a.txt", "b.txt"]
    assert tables.text_files(spark, str(tmp_path / "in"), limit=1).first()["text"] == "one\nline"
    doc = {"source_file": "s", "filename": "f", "paragraphs": [{"paragraph_index": 0, "text": "x", "outline_level": 2, "style_name": None}, {"paragraph_index": 1, "text": "y"}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, ensure_ascii=False) + "\n{broken\n")
    docs = tables.structured_files(spark, str(tmp_path / "d.json"))
    assert docs.where("read_error IS NOT NULL").count() == 1
    assert [(r["raw"], r["outline_level"]) for r in tables.structured_paragraphs(docs).orderBy("ord").collect()] == [("x", 2), ("y", 10)]
    html = spark.createDataFrame([(1, "<script>var t='<p>no</p>'</script><h1 class=a>T &amp; t</h1><p>a <b>b</b></p><pre>c</pre><h3>S</h3>"), (2, None)], "page_id int, html string")
    assert [(r["outline_level"], r["raw"]) for r in tables.html_paragraphs(html).orderBy("ord").collect()] == [(1, "T & t"), (10, "a b"), (3, "S")]
    chunks = spark.createDataFrame([("c", "t", "d")], "chunk_id string, text string, doc_name string")
    tables.write_chunks(chunks, str(tmp_path / "out"))
    assert tables.read_chunks(spark, str(tmp_path / "out")).first().asDict() == {"schema_version": "chunks_v1", "chunk_id": "c", "text": "t", "doc_name": "d"}


@pytest.mark.parametrize("n", [0, 1, 3, 10, 57])
def test_size_diverse_sample(spark, n):
    docs = spark.createDataFrame([(i, i * 7 % 5) for i in range(n)], "doc_id long, n_chars long")
    got = sorted((r["place"], r["id"]) for r in tables.size_diverse_sample(docs, 5).collect())
    order = sorted(range(n), key=lambda i: (i * 7 % 5, i))
    k = min(5, n)
    assert got == [(j, order[j * (n - 1) // max(k - 1, 1)]) for j in range(k)]


def test_streaming_upsert_keeps_the_newest_version(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    source, store = str(tmp_path / "src"), str(tmp_path / "store")
    spark.createDataFrame([(1, "old text", "s"), (2, "stays", "s")], schema).write.mode("append").parquet(source)
    run = lambda: upsert.ingest(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination(120)
    run()
    spark.createDataFrame([(1, "new text", "s"), (3, "more", "s")], schema).write.mode("append").parquet(source)
    run()
    assert {r["doc_key"]: r["text"] for r in upsert.latest(spark, store).collect()} == {1: "new text", 2: "stays", 3: "more"}


def test_streams_of_emptied_late_and_repeated_documents(spark, tmp_path):
    schema = "doc_id long, text string, source string, at long"
    source, store = str(tmp_path / "src"), str(tmp_path / "store")
    batches = [
        [(1, "old secret text", "s", 1), (2, "x", "s", 5), (3, "stays", "s", 1)],
        [(1, "", "s", 2), (2, "late and older", "s", 4), (2, "y", "s", 6), (2, "z", "s", 5), (4, None, "s", 1)],
        [(3, "stays", "s", 1), (5, "a", "s", None), (5, "b", "s", 0), (1, "late", "s", 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        upsert.ingest(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp"), version="at").awaitTermination(120)
    got = {r["doc_key"]: r["text"] for r in upsert.latest(spark, store).collect()}
    assert got == {2: "y", 3: "stays", 5: "b"}
    all_ = upsert.newest_documents(spark.createDataFrame([r for b in batches for r in b], schema), "at")
    assert got == {r["doc_id"]: r["text"] for r in all_.where("text <> ''").collect()}


def test_sinks_keep_the_old_table_when_a_write_fails(spark, tmp_path):
    path = str(tmp_path / "report")
    old = spark.createDataFrame([(1,)], "a long")
    tables.replace_json(old, path)
    with pytest.raises(Exception, match="odd"):
        tables.replace_json(old.select(F.when(F.col("a") == 1, F.raise_error(F.lit("odd"))).alias("a")), path)
    assert [r["a"] for r in spark.read.json(path).collect()] == [1]
    tables.replace_json(spark.read.json(path).select((F.col("a") + 1).alias("a")), path)  # may read what it replaces
    assert [r["a"] for r in spark.read.json(path).collect()] == [2]


def test_chunk_files_of_other_shapes(spark, tmp_path):
    chunk = {"chunk_id": "c", "text": "t", "payload": {"doc_name": "D", "text": "own"}}
    for name, body in (("array", [chunk]), ("object", {"chunks": [chunk], "n": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=2))
        r = tables.read_chunks(spark, str(tmp_path / f"{name}.json")).first().asDict()
        assert (r["chunk_id"], r["doc_name"], r["text"]) == ("c", "D", "own")
    for name, body in (("other", {"rows": [1]}), ("scalar", {"chunks": "none"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        with pytest.raises(ValueError, match="no chunks"):
            tables.read_chunks(spark, str(tmp_path / f"{name}.json"))


def test_catalog_by_the_first_row(spark):
    rows = [(3, "A", "late.txt", "x"), (1, " A ", "first 9.txt", None), (0, "B", "b.txt", " b1 "), (5, " ", "c.txt", "c")]
    got = {r["doc_name"]: (r["catalog_id"], r["filename"], r["doc_id"]) for r in understanding.catalog(spark.createDataFrame(rows, "n int, doc_name string, filename string, doc_id string"), doc_id="doc_id", order="n").collect()}
    assert got == {"A": ("doc_2", "first 9.txt", ""), "B": ("b1", "b.txt", "b1")}
