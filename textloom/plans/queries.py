"""The library's own queries over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, ids
from ..functions import text as T
from ..operators import answers, chunking, evaluation, fusion, index_store, indexing, knowledge, metadata, planning, predicates, quality, replies, retrieval, runtime, structure, understanding, vector_cells
from ..sources import tables
from ..streaming import upsert

#: Headings of capitals in Latin letters, as the given tables have them.
LATIN_CAPITALS = r"[A-Z]{4,}"
#: What payload search reads and returns of the chunks of ``documents``.
SEARCHED = ("chunk_id", "doc_name", "filename", "point_number", "heading_path_text", "text")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str, most: int = 1600) -> DataFrame:
    """Chunks of ``documents`` with a payload; parts of a split text are points of the heading of its source."""
    c = chunking.plain_chunks(read(spark, sf_dir, "documents"), most)
    split = F.col("total_parts") > 1
    name = F.coalesce("doc_name", F.lit(""))
    return c.withColumns({
        "ord": F.struct("doc_key", "part_index"), "is_split": split, "is_complete_point": ~split, "headings": F.when(split, F.array(name)).otherwise(F.array().cast("array<string>")), "heading_path_text": F.when(split, name).otherwise(""),
        "point_number": F.when(split, (F.col("part_index") + 1).cast("string")).otherwise(""), "point_id": F.concat_ws("_", "doc_id", "part_index"), "metadata_confidence": F.when(split, "high").otherwise(""),
        "doc_title_full": F.concat(F.lit("Source "), name, F.lit(" of texts")), "doc_kind": F.when(split, "order").otherwise("unknown"), "doc_number": name, "doc_date": F.lit(""), "authority": name, "approving_act": F.lit(fixed.NOT_STATED),
        "payload_keys": F.when(split, F.array(*map(F.lit, fixed.REQUIRED_PAYLOAD))).otherwise(F.array(*map(F.lit, fixed.REQUIRED_PAYLOAD[1:]))),
    })


def vector_hits(spark: SparkSession, sf_dir: str, same: bool = False, limit: int = 10) -> DataFrame:
    """(qid, chunk_id, score, rank): every vector whose id is divisible by 50, against all."""
    v = read(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").alias("want"))
    return retrieval.vector_search(q, v.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), limit=limit, same=("want", "label") if same else None)


def tool_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranked lists: vector (nearest), payload (nearest of the same label) and point (the vector itself)."""
    v = read(spark, sf_dir, "embeddings")
    near, alike = vector_hits(spark, sf_dir), vector_hits(spark, sf_dir, same=True, limit=5)
    self_ = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.lit("point").alias("tool"), F.lit(1).alias("rank"), F.lit(None).cast("double").alias("score"), F.col("vec_id").alias("chunk_id"))
    hits = near.select("qid", F.lit("vector").alias("tool"), "rank", "score", "chunk_id").union(alike.select("qid", F.lit("payload").alias("tool"), "rank", "score", "chunk_id")).union(self_)
    item = v.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label "), "label").alias("doc_name"), F.col("vec_id").cast("string").alias("point_number"))
    return hits.join(item, "chunk_id").select("qid", "tool", "rank", F.round("score", 6).alias("score"), F.col("chunk_id").cast("string").alias("chunk_id"), "doc_name", "point_number", F.concat(F.lit("vector "), "chunk_id").alias("text"))


def paragraphs_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = structure.make_paragraphs(structure.paragraphs_of(read(spark, sf_dir, "documents")), capitals=LATIN_CAPITALS)
    return p.select("doc_key", "ord", "paragraph_index", F.md5("text").alias("text_md5"), "heading_level", "point_number", "char_start", "char_end")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.make_paragraphs(tables.turn_paragraphs(read(spark, sf_dir, "conversations")), capitals=LATIN_CAPITALS)


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_paths(_turns(spark, sf_dir)).select("doc_key", "ord", "heading_level", F.md5(F.array_join("heading_path", " > ")).alias("path_md5"))


def point_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = structure.units(_turns(spark, sf_dir))
    return u.select("doc_key", F.col("chunk_index").cast("long"), F.md5("text").alias("text_md5"), F.md5(F.array_join("headings", " > ")).alias("path_md5"), "point_number", "chunk_start", "char_start", "char_end")


def marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.marked_text(_turns(spark, sf_dir)).select("doc_key", F.md5("marked_text").alias("marked_md5"))


def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.html_paragraphs(read(spark, sf_dir, "pages")).select("doc_key", "ord", "outline_level", F.md5("raw").alias("text_md5"))


def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).select("doc_key", "part_index", "total_parts", F.md5("text").alias("text_md5"), "token_estimate", "chunk_id", "doc_id")


def index_point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).select("chunk_id", ids.index_point_id(F.col("chunk_id")).alias("index_id"))


def token_estimate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_chunks(spark, sf_dir).withColumn("doc_name", F.coalesce("doc_name", F.lit("")))
    return quality.percentiles(c, "token_estimate", {"p50": 0.5, "p95": 0.95}, ("doc_name",)).select("doc_name", "p50", "p95")


def chunk_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(document_chunks(spark, sf_dir)).select("doc_key", "part_index", "score", F.array_join("penalties.code", ",").alias("codes"))


def worst_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.worst_chunks(document_chunks(spark, sf_dir)).select("doc_key", "part_index", "score")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_counters(tables.staged(document_chunks(spark, sf_dir))).select("section", "metric", F.round("value", 6).alias("value"))


def blocking_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.blocking_defects(quality.quality_counters(tables.staged(document_chunks(spark, sf_dir)))).select("position", "code", "stage", F.col("count").alias("n"))


def duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = document_chunks(spark, sf_dir).groupBy(ids.text_hash(T.normalize_for_hash(F.col("text"))).alias("text_hash")).agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_chunk"))
    return h.where("copies > 1")


def metadata_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_metadata_quality(document_chunks(spark, sf_dir)).select("filename", "score", "doc_kind_ok", "authority_ok", "approving_act_ok")


def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = quality.compare_quality(tables.staged(document_chunks(spark, sf_dir)), tables.staged(document_chunks(spark, sf_dir, 800)))
    return c.select("metric", F.round("new", 6).alias("new_value"), F.round("baseline", 6).alias("baseline_value"), F.round("delta_in_better_direction", 6).alias("delta"), "passes", "gate")


def size_diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.size_diverse_sample(read(spark, sf_dir, "documents"), 10).select("id", "size", "place")


def filter_must(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_chunks(spark, sf_dir)
    return c.where(predicates.payload_filter("the", {"doc_name": ["SRC1", "src2", "src3"], "heading_path_text": "src2"})).select("doc_key", "part_index")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.create_map().cast("map<string,array<string>>")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), none.alias("filters"), F.lit(5).alias("limit"))


def payload_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.payload_search(_questions(spark, sf_dir), tables.staged(document_chunks(spark, sf_dir).select(*SEARCHED))).select("qid", "rank", "chunk_id", "doc_name")


def payload_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``payload_search``, from the postings of an index of all chunks."""
    path = tables.scratch_path(spark, "index")
    index_store.write_version(index_store.chunk_records(document_chunks(spark, sf_dir).select(*SEARCHED)), path)
    return index_store.indexed_search(_questions(spark, sf_dir), path).select("qid", "rank", "chunk_id", "doc_name")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("chunk_id"), F.concat(F.lit("conversation "), "conv_id").alias("doc_name"), F.col("turn").cast("string").alias("point_number"), "text")
    asked = read(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.col("conv_id").alias("qid"), F.lit("").alias("query"), F.lit(3).alias("limit"),
        F.create_map(F.lit("doc_name"), F.array(F.concat(F.lit("conversation "), "conv_id")), F.lit("point_number"), F.array(F.lit("1"), F.lit("2"))).alias("filters"))
    return retrieval.point_search(asked, turns).select("qid", "rank", "chunk_id", "point_number")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``vector_topk``, from vectors stored by cell."""
    v, path = read(spark, sf_dir, "embeddings"), tables.scratch_path(spark, "cells")
    vector_cells.store_cells(v, path, id_col="vec_id")
    found = vector_cells.search_cells(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), path)
    return found.select("qid", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir, same=True, limit=5).select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.reciprocal_rank_fusion(tool_hits(spark, sf_dir))
    return fused.select("qid", "chunk_id", F.round("rrf_score", 8).alias("rrf_score"), "rank", *(F.col("source_ranks")[t].alias(f"{t}_rank") for t in fixed.TOOLS))


def hybrid_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tool_hits(spark, sf_dir)
    both = hits.select("qid", "tool", "rank", "chunk_id", "doc_name", "point_number").unionByName(fusion.fused_items(hits, fusion.reciprocal_rank_fusion(hits)).select("qid", "tool", "rank", "chunk_id", "doc_name", "point_number"))
    own = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    q = own.select(F.col("vec_id").alias("qid"), F.struct(F.concat(F.lit("LABEL "), "label").alias("doc_name"), F.when(F.col("label") < 5, F.col("vec_id").cast("string")).otherwise("").alias("point_number"), F.lit("").alias("chunk_id")).alias("expected"))
    return evaluation.summarize(evaluation.match_metrics(q, both, ["point", "payload", "vector", "hybrid"]))


def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tool_hits(spark, sf_dir).where("tool <> 'point'").withColumn("query_no", F.when(F.col("tool") == "vector", 0).otherwise(1)).withColumn("tool", F.lit("vector"))
    return retrieval.merge_query_results(h).select("qid", "rank", "chunk_id", "query_no")


def score_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.score_rerank(tool_hits(spark, sf_dir), 8).select("qid", "tool", "chunk_id", "rerank")


def _replies(spark: SparkSession, sf_dir: str, shapes: list[str]) -> DataFrame:
    """A reply for each question of ``vector_hits``, in turn of one of ``shapes``, where {1} to {3} stand for its best vectors."""
    top = vector_hits(spark, sf_dir, limit=3).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id")))).alias("t"))
    text = F.get(F.array(*map(F.lit, shapes)), (F.col("qid") / 50 % len(shapes)).cast("int"))
    for k in (1, 2, 3):
        text = F.replace(text, F.lit(f"{{{k}}}"), F.get("t", F.lit(k - 1))["id"])
    return top.select("qid", text.alias("reply"))


def reply_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in the order of replies, which hold it in fences, prose, arrays, strings and items; what is no evidence is skipped."""
    r = _replies(spark, sf_dir, ['```json\n{"ranked_chunk_ids": ["{3}", "none", "{1}", "{3}"]}\n```', "So: [\"{2}\", {1}] it is", '{"chunk_ids": "{3}, {2};{1}"}', '{"ranking": null, "items": [{"chunk_id": "{2}"}, "{3}", {}]}', "none at all"])
    ranked = replies.ranked_replies(r)
    evidence = tool_hits(spark, sf_dir).where("tool = 'vector' AND rank <= 3")
    return fusion.order_by_ids(evidence, ranked.where("error IS NULL")).select("qid", "chunk_id", "rerank")


def reply_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, citations and warnings of replies of several shapes."""
    r = _replies(spark, sf_dir, ['```\n{"answer": "A", "citations": ["{1}", "{2}"]}\n```', 'Sure! {"response": {"answer": " B "}, "sources": "{1}; {2},,{3}"} done', '{"result": {"answer": "C"}, "references": [{"id": "{1}", "doc_name": " D "}, {"doc_name": "x"}, 5, " "]}', '{"answer": "", "citations": []}', "no JSON", '["{1}"]', '{"answer": "E", "citations": 7}'])
    out = replies.answered_replies(r)
    return out.select("qid", "answer", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["chunk_id"], c["doc_name"])), "|").alias("citations"), F.array_join("warnings", "|").alias("warnings"), F.coalesce("error", F.lit("")).alias("error"))


def validate_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tool_hits(spark, sf_dir).where("tool = 'vector'")
    pos = F.col("rank")
    cited = e.select("qid", pos.alias("pos"), F.when(pos == 2, "").when(pos == 3, "none").otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(pos == 4, "other").otherwise(F.col("doc_name")).alias("doc_name"), F.when(pos == 5, "0.0").otherwise("").alias("point_number"))
    return answers.validate_citations(e, cited).select("qid", "pos", "status", "doc_name", "point_number", "warning")


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fusion.passthrough_rerank(tool_hits(spark, sf_dir).where("tool = 'vector'"), 3)
    q = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.concat(F.lit("question "), "vec_id").alias("query"))
    return answers.evidence_summary(q, e).select("qid", F.md5("answer").alias("answer_md5"))


def answer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tool_hits(spark, sf_dir)
    results = e.groupBy("qid").agg(F.count("*").cast("int").alias("items_returned"), F.count_if(F.col("score") > 0.5).cast("int").alias("reranked_items")).select(
        "qid", "items_returned", "reranked_items", F.array_repeat("qid", F.col("reranked_items")).alias("citations"), F.when(F.col("qid") % 100 == 0, "").otherwise("text").alias("answer"),
        F.when(F.col("qid") % 200 == 0, F.array(F.lit("citation[0]: missing chunk_id"), F.lit("Reranker used passthrough ordering"))).alias("warnings"))
    return evaluation.summarize_answers(evaluation.evaluate_answers(results))


def _part_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    q = part.select(F.concat_ws(" ", "p_type", "p_name").alias("query")).distinct().select(F.col("query").alias("qid"), "query")
    return q, understanding.catalog(part.select(F.col("p_name").alias("doc_name"), F.concat_ws(" ", F.lit("N 17"), "p_name").alias("filename")))


def catalog_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_questions(spark, sf_dir)[1].select("doc_name", F.array_join("aliases", "|").alias("aliases"), F.array_join("order_numbers", "|").alias("order_numbers"))


def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of all documents by source and language, each with the file and id of its first document; every other has no id."""
    d = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    named = d.select("doc_id", F.concat_ws(" ", F.lit(" N 7"), "source", F.lit("in"), "lang").alias("doc_name"), F.concat("doc_id", F.lit(".txt")).alias("filename"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("d"), "doc_id")).alias("own"))
    return understanding.catalog(named, doc_id="own", order="doc_id").select("catalog_id", "doc_name", "filename", "doc_id", F.array_join("order_numbers", "|").alias("order_numbers"))


def catalog_score_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.catalog_candidates(*_part_questions(spark, sf_dir), alike=False)


def catalog_score_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.catalog_candidates(*_part_questions(spark, sf_dir))


def resolve_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return understanding.resolve_document(catalog_score_exact(spark, sf_dir))


def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    filters = F.map_filter(F.create_map(F.lit("doc_name"), F.array("source"), F.lit("point_number"), F.when(F.col("lang") != "en", F.array("lang"))), lambda _, v: v.isNotNull())
    q = d.select(F.col("doc_id").alias("qid"), F.col("text").alias("query"), filters.alias("filters"))
    return understanding.route_tools(q).select("qid", F.array_join("tools", ",").alias("tools"))


def comparison_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small chunks against large ones of all documents but those whose id is divisible by 7."""
    new, old = document_chunks(spark, sf_dir, 800).where("doc_key % 7 <> 0"), document_chunks(spark, sf_dir)
    return quality.comparison_defects(tables.staged(new), tables.staged(old)).select("code", "stage", F.col("count").alias("n"))


def baseline_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = document_chunks(spark, sf_dir).where("doc_key % 7 <> 0"), document_chunks(spark, sf_dir, 800).where("doc_key % 5 <> 0")
    return quality.scope(new, old)


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, number, date and authority of registrations: literals, as the given tables have none."""
    rows = spark.createDataFrame(
        [
            (1, "Правила работы с персоналом", "Приказ Минэнерго России от 12.05.2010 № 345"), (2, "О безопасности 35-ФЗ", ""), (3, "Об энергетике", "Федеральный закон 35-ФЗ"), (4, "", "Федеральный закон от 4 ноября 2007 г. 250 - фз"),
            (5, "ГОСТ Р 12.0.004-2015", "ГОСТ 12.1.030-81 от 15 мая 1981"), (6, "", "Постановление Правительства РФ от 1.2.2003 N 17-а"), (7, "ПУЭ", "Приказом Министерства энергетики Российской Федерации от 8 июля 2002 г. № 204"), (8, "", ""),
        ],
        "id int, name string, registration string",
    )
    kind = T.doc_kind(F.col("name"), F.col("registration"))
    return rows.select("id", kind.alias("kind"), T.doc_kind_label(kind).alias("label"), T.doc_number(F.col("registration"), F.col("name"), kind).alias("number"), T.doc_date(F.col("registration")).alias("date"), T.payload_authority(F.lit(""), F.col("registration"), F.lit(""), kind).alias("authority"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw paragraphs of documents under the head of an order; every third has no registration line."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    line = F.when(F.col("doc_id") % 3 == 0, F.lit("без номера")).otherwise(F.concat(F.lit("от 12.05.2010 № "), F.col("doc_id").cast("string"), F.lit("-р")))
    head = F.array(F.lit("ПРИКАЗ"), line, F.concat(F.lit("Об утверждении Правил хранения "), "source"), F.concat(F.lit("Глава "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(". Общие")), F.lit("1. Первый пункт о хранении"), F.concat(F.lit("2. Второй пункт о "), "source"))
    each = d.select(F.col("doc_id").alias("doc_key"), F.posexplode(head).alias("ord", "raw"))
    return each.select("doc_key", "ord", "raw", F.when(F.col("ord") == 3, 1).otherwise(10).alias("outline_level"), F.lit("").alias("style_name"))


def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metadata.extract_metadata(structure.make_paragraphs(_orders(spark, sf_dir)))
    return m.select("doc_key", "doc_name", "doc_reg", "metadata_source", "metadata_confidence", "doc_kind", "doc_number", "doc_date", "authority", "manifest_kind")


def metadata_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metadata.extract_metadata(structure.make_paragraphs(_orders(spark, sf_dir))).withColumn("filename", F.concat(F.col("doc_key").cast("string"), F.lit("|a.txt"))).withColumn("manifest_kind", F.when(F.col("metadata_confidence") == "medium", "title_fallback").otherwise(F.col("manifest_kind")))
    return tables.manifest(m).select("filename", F.md5("line").alias("line_md5"))


def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = structure.make_paragraphs(_orders(spark, sf_dir))
    doc = metadata.extract_metadata(p).withColumns({"source_file": F.concat(F.lit("/in/"), F.col("doc_key").cast("string")), "filename": F.col("doc_key").cast("string")})
    c = chunking.build_chunks(structure.units(p), doc)
    return c.select("doc_key", F.col("chunk_index").cast("long"), "chunk_id", "doc_id", "point_id", F.md5("point_identity_key").alias("key_md5"), "chapter_number", "chapter_title", "retrieval_anchor_heading", "point_number", F.md5("text").alias("text_md5"))


def structured_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 9).cast("string")
    headings = F.array(F.concat(F.lit("Раздел IV. Часть "), "source"), F.concat(F.lit("Глава "), n, F.lit("_2. О хранении.")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Статья "), n, F.lit(". "), "lang")).otherwise(F.lit("Прочее")))
    d = read(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", headings.alias("headings"))
    return d.select("doc_id", *(c.alias(k) for k, c in T.structured_headings(F.col("headings")).items()))


def _vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    key = F.col("vec_id").cast("string")
    return v.select(key.alias("chunk_id"), F.concat(F.lit("label "), "label").alias("doc_name"), key.alias("point_number"), F.concat(F.lit("vector "), key).alias("text"), F.concat(key, F.lit(".txt")).alias("filename"), F.lit("chunks_v1").alias("schema_version"), "embedding")


def point_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _vector_chunks(spark, sf_dir)
    return indexing.point_records(c.drop("embedding"), c).select("id", "payload.chunk_id", "payload.text", F.size("vector").alias("n"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _vector_chunks(spark, sf_dir)
    return indexing.payload_postings(indexing.point_records(c.drop("embedding"), c)).groupBy("field", "value").agg(F.count("*").alias("n"))


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _vector_chunks(spark, sf_dir)
    all_ = indexing.point_records(c.drop("embedding"), c)
    new = all_.where("payload.doc_name = 'label 3'").withColumn("payload", F.col("payload").withField("text", F.lit("new text")))
    return indexing.upserted(all_.where("payload.doc_name <> 'label 5'"), new).select("id", "payload.chunk_id", "payload.text")


def index_upsert_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``index_upsert``, by three versions of one index: all but label 5, then these, which the third removes as it writes those of label 3 anew."""
    path = tables.scratch_path(spark, "index")
    c = _vector_chunks(spark, sf_dir)
    all_ = index_store.chunk_records(c.drop("embedding"))
    extra = all_.where("payload.doc_name = 'label 5'")
    index_store.write_version(all_.where("payload.doc_name <> 'label 5'"), path, bucket_rows=64)
    index_store.write_version(extra, path)
    new = all_.where("payload.doc_name = 'label 3'").withColumn("payload", F.col("payload").withField("text", F.lit("new text")))
    index_store.write_version(new, path, removed=all_.where("payload.doc_name = 'label 5'").select("id"))
    return index_store.read_records(spark, path).select("id", "payload.chunk_id", "payload.text")


def index_schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _vector_chunks(spark, sf_dir).withColumn("filename", F.col("point_number").cast("long"))
    return indexing.schema_differences(indexing.index_schema(indexing.point_records(c.drop("embedding"), c)))


def index_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.verify_index(document_chunks(spark, sf_dir)).select("section", "metric", F.round("value", 6).alias("value"))


def index_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.index_defects(indexing.verify_index(document_chunks(spark, sf_dir))).select("position", "code", "stage", F.col("count").alias("n"))


def _knowledge(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Part names as documents, part types as terms, and a few literals."""
    part = read(spark, sf_dir, "part")
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("position"), F.min("p_type").alias("p_type"), F.min("p_brand").alias("p_brand"))
    types = part.groupBy(F.col("p_type").alias("label")).agg(F.min("p_partkey").alias("position"))
    return {
        "documents": names.select(F.concat(F.lit("d"), F.col("position").cast("string")).alias("doc_id"), F.col("p_name").alias("doc_name"), F.concat("p_type", F.lit(" goods made by "), "p_brand").alias("annotation"), "position"),
        "terms": types,
        "abbreviations": spark.createDataFrame([("red", "bolt and gear of steel", 0), ("promo", "widget", 1), ("x", "ring", 2)], "abbreviation string, expansion string, position long"),
        "topics": spark.createDataFrame([("Economy bolt", ["bolt"], ["blue"], 0), ("ring", ["small", "red"], [], 1)], "phrase string, doc_names array<string>, not_doc_names array<string>, position long"),
    }


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions with and without a point number, and the catalog."""
    q, entries = _part_questions(spark, sf_dir)
    more = read(spark, sf_dir, "part").select(F.concat(F.lit("пункт 7.1 "), "p_name").alias("query")).distinct().select(F.col("query").alias("qid"), "query")
    return q.union(more), entries.withColumn("catalog_id", F.concat(F.lit("c:"), "doc_name"))


def knowledge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _knowledge(spark, sf_dir)
    found = knowledge.knowledge_candidates(_planned(spark, sf_dir)[0], k["documents"], k["terms"], k["abbreviations"], k["topics"])
    return found.select("qid", "doc_id", "score", F.array_join("reasons", "|").alias("reasons"), "rank")


def knowledge_candidates_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``knowledge_candidates``, where names that are merely similar count, too."""
    k = _knowledge(spark, sf_dir)
    found = knowledge.knowledge_candidates(_planned(spark, sf_dir)[0], k["documents"], k["terms"], k["abbreviations"], k["topics"], alike=True)
    return found.select("qid", "doc_id", "score", F.array_join("reasons", "|").alias("reasons"), "rank")


def matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _knowledge(spark, sf_dir)
    return knowledge.terms_in_queries(_planned(spark, sf_dir)[0], k["terms"], k["abbreviations"], k["topics"]).select("qid", F.array_join("matched_terms", "|").alias("terms"))


def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, entries = _planned(spark, sf_dir)
    found = knowledge.knowledge_candidates(q, **_knowledge(spark, sf_dir))
    merged = knowledge.merged_candidates(understanding.catalog_candidates(q, entries, alike=False), found, entries)
    return merged.select("qid", "catalog_id", "doc_name", "score", "source", "rank")


def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, entries = _planned(spark, sf_dir)
    p = planning.plan_queries(q, entries, **_knowledge(spark, sf_dir))
    joined = [F.array_join(c, "|").alias(c) for c in ("concepts", "resolved_doc_names", "point_number_hints", "point_queries", "payload_queries", "vector_queries", "selected_tools", "warnings")]
    return p.select("qid", "question_type", "catalog_id", "doc_name", "confidence", "ambiguous", "candidates_total", "resolver", *joined)


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Callable[[DataFrame], DataFrame]]]:
    """Every vector whose id is divisible by 50 asks, in turns with and without text, filters, a profile and a limit; and the tools over all vectors."""
    c = _vector_chunks(spark, sf_dir)
    n = F.col("vec_id")
    q = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(
        n.alias("qid"), F.when(n % 100 == 0, "").otherwise(F.concat(F.lit("vector "), n.cast("string"))).alias("query"), "label",
        F.map_filter(F.create_map(F.lit("point_number"), F.when(n % 150 == 0, F.array(n.cast("string"))), F.lit("doc_name"), F.when(n % 350 == 0, F.array(F.concat(F.lit("label "), "label")))), lambda _, v: v.isNotNull()).alias("filters"),
        F.when(n % 200 == 50, "fast").when(n % 400 == 150, "deep").alias("profile"), F.when(n % 250 == 0, 0).otherwise(F.lit(3)).alias("limit"), F.when(n % 450 == 0, "score").alias("reranker"), "embedding",
    )
    vectors = q.select(F.col("qid").alias("own"), "embedding")
    tools = {
        "point": lambda a: retrieval.point_search(a, c), "payload": lambda a: retrieval.payload_search(a, c),
        "vector": lambda a: retrieval.vector_tool(a.where("query <> ''").join(vectors, F.col("qid.qid") == F.col("own")).drop("own"), c),
    }
    return q.drop("embedding"), tools


def _runtime(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, tools = _asked(spark, sf_dir)
    return runtime.run_runtime(runtime.requests(q), tools)


def retrieval_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, tools = _asked(spark, sf_dir)
    hits, _ = runtime.compare_tools(runtime.requests(q), tools)
    expected = q.select("qid", F.struct(F.concat(F.lit("LABEL "), "label").alias("doc_name"), F.when(F.col("label") < 5, F.col("qid").cast("string")).otherwise("").alias("point_number"), F.lit("").alias("chunk_id")).alias("expected"))
    return evaluation.summarize(evaluation.match_metrics(expected, hits, ["point", "payload", "vector", "hybrid"]))


def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runtime.run_pipeline(*_asked(spark, sf_dir))
    return r.select("qid", F.md5("answer").alias("answer_md5"), F.array_join("citations", ",").alias("citations"), "items_returned", "reranked_items", F.array_join("warnings", "|").alias("warnings"))


def empty_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, _ = _asked(spark, sf_dir)
    q = q.withColumn("query", F.when(F.col("qid") % 250 == 0, "no such words").otherwise(F.col("query")))
    return retrieval.empty_reasons(q, retrieval.payload_search(q, _vector_chunks(spark, sf_dir)))


def runtime_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runtime(spark, sf_dir)[0].select("qid", "tool", "rank", "chunk_id", "doc_name")


def runtime_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks for itself, and the tool fails for one of them: hits, and who was told of an error."""
    c = _vector_chunks(spark, sf_dir)
    bad = F.col("qid.qid") == 450
    tool = lambda a: retrieval.payload_search(a.withColumn("query", F.when(bad, F.raise_error(F.lit("no such filter"))).otherwise(F.col("query"))), c)
    step = F.struct(F.lit("payload").alias("tool"), F.array(F.concat(F.lit("vector "), F.col("qid").cast("string"))).alias("queries"), F.lit("").alias("reason"))
    q = read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.create_map().cast("map<string,array<string>>").alias("filters"), F.lit(5).alias("limit")).withColumn("plan", F.array(step))
    hits, runs = runtime.run_tools(q, {"payload": tool})
    n = hits.groupBy("qid").agg(F.count("*").alias("hits"))
    return runs.join(n, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("warning").isNotNull().alias("failed"))


def runtime_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runtime(spark, sf_dir)[1]
    return r.select("qid", "profile", F.array_join("selected_tools", ",").alias("tools"), "tools_planned", "tools_succeeded", "items_returned", "fusion", "empty_reason", F.array_join("warnings", "|").alias("warnings"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.windowed_events(read(spark, sf_dir, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events", "total_cents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        paragraphs_clean, heading_paths, point_units, marked_text, html_paragraphs, split_chunks, index_point_ids, token_estimate_stats, chunk_penalties, worst_chunks, quality_report,
        blocking_defects, duplicate_text, metadata_quality, baseline_compare, size_diverse_sample, filter_must, payload_search, payload_search_indexed, point_lookup, vector_topk, vector_topk_cells, vector_topk_filtered, rrf_fusion,
        hybrid_eval, multi_query_merge, score_rerank, reply_rerank, reply_answers, validate_citations, evidence_summary, answer_eval, catalog_aliases, catalog_entries, catalog_score_exact, catalog_score_fuzzy, resolve_document, route_plan, windowed_events,
        comparison_defects, baseline_scope, registrations, document_metadata, metadata_manifest, structured_chunks, structured_headings, point_records, index_postings, index_upsert, index_upsert_committed, index_schema_diff, index_verify, index_defects,
        knowledge_candidates, knowledge_candidates_alike, matched_terms, merged_candidates, query_plans, runtime_batch, runtime_isolated, runtime_report, retrieval_compare, answer_pipeline, empty_reasons,
    )
}
