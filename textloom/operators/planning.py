"""The deterministic query plan: what a table of questions asks for, before any tool runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.tables import staged
from . import knowledge, understanding


def tool_queries(query: Column, words: Column, asked: dict[str, Column] | None = None) -> dict[str, Column]:
    """Up to MOST_QUERIES queries for each tool: those ``asked`` for (arrays), with the question's own text before them for payload and vector.

    Where none are asked for, payload and vector take the text and the significant words.
    """
    text = T.strip(F.coalesce(query, F.lit("")))
    none = F.array().cast("array<string>")
    first = lambda a: F.slice(a, 1, fixed.MOST_QUERIES)
    own = {t: first(F.array_distinct(F.filter(F.transform(F.coalesce((asked or {}).get(t, none), none), T.squeeze), lambda x: x != ""))) for t in fixed.TOOLS}
    core = first(F.filter(F.concat(F.array(text), words), lambda x: x != ""))
    for t in ("payload", "vector"):
        more = first(F.concat(F.array(text), own[t]))
        own[t] = F.when(F.size(own[t]) == 0, core).when((text != "") & ~F.array_contains(own[t], text), more).otherwise(own[t])
    return own


def prepare_queries(questions: DataFrame, candidates: DataFrame, matched: DataFrame) -> DataFrame:
    """One plan for each question (qid, query).

    ``candidates`` are ranked (qid, catalog_id, doc_name, score, rank), ``matched`` has qid and matched_terms. A plan
    has original_query, question_type, concepts, significant_words, catalog_id, doc_name, resolved_doc_names,
    point_number_hints, point_queries, payload_queries, vector_queries, selected_tools, confidence, ambiguous,
    candidates_total, resolver and warnings. A question without text has an empty plan, whose resolver is none.
    """
    none = F.array().cast("array<string>")
    text = T.strip(F.coalesce("query", F.lit("")))
    resolved = understanding.resolve_document(candidates)
    top = candidates.groupBy("qid").agg(F.count("*").alias("candidates_total"), F.max(F.when(F.col("rank") == 1, F.col("catalog_id"))).alias("catalog_id"))
    q = questions.select("qid", text.alias("original_query")).join(matched, "qid", "left").join(resolved, "qid", "left").join(top, "qid", "left")
    empty = F.col("original_query") == ""
    terms = F.when(empty, none).otherwise(F.coalesce("matched_terms", none))
    hint = T.point_number_hint(F.col("original_query"))
    q = q.withColumns({"concepts": F.slice(terms, 1, 8), "significant_words": F.slice(terms, 1, 12), "point_number_hints": F.when(hint != "", F.array(hint)).otherwise(none), "resolved_doc_names": F.when(F.col("resolved_name").isNotNull() & ~empty, F.array("resolved_name")).otherwise(none)})
    own = tool_queries(F.col("original_query"), F.col("significant_words"))
    point = (F.size("point_number_hints") > 0) & (F.size("resolved_doc_names") > 0)
    low = F.concat(F.lit("document resolution confidence "), F.format_string("%.2f", F.bround("confidence", 2)), F.lit(" below threshold; search will run without doc_name filter"))
    warning = (
        F.when(F.coalesce("candidates_total", F.lit(0)) == 0, "no document candidates matched the query")
        .when(F.col("ambiguous"), "document resolution ambiguous; search will run without doc_name filter")
        .when(F.col("resolved_name").isNull(), low)
    )
    return q.select(
        "qid", "original_query", F.when(F.size("point_number_hints") > 0, "point_lookup").otherwise("factual").alias("question_type"), "concepts", "significant_words",
        F.when(empty, "").otherwise(F.coalesce("catalog_id", F.lit(""))).alias("catalog_id"), F.when(empty, "").otherwise(F.coalesce("resolved_name", "top_name", F.lit(""))).alias("doc_name"), "resolved_doc_names", "point_number_hints",
        F.when(point, F.col("point_number_hints")).otherwise(none).alias("point_queries"), own["payload"].alias("payload_queries"), own["vector"].alias("vector_queries"),
        F.array_compact(F.array(F.when(point, "point"), F.when(F.size(own["payload"]) > 0, "payload"), F.when(F.size(own["vector"]) > 0, "vector"))).alias("selected_tools"),
        F.when(empty, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), (~empty & F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"),
        F.when(empty, 0).otherwise(F.coalesce("candidates_total", F.lit(0))).cast("long").alias("candidates_total"), F.when(empty, "none").otherwise("deterministic").alias("resolver"),
        F.when(empty | warning.isNull(), none).otherwise(F.array(warning)).alias("warnings"),
    )


def plan_queries(questions: DataFrame, entries: DataFrame, documents: DataFrame, terms: DataFrame, abbreviations: DataFrame, topics: DataFrame) -> DataFrame:
    """Plans of questions (qid, query) from a catalog (with catalog_id) and the knowledge tables."""
    # Each part is written, small as it is: one plan over all of them would be planned anew after each of its many stages.
    questions = staged(questions.select("qid", "query"))
    found = staged(knowledge.knowledge_candidates(questions, documents, terms, abbreviations, topics))
    merged = staged(knowledge.merged_candidates(staged(understanding.catalog_candidates(questions, entries, alike=False)), found, entries))
    return prepare_queries(questions, merged, staged(knowledge.terms_in_queries(questions, terms, abbreviations, topics)))


def understandings(plans: DataFrame) -> DataFrame:
    """(qid, original_query, search_query, document_hints, resolved_doc_names, point_number_hints, tool_hints, confidence, ambiguous) of plans: what a search needs to know."""
    first = F.coalesce(F.get("payload_queries", F.lit(0)), F.get("vector_queries", F.lit(0)), F.col("original_query"))
    return plans.select("qid", "original_query", first.alias("search_query"), F.col("significant_words").alias("document_hints"), "resolved_doc_names", "point_number_hints", F.col("selected_tools").alias("tool_hints"), "confidence", "ambiguous")
