"""Evaluation of result lists and answers over question tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

METRICS = ("top1_doc_match", "top5_doc_match", "top1_point_match", "top5_chunk_match")


def filled(value: Column) -> Column:
    """Stripped text; null if nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def same_name(expected: Column, actual: Column) -> Column:
    """Equality of names regardless of case; no name equals an empty one."""
    return (F.trim(actual) != "") & (F.lower(F.trim(actual)) == F.lower(F.trim(expected)))


def match_metrics(questions: DataFrame, hits: DataFrame, pipelines: list[str] | None = None) -> DataFrame:
    """(qid, pipeline, the four metrics) of lists (qid, tool, rank, chunk_id, doc_name, point_number).

    ``questions`` has qid and expected (struct of doc_name, point_number, chunk_id). A metric is null where nothing is
    expected, and false where a list is empty. ``pipelines`` are those that ran, all tools of the hits by default.
    """
    e = lambda k: filled(F.col(f"expected.{k}"))
    ran = questions.select("qid", e("doc_name").alias("__doc"), e("point_number").alias("__point"), e("chunk_id").alias("__chunk"))
    names = hits.sparkSession.createDataFrame([(p,) for p in pipelines], "pipeline string") if pipelines else hits.select(F.col("tool").alias("pipeline")).distinct()
    grid = ran.join(F.broadcast(names))  # bounded: a few pipelines
    # A list has five places here at most, so counting them is all a group holds.
    top = hits.where("rank <= 5").select("qid", F.col("tool").alias("pipeline"), "rank", "chunk_id", "doc_name", "point_number")
    joined = grid.join(top, ["qid", "pipeline"], "left")
    any_ = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))
    got = joined.groupBy("qid", "pipeline", "__doc", "__point", "__chunk").agg(
        any_((F.col("rank") == 1) & same_name(F.col("__doc"), F.col("doc_name"))).alias("a"), any_(same_name(F.col("__doc"), F.col("doc_name"))).alias("b"),
        any_((F.col("rank") == 1) & (F.col("point_number") == F.col("__point"))).alias("c"), any_(F.col("chunk_id") == F.col("__chunk")).alias("d"))
    when = lambda k, c: F.when(F.col(k).isNotNull(), F.col(c))
    return got.select("qid", "pipeline", when("__doc", "a").alias(METRICS[0]), when("__doc", "b").alias(METRICS[1]), when("__point", "c").alias(METRICS[2]), when("__chunk", "d").alias(METRICS[3]))


def summarize(metrics: DataFrame) -> DataFrame:
    """(pipeline, metric, passed, scored)."""
    long = metrics.unpivot(["pipeline"], list(METRICS), "metric", "value")
    return long.groupBy("pipeline", "metric").agg(F.count_if("value").alias("passed"), F.count("value").alias("scored"))


def is_fallback(warning: Column) -> Column:
    return F.exists(F.array(*map(F.lit, fixed.FALLBACK_MARKERS)), lambda m: F.contains(F.lower(warning), m))


def evaluate_answers(results: DataFrame) -> DataFrame:
    """Per question counters of (qid, items_returned, reranked_items, citations, answer, warnings)."""
    w = F.coalesce("warnings", F.array().cast("array<string>"))
    count = lambda f: F.size(F.filter(w, f))
    return results.select(
        "qid", "items_returned", "reranked_items", F.size("citations").alias("citations_count"), F.size("citations").alias("valid_citations"),
        count(lambda x: x.startswith("citation[")).alias("citation_warnings"), F.size(w).alias("warnings_count"), count(is_fallback).alias("fallback_count"),
        (F.trim(F.coalesce("answer", F.lit(""))) == "").alias("empty_answer"),
    )


def summarize_answers(evals: DataFrame) -> DataFrame:
    """One row of totals, rates and averages (4 digits); rates of no questions are 0, averages null."""
    n = F.count("*")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per = lambda c: F.round(F.sum(c) / F.nullif(n, F.lit(0)), 4)
    return evals.agg(
        n.alias("questions_total"), total("items_returned").alias("items_returned_total"), total("citations_count").alias("citations_total"), total("citation_warnings").alias("citation_warnings_total"),
        total("warnings_count").alias("warnings_total"), total("fallback_count").alias("fallback_total"), F.count_if("empty_answer").alias("empty_answer_count"),
        F.coalesce(F.round(F.count_if("empty_answer") / F.nullif(n, F.lit(0)), 4), F.lit(0.0)).alias("empty_answer_rate"), per("warnings_count").alias("avg_warnings_per_question"), per("fallback_count").alias("avg_fallbacks_per_question"),
    )
