"""Rank fusion and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def reciprocal_rank_fusion(hits: DataFrame, k: int = fixed.RRF_K, tools: tuple[str, ...] = fixed.TOOLS, limit: str | None = None) -> DataFrame:
    """(qid, chunk_id, rrf_score, rank, source_ranks) of ranked lists (qid, tool, rank, chunk_id).

    The score is the sum of 1 / (k + rank) over all places; a chunk twice in a list counts twice and keeps the later
    rank. Sums are taken tool by tool in a fixed order, so they do not depend on the order of rows. Equal scores go by
    chunk_id; hits without one don't take part. ``limit`` names a column of the hits.
    """
    own = hits.where(F.coalesce("chunk_id", F.lit("")) != "")
    places = {t: F.aggregate(F.array_sort(F.collect_list(F.when(F.col("tool") == t, F.col("rank")))), F.lit(0.0), lambda s, r: s + 1.0 / (k + r)) for t in tools}
    last = {t: F.max(F.when(F.col("tool") == t, F.col("rank"))) for t in tools}
    more = [F.max(limit).alias(limit)] if limit else []
    both = own.groupBy("qid", "chunk_id").agg(*(c.alias(f"__s_{t}") for t, c in places.items()), *(c.alias(f"__r_{t}") for t, c in last.items()), *more)
    score = reduce(lambda a, b: a + b, (F.col(f"__s_{t}") for t in tools))
    ranks = F.map_filter(F.create_map(*(x for t in tools for x in (F.lit(t), F.col(f"__r_{t}")))), lambda _, v: v.isNotNull())
    out = both.withColumn("__score", score).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("__score"), "chunk_id")))
    if limit:
        out = out.where(F.col("rank") <= F.col(limit))
    return out.select("qid", "chunk_id", F.round("__score", 8).alias("rrf_score"), "rank", ranks.alias("source_ranks"))


def fused_items(hits: DataFrame, fused: DataFrame, tools: tuple[str, ...] = fixed.TOOLS) -> DataFrame:
    """The fused list with the attributes of each chunk's first hit, by tool and rank."""
    order = F.struct(F.array_position(F.array(*map(F.lit, tools)), F.col("tool")).alias("t"), F.col("rank").alias("r"))
    rest = [c for c in hits.columns if c not in ("qid", "chunk_id", "tool", "rank", "score")]
    first = hits.groupBy("qid", "chunk_id").agg(F.min_by(F.struct(*rest), order).alias("item")) if rest else hits.select("qid", "chunk_id").distinct()
    out = fused.join(first, ["qid", "chunk_id"])
    return out.select("qid", F.lit("hybrid").alias("tool"), "rank", F.col("rrf_score").alias("score"), "chunk_id", "source_ranks", *([F.col(f"item.{c}") for c in rest]))


def score_rerank(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """By score (null is 0) from the highest, then by tool, then by chunk_id; adds rerank."""
    priority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in fixed.TOOL_PRIORITY.items() for x in kv)), F.col("tool")), F.lit(99))
    w = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), priority, "chunk_id")
    out = hits.withColumn("rerank", F.row_number().over(w))
    return out.where(F.col("rerank") <= limit) if limit is not None else out


def passthrough_rerank(hits: DataFrame, limit: int | None = None) -> DataFrame:
    out = hits.withColumn("rerank", F.col("rank"))
    return out.where(F.col("rerank") <= limit) if limit is not None else out


def order_by_ids(evidence: DataFrame, ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """Evidence in the order of ``ranked`` (qid, ids), each chunk once; ids that are not evidence are skipped."""
    places = ranked.select("qid", F.posexplode(F.array_distinct("ids")).alias("__p", "chunk_id"))
    one = evidence.groupBy("qid", "chunk_id").agg(F.min_by(F.struct(*[c for c in evidence.columns if c not in ("qid", "chunk_id")]), "rank").alias("e"))
    out = places.join(one, ["qid", "chunk_id"]).withColumn("rerank", F.row_number().over(Window.partitionBy("qid").orderBy("__p"))).select("qid", "chunk_id", "e.*", "rerank")
    return out.where(F.col("rerank") <= limit) if limit is not None else out


def first_tool(hits: DataFrame, limit: str) -> DataFrame:
    """Without fusion: the list of the first tool that found something, cut to ``limit`` (a column)."""
    priority = F.array_position(F.array(*map(F.lit, fixed.TOOLS)), F.col("tool"))
    return hits.withColumn("__p", priority).withColumn("__first", F.min("__p").over(Window.partitionBy("qid"))).where((F.col("__p") == F.col("__first")) & (F.col("rank") <= F.col(limit))).drop("__p", "__first")
