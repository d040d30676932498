"""Citations and evidence-only answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_EVIDENCE = "No evidence found for the request."


def validate_citations(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations (qid, pos, chunk_id, doc_name, point_number) with status, warning and the evidence's own values.

    Of evidence that repeats a chunk_id the last by rank counts. Status: valid, missing_chunk_id, unknown_chunk_id,
    doc_name_mismatch or point_number_mismatch.
    """
    own = evidence.where(F.coalesce("chunk_id", F.lit("")) != "").groupBy("qid", "chunk_id").agg(F.max_by(F.struct("doc_name", "point_number"), "rank").alias("e"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    asked = citations.select("qid", "pos", text("chunk_id").alias("chunk_id"), text("doc_name").alias("doc_name"), text("point_number").alias("point_number"))
    both = asked.join(own, ["qid", "chunk_id"], "left")
    status = (
        F.when(F.col("chunk_id") == "", "missing_chunk_id").when(F.col("e").isNull(), "unknown_chunk_id")
        .when((F.col("doc_name") != "") & (F.col("doc_name") != F.col("e.doc_name")), "doc_name_mismatch")
        .when((F.col("point_number") != "") & (F.col("point_number") != F.col("e.point_number")), "point_number_mismatch").otherwise("valid")
    )
    out = both.withColumn("status", status)
    label = F.concat(F.lit("citation["), F.col("pos").cast("string"), F.lit("]: "))
    detail = F.when(F.col("status") == "missing_chunk_id", F.lit("missing chunk_id")).otherwise(F.concat_ws(" ", F.replace("status", F.lit("_"), F.lit(" ")), F.when(F.col("status") == "unknown_chunk_id", F.col("chunk_id")).when(F.col("status") == "doc_name_mismatch", F.col("doc_name")).otherwise(F.col("point_number"))))
    ok = F.col("status") == "valid"
    return out.select("qid", "pos", "chunk_id", "status", F.when(ok, F.col("e.doc_name")).alias("doc_name"), F.when(ok, F.col("e.point_number")).alias("point_number"), F.when(~ok, F.concat(label, detail)).alias("warning"))


def evidence_summary(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, answer): numbered evidence, or the sentence for none. A question's evidence is its top-k list, so bounded."""
    head, text = F.trim(F.concat(F.col("rank").cast("string"), F.lit(". "), F.concat_ws(" ", "doc_name", "point_number"))), F.trim(F.coalesce("text", F.lit("")))
    entry = F.when(text == "", head).otherwise(F.concat_ws("\n", head, text))
    entries = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("e"))
    asked = F.trim(F.coalesce("query", F.lit("")))
    head = F.concat(F.lit("Evidence summary for query: "), F.when(asked == "", "request").otherwise(asked), F.lit("\n\n"))
    return questions.join(entries, "qid", "left").select("qid", F.when(F.col("e").isNull(), NO_EVIDENCE).otherwise(F.concat(head, F.array_join(F.col("e.entry"), "\n\n"))).alias("answer"))


def evidence_json(evidence: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, evidence): the first ``limit`` items as JSON with seven fields."""
    item = F.struct("chunk_id", "doc_name", "point_number", "heading_path_text", "filename", "text", "score")
    rows = evidence.where(F.col("rank") <= limit).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("e"))
    return rows.select("qid", F.to_json(F.col("e.item")).alias("evidence"))
