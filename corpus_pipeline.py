"""From raw documents to training sequences: quality rules, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontam, lines, minhash, packing, quality_rules
from textloom.llm._common import Scratch, read, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, row by row; ids play no part. Null, empty and very short texts are rejected."""
    return quality_rules.judge_quality(docs, carry=True).where("kept").select("document.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from ``text``, and ``n_chars`` follows; a document of which no word is left goes.

    Rows that repeat a ``doc_id``, or have none, count as one document when recurrence is counted. A null or empty text
    has no line to lose and stays. Lines of two documents stay, long ones, too: two copies must reach near-dedup whole,
    which removes one of them, instead of leaving a part of it.
    """
    out = lines.drop_template_lines(docs, long_documents=3, carry=True).where(F.col("kept_text").rlike(r"[^ \t\n\r\f\x0b]") | (F.col("n_dropped") == 0))
    own = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("document.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(own[c].alias(c) if own.get(c) is not None else F.col("document").getField(c).alias(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) one row stays: the smallest ``doc_id``, null last.

    Every row is a document of its own here, whatever its id: a copy without an id goes like any other, and so does the
    second of two rows with the same id and text. Null and empty texts are linked with nothing and stay.
    """
    # Numbered once and written, so that a row keeps its number however often a lost task is repeated.
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("document")), "numbered")
    group = minhash.near_duplicates(rows.select("row", "document.text"), id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    others = group.where(F.col("row") != F.col("group"))
    members = stored(others.union(others.select(F.col("group").alias("row"), "group").distinct()).join(rows.select("row", "document.doc_id"), "row"), "members")
    first = stored(members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("group", F.col("first.row").alias("first")), "first")
    gone = members.join(first, "group").where(F.col("row") != F.col("first")).select("row")
    return rows.join(gone, "row", "left_anti").select("document.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, exact or edited, go, with or without a ``doc_id``; clean rows of the same id stay. Null and empty texts stay."""
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their ids. A null or empty text is one piece; rows that repeat a ``doc_id`` are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The rules' distances, min-max hashing, alignment and byte-pair encoding go beyond SQL; tests/llm/test_queries.py holds
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is written as Parquet and read again, and goes after the next."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = scratch.write(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    return docs
