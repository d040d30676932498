"""Chunks: units split to a size, with their payload and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T

SCHEMA_VERSION = "chunks_v1"


def _once(parts: str) -> Column:
    """The column as an expression: of a plain column Spark infers a filter for the explode, which would split each text twice more."""
    return F.flatten(F.array(parts))


def split_documents(docs: DataFrame, most: int = 1600, doc_key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_key, part_index, total_parts and text for every part of every text."""
    parts = docs.select(F.col(doc_key).alias("doc_key"), T.split_text(F.col(text_col), most).alias("parts"))
    return parts.select("doc_key", F.size("parts").alias("total_parts"), F.posexplode(_once("parts")).alias("part_index", "text"))


def build_chunks(units: DataFrame, metadata: DataFrame, most: int = 1600) -> DataFrame:
    """Chunk rows (the payload is flat columns) of the units of documents.

    ``metadata`` has one row for each doc_key, with source_file and filename; units of other documents go.
    """
    doc = metadata.withColumn("doc_id", ids.stable_id("doc", T.first_filled(F.col("doc_name"), F.col("source_file"), F.col("filename")), F.col("doc_reg"), T.first_filled(F.col("source_file"), F.col("filename"))))
    joined = units.join(doc, "doc_key").withColumns(T.structured_headings(F.col("headings")))
    scope = T.first_filled(T.strip(F.col("retrieval_anchor_heading")), T.strip(F.col("heading_path_text")), F.lit("__no_heading__"))
    joined = joined.withColumns({"point_scope": scope, "point_anchor": F.concat_ws(":", "chunk_start", "chunk_index")})
    number = T.first_filled(F.col("point_number"), F.lit("__unnumbered__"))
    joined = joined.withColumn("point_identity_key", F.concat_ws("::", number, "point_scope", "point_anchor")).withColumn("point_id", ids.stable_id("point", F.col("doc_id"), F.col("point_identity_key")))
    parts = joined.withColumn("parts", T.split_text(F.col("text"), most)).drop("text").select("*", F.size("parts").alias("total_parts"), F.posexplode(_once("parts")).alias("part_index", "text")).drop("parts")
    split = F.col("total_parts") > 1
    return parts.withColumns({
        "schema_version": F.lit(SCHEMA_VERSION), "heading_path": F.col("headings"), "token_estimate": T.estimate_tokens(F.col("text")),
        "is_split": split, "is_complete_point": ~split, "split_reason": F.when(split, "max_chars").otherwise(""),
        "chunk_id": ids.stable_id("chunk", F.col("doc_id"), F.col("point_id"), F.col("part_index"), T.normalize_for_hash(F.col("text"))),
    })


def plain_chunks(docs: DataFrame, most: int = 1600, doc_key: str = "doc_id", text_col: str = "text", name_col: str = "source") -> DataFrame:
    """Chunks of texts without structure: chunk_id, doc_id, doc_name, filename, part_index, total_parts, text, token_estimate."""
    named = docs.select(F.col(doc_key).alias("doc_key"), F.col(name_col).alias("doc_name"), F.col(text_col).alias("body"))
    parts = named.select("doc_key", "doc_name", T.split_text(F.col("body"), most).alias("parts")).select("doc_key", "doc_name", F.size("parts").alias("total_parts"), F.posexplode(_once("parts")).alias("part_index", "text"))
    doc_id = ids.stable_id("doc", F.col("doc_name"), F.col("doc_key"))
    return parts.withColumn("doc_id", doc_id).withColumns({
        "filename": F.concat(F.col("doc_key").cast("string"), F.lit(".txt")), "token_estimate": T.estimate_tokens(F.col("text")),
        "chunk_id": ids.stable_id("chunk", F.col("doc_id"), F.col("part_index"), T.normalize_for_hash(F.col("text"))),
    })
