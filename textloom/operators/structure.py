"""Paragraphs, heading paths and numbered units of documents.

Paragraph tables have the columns doc_key, ord (order in the document), text, outline_level and style_name; order is
always a column, as rows of a DataFrame have none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def paragraphs_of(docs: DataFrame, doc_key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A raw paragraph for each line of a text."""
    return docs.select(F.col(doc_key).alias("doc_key"), F.posexplode(F.split(F.col(text_col), "\n")).alias("ord", "raw")).withColumns({"outline_level": F.lit(10), "style_name": F.lit("")})


def make_paragraphs(raw: DataFrame, *, skipped: Sequence[str] = fixed.SKIPPED, points: Sequence[str] = fixed.POINT_NUMBER, capitals: str = fixed.HEADING_CAPITALS) -> DataFrame:
    """Cleaned paragraphs with their level, point number and character offsets; skipped ones go.

    A kept paragraph advances the offset by its cleaned length and one, a skipped one by its raw length.
    """
    clean = raw.withColumn("text", T.clean_paragraph_text(F.col("raw")))
    clean = clean.withColumn("kept", ~T.should_skip_paragraph(F.col("text"), skipped))
    before = Window.partitionBy("doc_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kept"), F.length("text") + 1).otherwise(F.length("raw"))
    placed = clean.withColumns({
        "char_start": F.coalesce(F.sum(step).over(before), F.lit(0)),
        "paragraph_index": F.coalesce(F.count_if("kept").over(before), F.lit(0)),
    }).where("kept")
    level = T.infer_heading_level(F.col("text"), F.col("outline_level"), F.col("style_name"), capitals)
    return placed.select(
        "doc_key", "ord", F.col("paragraph_index").cast("int"), "text", "outline_level", "style_name", level.alias("heading_level"),
        T.extract_point_number(F.col("text"), points).alias("point_number"), F.col("char_start").cast("long"), (F.col("char_start") + F.length("text")).cast("long").alias("char_end"),
    ).withColumn("is_heading", F.col("heading_level").isNotNull())


def marked_text(paragraphs: DataFrame) -> DataFrame:
    """doc_key and marked_text: headings between number signs, one paragraph a line."""
    marks = F.repeat(F.lit("#"), F.least(F.col("heading_level"), F.lit(6)))
    line = F.when(F.col("is_heading") & (F.col("heading_level") > 0), F.concat_ws(" ", marks, F.col("text"), marks)).otherwise(F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return paragraphs.groupBy("doc_key").agg(lines.alias("l")).select("doc_key", F.concat(T.strip(F.array_join(F.col("l.line"), "\n")), F.lit("\n")).alias("marked_text"))


def heading_paths(paragraphs: DataFrame, levels: int = 6) -> DataFrame:
    """Adds heading_path: for each paragraph, the headings that it stands under, itself included if it is one.

    Of each level the last heading so far counts, unless one of a smaller level came after it. All levels share one
    window, so a document is sorted once.
    """
    so_far = Window.partitionBy("doc_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("is_heading"), F.coalesce(F.nullif(F.col("heading_level"), F.lit(0)), F.lit(1)))
    last = {f"__h{k}": F.max(F.when(level == k, F.struct("ord", T.clean_marker_text(F.col("text")).alias("text")))).over(so_far) for k in range(1, levels + 1)}
    out = paragraphs.withColumns(last)

    def alive(k: int) -> Column:
        ok = F.col(f"__h{k}").isNotNull()
        for j in range(1, k):
            ok = ok & (F.col(f"__h{j}").isNull() | (F.col(f"__h{j}.ord") < F.col(f"__h{k}.ord")))
        return F.when(ok, F.col(f"__h{k}.text"))

    return out.withColumn("heading_path", F.array_compact(F.array(*(alive(k) for k in range(1, levels + 1))))).drop(*last)


def units(paragraphs: DataFrame, points: Sequence[str] = fixed.POINT_NUMBER) -> DataFrame:
    """Text units: paragraphs from a numbered one, or the first after a heading, up to the next of either.

    Returns doc_key, chunk_index, text, headings, point_number, chunk_start, char_start, char_end.
    """
    so_far = Window.partitionBy("doc_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = heading_paths(paragraphs).withColumn("unit", F.sum((F.col("is_heading") | (F.col("point_number") != "")).cast("int")).over(so_far))
    body = numbered.where(~F.col("is_heading"))
    first = lambda c: F.min_by(c, "ord").alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]), "\n")
    joined = body.groupBy("doc_key", "unit").agg(
        T.strip(text).alias("text"), F.min_by("heading_path", "ord").alias("headings"), first("point_number"), F.min_by("paragraph_index", "ord").alias("chunk_start"), first("char_start"), F.max_by("char_end", "ord").alias("char_end"),
    ).where("text <> ''")
    point = T.first_filled(F.col("point_number"), T.extract_point_number(F.col("text"), points))
    return joined.withColumn("point_number", point).withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_key").orderBy("unit")) - 1).drop("unit")
