"""Chunk quality: penalties, counters, gates and comparison with a baseline.

Reports are long tables of (section, metric, value). Chunk tables have an ``ord`` column, their order in the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, ids
from ..functions import text as T
from ..sources.tables import staged

METADATA_FIELDS = ("doc_name", "doc_title_full", "doc_kind", "doc_number", "doc_date", "authority", "approving_act")


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def with_payload_keys(chunks: DataFrame) -> DataFrame:
    """Adds payload_keys, which the table's own columns are if it has none."""
    return chunks if "payload_keys" in chunks.columns else chunks.withColumn("payload_keys", F.array(*map(F.lit, chunks.columns)))


def missing_keys(keys: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, fixed.REQUIRED_PAYLOAD)), keys)


def penalties(text: Column | None = None) -> Column:
    """array of struct(code, points, stage), in the order of the rules."""
    t = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    rules = [
        (_empty("doc_name"), "missing_doc_name", 25, "metadata_extraction"),
        (_empty("heading_path_text"), "missing_heading_path_text", 20, "heading_parsing"),
        (F.length(T.strip(t)) < 20, "too_short", 20, "chunk_splitting"),
        (T.has_service_markers(t), "service_markers", 15, "rtf_processing"),
        (T.looks_truncated(t), "looks_truncated", 15, "chunk_splitting"),
        (_empty("point_number") & T.has_point_structure(t), "missing_point_number", 10, "point_parsing"),
        (F.length(t) > 1800, "too_long", 10, "chunk_splitting"),
        (F.size(missing_keys(F.col("payload_keys"))) > 0, "missing_required_payload_keys", 20, "payload_compatibility"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"), F.lit(stage).alias("stage"))) for c, code, points, stage in rules)))


def scored(chunks: DataFrame) -> DataFrame:
    """Adds penalties and score (100 less the points, 0 at least)."""
    out = with_payload_keys(chunks).withColumn("penalties", penalties())
    return out.withColumn("score", F.greatest(F.lit(0), F.lit(100) - F.aggregate("penalties", F.lit(0), lambda s, p: s + p["points"])))


def worst_chunks(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` lowest scores; equal ones by their order in the corpus."""
    return scored(chunks).orderBy("score", "ord").limit(limit)


def percentiles(table: DataFrame, value: str, shares: dict[str, float], group: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank percentiles, the rank rounded half to even; 0 where a group has no rows.

    Equal values are counted first, so ranks run over distinct values, not over rows.
    """
    counts = table.where(F.col(value).isNotNull()).groupBy(*group, value).count()
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    running = counts.withColumns({"upto": F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("count").over(w)})
    return running.groupBy(*group).agg(*(F.coalesce(F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * share), F.col(value))), F.lit(0)).alias(name) for name, share in shares.items()))


def value_spread(table: DataFrame, value: str, group: tuple[str, ...], share: float) -> DataFrame:
    """Of each group the nearest-rank percentile and the median, the mean of the two middle values; from counts of the different values."""
    counts = table.where(F.col(value).isNotNull()).groupBy(*group, value).count()
    w = Window.partitionBy(*group)
    running = counts.withColumns({"upto": F.sum("count").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("count").over(w)})
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    return running.groupBy(*group).agg(at(F.bround((F.col("n") - 1) * share)).alias("percentile"), ((at(F.floor((F.col("n") - 1) / 2)) + at(F.ceil((F.col("n") - 1) / 2))) / 2).alias("median"))


def duplicate_count(table: DataFrame, *keys: str) -> DataFrame:
    """One row: rows beyond the first of each key. Null counts as a value."""
    return table.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def document_metadata_quality(chunks: DataFrame) -> DataFrame:
    """One row for each file: which of seven fields its first chunk fills well, and the score in percent."""
    name = T.first_filled(F.col("filename"), F.col("source_file") if "source_file" in chunks.columns else F.lit(""))
    first = chunks.withColumn("__file", name).where("__file <> ''").groupBy("__file").agg(*(F.min_by(F.coalesce(F.col(c).cast("string"), F.lit("")), "ord").alias(c) for c in METADATA_FIELDS))
    ok = {c: T.strip(F.col(c)) != "" for c in METADATA_FIELDS}
    ok["doc_title_full"] = F.length(T.strip(F.col("doc_title_full"))) >= 12
    ok["doc_kind"] &= ~F.col("doc_kind").isin("unknown", "other")
    ok["approving_act"] &= F.lower(T.strip(F.col("approving_act"))) != fixed.NOT_STATED.lower()
    score = F.round(F.lit(100.0) * reduce(lambda a, b: a + b, (c.cast("int") for c in ok.values())) / len(ok), 2)
    return first.select(F.col("__file").alias("filename"), score.alias("score"), *(c.alias(f"{k}_ok") for k, c in ok.items()))


def quality_counters(chunks: DataFrame) -> DataFrame:
    """The report: rows of (section, metric, value double).

    One pass counts what is a property of a chunk; what needs groups (duplicates, documents, percentiles) is
    aggregated by group first, so nothing is gathered in one place but sums.
    """
    c = with_payload_keys(chunks).withColumns({"__n": F.length(F.coalesce("text", F.lit(""))), "__missing": F.size(missing_keys(F.col("payload_keys"))) > 0})
    text = F.coalesce(F.col("text"), F.lit(""))
    count = F.count_if
    flat = c.agg(
        F.struct(count(_empty("doc_name")).alias("chunks_without_doc_name")).alias("documents"),
        F.struct(count(_empty("heading_path_text")).alias("chunks_without_heading_path_text"), F.coalesce(F.sum(F.size(F.filter("headings", lambda h: F.length(h) > 220))), F.lit(0)).alias("suspicious_long_headings")).alias("structure"),
        F.struct(
            count(~_empty("point_number")).alias("chunks_with_point_number"), count(_empty("point_number")).alias("chunks_without_point_number"),
            count("is_split").alias("split_chunks"), count(~F.col("is_complete_point")).alias("incomplete_point_chunks"),
        ).alias("points"),
        F.struct(
            F.count("*").alias("chunks_total"), F.coalesce(F.avg("__n"), F.lit(0)).alias("avg_chars"), F.coalesce(F.avg("token_estimate"), F.lit(0)).alias("avg_token_estimate"),
            count(F.col("__n") < 80).alias("chunks_under_80_chars"), count(F.col("__n") > 1600).alias("chunks_over_target"), count(T.has_service_markers(text)).alias("chunks_with_service_markers"), count(T.looks_truncated(text)).alias("chunks_look_truncated"),
        ).alias("chunks"),
        F.struct(
            count("__missing").alias("chunks_missing_required_payload_keys"), F.coalesce(1 - count("__missing") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("required_payload_keys_coverage"),
            count(T.strip(text) == "").alias("empty_text_chunks"),
        ).alias("retrieval_readiness"),
    )
    rows = [F.struct(F.lit(s).alias("section"), F.lit(f.name).alias("metric"), F.col(f"{s}.{f.name}").cast("double").alias("value")) for s in flat.columns for f in flat.schema[s].dataType]
    out = flat.select(F.inline(F.array(*rows)))
    # Distinct values are counted by grouping once by each kind of id: no row is multiplied.
    headings = c.groupBy(F.coalesce("filename", F.lit("")).alias("f")).agg(F.max(F.size("headings")).alias("most")).agg(count(F.coalesce("most", F.lit(0)) <= 0).alias("v"), count(F.col("f") != "").alias("files"))
    points = c.where(~_empty("point_id")).groupBy("point_id").agg(count(~F.col("is_split")).alias("whole")).agg(F.count("*").alias("all"), F.coalesce(F.sum(F.greatest(F.col("whole") - 1, F.lit(0))), F.lit(0)).alias("more"))
    last_ids = c.where(~_empty("filename") & ~_empty("doc_id")).groupBy("filename").agg(F.max_by("doc_id", "ord").alias("doc_id"))
    identity = c.select("doc_name", "point_number", ids.text_hash(T.normalize_for_hash(text)).alias("h"))
    meta = document_metadata_quality(chunks)
    one = lambda df, section, metric, column: df.select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.col(column).cast("double").alias("value"))
    # Percentiles and medians of both sizes from one count of their values.
    sizes = c.select(F.inline(F.array(F.struct(F.lit("chars").alias("of"), F.col("__n").cast("long").alias("v")), F.struct(F.lit("token_estimate").alias("of"), F.col("token_estimate").cast("long").alias("v")))))
    spread = value_spread(sizes, "v", ("of",), 0.95)
    names = spread.select(F.lit("chunks").alias("section"), F.inline(F.array(F.struct(F.concat(F.lit("p95_"), "of").alias("metric"), F.col("percentile").cast("double").alias("value")), F.struct(F.concat(F.lit("p50_"), "of").alias("metric"), F.col("median").cast("double").alias("value")))))
    asked = chunks.sparkSession.createDataFrame([(f"{p}_{k}",) for p in ("p95", "p50") for k in ("chars", "token_estimate")], "metric string")
    names = asked.join(names, "metric", "left").select(F.lit("chunks").alias("section"), "metric", F.coalesce("value", F.lit(0.0)).alias("value"))
    summary = meta.agg(F.count("*").alias("documents_evaluated"), F.coalesce(F.avg("score"), F.lit(0)).alias("avg_score"), F.coalesce(F.min("score"), F.lit(0)).alias("min_score"), *(count(~F.col(f"{k}_ok")).alias(f"missing_{k}") for k in METADATA_FIELDS))
    more = [
        headings.select(F.inline(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(v).cast("double").alias("value")) for s, m, v in (("structure", "documents_without_headings", "v"), ("documents", "documents_total", "files")))))),
        points.select(F.inline(F.array(*(F.struct(F.lit("points").alias("section"), F.lit(m).alias("metric"), F.col(v).cast("double").alias("value")) for m, v in (("points_detected", "all"), ("duplicate_point_ids", "more")))))),
        one(duplicate_count(c.select(F.coalesce("chunk_id", F.lit("")).alias("id")), "id"), "retrieval_readiness", "duplicate_chunk_ids", "duplicates"),
        names,
        one(duplicate_count(last_ids, "doc_id"), "documents", "duplicate_doc_ids", "duplicates"),
        one(duplicate_count(identity, "doc_name", "point_number", "h"), "chunks", "duplicate_doc_point_text", "duplicates"),
        summary.select(F.inline(F.array(*(F.struct(F.lit("metadata_quality").alias("section"), F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in summary.columns)))),
        c.groupBy(F.coalesce(F.nullif("metadata_confidence", F.lit("")), F.lit("(empty)")).alias("m")).count().select(F.lit("metadata_confidence").alias("section"), F.col("m").alias("metric"), F.col("count").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, more, out)


#: (code, stage, metric, whether 0 is the defect), in the order of the report.
_BLOCKING = [
    ("no_documents_processed", "rtf_processing", "documents_total", True),
    ("missing_required_payload_keys", "payload_compatibility", "chunks_missing_required_payload_keys", False),
    ("empty_text_chunks", "chunk_splitting", "empty_text_chunks", False),
    ("duplicate_chunk_ids", "chunk_splitting", "duplicate_chunk_ids", False),
    ("service_markers_in_text", "rtf_processing", "chunks_with_service_markers", False),
    ("missing_doc_name", "metadata_extraction", "chunks_without_doc_name", False),
    ("missing_heading_path_text", "heading_parsing", "chunks_without_heading_path_text", False),
    ("duplicate_point_ids", "point_parsing", "duplicate_point_ids", False),
]


def blocking_defects(report: DataFrame) -> DataFrame:
    """(position, code, stage, count) of the rules that a report breaks."""
    rules = report.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(_BLOCKING)], "position int, code string, stage string, metric string, none boolean")
    hit = F.when(F.col("none"), F.col("value") == 0).otherwise(F.col("value") > 0)
    return report.join(F.broadcast(rules), "metric").where(hit).select("position", "code", "stage", F.when(F.col("none"), 1).otherwise(F.col("value")).cast("long").alias("count"))


def passes_gate(report: DataFrame) -> bool:
    return blocking_defects(report).isEmpty()


#: (metric of the comparison, metric of the report, whether higher is better, whether it is gated).
_COMPARED = [
    ("documents_total", "documents_total", True, True),
    ("chunks_total", "chunks_total", True, False),
    ("chunks_without_doc_name", "chunks_without_doc_name", False, True),
    ("chunks_without_heading_path_text", "chunks_without_heading_path_text", False, True),
    ("chunks_without_point_number", "chunks_without_point_number", False, True),
    ("duplicate_doc_point_text", "duplicate_doc_point_text", False, True),
    ("service_markers", "chunks_with_service_markers", False, True),
    ("document_metadata_avg_score", "avg_score", True, True),
    ("documents_missing_doc_kind", "missing_doc_kind", False, True),
    ("documents_missing_doc_date", "missing_doc_date", False, True),
    ("documents_missing_authority", "missing_authority", False, True),
    ("documents_missing_approving_act", "missing_approving_act", False, True),
]


def normalize_baseline(chunks: DataFrame) -> DataFrame:
    """Fills doc_id, point_id, token_estimate and chunk_id of foreign chunks where they are null."""
    has = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = chunks.withColumn("doc_id", F.coalesce(has("doc_id"), ids.stable_id("doc", F.coalesce(has("doc_name"), F.lit("")), F.coalesce(has("doc_reg"), F.lit("")))))
    out = out.withColumn("point_id", F.coalesce(has("point_id"), ids.stable_id("point", F.col("doc_id"), F.coalesce(has("point_identity_key"), F.lit("")), F.col("ord"))))
    out = out.withColumn("token_estimate", F.coalesce(F.col("token_estimate") if "token_estimate" in chunks.columns else F.lit(None).cast("int"), T.estimate_tokens(text)))
    return out.withColumn("chunk_id", T.first_filled(has("chunk_id"), ids.stable_id("chunk", F.col("doc_id"), F.col("point_id"), T.normalize_for_hash(text))))


def scope(new: DataFrame, baseline: DataFrame) -> DataFrame:
    """(filename, in_new, in_baseline) of all file names of either table."""
    names = lambda df, side: df.where(~_empty("filename")).select("filename").distinct().withColumn(side, F.lit(True))
    both = names(new, "in_new").join(names(baseline, "in_baseline"), "filename", "full")
    return both.select("filename", F.coalesce("in_new", F.lit(False)).alias("in_new"), F.coalesce("in_baseline", F.lit(False)).alias("in_baseline"))


def restrict_baseline(new: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline chunks of the new files; all of them if there is no new file."""
    names = new.where(~_empty("filename")).select("filename").distinct()
    some = names.limit(1).select(F.lit(True).alias("__some"))
    return baseline.join(names.withColumn("__new", F.lit(True)), "filename", "left").join(F.broadcast(some), how="left").where(F.col("__some").isNull() | F.col("__new").isNotNull()).drop("__some", "__new")


def compare_quality(new: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, new, baseline, delta_in_better_direction, passes, gate) of twelve metrics."""
    rules = new.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(_COMPARED)], "position int, name string, metric string, higher boolean, gate boolean")
    a = quality_counters(new).where("section <> 'metadata_confidence'").select("metric", F.col("value").alias("new"))
    # Joined and filled once, not by each of the report's counts.
    b = quality_counters(staged(normalize_baseline(restrict_baseline(new, baseline)))).where("section <> 'metadata_confidence'").select("metric", F.col("value").alias("baseline"))
    both = a.join(b, "metric").join(F.broadcast(rules), "metric")
    better = F.when(F.col("higher"), F.col("new") - F.col("baseline")).otherwise(F.col("baseline") - F.col("new"))
    return both.select("position", F.col("name").alias("metric"), "new", "baseline", better.alias("delta_in_better_direction"), (better >= 0).alias("passes"), "gate")


def comparison_defects(new: DataFrame, baseline: DataFrame) -> DataFrame:
    """(code, stage, count) of the new report, of failed gated metrics, and of a scope that does not match."""
    own = blocking_defects(quality_counters(new)).select("code", "stage", "count")
    failed = compare_quality(new, baseline).where("gate AND NOT passes").select(F.concat(F.lit("baseline_metric_failed:"), "metric").alias("code"), F.lit("baseline_comparison").alias("stage"), F.lit(1).cast("long").alias("count"))
    s = scope(new, baseline).agg(F.count_if("in_new").alias("new"), F.count_if(F.col("in_new") & F.col("in_baseline")).alias("both"), F.count_if(~F.col("in_new")).alias("missing"))
    code = F.when((F.col("new") > 0) & (F.col("both") == 0), "baseline_scope_mismatch").when(F.col("missing") > 0, "baseline_documents_missing_in_new")
    scoped = s.select(code.alias("code"), F.lit("baseline_comparison").alias("stage"), F.greatest("missing", F.lit(1)).cast("long").alias("count")).where("code IS NOT NULL")
    return own.unionByName(failed).unionByName(scoped)
