"""Document metadata: registration, title, kind, number, date and authority, from the paragraphs alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


class MetadataError(ValueError):
    """A document has no title or no registration."""


def approval_act(joined: Column) -> Column:
    """The approving act that a text names; '' if none."""
    return T.first_filled(*(T.squeeze(F.regexp_extract(joined, p, 1)) for p in fixed.APPROVAL_ACT))


def law_signature(paragraphs: DataFrame, tail: int = 800) -> DataFrame:
    """doc_key and law_reg: the last number line of a law that follows a date line, among the last ``tail`` paragraphs."""
    order = Window.partitionBy("doc_key").orderBy("ord")
    lined = paragraphs.select("doc_key", "ord", T.clean_marker_text(F.col("text")).alias("line")).withColumns(
        {"before": F.lag("line").over(order), "from_end": F.row_number().over(Window.partitionBy("doc_key").orderBy(F.desc("ord")))})
    hits = lined.where((F.col("from_end") < tail) & F.col("line").rlike(fixed.LAW_NUMBER) & F.col("before").rlike(fixed.LAW_DATE))
    act = F.concat(F.lit("Федеральный закон от "), T.strip(F.replace("before", F.lit(" года"), F.lit(" г."))), F.lit(" "), F.col("line"))
    return hits.groupBy("doc_key").agg(F.max_by(act, "ord").alias("law_reg"))


def extract_metadata(paragraphs: DataFrame, *, head: int = 80, act_lines: int = 1500) -> DataFrame:
    """One row for each document: doc_key, doc_name, doc_reg, doc_title_full, approving_act, metadata_source,
    metadata_confidence, doc_kind, doc_number, doc_date, authority and manifest_kind.

    Registration: a line of the first 30 that begins like one; an approval act in the first lines, then in all;
    the signature of a law; the canonical act of the electrical rules. Title: the best-scored of the first 45 lines; a
    bracketed subject; a line that begins like a subject. What is not found stays empty: a file name never fills in.
    """
    w = Window.partitionBy("doc_key").orderBy("ord")
    lines = paragraphs.where(F.col("text") != "").select("doc_key", "ord", T.clean_marker_text(F.col("text")).alias("line")).withColumn("i", F.row_number().over(w) - 1).withColumn("up", F.upper("line"))
    n, up, line, i = F.length("line"), F.col("up"), F.col("line"), F.col("i")
    text_of = lambda most: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(i < most, F.struct("i", "line")))), lambda p: p["line"]), " ")
    first = lambda value, when: F.min_by(value, F.when(when, i))
    at = lambda value, when: F.when(F.min(F.when(when, i)).isNotNull(), first(value, when))
    subject = up.startswith("О ") | up.startswith("ОБ ")
    words = F.lit(False)
    for word in fixed.TITLE_WORDS:
        words = words | up.contains(word)
    score = F.when(words, 4).otherwise(0) - F.when(line.endswith(".") & (n > 120), 2).otherwise(0)
    titled = (i < 45) & (n >= 8) & (n <= F.when(subject, 2000).otherwise(280)) & (score > 0)
    key = F.struct(score.alias("score"), (-i).alias("i"), line.alias("line"))
    bracket = (i < 20) & (n >= 22) & line.startswith("[") & line.endswith("]")
    inner = T.strip(F.expr("substring(line, 2, length(line) - 2)"))
    docs = lines.groupBy("doc_key").agg(
        at(F.initcap("line"), (i < 30) & up.isin(*fixed.DOC_TYPES)).alias("doc_type"),
        at(line, (i < 30) & line.rlike(fixed.REGISTRATION_LINE)).alias("reg_line"),
        F.max(F.when(titled, key))["line"].alias("title_scored"),
        at(inner, bracket & (F.length(inner) >= 15)).alias("title_bracket"),
        at(line, i.between(2, 29) & n.between(30, 2000) & ~line.rlike(r"(?iuU)^от\s+\d") & subject).alias("title_subject"),
        text_of(head).alias("head_text"), text_of(act_lines).alias("act_text"), F.upper(text_of(50)).alias("early"),
        F.max(up.rlike(fixed.RULES_MARKS)).alias("rules_like"),
    ).join(law_signature(paragraphs), "doc_key", "left")
    act = T.first_filled(approval_act(F.col("head_text")), approval_act(F.col("act_text")))
    law = F.when(F.col("early").rlike(fixed.LAW_MARKS), F.col("law_reg"))
    docs = docs.withColumn("act", act).withColumn("law", law)
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    reg = F.when(has("reg_line"), F.concat_ws(" ", "doc_type", "reg_line")).when(has("act"), F.col("act")).when(has("law"), F.col("law")).when(F.col("rules_like"), fixed.RULES_ACT).otherwise(fixed.NOT_STATED)
    reg_source = F.when(has("reg_line"), "initial_lines_header").when(has("act"), "initial_lines_approved_phrase").when(has("law"), "law_signature_tail").when(F.col("rules_like"), "pue_seventh_edition_canonical").otherwise("not_extracted")
    title = T.first_filled(F.col("title_scored"), F.col("title_bracket"), F.col("title_subject"))
    title_source = F.when(has("title_scored"), "initial_lines_title").when(has("title_bracket"), "preamble_bracketed_subject").when(has("title_subject"), "preamble_o_subject").otherwise("not_extracted")
    docs = docs.select("doc_key", title.alias("doc_name"), reg.alias("doc_reg"), reg_source.alias("reg_source"), title_source.alias("title_source"))
    docs = docs.withColumn("kind", T.doc_kind(F.col("doc_name"), F.col("doc_reg")))
    rules = F.col("reg_source") == "pue_seventh_edition_canonical"
    confidence = F.when((F.col("reg_source") == "not_extracted") & (F.col("title_source") == "not_extracted"), "low").when(F.col("reg_source").startswith("initial") & F.col("title_source").startswith("initial"), "high").otherwise("medium")
    kind = F.col("kind")
    manifest = F.when(rules, "pue_canonical").when(F.col("title_source").startswith("preamble") | (confidence == "low"), "title_fallback").otherwise("")
    return docs.select(
        "doc_key", "doc_name", "doc_reg", F.col("doc_name").alias("doc_title_full"), F.col("doc_reg").alias("approving_act"),
        F.concat(F.lit("reg:"), "reg_source", F.lit(";title:"), "title_source").alias("metadata_source"), confidence.alias("metadata_confidence"),
        T.doc_kind_label(kind).alias("doc_kind"), T.doc_number(F.col("doc_reg"), F.col("doc_name"), kind).alias("doc_number"),
        T.first_filled(F.when(rules, fixed.RULES_DATE), T.doc_date(F.col("doc_reg"))).alias("doc_date"),
        T.payload_authority(F.when(rules, F.lit(fixed.RULES_AUTHORITY)).otherwise(""), F.col("doc_reg"), F.col("doc_reg"), kind).alias("authority"), manifest.alias("manifest_kind"),
    )


def is_valid(title: Column, registration: Column) -> Column:
    return (T.strip(title) != "") & ~T.strip(registration).isin("", fixed.NOT_STATED)


def validated(metadata: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows. With ``strict``, reading a document without title or registration is an error instead."""
    ok = is_valid(F.col("doc_title_full"), F.col("doc_reg"))
    if strict:
        problem = F.concat(F.lit("no title or registration in document "), F.col("doc_key").cast("string"))
        return metadata.withColumn("doc_reg", F.when(ok, F.col("doc_reg")).otherwise(F.raise_error(problem))), metadata.limit(0)
    return metadata.where(ok), metadata.where(~ok)
