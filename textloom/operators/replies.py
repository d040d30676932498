"""Replies in JSON, wherever they come from: found inside prose or fences, and brought into one form, for tables of replies.

Everything is expressions over VARIANT, so a reply of any shape is a row with its values or with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fences, the outermost object or array, and what parts a list that is a string.
_FENCE, _OBJECT, _ARRAY, _PARTS = r"(?i)```(?:json)?\s*([\s\S]*?)\s*```", r"\{[\s\S]*\}", r"\[[\s\S]*\]", r"[,;\n]+"


def json_text(reply: Column) -> Column:
    """The JSON of a reply: what is fenced, or all of it; if that is no JSON, its outermost object, else array, else the text as it is."""
    whole = T.strip(F.coalesce(reply, F.lit("")))
    own = F.when(F.regexp_like(whole, F.lit(_FENCE)), T.strip(F.regexp_extract(whole, _FENCE, 1))).otherwise(whole)
    inside = F.coalesce(F.nullif(F.regexp_extract(own, _OBJECT, 0), F.lit("")), F.nullif(F.regexp_extract(own, _ARRAY, 0), F.lit("")), own)
    return F.when(F.try_parse_json(own).isNotNull(), own).otherwise(inside)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; null where there is no value, VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _first(v: Column, *keys: str) -> Column:
    """The value of the first key that an object has, be it null."""
    return F.coalesce(*(_get(v, f"$.{k}") for k in keys))


def _listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, _PARTS), T.strip), lambda x: x != "")


def _parsed(replies: DataFrame, reply: str) -> DataFrame:
    """qid, the value v of each reply, and an error; an array stands for an object with ranked_chunk_ids."""
    text = json_text(F.col(reply))
    rows = replies.select("qid", T.strip(F.coalesce(reply, F.lit(""))).alias("__whole"), F.try_parse_json(text).alias("v")).withColumn("kind", _kind(F.col("v")))
    error = F.when(F.col("__whole") == "", "reply is empty").when(F.col("v").isNull(), "reply is not JSON").when(~F.col("kind").isin("OBJECT", "ARRAY"), "reply must be an object")
    return rows.select("qid", "v", "kind", error.alias("error"))


def ranked_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(qid, ids, error): the chunk ids that each reply (qid, ``reply``) ranks, in its order.

    A list or a string of ids is taken from ranked_chunk_ids, chunk_ids or ranking, the first of these that is there, or
    a list from items, whose entries may be objects with a chunk_id. Empty ids are left out. A reply without any of these
    has no ids and an error.
    """
    rows = _parsed(replies, reply).withColumn("raw", F.when(F.col("kind") == "ARRAY", F.col("v")).otherwise(_first(F.col("v"), "ranked_chunk_ids", "chunk_ids", "ranking")))
    none = F.array().cast("array<string>")
    named = F.col("raw").isNull() | (_kind(F.col("raw")) == "VOID")
    raw = F.when(named & (_kind(_get(F.col("v"), "$.items")) == "ARRAY"), _get(F.col("v"), "$.items")).otherwise(F.col("raw"))
    rows = rows.withColumn("raw", raw).withColumn("k", _kind(F.col("raw")))
    entry = lambda x: T.strip(F.coalesce(F.when(_kind(x) == "OBJECT", _get(x, "$.chunk_id", "string")).otherwise(F.try_variant_get(x, "$", "string")), F.lit("")))
    each = F.filter(F.transform(_get(F.col("raw"), "$", "array<variant>"), entry), lambda x: x != "")
    ids = F.when(F.col("k") == "ARRAY", each).when(F.col("k") == "STRING", _listed(_get(F.col("raw"), "$", "string")))
    out = rows.select("qid", F.when(F.col("error").isNull(), ids).alias("ids"), "error")
    return out.select("qid", F.coalesce("ids", none).alias("ids"), F.coalesce("error", F.when(F.col("ids").isNull(), "ranked_chunk_ids must be a list or string")).alias("error"))


def answered_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(qid, answer, citations, warnings, error) of replies (qid, ``reply``).

    The answer is a reply's own, or that of its response or result. Citations (chunk_id, doc_name, point_number) come from
    citations, sources or references: a string of ids, or a list of ids and of objects with chunk_id or id; an entry
    without one, or of another kind, is a warning with its place. A reply without an answer has an error, no citations.
    """
    rows = _parsed(replies, reply)
    v = F.col("v")
    answer = F.coalesce(*(F.nullif(_get(v, f"$.{k}", "string"), F.lit("")) for k in ("answer", "response.answer", "result.answer")), F.lit(""))
    rows = rows.withColumns({"answer": F.when(F.col("kind") == "OBJECT", T.strip(answer)).otherwise(""), "raw": F.when(F.col("kind") == "OBJECT", _first(v, "citations", "sources", "references"))}).withColumn("k", _kind(F.col("raw")))
    error = F.coalesce("error", F.when(F.col("answer") == "", "answer must be a non-empty string"), F.when(~F.col("k").isin("ARRAY", "STRING", "VOID"), "citations must be a list or string"))
    part = lambda x, *keys: T.strip(F.coalesce(*(F.nullif(_get(x, f"$.{k}", "string"), F.lit("")) for k in keys), F.lit("")))
    cited = lambda a, b, c, w: F.struct(a.alias("chunk_id"), b.alias("doc_name"), c.alias("point_number"), w.alias("warning"))
    empty = F.lit("")

    def entry(x: Column, i: Column) -> Column:
        told = lambda what: F.concat(F.lit("citation["), i.cast("string"), F.lit(f"]: {what}"))
        kind, text, key = _kind(x), T.strip(F.coalesce(F.try_variant_get(x, "$", "string"), empty)), part(x, "chunk_id", "id")
        of_text = cited(text, empty, empty, F.when(text == "", told("empty chunk_id string")))
        of_object = cited(key, part(x, "doc_name"), part(x, "point_number"), F.when(key == "", told("missing chunk_id")))
        return F.when(kind == "STRING", of_text).when(kind == "OBJECT", of_object).otherwise(cited(empty, empty, empty, told("unsupported citation type")))

    none = F.array().cast("array<struct<chunk_id:string,doc_name:string,point_number:string,warning:string>>")
    listed = F.transform(_listed(_get(F.col("raw"), "$", "string")), lambda x: cited(x, empty, empty, F.lit(None).cast("string")))
    every = F.when(F.col("k") == "ARRAY", F.transform(_get(F.col("raw"), "$", "array<variant>"), entry)).when(F.col("k") == "STRING", listed)
    rows = rows.select("qid", F.when(error.isNull(), F.col("answer")).otherwise("").alias("answer"), F.when(error.isNull(), F.coalesce(every, none)).otherwise(none).alias("every"), error.alias("error"))
    kept = F.transform(F.filter("every", lambda c: c["warning"].isNull()), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["doc_name"].alias("doc_name"), c["point_number"].alias("point_number")))
    return rows.select("qid", "answer", kept.alias("citations"), F.array_compact(F.transform("every", lambda c: c["warning"])).alias("warnings"), "error")
