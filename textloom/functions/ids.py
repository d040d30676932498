"""Deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_PREFIX = "textloom:chunk:"


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the SHA-1 of the parts, one a line. A null part counts as the word None."""
    joined = F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha1(joined.cast("binary")), F.lit(16)))


def index_point_id(chunk_id: Column, prefix: str = NAME_PREFIX) -> Column:
    """Version 5 UUID in the URL namespace of ``prefix`` and the chunk id; an empty chunk id is an error."""
    name = F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(F.concat(F.lit(prefix), chunk_id), "utf-8"))
    h = F.sha1(name)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    out = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(F.coalesce(chunk_id, F.lit("")) != "", out).otherwise(F.raise_error(F.lit("a chunk without chunk_id has no index id")))


def text_hash(text: Column) -> Column:
    """12 hex digits of the SHA-1 of a normalised text."""
    return F.left(F.sha1(text.cast("binary")), F.lit(12))
