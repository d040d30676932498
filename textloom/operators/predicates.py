"""Filter specs: from field values to boolean columns.

A filter map is {field: value or list of values}. A single value is equality on a keyword field and all of its words
on a text field; a list is membership on either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

#: The largest limit of a question.
MOST = 100
SUPPORTED = (*fixed.KEYWORD_FIELDS, *fixed.TEXT_FIELDS)


def normalize_filters(filters: dict | None) -> dict:
    """Supported fields only; values stripped, empty ones dropped, other types as text, lists kept."""
    out = {}
    for k, v in (filters or {}).items():
        if k not in SUPPORTED or v is None:
            continue
        v = [str(x).strip() for x in v if str(x).strip()] if isinstance(v, (list, tuple)) else str(v).strip()
        if v:
            out[k] = v
    return out


def doc_name_variants(value: str | list[str]) -> str | list[str]:
    """The values and their upper-case forms, each once; a scalar if that is just one."""
    values = [value] if isinstance(value, str) else list(value)
    out = list(dict.fromkeys(x for v in values for x in (v.strip(), v.strip().upper()) if x))
    return out[0] if len(out) == 1 else out


def expand_doc_name_variants(filters: dict) -> dict:
    return filters | ({"doc_name": doc_name_variants(filters["doc_name"])} if filters.get("doc_name") else {})


def has_all_tokens(query: Column, text: Column) -> Column:
    """Whether a full-text index finds the text: it has every word of the query, which has one at least."""
    return T.let(T.search_tokens(query), lambda q: (F.size(q) > 0) & (F.size(F.array_except(q, T.search_tokens(text))) == 0))


def condition(field: str, value: str | list[str]) -> Column:
    if isinstance(value, (list, tuple)):
        return F.col(field).isin(*value)
    return has_all_tokens(F.lit(value), F.col(field)) if field in fixed.TEXT_FIELDS else F.col(field) == value


def must(filters: dict | None) -> Column:
    """All conditions of a filter map; true for an empty one."""
    return reduce(lambda a, b: a & b, (condition(k, v) for k, v in normalize_filters(filters).items()), F.lit(True))


def should(query: str, fields: tuple[str, ...] = fixed.SEARCH_FIELDS) -> Column:
    """Any field that the query finds; true for an empty query."""
    return reduce(lambda a, b: a | b, (condition(f, query.strip()) for f in fields)) if query.strip() else F.lit(True)


def payload_filter(query: str, filters: dict | None, fields: tuple[str, ...] = fixed.SEARCH_FIELDS) -> Column:
    return must(expand_doc_name_variants(normalize_filters(filters))) & should(query, fields)


def is_point_lookup(filters: Column) -> Column:
    """Whether a filter map column can be looked up as a point."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.size(filters[k]) > 0, F.lit(False)) for k in ("chunk_id", "point_identity_key", "point_number", "heading_path_text")))


def row_matches(filters: Column, fields: tuple[str, ...] = SUPPORTED) -> Column:
    """Whether the row's fields fit its question's filters, a column map<string, array<string>>."""

    def one(field: str) -> Column:
        want = filters[field]
        ok = F.array_contains(want, F.col(field))
        if field in fixed.TEXT_FIELDS:
            ok = F.when(F.size(want) == 1, has_all_tokens(want[0], F.col(field))).otherwise(ok)
        if field == "doc_name":
            ok = F.array_contains(F.concat(want, F.transform(want, F.upper)), F.col(field))
        return want.isNull() | F.coalesce(ok, F.lit(False))

    return reduce(lambda a, b: a & b, map(one, fields))


def clamp_limit(limit: Column, default: int = 10, most: int = MOST) -> Column:
    return F.when(F.coalesce(limit, F.lit(0)) <= 0, default).otherwise(F.least(limit, F.lit(most))).cast("int")
