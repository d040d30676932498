"""Text functions. White space, case and word characters are Unicode's, as the patterns' flags say."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: All characters of the class [\\s\\x1c-\\x1f] by Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000" + _SEPARATORS


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once a row."""
    return F.transform(F.array(value), then)[0]


def first_filled(*options: Column) -> Column:
    """The first option that is neither null nor empty; '' if there is none."""
    return F.coalesce(*(F.when(o != "", o) for o in options), F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; the ends are stripped."""
    # Single spaces, which are nearly all white space, stay as they are.
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]", " "))


def clean_paragraph_text(text: Column) -> Column:
    """Line ends and bells go, runs of tabs and spaces become one space, the ends are stripped."""
    return strip(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\r\n\x07", ""), r"[\t ]+", " "))


def clean_marker_text(text: Column) -> Column:
    """Heading marks, rules and emphasis marks go; then ``squeeze``."""

    def clean(t: Column) -> Column:
        out = F.regexp_replace(t, r"(?U)^\s*(#{1,9}|\*{3}|//)\s*", "")
        out = F.regexp_replace(out, r"(?U)\s*(#{1,9}|\*{3}|\\)\s*$", "")
        return F.regexp_replace(out, r"\*{2,}", "")

    # Most texts have no mark: a search for plain strings tells, before any pattern is tried at each character.
    marked = lambda t: F.contains(t, F.lit("#")) | F.contains(t, F.lit("**")) | F.contains(t, F.lit("//")) | F.contains(t, F.lit("\\"))
    return squeeze(let(F.coalesce(text, F.lit("")), lambda t: F.when(marked(t), clean(t)).otherwise(t)))


def normalize_for_hash(text: Column) -> Column:
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def extract_point_number(text: Column, patterns: Sequence[str] = fixed.POINT_NUMBER) -> Column:
    """Group 1 of the first pattern that matches, stripped; '' if none does."""
    return strip(first_filled(*(F.regexp_extract(text, p, 1) for p in patterns)))


def should_skip_paragraph(text: Column, patterns: Sequence[str] = fixed.SKIPPED) -> Column:
    out = strip(text) == ""
    for p in patterns:
        out = out | strip(text).rlike(p)
    return out


def infer_heading_level(text: Column, outline_level: Column, style_name: Column, capitals: str = fixed.HEADING_CAPITALS) -> Column:
    """Level of a heading, 1 to 6; null for other paragraphs. ``capitals`` must be found in a heading of capitals."""
    t, n = strip(text), F.length(strip(text))
    style = F.regexp_extract(F.lower(F.coalesce(style_name, F.lit(""))), fixed.HEADING_STYLE, 2)
    return (
        F.when(outline_level.between(1, 9), F.least(outline_level, F.lit(6)))
        .when(style != "", F.least(F.expr("6"), style.cast("int")))
        .when((n < 180) & t.rlike(fixed.HEADING_STANDARD), 1)
        .when((n < 180) & t.rlike(fixed.HEADING_DIRECTIVE), 1)
        .when(t.rlike(fixed.HEADING_PART), F.when(F.lower(t).startswith("раздел"), 1).otherwise(2))
        .when((n < 180) & t.rlike(fixed.HEADING_ROMAN), 1)
        .when((n < 160) & t.rlike(fixed.HEADING_NUMBERED), 2)
        .when(n.between(12, 180) & (F.upper(t) == t) & t.rlike(capitals) & ~t.rlike(fixed.HEADING_CAPITALS_NOT), 2)
        .cast("int")
    )


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def parse_structured_heading(heading: Column, kind: str) -> Column:
    """struct(heading, number, title) of an article, chapter or section heading; empty strings for any other."""
    pattern = fixed.STRUCTURED_HEADING[kind]
    hit = heading.rlike(pattern)
    part = lambda c: F.when(hit, c).otherwise("")
    title = F.regexp_replace(F.regexp_extract(heading, pattern, 2), r"^[ .]+|[ .]+$", "")
    return F.struct(part(strip(heading)).alias("heading"), part(F.replace(strip(F.regexp_extract(heading, pattern, 1)), F.lit("_"), F.lit("."))).alias("number"), part(title).alias("title"))


def structured_headings(headings: Column) -> dict[str, Column]:
    """Columns of the heading path: its text, the last chapter, section and article on it, and the anchor."""
    out = {"nearest_heading": F.coalesce(F.get(headings, F.size(headings) - 1), F.lit("")), "heading_path_text": F.array_join(headings, " > ")}
    for kind in ("chapter", "section", "article"):
        pattern = fixed.STRUCTURED_HEADING[kind]
        hits = F.filter(headings, lambda h: h.rlike(pattern))  # noqa: B023  called at once
        last = F.coalesce(F.get(hits, F.size(hits) - 1), F.lit(""))
        for part in ("heading", "number", "title"):
            out[f"{kind}_{part}"] = parse_structured_heading(last, kind)[part]
    out["retrieval_anchor_heading"] = first_filled(out["article_heading"], out["section_heading"], out["chapter_heading"], out["nearest_heading"])
    return out


def split_text(text: Column, most: int) -> Column:
    """Parts of ``most`` characters at most, from whole sentences; a longer sentence is cut, and its tail opens the next part.

    The markers are cleaned first. Empty text has no parts.
    """
    # After cleaning, one space parts any two sentences, so a part is a slice of the text. The fold runs over lengths
    # only; its state is (slices done, where the current one begins, its length, where the next sentence begins). A
    # sentence that fits joins the current slice; else that is done, all whole cuts of the sentence are, too, and what
    # is left of it (never nothing) is the new current slice.
    slices = "array<struct<begin:int,size:int>>"
    start = F.struct(F.array().cast(slices).alias("done"), F.lit(0).alias("begin"), F.lit(0).alias("size"), F.lit(0).alias("at"))
    piece = lambda begin, size: F.struct(begin.cast("int").alias("begin"), size.cast("int").alias("size"))
    ended = lambda s: F.when(s["size"] > 0, F.concat(s["done"], F.array(piece(s["begin"], s["size"])))).otherwise(s["done"])

    def step(s: Column, n: Column) -> Column:
        fits = s["size"] + n + 1 <= most
        full = F.greatest(F.ceil(n / most).cast("int") - 1, F.lit(0))
        cuts = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda i: piece(s["at"] + i * most, F.lit(most)))).otherwise(F.array().cast(slices))
        begin = F.when(~fits, s["at"] + full * most).when(s["size"] == 0, s["at"]).otherwise(s["begin"])
        size = F.when(~fits, n - full * most).when(n == 0, s["size"]).when(s["size"] == 0, n).otherwise(s["size"] + 1 + n)
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(ended(s), cuts)).alias("done"), begin.alias("begin"), size.alias("size"), (s["at"] + n + 1).alias("at"))

    def cut(t: Column) -> Column:
        lengths = F.transform(F.split(t, r"(?<=[.!?])\s+"), F.length)
        return F.transform(F.aggregate(lengths, start, step, ended), lambda x: F.substring(t, x["begin"] + 1, x["size"]))

    def of(t: Column) -> Column:
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(cut(t))

    return let(clean_marker_text(text), of)


def has_service_markers(text: Column) -> Column:
    return text.rlike(r"(?mU)^\s*//") | text.contains("***") | text.rlike(r"(?mU)^\s*\\\s*$")


def looks_truncated(text: Column) -> Column:
    return strip(text).rlike(r"[:(,]$")


def has_point_structure(text: Column) -> Column:
    return text.rlike(r"(?iuU)^\s*(\{?\d+(?:[\.\-]\d+)*\}?|пункт)")


def doc_kind(name: Column, registration: Column) -> Column:
    """Kind by words of the name, else of the registration; ``unknown`` if neither tells."""

    def of(c: Column) -> Column:
        out = F.when(F.lit(False), "")
        for kind, pattern in fixed.DOC_KINDS:
            out = out.when(F.upper(c).rlike(pattern), kind)
        return out

    return F.coalesce(of(name), of(registration), F.lit("unknown"))


def doc_kind_label(kind: Column) -> Column:
    """The label of a kind; an unknown kind is an error."""
    labels = F.create_map(*(F.lit(x) for kv in fixed.DOC_KIND_LABELS.items() for x in kv))
    label = F.try_element_at(labels, strip(kind))
    return F.when(label.isNotNull(), label).otherwise(F.raise_error(F.concat(F.lit("unknown document kind: "), F.coalesce(kind, F.lit("null")))))


def doc_number(registration: Column, name: Column, kind: Column) -> Column:
    """A standard's number, a number after its sign, or a law's code. Standards and laws are looked for in the name, and in the registration only if there is no name."""
    named = first_filled(name, registration)
    standard = F.regexp_extract(named, fixed.STANDARD_NUMBER, 1)
    law = F.upper(F.regexp_replace(F.regexp_extract(named, fixed.LAW_CODE, 1), r"(?U)\s+", ""))
    return first_filled(F.when(kind == "gost", standard), F.regexp_extract(F.coalesce(registration, F.lit("")), fixed.ANY_NUMBER, 1), standard, law)


def doc_date(registration: Column) -> Column:
    return F.regexp_extract(registration, fixed.DOC_DATE, 1)


def authority(registration: Column) -> Column:
    low = F.lower(F.coalesce(registration, F.lit("")))
    body = F.lit(False)
    for mark in fixed.STANDARDS_BODY_MARKS:
        body = body | low.contains(mark)
    return (
        F.when(low.contains(fixed.GOVERNMENT_MARK), fixed.GOVERNMENT)
        .when(body, fixed.STANDARDS_BODY)
        .when(low.rlike(fixed.ENERGY_MARK), fixed.RULES_AUTHORITY)
        .otherwise(strip(F.regexp_extract(F.coalesce(registration, F.lit("")), fixed.MINISTRY, 1)))
    )


def canonical_authority(name: Column) -> Column:
    """The full form of a known short form; else the name itself."""
    a = strip(name)
    low = F.lower(a)
    out = F.when(a == "", "")
    for short, full in fixed.AUTHORITY_PREFERRED.items():
        out = out.when(a == short, full)
    for alias, full in fixed.AUTHORITY_ALIASES.items():
        out = out.when(low.contains(alias), full)
    for m in sorted(fixed.MINISTRIES, key=len, reverse=True):
        out = out.when(low.contains(m.lower()) | F.contains(F.lit(m.lower()), low), m)
    return out.otherwise(a)


def payload_authority(stated: Column, registration: Column, approving: Column, kind: Column) -> Column:
    """Stated, else extracted from the registration or the approving act, else the default of the kind."""
    defaults = F.create_map(*(F.lit(x) for kv in fixed.AUTHORITY_BY_LABEL.items() for x in kv))
    default = F.coalesce(F.try_element_at(defaults, doc_kind_label(kind)), F.when(kind == "pue", fixed.RULES_AUTHORITY), F.lit(""))
    return first_filled(canonical_authority(stated), canonical_authority(authority(registration)), canonical_authority(authority(approving)), default)


def normalize_catalog_text(text: Column) -> Column:
    """Lower case, ё as е, words and single spaces only."""
    return squeeze(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), r"(?U)[^\w\s]+", " "))


def extract_order_numbers(*texts: Column) -> Column:
    """All order numbers, each once, by text, pattern and place."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(p), 1) for t in texts for p in fixed.ORDER_NUMBER)))


def point_number_hint(query: Column) -> Column:
    q = F.coalesce(query, F.lit(""))
    return strip(first_filled(F.regexp_extract(q, fixed.POINT_HINT, 1), F.regexp_extract(q, fixed.POINT_HINT, 2)))


def acronym(name: Column) -> Column:
    """Initials of the first six words that are longer than two letters; '' for fewer than two such words."""
    words = F.filter(F.regexp_extract_all(name, F.lit("[A-Za-zА-Яа-я0-9]+"), 0), lambda w: F.length(w) > 2)
    return let(words, lambda w: F.when(F.size(w) < 2, "").otherwise(F.lower(F.array_join(F.transform(F.slice(w, 1, 6), lambda x: F.left(x, F.lit(1))), ""))))


def aliases(name: Column, filename: Column) -> Column:
    """Names under which a document may be asked for, each once."""
    numbers = F.flatten(F.transform(extract_order_numbers(name, filename), lambda n: F.array(F.concat(F.lit("приказ "), n), n)))
    short = lambda n: let(F.split(normalize_catalog_text(name), " "), lambda w: F.when(F.size(w) >= n, F.array_join(F.slice(w, 1, n), " ")).otherwise(""))
    out = F.concat(F.array(normalize_catalog_text(name), normalize_catalog_text(filename), acronym(name)), numbers, F.array(short(4), short(6)))
    return F.filter(F.array_distinct(out), lambda a: a != "")


def token_roots(text: Column) -> Column:
    """Stems of the words longer than three letters: without their last two letters, four at least."""
    words = F.filter(F.split(normalize_catalog_text(text), " "), lambda w: F.length(w) > 3)
    return F.transform(words, lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 2)))


def alias_overlap(query: Column, alias: Column) -> Column:
    """Share of the alias's stems that the query contains; 0 for fewer than two stems."""
    return let(token_roots(alias), lambda r: F.when(F.size(r) < 2, 0.0).otherwise(F.size(F.filter(r, lambda x: F.contains(query, x))) / F.size(r)))


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words of four letters or more that the text contains."""
    words = F.filter(F.split(query, " "), lambda w: F.length(w) >= 4)
    return let(words, lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.filter(w, lambda x: F.contains(text, x))) / F.size(w)))


def search_tokens(text: Column) -> Column:
    """Distinct lower-cased words, as a full-text index keeps them."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+"), lambda t: t != ""))
