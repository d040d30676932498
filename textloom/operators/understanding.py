"""Query understanding: catalog candidates, document resolution and tool routing, for tables of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.tables import staged
from .matching import alike as alike_strings
from .matching import containing, sharing_tokens

#: Confidence and lead over the second candidate that a resolved document needs.
LEAST_CONFIDENCE, LEAST_GAP = 0.55, 0.08


def catalog(docs: DataFrame, name: str = "doc_name", filename: str = "filename", *, doc_id: str | None = None, order: str | None = None) -> DataFrame:
    """One row for each document name: doc_name, filename, aliases, order_numbers and doc_norm.

    With ``order``, a column that says which row comes first, names, files and ids are stripped, each name has the file
    and ``doc_id`` of its first row, and a catalog_id: its id, or doc_ and the number of the name in the order of first
    rows. Without it, a name has its smallest file. Only names are numbered in one place, not rows.
    """
    clean = (lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))) if order else (lambda c: F.coalesce(c, F.lit("")))
    rows = docs.where(clean(name) != "").select((clean(name) if order else F.col(name)).alias("doc_name"), clean(filename).alias("filename"), (clean(doc_id) if doc_id else F.lit("")).alias("doc_id"), *([F.col(order).alias("__order")] if order else []))
    more = []
    if order:
        first = rows.groupBy("doc_name").agg(F.min(F.struct("__order", "filename", "doc_id")).alias("f")).select("doc_name", "f.*")
        number = F.row_number().over(Window.orderBy("__order", "doc_name")).cast("string")
        first = first.withColumn("catalog_id", F.coalesce(F.nullif("doc_id", F.lit("")), F.concat(F.lit("doc_"), number)))
        more = ["catalog_id", "doc_id"]
    else:
        first = rows.groupBy("doc_name").agg(F.min("filename").alias("filename"))
    return first.select("doc_name", "filename", T.aliases(F.col("doc_name"), F.col("filename")).alias("aliases"), T.extract_order_numbers(F.col("doc_name"), F.col("filename")).alias("order_numbers"), T.normalize_catalog_text(F.col("doc_name")).alias("doc_norm"), *more)


def _alias_score(query: Column, aliases: Column, ratios: Column | None) -> Column:
    """The first alias that is named or overlaps ends the search; those before it count if they are alike."""

    def step(s: Column, i: Column) -> Column:
        alias = F.get(aliases, i)
        named = F.contains(query, alias) | F.contains(alias, query)
        overlap = T.alias_overlap(query, alias)
        hit = F.when(named, F.lit(0.35)).when(overlap >= 0.7, 0.6 * overlap)
        alike = F.get(ratios, i) if ratios is not None else F.lit(0.0)
        more = F.coalesce(hit, F.when(alike >= 0.72, 0.25 * alike), F.lit(0.0))
        return F.when(s["done"], s).otherwise(F.struct((s["score"] + more).alias("score"), hit.isNotNull().alias("done")))

    start = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("done"))
    return F.when(F.size(aliases) > 0, F.aggregate(F.sequence(F.lit(0), F.size(aliases) - 1), start, step)["score"]).otherwise(0.0)


def catalog_candidates(questions: DataFrame, entries: DataFrame, limit: int = 8, alike: bool = True) -> DataFrame:
    """(qid, doc_name, score, rank): the best-scored entries of each question (qid, query); scores above 0 only.

    Rules look for one text inside another, for equal numbers, or, with ``alike``, for names and aliases that are
    similar; only pairs for which one of these holds are scored. A question with an ``explicit_doc_name``, if there is
    such a column, has one candidate: the first entry with that name, or with a name that contains it in any case, with
    score 1, else that name itself with score 0.2.
    """
    text = F.coalesce("query", F.lit(""))
    explicit = T.strip(F.coalesce("explicit_doc_name", F.lit(""))) if "explicit_doc_name" in questions.columns else F.lit("")
    rows = questions.select("qid", text.alias("query"), explicit.alias("explicit"))
    q = rows.where("explicit = ''").select("qid", "query", T.normalize_catalog_text(F.col("query")).alias("q"), T.extract_order_numbers(F.col("query")).alias("numbers")).where("q <> ''")
    pairs = _pairs(q, entries)
    query, doc = F.col("q"), F.col("doc_norm")
    score = F.when(F.contains(doc, query), 0.45).otherwise(0.0) + F.when(F.contains(query, doc), 0.35).otherwise(0.0)
    ratios = None
    if alike:
        names, aliases = _similar(q, entries)
        pairs = pairs.union(names.select("qid", "doc_name")).union(aliases.select("qid", "doc_name")).distinct()
        score, ratios = score + F.coalesce(0.4 * F.col("ratio"), F.lit(0.0)), F.transform("aliases", lambda a: F.coalesce(F.col("ratios")[a], F.lit(0.0)))
    pairs = staged(pairs).join(q, "qid").join(entries, "doc_name")
    if alike:
        pairs = pairs.join(names, ["qid", "doc_name"], "left").join(aliases, ["qid", "doc_name"], "left")
    score = score + _alias_score(query, F.col("aliases"), ratios) + 0.5 * F.size(F.array_intersect("numbers", "order_numbers"))
    for short, phrases in fixed.KNOWN_ALIASES.items():
        score = score + F.when(query.contains(short) & reduce(lambda a, b: a | b, (doc.contains(p) for p in phrases)), 0.55).otherwise(0.0)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_name")
    found = pairs.select("qid", "doc_name", F.round(score, 6).alias("score")).where("score > 0")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked if "explicit_doc_name" not in questions.columns else ranked.union(_explicit(rows, entries))


def _similar(q: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, doc_name, ratio) of names and (qid, doc_name, ratios) of aliases, a map, that are similar enough to count."""
    names = staged(alike_strings(q.select(F.col("q").alias("asked")), entries.select(F.col("doc_norm").alias("text")), 0.55))
    aliases = staged(alike_strings(q.select(F.col("q").alias("asked")), entries.select(F.explode("aliases").alias("text")), 0.72))
    own = q.select("qid", F.col("q").alias("asked"))
    by_name = names.join(entries.select("doc_name", F.col("doc_norm").alias("text")), "text").join(own, "asked").select("qid", "doc_name", "ratio")
    each = entries.select("doc_name", F.explode(F.array_distinct("aliases")).alias("text"))
    by_alias = aliases.join(each, "text").join(own, "asked").groupBy("qid", "doc_name").agg(F.map_from_entries(F.collect_list(F.struct("text", "ratio"))).alias("ratios"))
    return by_name, by_alias


def _explicit(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The one candidate of each question that names its document."""
    asked = rows.where("explicit <> ''").select("qid", "explicit", F.upper("explicit").alias("needle"))
    names = entries.select("doc_name", F.upper("doc_name").alias("text"))
    found = containing(asked.select("needle"), names.select("text")).join(names, "text").groupBy("needle").agg(F.min("doc_name").alias("first"))
    exact = entries.select(F.col("doc_name").alias("explicit"), F.col("doc_name").alias("same"))
    both = asked.join(found, "needle", "left").join(exact, "explicit", "left")
    # Of the entries that fit, the first counts, whether it has the name itself or a longer one.
    name = F.least("first", "same")
    return both.select("qid", F.coalesce(name, "explicit").alias("doc_name"), F.when(name.isNotNull(), 1.0).otherwise(0.2).alias("score"), F.lit(1).alias("rank"))


def _pairs(q: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, doc_name) of all pairs of which a rule may score above 0."""
    names = entries.select("doc_name", F.explode(F.array_distinct(F.concat(F.array("doc_norm"), "aliases"))).alias("alias")).where("alias <> ''")
    alias, query = names.select(F.col("alias").alias("needle")), q.select(F.col("q").alias("text"))
    roots = names.select(F.col("alias").alias("asked"), T.token_roots(F.col("alias")).alias("tokens")).where(F.size("tokens") >= 2)
    by_name = containing(alias, query).select(F.col("needle").alias("alias"), F.col("text").alias("q"))
    by_name = by_name.union(containing(q.select(F.col("q").alias("needle")), names.select(F.col("alias").alias("text"))).select("text", "needle")).union(sharing_tokens(roots, query, 0.7).select("asked", "text")).distinct()
    out = by_name.join(names, "alias").join(q.select("qid", "q"), "q").select("qid", "doc_name")
    number = entries.select("doc_name", F.explode("order_numbers").alias("number"))
    out = out.union(q.select("qid", F.explode("numbers").alias("number")).join(number, "number").select("qid", "doc_name"))
    known = F.array_compact(F.array(*(F.when(F.col("q").contains(short), short) for short in fixed.KNOWN_ALIASES)))
    meant = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.col("doc_norm").contains(p) for p in phrases)), short) for short, phrases in fixed.KNOWN_ALIASES.items())))
    return out.union(q.select("qid", F.explode(known).alias("short")).join(entries.select("doc_name", F.explode(meant).alias("short")), "short").select("qid", "doc_name")).distinct()


def resolve_document(candidates: DataFrame) -> DataFrame:
    """(qid, top_name, confidence, ambiguous, resolved_name) of ranked candidates.

    Two candidates that lie close make a question ambiguous; then, or with little confidence, no name is resolved.
    """
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    two = candidates.where("rank <= 2").groupBy("qid").agg(at(1, "doc_name").alias("top_name"), at(1, "score").alias("top"), at(2, "score").alias("second"))
    ambiguous = F.coalesce(F.col("top") - F.col("second") < LEAST_GAP, F.lit(False))
    confidence = F.least(F.lit(1.0), F.col("top"))
    return two.select("qid", "top_name", confidence.alias("confidence"), ambiguous.alias("ambiguous"), F.when(~ambiguous & (confidence >= LEAST_CONFIDENCE), F.col("top_name")).alias("resolved_name"))


def apply_resolution(questions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Questions whose filters have the resolved name (over the asker's) and the point number that the query hints at."""
    hint = T.point_number_hint(F.col("query"))
    both = questions.join(resolved.select("qid", "resolved_name"), "qid", "left").withColumn("filters", F.coalesce("filters", F.create_map().cast("map<string,array<string>>")))
    add = F.map_filter(
        F.create_map(F.lit("doc_name"), F.array("resolved_name"), F.lit("point_number"), F.array(F.nullif(F.when(F.col("filters")["point_number"].isNull(), hint), F.lit("")))),
        lambda _, v: F.get(v, F.lit(0)).isNotNull(),
    )
    rest = F.map_filter("filters", lambda k, _: ~F.array_contains(F.map_keys(add), k))
    return both.withColumn("filters", F.map_concat(rest, add)).drop("resolved_name")


def route_tools(questions: DataFrame) -> DataFrame:
    """(qid, tools): point for a stable id or scope, payload for a query or scope, vector for a query; none for neither."""
    has = lambda k: F.coalesce(F.size(F.col("filters")[k]) > 0, F.lit(False))
    scope = has("chunk_id") | has("point_identity_key") | has("point_number") | has("heading_path_text")
    query = T.strip(F.coalesce("query", F.lit(""))) != ""
    return questions.select("qid", F.array_compact(F.array(F.when(scope, "point"), F.when(query | scope, "payload"), F.when(query, "vector"))).alias("tools"))
