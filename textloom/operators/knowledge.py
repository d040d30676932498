"""Document candidates from a knowledge table, for tables of questions.

Knowledge is four tables: documents (doc_id, doc_name, annotation), terms (label), abbreviations (abbreviation,
expansion) and topics (phrase, doc_names, not_doc_names: parts of document names). Each has a ``position``, the order
in which its rows count. All rules look for one text inside another, so containment joins find the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.tables import staged
from .matching import alike as alike_strings
from .matching import containing, sharing_tokens


def knowledge_documents(annotations: DataFrame, openings: DataFrame) -> DataFrame:
    """doc_id, doc_name, annotation and position of annotated documents (doc_id, annotation, position); names come from ``openings`` (doc_id, doc_name)."""
    names = openings.where(F.coalesce("doc_id", F.lit("")) != "").groupBy("doc_id").agg(F.max_by(T.strip(F.coalesce("doc_name", F.lit(""))), "position").alias("doc_name"))
    own = annotations.select(T.strip(F.coalesce("doc_id", F.lit(""))).alias("doc_id"), shortened(F.coalesce("annotation", F.lit("")), 500).alias("annotation"), "position").where("doc_id <> ''")
    return own.join(names, "doc_id", "left").select("doc_id", F.coalesce("doc_name", F.lit("")).alias("doc_name"), "annotation", "position")


def shortened(text: Column, most: int) -> Column:
    """Text with single spaces, cut to ``most`` characters of which the last is an ellipsis."""
    return T.let(T.squeeze(text), lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, F.lit(1), F.lit(most - 1))), F.lit("…"))).otherwise(t))


def _first(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy("position").limit(most)


def knowledge_abbreviations(rows: DataFrame, most: int = fixed.MOST_ABBREVIATIONS) -> DataFrame:
    """abbreviation, expansion and position: short abbreviations of letters, digits, dots and hyphens with an expansion (the first of values) of eight characters or more; the first ``most``."""
    short = T.strip(F.coalesce("abbreviation", F.lit("")))
    out = rows.select(short.alias("abbreviation"), shortened(F.coalesce(F.get("values", F.lit(0)), F.lit("")), 180).alias("expansion"), "position")
    return _first(out.where(F.length("abbreviation").between(1, 12) & F.col("abbreviation").rlike(fixed.ABBREVIATION) & (F.length("expansion") >= 8)), most)


def knowledge_terms(rows: DataFrame, most: int = fixed.MOST_TERMS) -> DataFrame:
    """label and position of terms of four characters or more that don't begin with a digit and name no table or standard; the first ``most``."""
    label = F.col("label")
    out = rows.select(shortened(F.coalesce("label", F.lit("")), 120).alias("label"), "position").where((F.length("label") >= 4) & ~label.rlike(r"(?U)^\d"))
    return _first(reduce(lambda d, mark: d.where(~label.contains(mark)), fixed.NO_TERM, out), most)


def knowledge_graph_abbreviations(rows: DataFrame, most: int = fixed.MOST_GRAPH_ABBREVIATIONS) -> DataFrame:
    """label and position of the labels of up to 20 characters; the first ``most``."""
    return _first(rows.select(T.strip(F.coalesce("label", F.lit(""))).alias("label"), "position").where(F.length("label").between(1, 20)), most)


def bundle_counts(documents: DataFrame, abbreviations: DataFrame, terms: DataFrame, graph_abbreviations: DataFrame, topics: DataFrame) -> DataFrame:
    """(part, rows) of a knowledge bundle."""
    parts = {"documents": documents, "abbreviations": abbreviations, "terms": terms, "graph_abbreviations": graph_abbreviations, "topic_aliases": topics}
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("rows")).select(F.lit(k).alias("part"), "rows") for k, d in parts.items()))


def _tokens(text: Column, least: int = 4) -> Column:
    return F.filter(F.split(text, " "), lambda t: F.length(t) >= least)


def _named(pairs: DataFrame, name: str, text: str) -> DataFrame:
    """Pairs of ``containing`` under the names of the columns that they are joined with."""
    return pairs.select(F.col("needle").alias(name), F.col("text").alias(text))


def _together(*columns: tuple[DataFrame, str], name: str) -> DataFrame:
    """The different values of columns of several tables."""
    return reduce(DataFrame.union, (t.select(F.col(c).alias(name)) for t, c in columns)).distinct()


def _share(asked: DataFrame, name: str, texts: DataFrame, text: str, least: float, inside: DataFrame) -> DataFrame:
    """(name, text, share) of pairs where at least ``least`` of the longer words of one are inside the other."""
    rows = asked.select(F.col(name).alias("asked"), _tokens(F.col(name)).alias("tokens"))
    pairs = sharing_tokens(rows, texts.select(F.col(text).alias("text")), least, inside)
    return pairs.select(F.col("asked").alias(name), F.col("text").alias(text), T.token_overlap(F.col("asked"), F.col("text")).alias("share")).where(F.col("share") >= least)


def _digits(share: Column) -> Column:
    return F.format_string("%.2f", F.bround(share, 2))


def _own_scores(q: DataFrame, d: DataFrame, in_q: DataFrame, in_d: DataFrame, alike: bool) -> DataFrame:
    """Scores of documents by their own names and annotations: qid, document, score and reasons."""
    w = fixed.KNOWLEDGE_SCORES
    parts = [
        ("doc_name_contains_query", _named(in_d, "q", "name").withColumn("part", F.lit(w["doc_name_contains_query"])), None),
        ("query_contains_doc_name", _named(in_q, "name", "q").withColumn("part", F.lit(w["query_contains_doc_name"])), None),
        ("doc_name_token_overlap", _share(q, "q", d, "name", 0.5, in_d), w["doc_name_token_overlap"]),
        ("annotation_contains_query", _named(in_d, "q", "note").withColumn("part", F.lit(w["annotation_contains_query"])), None),
        ("annotation_token_overlap", _share(q, "q", d, "note", 0.45, in_d), w["annotation_token_overlap"]),
    ]
    if alike:
        near = staged(alike_strings(q.select(F.col("q").alias("asked")), d.select(F.col("name").alias("text")), fixed.LEAST_ALIKE))
        parts.append(("fuzzy_doc_name", near.select(F.col("asked").alias("q"), F.col("text").alias("name"), F.col("ratio").alias("share")), w["fuzzy_doc_name"]))
    rows = []
    for i, (reason, pairs, weight) in enumerate(parts):
        value = F.col("part") if weight is None else F.col("share") * weight
        said = F.lit(reason) if weight is None else F.concat(F.lit(f"{reason}:"), _digits(F.col("share")))
        on = "note" if reason.startswith("annotation") else "name"
        rows.append(pairs.select("q", on, F.struct(F.lit(i).alias("i"), value.alias("score"), said.alias("reason")).alias("p")).join(d, on).join(q, "q").select("qid", "doc_id", "p"))
    parts_of = reduce(DataFrame.unionByName, rows).groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts_of.select("qid", "doc_id", F.aggregate("p", F.lit(0.0), lambda s, p: s + p["score"]).alias("score"), F.transform("p", lambda p: p["reason"]).alias("reasons"))


def _topic_parts(topics: DataFrame, column: str) -> DataFrame:
    return topics.select("topic", F.explode(column).alias("part")).select("topic", T.normalize_catalog_text(F.col("part")).alias("part"))


def _topic_documents(topics: DataFrame, d: DataFrame, in_d: DataFrame) -> DataFrame:
    """(topic, doc_id): documents whose name holds one of a topic's parts of names and none of those it excludes."""
    holds = lambda c: _topic_parts(topics, c).join(_named(in_d, "part", "name"), "part").join(d, "name").select("topic", "doc_id").distinct()
    return holds("doc_names").join(holds("not_doc_names"), ["topic", "doc_id"], "left_anti")


def knowledge_candidates(questions: DataFrame, documents: DataFrame, terms: DataFrame, abbreviations: DataFrame, topics: DataFrame, limit: int = 12, alike: bool = False) -> DataFrame:
    """(qid, doc_id, doc_name, annotation, score, reasons, rank): the best documents of each question (qid, query).

    A document counts by its own name and annotation, by a topic or abbreviation that the question names, or by a term
    that both name. The best of these scores counts, with its reasons and those of what was tried after it; equal
    scores go by what was tried first. With ``alike``, a name that is similar to the question counts, too.

    A topic, an abbreviation or a term may stand in any number of documents, and any number of questions may name it. Of
    documents that a question reaches only so, those after the first ``limit`` of the item cannot be among its best:
    they score the same and come later. So only the first are paired with questions, and then all that the best ones
    are reached by is looked up by question and document.
    """
    # What many joins read is written once.
    q = staged(questions.select("qid", T.normalize_catalog_text(F.coalesce("query", F.lit(""))).alias("q")).where("q <> ''"))
    norm = lambda c: T.normalize_catalog_text(F.coalesce(c, F.lit("")))
    d = staged(documents.where(F.coalesce("doc_id", F.lit("")) != "").select("doc_id", F.col("position").alias("place"), norm("doc_name").alias("name"), norm("annotation").alias("note"), T.normalize_catalog_text(F.concat_ws(" ", F.coalesce("doc_name", F.lit("")), F.coalesce("annotation", F.lit("")))).alias("both")))
    t = topics.select(F.col("position").cast("long").alias("topic"), norm("phrase").alias("phrase"), "doc_names", "not_doc_names").where("phrase <> ''")
    words = t.select("topic", F.explode(F.concat(F.array("phrase"), _tokens(F.col("phrase"), 5))).alias("word"))
    a = abbreviations.select(F.col("position").alias("item"), norm("abbreviation").alias("short"), norm("expansion").alias("expansion")).where("length(short) >= 2 AND expansion <> ''").withColumn("head", F.substring("expansion", 1, 40))
    n = terms.select(F.col("position").alias("item"), norm("label").alias("label")).where("length(label) >= 5")
    # All that is looked for in questions, and all that is looked for in documents, in one join each.
    in_q = staged(containing(_together((d, "name"), (words, "word"), (a, "short"), (n, "label"), name="needle"), q.select(F.col("q").alias("text"))))
    parts = reduce(DataFrame.union, (_topic_parts(t, c) for c in ("doc_names", "not_doc_names")))
    tokens = lambda rows, c: rows.select(F.explode(_tokens(F.col(c))).alias("token"))
    in_d = staged(containing(_together((q, "q"), (tokens(q, "q"), "token"), (parts, "part"), (a, "head"), (tokens(a, "expansion"), "token"), (n, "label"), name="needle"), _together((d, "name"), (d, "note"), (d, "both"), name="text")))

    own = staged(_own_scores(q, d, in_q, in_d, alike)).select("qid", "doc_id", "score", "reasons", F.lit(0).alias("family"), F.lit(0).cast("long").alias("item"))
    # What questions name, and which documents hold it: (qid, family, item) and (family, item, doc_id).
    kind = lambda rows, family, item, *more: rows.select(*more, F.lit(family).alias("family"), F.col(item).cast("long").alias("item"))
    by_topic = words.join(_named(in_q, "word", "q"), "word").join(q, "q")
    by_short = a.join(_named(in_q, "short", "q"), "short").join(q, "q")
    by_term = n.join(_named(in_q, "label", "q"), "label").join(q, "q")
    named = staged(reduce(DataFrame.union, (kind(by_topic, 1, "topic", "qid"), kind(by_short, 2, "item", "qid"), kind(by_term, 3, "item", "qid"))).distinct())
    spelled = _named(in_d, "head", "both").join(a, "head").select("item", "both").union(_share(a, "expansion", d, "both", 0.35, in_d).join(a, "expansion").select("item", "both"))
    held = (kind(_topic_documents(t, d, in_d), 1, "topic", "doc_id"), kind(spelled.join(d, "both"), 2, "item", "doc_id"), kind(n.join(_named(in_d, "label", "both"), "label").join(d, "both"), 3, "item", "doc_id"))
    holding = staged(reduce(DataFrame.union, held).distinct().join(d.select("doc_id", "place"), "doc_id"))
    said = lambda rows, what, c, family, item: kind(rows, family, item, F.lit(fixed.KNOWLEDGE_SCORES[what]).alias("score"), F.array(F.concat(F.lit(f"{what}:"), c)).alias("reasons"))
    items = reduce(DataFrame.union, (said(t, "topic_alias", F.col("phrase"), 1, "topic"), said(a, "abbreviation", F.col("short"), 2, "item"), said(n, "term", F.col("label"), 3, "item")))
    of = ["family", "item"]
    first = holding.withColumn("__n", F.row_number().over(Window.partitionBy(*of).orderBy("place", "doc_id"))).where(F.col("__n") <= limit).select(*of, "doc_id")
    pairs = own.where("score > 0").select("qid", "doc_id").union(named.join(first, of).select("qid", "doc_id")).distinct()

    def reached(pairs: DataFrame) -> DataFrame:
        """All that pairs of question and document have in common, with their own scores."""
        shared = pairs.join(named, "qid").join(holding.select(*of, "doc_id"), [*of, "doc_id"]).join(items, of).select("qid", "doc_id", "score", "reasons", *of)
        both = own.join(pairs, ["qid", "doc_id"], "left_semi").unionByName(shared)
        return both.where("score > 0").groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("family", "item", "score", "reasons"))).alias("all"))

    tried = reached(pairs)
    best = F.aggregate(
        F.slice("all", F.lit(2), F.size("all")), F.struct(F.col("all")[0]["score"].alias("score"), F.col("all")[0]["reasons"].alias("reasons")),
        lambda s, x: F.when(x["score"] > s["score"], F.struct(x["score"].alias("score"), x["reasons"].alias("reasons"))).otherwise(F.struct(s["score"].alias("score"), F.array_distinct(F.concat(s["reasons"], x["reasons"])).alias("reasons"))))
    out = tried.select("qid", "doc_id", best.alias("b"), F.col("all")[0]["family"].alias("family"), F.col("all")[0]["item"].alias("item")).join(documents.select("doc_id", "doc_name", "annotation", "position"), "doc_id")
    w = Window.partitionBy("qid").orderBy(F.desc("b.score"), "family", "item", "position")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.select("qid", "doc_id", F.coalesce("doc_name", F.lit("")).alias("doc_name"), F.coalesce("annotation", F.lit("")).alias("annotation"), F.round("b.score", 4).alias("score"), F.col("b.reasons").alias("reasons"), "rank")


def terms_in_queries(questions: DataFrame, terms: DataFrame, abbreviations: DataFrame, topics: DataFrame, limit: int = 12) -> DataFrame:
    """(qid, matched_terms): labels, then phrases, then expansions of abbreviations that a question names, each once, ``limit`` at most; none: an empty list."""
    q = questions.select("qid", T.normalize_catalog_text(F.coalesce("query", F.lit(""))).alias("q"))
    part = lambda rows, key, shown, family: rows.select(F.lit(family).alias("family"), F.col("position").cast("long").alias("item"), T.normalize_catalog_text(F.coalesce(key, F.lit(""))).alias("key"), T.strip(F.coalesce(shown, F.lit(""))).alias("shown"))
    every = part(terms, "label", "label", 0).where("length(key) >= 5").union(part(topics, "phrase", "phrase", 1)).union(part(abbreviations, "abbreviation", "expansion", 2)).where("key <> '' AND shown <> ''")
    hits = every.join(_named(containing(every.select(F.col("key").alias("needle")), q.select(F.col("q").alias("text"))), "key", "q"), "key").join(q, "q").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("family", "item", "shown"))).alias("all"))
    found = hits.select("qid", F.slice(F.array_distinct(F.transform("all", lambda x: x["shown"])), 1, limit).alias("matched"))
    return questions.select("qid").join(found, "qid", "left").select("qid", F.coalesce("matched", F.array().cast("array<string>")).alias("matched_terms"))


def merged_candidates(catalog_candidates: DataFrame, found: DataFrame, catalog: DataFrame) -> DataFrame:
    """(qid, catalog_id, doc_name, score, reasons, annotation, source, rank): candidates of both kinds, one row a name.

    The higher score and the reasons of both count; equal scores go by the catalog's order, then by the knowledge's.
    ``catalog_candidates`` has qid, doc_name, score, rank and may have reasons; ``catalog`` has doc_name and catalog_id.
    """
    none = F.array().cast("array<string>")
    reasons = F.coalesce("reasons", none) if "reasons" in catalog_candidates.columns else none
    c = catalog_candidates.select("qid", "doc_name", F.struct("score", reasons.alias("reasons"), "rank").alias("c"))
    k = found.groupBy("qid", "doc_name").agg(F.min_by(F.struct("score", "reasons", "rank", "doc_id", "annotation"), "rank").alias("k"))
    both = c.join(k, ["qid", "doc_name"], "full").join(catalog.select("doc_name", "catalog_id"), "doc_name", "left")
    score = F.greatest("c.score", "k.score")
    out = both.select(
        "qid", F.coalesce("catalog_id", F.concat(F.lit("knowledge:"), "k.doc_id")).alias("catalog_id"), "doc_name", score.alias("score"),
        F.array_distinct(F.concat(F.coalesce("c.reasons", none), F.coalesce("k.reasons", none))).alias("reasons"), F.coalesce("k.annotation", F.lit("")).alias("annotation"),
        F.when(F.col("k").isNull(), "catalog").when(F.col("c").isNull(), "knowledge").otherwise("catalog+knowledge").alias("source"), F.coalesce("c.rank", F.col("k.rank") + 1_000_000).alias("place"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "place"))).drop("place")
