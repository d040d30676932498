"""The runtime for tables of questions: requests, routing, tools, fusion, and what came of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..sources.tables import replace_json, staged
from . import answers, fusion, retrieval, understanding
from . import predicates as P

_NONE = "array<string>"
#: Runs of a failing tool for each halving of its questions, after which the tool counts as broken.
RUNS = 8


def requests(questions: DataFrame, profile: str = "balanced", limit: int = 10) -> DataFrame:
    """qid, query, filters, limit, profile, mode, trace_id and tool_queries of questions of which any column but qid may be missing or null.

    A question's own profile and limit go before the defaults; a limit of 0 or less means that of the profile. The
    trace id is the first of trace_id, id, name and qid that is filled.
    """
    have = set(questions.columns)
    own = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    named = F.coalesce(own("profile"), F.lit(profile))
    name = F.when(named.isin(*fixed.PROFILES), named).otherwise("balanced")
    default = F.element_at(F.create_map(*(F.lit(x) for k, v in fixed.PROFILES.items() for x in (k, v["limit"]))), name)
    return questions.select(
        "qid", T.strip(F.coalesce(own("query"), F.lit(""))).alias("query"), F.coalesce(own("filters", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>")).alias("filters"),
        P.clamp_limit(F.coalesce(own("limit", "int"), F.lit(limit)), default).alias("limit"), name.alias("profile"), F.coalesce(own("mode"), F.lit("evidence")).alias("mode"),
        T.first_filled(own("trace_id"), own("id"), own("name"), F.col("qid").cast("string")).alias("trace_id"), F.coalesce(own("tool_queries", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>")).alias("tool_queries"),
    )


def with_plans(asked: DataFrame, plans: DataFrame) -> DataFrame:
    """Requests under their query plans: the resolved document and point become filters, and each selected tool has its own queries."""
    resolved = plans.select("qid", F.get("resolved_doc_names", F.lit(0)).alias("resolved_name"))
    own = F.map_filter(F.create_map(*(x for t in fixed.TOOLS for x in (F.lit(t), F.when(F.array_contains("selected_tools", t), F.col(f"{t}_queries"))))), lambda _, v: v.isNotNull())
    return understanding.apply_resolution(asked, resolved).drop("tool_queries").join(plans.select("qid", own.alias("tool_queries")), "qid", "left").withColumn("tool_queries", F.coalesce("tool_queries", F.create_map().cast("map<string,array<string>>")))


def _profile_has(tool: str) -> Column:
    return F.col("profile").isin(*(k for k, v in fixed.PROFILES.items() if tool in v["tools"]))


def routed(asked: DataFrame) -> DataFrame:
    """Requests with ``plan``, the tools to run (array of structs tool, queries, reason), and ``notes``.

    A plan made beforehand (tool_queries) goes first, as far as the profile has its tools; without one, or if nothing of
    it can run, the tools are those that the query and the filters call for. A tool without queries of its own takes
    the question's; a point lookup by its filters needs none.
    """
    none = F.array().cast(_NONE)
    query, scope = F.col("query") != "", P.is_point_lookup(F.col("filters"))
    whole = F.when(query, F.array("query")).otherwise(none)
    step = lambda tool, queries, reason: F.struct(F.lit(tool).alias("tool"), queries.alias("queries"), F.lit(reason).alias("reason"))

    def prepared(tool: str) -> Column:
        own = F.filter(F.transform(F.col("tool_queries")[tool], T.strip), lambda x: x != "")
        queries = F.when(F.size(own) > 0, own).otherwise(whole)
        runs = (F.size(queries) > 0) | scope if tool == "point" else F.size(queries) > 0
        return F.when(F.col("tool_queries")[tool].isNotNull() & _profile_has(tool) & runs, step(tool, queries, f"prepared query plan selected {tool}"))

    direct = {"point": (scope, "stable point filters present"), "payload": (query | scope, "text or scoped payload lookup"), "vector": (query, "semantic vector lookup for non-empty query")}
    out = asked.withColumns({
        "prepared": F.array_compact(F.array(*map(prepared, fixed.TOOLS))),
        "direct": F.array_compact(F.array(*(F.when(_profile_has(t) & when, step(t, whole, reason)) for t, (when, reason) in direct.items()))),
    })
    planned = F.size("tool_queries") > 0
    used = planned & (F.size("prepared") > 0)
    off = [F.when(planned & F.col("tool_queries")[t].isNotNull() & ~_profile_has(t), F.concat(F.lit(f"prepared tool {t} disabled by profile "), "profile")) for t in fixed.TOOLS]
    notes = F.array_compact(F.array(
        *off, F.when(planned & ~used, "prepared query plan produced no runnable tools; using deterministic routing"),
        F.when(~used & ~query & ~scope, "runtime requires a non-empty query or stable point filters").when(~used & (F.size("direct") == 0), "router produced an empty tool plan for the given request and profile"),
    ))
    return out.withColumns({"plan": F.when(used, F.col("prepared")).otherwise(F.col("direct")), "notes": notes}).drop("prepared", "direct")


def run_tools(planned: DataFrame, tools: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(hits, runs) of routed questions.

    ``tools`` gives for each name a function from (qid, query, filters, limit) to hits (qid, rank, score and the chunk's
    columns). Every query of a question is a row of its own, and a tool sees all of them at once; several lists of one
    question are merged. Questions that a tool fails for are told, and the others keep their hits (see ``isolated``);
    ``runs`` has qid, tool, ran and warning.
    """
    spark = planned.sparkSession
    steps = staged(planned.select("qid", "filters", "limit", F.posexplode("plan").alias("priority", "step")).select("qid", "filters", "limit", "priority", F.col("step.tool").alias("tool"), F.col("step.queries").alias("queries")))
    hits, runs = [], []
    for name in (r["tool"] for r in steps.select("tool").distinct().orderBy("tool").collect()):  # as many as there are tools
        own = steps.where(F.col("tool") == name)
        # A point lookup by filters alone runs once, with no query.
        needs = F.when((F.size("queries") == 0) & (F.col("tool") == "point"), F.array(F.lit(""))).otherwise(F.col("queries"))
        each = own.select("qid", "filters", "limit", F.posexplode(needs).alias("query_no", "query"))
        key = each.select(F.struct("qid", "query_no").alias("qid"), "query", "filters", "limit")
        skipped = F.when(F.size(needs) == 0, F.lit(f"{name} skipped: empty query list"))
        if name not in tools:
            runs.append(own.select("qid", "tool", "priority", F.lit(False).alias("ran"), F.lit(f"unknown runtime tool: {name}").alias("warning")))
            continue
        found, failed = isolated(tools[name], key)
        for part in found:
            rest = [c for c in part.columns if c not in ("qid", "tool", "rank", "score")]
            hits.append(part.select(F.col("qid.qid").alias("qid"), F.lit(name).alias("tool"), "rank", "score", *rest, F.col("qid.query_no").alias("query_no")))
        told = own.withColumn("error", F.lit(None).cast("string"))
        if failed:
            told = own.join(reduce(DataFrame.unionByName, failed), "qid", "left")
        warning = F.coalesce(F.concat(F.lit(f"{name} failed: "), F.col("error")), skipped)
        runs.append(told.select("qid", "tool", "priority", warning.isNull().alias("ran"), warning.alias("warning")))
    nothing = steps.select("qid", "tool", "priority", F.lit(False).alias("ran"), F.lit(None).cast("string").alias("warning")).limit(0)
    empty = spark.createDataFrame([], "tool string, rank int, score double, chunk_id string, doc_name string, point_number string, text string, query_no int").join(planned.select("qid").limit(0))
    merged = retrieval.merge_query_results(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), hits)) if hits else empty
    return merged.drop("query_no"), reduce(DataFrame.unionByName, runs, nothing)


def isolated(tool: Callable[[DataFrame], DataFrame], key: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Hits of all questions that a tool can answer, and (qid, error) of the others.

    All questions run at once. If that fails, they are halved by a hash of their qid, again and again, until what fails
    is one question: the others keep their hits. A few bad questions among n take some 2 log2 n runs each. After
    RUNS * log2 n runs the tool itself is taken to be broken, and what has not run yet has its error.
    """

    def run(part: DataFrame) -> DataFrame:
        return staged(retrieval.with_item_fields(tool(part)))

    half = lambda level, rest: F.pmod(F.xxhash64("qid.qid"), F.lit(1 << level)) == rest
    found, failed, waiting, left, error = [], [], [(0, 0)], 1, ""
    while waiting:
        level, rest = waiting.pop(0)
        part = key.where(half(level, rest)) if level else key
        if left:
            try:
                found.append(run(part))
                left -= 1 if level else 0
                continue
            except Exception as e:  # a tool's own error, whatever it is, must not end the others
                error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            ids = part.select(F.col("qid.qid").alias("qid")).distinct()
            n = len(ids.limit(2).collect()) if level else ids.count()
            left = left - 1 if level else RUNS * max(1, n.bit_length())
            if n > 1 and level < 62:
                waiting += [(level + 1, rest), (level + 1, rest + (1 << level))]
                continue
        failed.append(part.select(F.col("qid.qid").alias("qid"), F.lit(error).alias("error")).distinct())
    return found, failed


def run_runtime(asked: DataFrame, tools: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(items, report) of requests.

    Where the profile fuses and two tools or more have run, even without hits, the items are the fused list; else they
    are the first tool's hits, in the order of tools. The report has, for each question, the selected tools and reasons,
    tools_succeeded, items_returned, fusion, empty_reason and warnings.
    """
    planned = staged(routed(asked))
    hits, runs = run_tools(planned, tools)
    hits = staged(hits)
    hybrid = F.col("profile").isin(*(k for k, v in fixed.PROFILES.items() if v["hybrid"]))
    ran = runs.groupBy("qid").agg(F.count_if("ran").alias("tools_run"), F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("priority", "warning")))).alias("failed"))
    state = staged(planned.join(ran, "qid", "left").withColumn("fused", hybrid & (F.coalesce("tools_run", F.lit(0)) > 1)))
    limits = state.select("qid", "limit", "fused")
    in_hybrid, alone = (hits.join(limits.where(c).drop("fused"), "qid") for c in ("fused", "NOT fused"))
    shown = [c for c in hits.columns if c not in ("qid", "tool", "rank", "score")]
    fused = fusion.fused_items(in_hybrid.drop("limit"), fusion.reciprocal_rank_fusion(in_hybrid, limit="limit")).drop("source_ranks")
    items = fused.select("qid", "tool", "rank", "score", *shown).unionByName(fusion.first_tool(alone, "limit").select("qid", "tool", "rank", "score", *shown))
    items = staged(items)
    n = items.groupBy("qid").agg(F.count("*").alias("items_returned"))
    ok = hits.groupBy("qid").agg(F.count_distinct("tool").alias("tools_succeeded"))
    got = F.coalesce("items_returned", F.lit(0))
    report = state.join(n, "qid", "left").join(ok, "qid", "left").select(
        "qid", "trace_id", "profile", "mode", F.transform("plan", lambda p: p["tool"]).alias("selected_tools"), F.transform("plan", lambda p: F.concat_ws(": ", p["tool"], p["reason"])).alias("routing_reasons"),
        F.size("plan").alias("tools_planned"), F.coalesce("tools_succeeded", F.lit(0)).cast("int").alias("tools_succeeded"), got.cast("int").alias("items_returned"), F.when(F.col("fused"), "hybrid_rrf").otherwise("").alias("fusion"),
        F.when(got > 0, "").when(F.size("plan") == 0, "empty_tool_plan").otherwise("no_runtime_matches").alias("empty_reason"),
        F.concat("notes", F.coalesce(F.transform("failed", lambda x: x["warning"]), F.array().cast(_NONE))).alias("warnings"),
    )
    return items, report


def compare_tools(asked: DataFrame, tools: Mapping[str, Callable[[DataFrame], DataFrame]], pipelines: tuple[str, ...] = (*fixed.TOOLS, "hybrid")) -> tuple[DataFrame, DataFrame]:
    """(hits, runs): every request through every one of ``pipelines``, whatever it asks for; hybrid fuses the others' lists.

    A pipeline that fails has no hits and a warning in ``runs``; the others are not disturbed.
    """
    own = [t for t in pipelines if t != "hybrid"]
    plan = F.array(*(F.struct(F.lit(t).alias("tool"), F.array("query").alias("queries"), F.lit("compared").alias("reason")) for t in own))
    hits, runs = run_tools(asked.withColumn("plan", plan), tools)
    if "hybrid" not in pipelines:
        return hits, runs
    hits = staged(hits)
    limited = hits.join(asked.select("qid", "limit"), "qid")
    fused = fusion.fused_items(hits, fusion.reciprocal_rank_fusion(limited, limit="limit")).drop("source_ranks")
    return hits.unionByName(fused.select(hits.columns)), runs


def run_pipeline(questions: DataFrame, tools: Mapping[str, Callable[[DataFrame], DataFrame]], *, profile: str = "balanced", limit: int = 10, reranker: str = "passthrough") -> DataFrame:
    """(qid, answer, citations, items_returned, reranked_items, warnings): questions through the runtime, a reranker and the evidence's own words.

    A question's ``reranker`` (passthrough or score), profile and limit go before the defaults. Citations are the
    evidence's chunks that have an id, checked like any others.
    """
    asked = requests(questions, profile, limit)
    items, report = run_runtime(asked, tools)
    named = F.coalesce(F.col("reranker"), F.lit(reranker)) if "reranker" in questions.columns else F.lit(reranker)
    by_score = items.join(questions.select("qid", (named == "score").alias("by_score")), "qid")
    # Places of both orders; each question takes its own.
    places = fusion.score_rerank(by_score).withColumn("rank", F.when(F.col("by_score"), F.col("rerank")).otherwise(F.col("rank"))).drop("rerank", "by_score")
    evidence = staged(places)
    cited = answers.validate_citations(evidence, evidence.where(F.coalesce("chunk_id", F.lit("")) != "").select("qid", (F.col("rank") - 1).alias("pos"), "chunk_id", "doc_name", "point_number"))
    per = cited.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("status") == "valid", F.struct("pos", "chunk_id")))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("pos", "warning")))).alias("w"))
    said = answers.evidence_summary(asked.select("qid", "query"), evidence)
    n = evidence.groupBy("qid").agg(F.count("*").cast("int").alias("reranked_items"))
    none = F.array().cast(_NONE)
    some = F.coalesce("reranked_items", F.lit(0))
    return said.join(report.select("qid", "items_returned", F.col("warnings").alias("own")), "qid").join(n, "qid", "left").join(per, "qid", "left").select(
        "qid", "answer", F.coalesce(F.transform("c", lambda x: x["chunk_id"]), none).alias("citations"), "items_returned", some.alias("reranked_items"),
        F.concat("own", F.when(some == 0, F.array(F.lit("no evidence items available for final answer"))).otherwise(none), F.coalesce(F.transform("w", lambda x: x["warning"]), none)).alias("warnings"))


def ingest_summary(docs: DataFrame) -> DataFrame:
    """documents_total, documents_processed_ok, documents_failed and documents_with_read_warnings of read documents (paragraphs, read_error)."""
    ok = F.coalesce(F.size("paragraphs"), F.lit(0)) > 0
    return docs.agg(F.count("*").alias("documents_total"), F.count_if(ok).alias("documents_processed_ok"), F.count_if(~ok).alias("documents_failed"), F.count_if(F.coalesce("read_error", F.lit("")) != "").alias("documents_with_read_warnings"))


def save_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines in place of the one before, which stays if the write fails."""
    replace_json(report, path)
