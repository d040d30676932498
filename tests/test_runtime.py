"""Knowledge candidates, query plans, the runtime and the index."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textloom.functions import vectors
from textloom.functions import text as T
from textloom.operators import answers, evaluation, fusion, indexing, knowledge, matching, metadata, planning, predicates, quality, retrieval, runtime, understanding
from textloom.plans.queries import QUERIES
from textloom.sources import tables

RULES = "Правила устройства электроустановок"
REPAIR = "Инструкция по предотвращению и ликвидации нарушений в работе станций"
REPORT = "Форма акта расследования аварии"


@pytest.fixture(scope="module")
def known(spark):
    docs = [("d1", RULES, "Заземление и наведенное напряжение, защита линий", 0), ("d2", REPAIR, "Порядок действий персонала при аварии", 1), ("d3", REPORT, "Форма для расследования", 2), ("", "no id", "", 3)]
    return {
        "documents": spark.createDataFrame(docs, "doc_id string, doc_name string, annotation string, position long"),
        "terms": spark.createDataFrame([("наведенное напряжение", 0), ("мало", 1)], "label string, position long"),
        "abbreviations": spark.createDataFrame([("ОЗП", "осенне-зимний период работы", 0), ("АРМ", "защита линий", 1)], "abbreviation string, expansion string, position long"),
        "topics": spark.createDataFrame([("ликвидация аварий", ["ликвидации нарушений"], ["расследования"], 0)], "phrase string, doc_names array<string>, not_doc_names array<string>, position long"),
    }


def test_containing_finds_every_pair(spark):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    needles, texts = [say(rng.randint(0, 7)) for _ in range(150)], [say(rng.randint(0, 30)) for _ in range(80)]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows] + [(None,)], f"{c} string")
    got = {(r["needle"], r["text"]) for r in matching.containing(frame(needles, "needle"), frame(texts, "text")).collect()}
    assert got == {(n, t) for n in needles for t in texts if n and t and n in t}
    asked = [(x, [w for w in x.split(" ") if w]) for x in texts]
    pairs = {(r["asked"], r["text"]) for r in matching.sharing_tokens(spark.createDataFrame(asked, "asked string, tokens array<string>"), frame(texts, "text"), 0.5).collect()}
    assert {(x, t) for x, w in asked for t in texts if w and t and 2 * sum(y in t for y in w) >= len(w)} <= pairs


def test_knowledge_candidates(spark, known):
    q = spark.createDataFrame([(1, "Какое наведенное напряжение безопасно?"), (2, "Покажи пункт 9: ликвидация аварий"), (3, ""), (4, None), (5, "что такое АРМ"), (6, "погода")], "qid int, query string")
    got = {}
    for r in knowledge.knowledge_candidates(q, **known, limit=5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r)
    assert got[1][0]["doc_name"] == RULES and got[2][0]["doc_name"] == REPAIR and got[2][0]["score"] == 0.72 and got[2][0]["reasons"] == ["topic_alias:ликвидация аварий"]
    assert REPORT not in [r["doc_name"] for r in got[2][:1]] and got[5][0]["reasons"] == ["abbreviation:арм"] and not {3, 4, 6} & set(got)
    matched = {r["qid"]: r["matched_terms"] for r in knowledge.terms_in_queries(q, known["terms"], known["abbreviations"], known["topics"]).collect()}
    assert matched == {1: ["наведенное напряжение"], 2: ["ликвидация аварий"], 3: [], 4: [], 5: ["защита линий"], 6: []}


def test_query_plans(spark, known):
    catalog = understanding.catalog(spark.createDataFrame([(n, f"{i}.rtf") for i, n in enumerate((RULES, REPAIR, REPORT))], "doc_name string, filename string")).withColumn("catalog_id", F.md5("doc_name"))
    q = spark.createDataFrame([(1, "Какое наведенное напряжение безопасно?"), (2, "Покажи пункт 9: ликвидация аварий"), (3, " "), (4, "погода завтра")], "qid int, query string")
    plans = planning.plan_queries(q, catalog, **known)
    p = {r["qid"]: r for r in plans.collect()}
    assert p[1]["original_query"] == "Какое наведенное напряжение безопасно?" and p[1]["vector_queries"][0] == p[1]["original_query"] and "наведенное напряжение" in p[1]["vector_queries"]
    assert p[2]["point_number_hints"] == ["9"] and p[2]["resolved_doc_names"] == [REPAIR] and p[2]["selected_tools"] == ["point", "payload", "vector"] and p[2]["question_type"] == "point_lookup"
    assert p[3]["resolver"] == "none" and p[3]["selected_tools"] == [] and p[3]["warnings"] == [] and p[4]["warnings"] == ["no document candidates matched the query"]
    asked = runtime.with_plans(runtime.requests(q), plans)
    f = {r["qid"]: r for r in runtime.routed(asked).collect()}
    assert f[2]["filters"] == {"doc_name": [REPAIR], "point_number": ["9"]} and [s["tool"] for s in f[2]["plan"]] == ["point", "payload", "vector"] and f[2]["plan"][0]["queries"] == ["9"]
    assert f[3]["plan"] == [] and f[3]["notes"][-1] == "runtime requires a non-empty query or stable point filters"
    u = {r["qid"]: r["search_query"] for r in planning.understandings(plans).collect()}
    assert u[1] == p[1]["original_query"] and u[3] == ""


def test_tool_queries_are_few_and_start_with_the_question(spark):
    row = spark.createDataFrame([("ask", ["a", "b"], [" one  two", "one two", "", "3", "4", "5", "6"])], "q string, words array<string>, own array<string>")
    t = planning.tool_queries(F.col("q"), F.col("words"), {"vector": F.col("own")})
    assert row.select(*(t[k].alias(k) for k in ("point", "payload", "vector"))).first() == ([], ["ask", "a", "b"], ["ask", "one two", "3", "4"])


HIT = "qid struct<qid:int,query_no:int>, rank int, score double, chunk_id string, doc_name string"


def tool(*chunks):
    """A tool that finds the same chunks for every query."""
    each = F.array(*(F.lit(c) for c in chunks)) if chunks else F.array().cast("array<string>")
    return lambda asked: asked.select("qid", F.posexplode(each).alias("rank", "chunk_id")).select("qid", (F.col("rank") + 1).alias("rank"), F.lit(None).cast("double").alias("score"), "chunk_id", F.lit("doc").alias("doc_name"))


def failing(asked):
    raise RuntimeError("index unavailable")


def run(spark, tools, query="заземление", profile="balanced", filters=None, limit=3):
    q = spark.createDataFrame([(1, query, filters or {}, profile, limit)], "qid int, query string, filters map<string,array<string>>, profile string, limit int")
    items, report = runtime.run_runtime(runtime.requests(q), tools)
    return [r["chunk_id"] for r in items.orderBy("rank").collect()], report.first()


def test_a_failing_tool_does_not_end_the_others(spark):
    items, r = run(spark, {"payload": failing, "vector": tool("ok")})
    assert items == ["ok"] and r["warnings"] == ["payload failed: RuntimeError: index unavailable"] and r["tools_succeeded"] == 1 and r["fusion"] == ""
    late = lambda asked: asked.select("qid", F.lit(1).alias("rank"), F.raise_error(F.lit("late")).cast("double").alias("score"), F.lit("x").alias("chunk_id"))
    items, r = run(spark, {"payload": late, "vector": tool("ok")})
    assert items == ["ok"] and r["warnings"][0].startswith("payload failed:")
    assert run(spark, {"vector": tool("ok")})[1]["warnings"] == ["unknown runtime tool: payload"]


def test_one_bad_question_among_a_thousand(spark):
    runs = []

    def tool(a, bad=(417,)):
        runs.append(1)
        hit = F.when(F.col("qid.qid").isin(*bad), F.raise_error(F.lit("odd filter"))).otherwise(F.lit("c"))
        return a.select("qid", F.lit("payload").alias("tool"), F.lit(1).alias("rank"), F.lit(None).cast("double").alias("score"), hit.alias("chunk_id"))

    step = F.array(F.struct(F.lit("payload").alias("tool"), F.array("q").alias("queries"), F.lit("").alias("reason")))
    planned = spark.range(1000).select(F.col("id").alias("qid"), F.create_map().cast("map<string,array<string>>").alias("filters"), F.lit(5).alias("limit"), F.lit("x").alias("q")).withColumn("plan", step).drop("q")
    hits, told = runtime.run_tools(planned, {"payload": tool})
    assert {r["qid"] for r in hits.collect()} == set(range(1000)) - {417} and len(runs) <= 30
    warned = {r["qid"]: r["warning"] for r in told.collect()}
    assert len(warned) == 1000 and [q for q, w in warned.items() if w] == [417] and "odd filter" in warned[417]
    runs.clear()
    hits, told = runtime.run_tools(planned.where("qid < 60"), {"payload": lambda a: tool(a, tuple(range(60)))})
    assert hits.collect() == [] and len(runs) <= 60 and all("odd filter" in r["warning"] and not r["ran"] for r in told.collect())


def test_runtime_without_hits_or_plan(spark):
    items, r = run(spark, {"payload": tool(), "vector": tool()})
    assert items == [] and r["empty_reason"] == "no_runtime_matches" and r["fusion"] == "hybrid_rrf" and r["tools_planned"] == 2
    items, r = run(spark, {"payload": tool("a")}, query="  ")
    assert items == [] and r["empty_reason"] == "empty_tool_plan" and r["tools_planned"] == 0


def test_profiles_fuse_or_take_the_first_tool(spark):
    both = {"payload": tool("b"), "vector": tool("a")}
    items, r = run(spark, both, profile="fast")
    assert items == ["b"] and r["fusion"] == ""
    items, r = run(spark, {"payload": tool("only"), "vector": tool()})
    assert items == ["only"] and r["fusion"] == "hybrid_rrf"
    items, r = run(spark, {"point": tool("p"), "payload": tool("q")}, query="", profile="fast", filters={"doc_name": ["d"], "point_number": ["1.7.1"]})
    assert items == ["p"] and r["selected_tools"] == ["point", "payload"] and r["warnings"] == ["payload skipped: empty query list"]
    items, r = run(spark, both, profile="no such", limit=0)
    assert items == ["a", "b"] and r["profile"] == "balanced"


def test_requests_fill_in_defaults(spark):
    q = spark.createDataFrame([(1, None, "fast", 0, None), (2, "x", None, None, "t2")], "qid int, query string, profile string, limit int, trace_id string")
    r = {x["qid"]: x for x in runtime.requests(q, profile="deep", limit=7).collect()}
    assert (r[1]["query"], r[1]["profile"], r[1]["limit"], r[1]["trace_id"]) == ("", "fast", 5, "1") and (r[2]["profile"], r[2]["limit"], r[2]["trace_id"], r[2]["filters"]) == ("deep", 7, "t2", {})


def test_several_queries_of_a_tool_are_merged(spark):
    q = spark.createDataFrame([(1, "whole", {"vector": ["a", "b"]})], "qid int, query string, tool_queries map<string,array<string>>")
    by_query = lambda asked: asked.select("qid", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("both").alias("chunk_id")), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("of "), "query").alias("chunk_id")))).alias("h")).select("qid", "h.rank", F.lit(0.5).alias("score"), "h.chunk_id", F.lit("d").alias("doc_name"), F.lit("").alias("point_number"), F.lit("").alias("text"))
    items, report = runtime.run_runtime(runtime.requests(q), {"vector": by_query})
    assert [r["chunk_id"] for r in items.orderBy("rank").collect()] == ["both", "of a", "of b"] and report.first()["selected_tools"] == ["vector"]


def test_best_vectors_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], rng.choice(["a", "b", "", None])) for i in range(400)] + [(900, None, "a")]
    v = spark.createDataFrame(rows, "chunk_id int, embedding array<double>, kind string")
    q = v.where("chunk_id < 10").select(F.col("chunk_id").alias("qid"), "embedding", F.col("kind").alias("want"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for same in (None, ("want", "kind")):
            got = {}
            for r in retrieval.vector_search(q, v, limit=7, same=same).orderBy("qid", "rank").collect():
                got.setdefault(r["qid"], []).append(r["chunk_id"])
            dot = lambda x, y: sum(a * b for a, b in zip(x, y))
            want = {}
            for i, x, kind in rows[:10]:
                each = [(-round(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5, 12), j) for j, y, k in rows if y and any(y) and any(x) and (not same or (kind is not None and k == kind))]
                want[i] = [j for _, j in sorted(each)[:7]]
            assert got == {i: w for i, w in want.items() if w}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vector_tool_with_filters(spark):
    c = spark.createDataFrame([("a", "D", [1.0, 0.0], "red part"), ("b", "D", [0.9, 0.1], "blue part"), ("c", "E", [1.0, 0.05], "red part"), ("z", "D", [0.0, 0.0], "red")], "chunk_id string, doc_name string, embedding array<double>, text string")
    q = spark.createDataFrame([(1, {}, 2, [1.0, 0.0]), (2, {"doc_name": ["d"]}, 5, [1.0, 0.0]), (3, {"text": ["RED part"]}, 5, [1.0, 0.0]), (4, None, 1, None)], "qid int, filters map<string,array<string>>, limit int, embedding array<double>")
    got = {}
    for r in retrieval.vector_tool(q, c).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["chunk_id"])
    assert got == {1: ["a", "c"], 2: ["a", "b"], 3: ["a", "c"]}


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(vectors.dot("a", "b"), vectors.norm("a"), vectors.cosine("a", "b"), vectors.cosine("a", "z"), vectors.normalized(F.col("a"))).first()
    assert r[:4] == (24.0, 5.0, 0.96, None) and [round(x, 6) for x in r[4]] == [0.6, 0.8]


def test_index_is_built_verified_and_kept_up(spark, tmp_path):
    from textloom.functions import fixed

    path = str(tmp_path / "index")
    keys = F.array(*map(F.lit, fixed.REQUIRED_PAYLOAD))
    c = spark.createDataFrame([("c1", "alpha beta", "D"), ("c2", "gamma", "D")], "chunk_id string, text string, doc_name string").withColumn("payload_keys", keys)
    assert indexing.read_index(spark, path) is None and indexing.build_index(c, indexing.word_encoder, path).count() == 0
    first = {r["payload"]["chunk_id"]: r for r in indexing.read_index(spark, path).collect()}
    assert set(first) == {"c1", "c2"} and abs(sum(x * x for x in first["c1"]["vector"]) - 1) < 1e-5
    more = spark.createDataFrame([("c2", "delta", "D"), ("c3", None, "D")], "chunk_id string, text string, doc_name string").withColumn("payload_keys", keys)
    bad = indexing.build_index(more, indexing.word_encoder, path)
    assert [(r["code"], r["count"]) for r in bad.collect()] == [("empty_vector_text", 1)]
    assert indexing.build_index(more.where("chunk_id = 'c2'"), indexing.word_encoder, path).isEmpty()
    assert {r["payload"]["chunk_id"]: r["payload"]["text"] for r in indexing.read_index(spark, path).collect()} == {"c1": "alpha beta", "c2": "delta"}
    assert indexing.build_index(more.where("chunk_id = 'c2'"), indexing.word_encoder, path, rebuild=True).isEmpty() and indexing.read_index(spark, path).count() == 1
    post = {(r["field"], r["value"]) for r in spark.read.parquet(f"{path}/postings/version=1").collect()}
    assert {("text", "alpha"), ("text", "beta"), ("doc_name", "D"), ("chunk_id", "c2")} <= post
    with pytest.raises(Exception, match="chunk_id is required"):
        indexing.index_payload(c.withColumn("chunk_id", F.lit(""))).collect()
    with pytest.raises(Exception, match="no vector for chunk c2"):
        indexing.point_records(c, spark.createDataFrame([("c1", [1.0])], "chunk_id string, embedding array<double>")).collect()
    actual = spark.createDataFrame([(f, f"PayloadSchemaType.{k.upper()}") for f, k in fixed.EXPECTED_PAYLOAD_INDEXES.items() if f != "heading_path_text"] , "field_name string, actual_schema string")
    assert [(r["field_name"], r["problem"]) for r in indexing.schema_differences(actual).collect()] == [("heading_path_text", "missing")]


def test_knowledge_tables_and_catalog_files(spark, tmp_path):
    bundle = {"documents": [{"doc_id": "1", "doc_name": "n"}, {"doc_id": ""}], "terms": [{"id": "t", "label": "l"}], "topic_aliases": [{"phrase": "p", "doc_name_substrings": ["x"]}]}
    (tmp_path / "k.json").write_text(json.dumps(bundle))
    k = tables.read_knowledge(spark, str(tmp_path / "k.json"))
    assert k["documents"].count() == 1 and k["topics"].first()["not_doc_names"] == [] and k["abbreviations"].count() == 0 and tables.read_knowledge(spark, str(tmp_path / "none.json"))["documents"].count() == 0
    assert {r["part"]: r["rows"] for r in knowledge.bundle_counts(k["documents"], k["abbreviations"], k["terms"], k["graph_abbreviations"], k["topics"]).collect()} == {"documents": 1, "abbreviations": 0, "terms": 1, "graph_abbreviations": 0, "topic_aliases": 1}
    ann = spark.createDataFrame([("1", "a " * 400, 0), (" ", "x", 1), ("2", None, 2)], "doc_id string, annotation string, position long")
    d = {r["doc_id"]: r for r in knowledge.knowledge_documents(ann, spark.createDataFrame([("1", " Name ", 0)], "doc_id string, doc_name string, position long")).collect()}
    assert d["1"]["doc_name"] == "Name" and len(d["1"]["annotation"]) <= 500 and d["1"]["annotation"].endswith("…") and d["2"]["doc_name"] == "" and len(d) == 2
    ab = spark.createDataFrame([("АРМ", ["рабочее место"], 0), ("too long to be one", ["expansion it is"], 1), ("а б", ["expansion it is"], 2), ("X", ["short"], 3), ("Y", [], 4)], "abbreviation string, values array<string>, position long")
    assert [r["abbreviation"] for r in knowledge.knowledge_abbreviations(ab).collect()] == ["АРМ"]
    te = spark.createDataFrame([("term", 0), ("9 volts", 1), ("в Таблице", 2), ("abc", 3), ("other term", 4)], "label string, position long")
    assert [r["label"] for r in knowledge.knowledge_terms(te, most=2).collect()] == ["term", "other term"]
    assert knowledge.knowledge_graph_abbreviations(te.withColumn("label", F.repeat("label", 3))).count() == 2
    entries = understanding.catalog(spark.createDataFrame([("Doc", "f 1.txt")], "doc_name string, filename string")).withColumn("catalog_id", F.lit("c"))
    tables.write_catalog(entries, str(tmp_path / "catalog"))
    back = tables.read_catalog(spark, str(tmp_path / "catalog")).first()
    assert (back["catalog_id"], back["doc_name"], back["doc_id"]) == ("c", "Doc", "") and back["aliases"] == entries.first()["aliases"]
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": "v", "entries": [{"catalog_id": "z", "doc_name": "Z"}, {"catalog_id": "y"}]}, indent=1))
    assert [r["doc_name"] for r in tables.read_catalog(spark, str(tmp_path / "c.json")).collect()] == ["Z"] and tables.read_catalog(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "q.json").write_text(json.dumps([{"id": "q1", "query": "x", "filters": {"doc_name": "D", "point_number": ["1", "2"]}, "limit": 3}, {"query": "y"}]))
    q = {r["qid"]: r for r in tables.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert q["q1"]["filters"] == {"doc_name": ["D"], "point_number": ["1", "2"]} and q["q1"]["limit"] == 3 and len(q) == 2
    runtime.save_report(entries.select("doc_name"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_shared_folder_is_not_made_up_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"

        @property
        def _jsc(self):
            return self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Empty()

    session = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.checkpoint_folder(session)


def test_merging_and_remaining_operators(spark):
    c = spark.createDataFrame([(1, "A", 0.6, 1), (1, "B", 0.5, 2)], "qid int, doc_name string, score double, rank int")
    k = spark.createDataFrame([(1, "kb", "B", "note", 0.6, ["r"], 1), (1, "kc", "C", "", 0.7, ["s"], 2)], "qid int, doc_id string, doc_name string, annotation string, score double, reasons array<string>, rank int")
    m = knowledge.merged_candidates(c, k, spark.createDataFrame([("A", "ca"), ("B", "cb")], "doc_name string, catalog_id string")).orderBy("rank").collect()
    assert [(r["doc_name"], r["catalog_id"], r["source"]) for r in m] == [("C", "knowledge:kc", "knowledge"), ("A", "ca", "catalog"), ("B", "cb", "catalog+knowledge")] and m[2]["annotation"] == "note"
    h = spark.createDataFrame([("q", "vector", 1, "v", 2), ("q", "payload", 1, "a", 2), ("q", "payload", 2, "b", 2), ("q", "payload", 3, "c", 2)], "qid string, tool string, rank int, chunk_id string, n int")
    assert [r["chunk_id"] for r in fusion.first_tool(h, "n").orderBy("rank").collect()] == ["a", "b"]
    e = spark.createDataFrame([("q", 1, "c", "D", "1", "h", "f", "t", 0.5)], "qid string, rank int, chunk_id string, doc_name string, point_number string, heading_path_text string, filename string, text string, score double")
    assert answers.evidence_json(e).count() == 1
    assert [r["s"] for r in spark.createDataFrame([("alpha beta xx", "alphabet")], "q string, t string").select(T.token_overlap(F.col("q"), F.col("t")).alias("s")).collect()] == [0.5]
    r = spark.createDataFrame([("documents", "documents_total", 0.0)], "section string, metric string, value double")
    assert not quality.passes_gate(r) and quality.blocking_defects(r).first()["code"] == "no_documents_processed"


def test_fuzzy_catalog_scores_equal_a_plain_version(spark, sf):
    """Every question against every entry with difflib, on all rows."""
    part = [r.asDict() for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name", "p_type").distinct().collect()]
    entries = understanding.catalog(spark.createDataFrame([(r["p_name"], f"N 17 {r['p_name']}") for r in part], "doc_name string, filename string")).collect()
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {}
    for qid in {f"{r['p_type']} {r['p_name']}" for r in part}:
        q, scores = qid.lower(), []
        for e in entries:
            s = 0.45 * (q in e["doc_norm"]) + 0.35 * (e["doc_norm"] in q)
            r = ratio(q, e["doc_norm"])
            s += 0.4 * r if r >= 0.55 else 0
            for a in e["aliases"]:
                roots = [w[: max(4, len(w) - 2)] for w in a.split(" ") if len(w) > 3]
                share = sum(x in q for x in roots) / len(roots) if len(roots) >= 2 else 0
                if a in q or q in a or share >= 0.7:
                    s += 0.35 if a in q or q in a else 0.6 * share
                    break
                s += 0.25 * ratio(q, a) if ratio(q, a) >= 0.72 else 0
            scores.append((-round(s, 6), e["doc_name"]))
        want[qid] = sorted(x for x in scores if x[0] < 0)[:8]
    got = {}
    for r in QUERIES["catalog_score_fuzzy"](spark, sf).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((-r["score"], r["doc_name"]))
    assert got.keys() == {k for k, v in want.items() if v}
    for k, rows in got.items():
        assert [(round(a, 5), n) for a, n in rows] == [(round(a, 5), n) for a, n in want[k]]


def test_knowledge_candidates_that_are_alike_equal_a_plain_version(spark, sf):
    """Every question against every document with difflib; what else counts comes from the query that has SQL."""
    plain, alike = ({(r["qid"], r["doc_id"]): r for r in QUERIES[n](spark, sf).collect()} for n in ("knowledge_candidates", "knowledge_candidates_alike"))
    part = spark.read.parquet(f"{sf}/part.parquet").collect()
    names = {f"d{min(r['p_partkey'] for r in part if r['p_name'] == n)}": n.lower() for n in {r["p_name"] for r in part}}
    qids = {f"{r['p_type']} {r['p_name']}" for r in part} | {f"пункт 7.1 {r['p_name']}" for r in part}
    for qid in sorted(qids)[::7]:
        near = {d: SequenceMatcher(None, qid.lower().replace(".", " "), n).ratio() for d, n in names.items()}
        got = {d: r for (q, d), r in alike.items() if q == qid}
        for d, r in got.items():
            said = [x for x in r["reasons"].split("|") if x.startswith("fuzzy_doc_name:")]
            beaten = r["reasons"].startswith(("topic", "abbreviation", "term"))  # something else scored better than the names
            assert said == ([f"fuzzy_doc_name:{near[d]:.2f}"] if near[d] >= 0.55 and not beaten else [])
            own = plain.get((qid, d))
            if said and own is not None and not own["reasons"].startswith(("topic", "abbreviation", "term")):
                assert abs(r["score"] - own["score"] - 0.25 * near[d]) < 2e-4
        least = min((r["score"] for r in got.values()), default=0)
        assert all(d in got or 0.25 * x <= least + 1e-4 for d, x in near.items() if x >= 0.55)


def test_alike_finds_every_pair(spark):
    rng = random.Random(8)
    say = lambda: "".join(rng.choice("abcd é") for _ in range(rng.randint(0, 14)))
    left, right = [say() for _ in range(120)] + ["x" * 300, "x y" * 100], [say() for _ in range(90)] + ["x" * 290, "x y" * 99 + "z"]
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    for least in (0.55, 0.72, 0.95):
        got = {(r["asked"], r["text"], r["ratio"]) for r in matching.alike(one(left, "asked"), one(right, "text"), least).collect()}
        assert got == {(a, b, x) for a in left for b in right if a and b and (x := SequenceMatcher(None, a, b).ratio()) >= least}
    assert matching.alike(one(left, "asked"), one([""], "text"), 0.5).collect() == []


def test_strings_in_several_blocks_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_CHARS", 150)
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    long = "long " * 40
    needles, texts = [long, long[:70], "long long", "é", "aa", ""] + [f"n{i}" for i in range(60)], [long + "end", "aaa é n7", "n1n12", "", "nothing"]
    got = {(r["needle"], r["text"]) for r in matching.containing(one(needles, "needle"), one(texts, "text")).collect()}
    assert got == {(n, t) for n in needles for t in texts if n and n in t}
    near = {(r["asked"], r["text"]) for r in matching.alike(one(texts, "asked"), one(needles, "text"), 0.6).collect()}
    assert near == {(a, b) for a in texts for b in needles if a and b and SequenceMatcher(None, a, b).ratio() >= 0.6}


def test_explicit_document_names(spark):
    entries = understanding.catalog(spark.createDataFrame([("Rules B", "b"), ("rules a", "a"), ("Other", "o")], "doc_name string, filename string"))
    q = spark.createDataFrame([(1, "x", "RULES"), (2, "x", "Other"), (3, "x", " none "), (4, "other", None), (5, "other", "")], "qid int, query string, explicit_doc_name string")
    got = {r["qid"]: (r["doc_name"], r["score"], r["rank"]) for r in understanding.catalog_candidates(q, entries, alike=False).collect()}
    assert got[1] == ("Rules B", 1.0, 1) and got[2] == ("Other", 1.0, 1) and got[3] == ("none", 0.2, 1) and got[4][0] == got[5][0] == "Other"


def test_predicates_and_names(spark):
    assert predicates.expand_doc_name_variants({"doc_name": "a"}) == {"doc_name": ["a", "A"]} and evaluation.METRICS
    m = spark.createDataFrame([("1", "f|x.txt", "title_fallback", "s", "T\n" + "y" * 200, "R", "", "A"), ("2", "g", "", "s", "t", "r", "", "")], "doc_key string, filename string, manifest_kind string, metadata_source string, doc_title_full string, doc_reg string, doc_date string, authority string")
    rows = tables.manifest(m).collect()
    assert len(rows) == 1 and rows[0]["line"].startswith("| f/x.txt | title_fallback | s | T yyy") and "y… | R |  | A |" in rows[0]["line"]
    assert metadata.approval_act(F.lit("")) is not None
