"""Retrieval: point, payload and vector search for a whole table of questions at once.

Questions have qid, query, filters (map<string, array<string>>) and limit; chunks have chunk_id and their payload
columns. Hits have qid, tool, rank, score and the chunk's columns; point and payload hits have no score and come in the
order of their index id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import fixed, ids
from ..functions import text as T
from ..functions.vectors import cosine
from ..shipping import ship
from ..sources.tables import staged
from . import predicates as P

ITEM_FIELDS = ("chunk_id", "doc_id", "point_id", "filename", "doc_name", "heading_path_text", "point_number", "text", "point_identity_key")
#: Most combinations of values by which one question is looked up.
COMBINATIONS = 256
#: Query vectors of one pass: a bound on what is broadcast.
QUERY_BLOCK = 4096
#: Words of the queries of one pass over the texts: a bound on what is broadcast.
WORD_BLOCK = 1 << 20
#: Most bytes of scores that a task holds at once.
SCORE_BYTES = 4 << 20
#: Hits that wait in a task until they are brought in order.
WAITING = 1 << 16


def with_item_fields(chunks: DataFrame) -> DataFrame:
    """Adds the fields that chunks lack, as empty strings; null becomes ''."""
    return chunks.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in chunks.columns else F.lit("") for c in ITEM_FIELDS})


def _ranked(found: DataFrame, chunks: DataFrame, tool: str) -> DataFrame:
    """Hits (qid, limit, chunk_id) in the order of their index id; the chunks' columns join those that stay."""
    w = Window.partitionBy("qid").orderBy(ids.index_point_id(F.col("chunk_id")))
    # Limits are clamped: tasks let go of what cannot be among the first before anything is shuffled.
    first = found.select("qid", "limit", "chunk_id").withColumn("__place", F.dense_rank().over(w)).where(F.col("__place") <= P.MOST).drop("__place")
    best = first.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("limit"))
    return best.join(chunks, "chunk_id").select("qid", F.lit(tool).alias("tool"), "rank", F.lit(None).cast("double").alias("score"), *ITEM_FIELDS)


def _lookup(questions: DataFrame, chunks: DataFrame, keys: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    """Questions with the keyword fields and ``carry`` of chunks that fit them in all of ``keys`` that they filter by.

    One equi-join on a hash of the values of all these keys together, so that no frequent value of one of them brings
    pairs that another one parts. A question has a row for each combination of its values; a key that would make more
    than COMBINATIONS is left out. A chunk has a row for each combination of keys that questions filter by. The caller
    compares the values themselves.
    """
    f = F.col("filters")
    values = lambda k: F.array_distinct(F.concat(f[k], F.transform(f[k], F.upper)) if k == "doc_name" else f[k])
    wanted = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), values(k).alias("values")) for k in keys)), lambda x: F.coalesce(F.size(x["values"]), F.lit(0)) > 0)
    start = F.struct(F.array(F.lit(0).cast("long")).alias("marks"), F.array().cast("array<string>").alias("used"))

    def step(s: Column, x: Column) -> Column:
        more = F.flatten(F.transform(s["marks"], lambda m: F.transform(x["values"], lambda v: F.xxhash64(m, v))))
        fits = (F.size(s["used"]) == 0) | (F.size(s["marks"]) * F.size(x["values"]) <= COMBINATIONS)
        return F.when(fits, F.struct(more.alias("marks"), F.concat(s["used"], F.array(x["key"])).alias("used"))).otherwise(s)

    asked = questions.withColumn("__by", F.aggregate(wanted, start, step)).where(F.size("__by.used") > 0).select(*questions.columns, F.col("__by.used").alias("__used"), F.explode("__by.marks").alias("__mark"))
    own = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k))))
    rows = chunks.select(*fixed.KEYWORD_FIELDS, *carry, own.alias("__own")).join(F.broadcast(asked.select("__used").distinct()))  # bounded: combinations of keys
    mark = F.aggregate("__used", F.lit(0).cast("long"), lambda m, k: F.xxhash64(m, F.col("__own")[k]))
    return asked.join(rows.withColumn("__mark", mark).drop("__own"), ["__used", "__mark"]).drop("__used", "__mark")


def point_search(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exact lookup by chunk_id, else by point_identity_key, else by point number or heading path, name and file.

    Questions that filter by a document alone are not looked up.
    """
    c = with_item_fields(chunks)
    f = F.col("filters")
    one = lambda k: F.coalesce(F.size(f[k]) > 0, F.lit(False))
    chosen = F.when(one("chunk_id"), F.map_filter(f, lambda k, _: k == "chunk_id")).when(one("point_identity_key"), F.map_filter(f, lambda k, _: k == "point_identity_key")).otherwise(
        F.map_filter(f, lambda k, _: k.isin("doc_name", "point_number", "heading_path_text", "filename")))
    q = questions.where(P.is_point_lookup(f)).withColumns({"filters": chosen, "limit": P.clamp_limit(F.col("limit"))}).select("qid", "filters", "limit")
    return _ranked(_filtered(q, c, ("chunk_id", "point_identity_key", "point_number", "filename", "doc_name")).select("qid", "limit", "chunk_id"), c, "point")


def _filtered(questions: DataFrame, chunks: DataFrame, keys: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Question-chunk pairs (the question's columns, chunk_id and ``carry`` of the chunk) that fit all filters: found by ``keys`` and whole texts, or by the rarest word where only words are filtered by."""
    f = F.col("filters")
    many = {k: F.coalesce(F.size(f[k]) > 1, F.lit(False)) for k in fixed.TEXT_FIELDS}
    exact = reduce(lambda a, b: a | b, [F.coalesce(F.size(f[k]) > 0, F.lit(False)) for k in keys] + list(many.values()))
    out = [*questions.columns, "chunk_id", *(c for c in carry if c != "chunk_id")]
    # Texts move only for questions that filter by them.
    texts = reduce(lambda a, b: a | b, (f[k].isNotNull() for k in fixed.TEXT_FIELDS))
    found = _lookup(questions.where(exact & ~texts), chunks, keys, carry).where(P.row_matches(f, fixed.KEYWORD_FIELDS)).select(*out)
    # One value of a text field is words, several are whole texts.
    whole = F.map_filter(f, lambda k, v: ~k.isin(*fixed.TEXT_FIELDS) | (F.size(v) > 1))
    near = _lookup(questions.where(exact & texts).withColumn("__all", f).withColumn("filters", whole), chunks, (*keys, *fixed.TEXT_FIELDS), ()).withColumn("filters", F.col("__all"))
    both = near.where(P.row_matches(f, fixed.KEYWORD_FIELDS)).select(*questions.columns, "chunk_id").join(chunks, "chunk_id").where(P.row_matches(f))
    field = F.coalesce(*(F.when(F.size(f[k]) == 1, F.lit(k)) for k in fixed.TEXT_FIELDS))
    words = questions.where(~exact).withColumn("field", field).where(F.col("field").isNotNull())
    hits = token_hits(words.select("qid", "field", f[F.col("field")][0].alias("query")), chunks)
    by_words = words.drop("field").join(hits, "qid").join(chunks, "chunk_id").where(P.row_matches(f))
    return found.unionByName(both.select(*out)).unionByName(by_words.select(*out))


def token_hits(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id) where the field has every word of the query (qid, field, query).

    Two passes over the texts, of which neither moves words or texts: the first counts, in each task, the words that are
    asked for; the rarest of a query names the chunks in which the second looks for its other words, while it has the
    chunk's at hand. Queries go to the tasks in blocks of about WORD_BLOCK words, with two passes each. Without words no
    text is read.
    """
    words = asked.select("qid", "field", F.explode(T.search_tokens(F.col("query"))).alias("token"))
    n = words.count()
    if not n:
        return words.select("qid").join(chunks.select("chunk_id")).limit(0)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), T.search_tokens(F.col(k)).alias("own")) for k in fixed.TEXT_FIELDS))).alias("h")
    own = chunks.select("chunk_id", each).select("chunk_id", "h.field", "h.own")
    blocks = -(-n // WORD_BLOCK)
    of = lambda df, b: df.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)

    def rarest(some: DataFrame) -> DataFrame:
        often = own.select("field", F.explode("own").alias("token")).join(F.broadcast(some.select("field", "token").distinct()), ["field", "token"], "left_semi").groupBy("field", "token").agg(F.count("*").alias("n"))
        each = some.join(often, ["field", "token"], "left").groupBy("qid", "field").agg(F.collect_list("token").alias("want"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"))
        return each.where("m.n > 0").select("qid", "field", "want", F.col("m.token").alias("token"))

    def having(some: DataFrame) -> DataFrame:
        found = own.select("chunk_id", "field", "own", F.explode("own").alias("token")).join(F.broadcast(some), ["field", "token"])
        return found.where(F.size(F.array_except("want", "own")) == 0).select("qid", "chunk_id")

    seeds = staged(reduce(DataFrame.unionByName, (rarest(of(words, b)) for b in range(blocks))))
    out = [having(of(seeds, b)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, out)


def payload_search(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Boolean search: all filters hold, and the query's words are all in text or heading path, or it is a document or file name.

    A question without query is looked up by its filters; one without either finds nothing.
    """
    c = with_item_fields(chunks)
    q = questions.select("qid", F.trim(F.coalesce("query", F.lit(""))).alias("query"), F.coalesce("filters", F.create_map().cast("map<string,array<string>>")).alias("filters"), P.clamp_limit(F.col("limit")).alias("limit"))
    asked, bare = q.where("query <> ''"), q.where("query = ''")
    parts = token_hits(asked.select("qid", F.explode(F.array(*map(F.lit, fixed.TEXT_FIELDS))).alias("field"), "query"), c)
    names = c.select("chunk_id", F.explode(F.array_distinct(F.array("doc_name", "filename"))).alias("query"))
    # A chunk may be found twice; it has one place in the order.
    found = asked.join(parts.union(asked.join(names, "query").select("qid", "chunk_id")), "qid")
    plain = found.where(F.size("filters") <= 0).select("qid", "limit", "chunk_id")
    fit = found.where(F.size("filters") > 0).join(c, "chunk_id").where(P.row_matches(F.col("filters"))).select("qid", "limit", "chunk_id")
    by_filter = _filtered(bare, c, fixed.KEYWORD_FIELDS).select("qid", "limit", "chunk_id")
    return _ranked(plain.unionByName(fit).unionByName(by_filter), c, "payload")


def vector_search(questions: DataFrame, vectors: DataFrame, *, qid: str = "qid", id_col: str = "chunk_id", vector: str = "embedding", limit: int = 10, same: tuple[str, str] | None = None) -> DataFrame:
    """(qid, id_col, score, rank): the ``limit`` most similar vectors of each query by exact cosine; equal scores by id.

    Query vectors go through in blocks of QUERY_BLOCK, which bounds the broadcast however many there are. Each task
    keeps its own best of every query, so ``limit`` rows a query and task are shuffled. ``same`` names a column of the
    questions and one of the vectors that must be equal, and not null. Null vectors and those of length zero match
    nothing. Scores are rounded to twelve digits, so equal vectors are equally far.
    """
    spark = vectors.sparkSession
    ship(spark)
    keep = questions.where(F.col(vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("v"), (F.col(same[0]) if same else F.lit(0)).cast("string").alias("same"))
    blocks = max(1, -(-keep.count() // QUERY_BLOCK))
    text = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(same[1]) if same else F.lit(0)).cast("string").alias("same"))
    kind = StructType([keep.schema["qid"], text.schema["id"], StructField("score", DoubleType())])
    out = []
    for b in range(blocks):
        rows = keep.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        m = np.array([r["v"] for r in rows])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((pa.array([r["qid"] for r in rows], to_arrow_schema(kind).field("qid").type), np.where(n > 0, m / np.where(n > 0, n, 1), np.nan), [r["same"] for r in rows]))
        out.append(text.mapInArrow(_best_of(shared, limit, to_arrow_schema(kind), same is not None), kind))
    if not out:
        return text.select(F.lit(None).cast(kind["qid"].dataType).alias(qid), F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return best.select(F.col("qid").alias(qid), F.col("id").alias(id_col), "score", "rank")


def _best_of(shared, limit: int, out: pa.Schema, alike: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries, same = shared.value
        codes: dict[str, int] = {}
        wanted = np.array([-1 if s is None else codes.setdefault(s, len(codes)) for s in same])
        rows = max(1, SCORE_BYTES // (8 * max(1, len(queries))))
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query, score and id of the best so far
        waiting, n_waiting = [], 0  # what may be among the best, not yet brought in order
        least = np.full(len(queries), -np.inf)

        def best(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            col, score, id_ = (np.concatenate([p[i] for p in parts if len(p[0])] or [parts[0][i]]) for i in range(3))
            order = np.lexsort((id_ if id_.dtype == np.int64 else np.unique(id_, return_inverse=True)[1], -score, col))
            col, score, id_ = col[order], score[order], id_[order]
            place = np.arange(len(col)) - np.searchsorted(col, col)
            keep, full = place < limit, place == limit - 1
            least[col[full]] = score[full]
            return [col[keep], score[keep], id_[keep]]

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x, id_ = _matrix(part.column("v"), queries.shape[1]), _ids(part.column("id"))
                n = np.linalg.norm(x, axis=1)
                score = x @ queries.T
                score /= np.where(n > 0, n, np.nan)[:, None]
                # Scores are rounded only where they may count: rounding moves none by more than a few 1e-13.
                near = score >= (least - 1e-11)[None, :]
                if alike:
                    own = np.array([-2 if s is None else codes.get(s, -2) for s in part.column("same").to_pylist()])
                    near &= own[:, None] == wanted[None, :]
                row, col = np.nonzero(near)
                score = np.round(score[row, col], 12)
                ok = score >= least[col]
                waiting.append([col[ok], score[ok], id_[row[ok]]])
                n_waiting += int(ok.sum())
                if n_waiting > max(WAITING, len(held[0])):
                    held, waiting, n_waiting = best([held, *waiting]), [], 0
        held = best([held, *waiting])
        for at in range(0, len(held[0]), WAITING):
            col, score, id_ = (h[at : at + WAITING] for h in held)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(col)), pa.array(id_ if id_.dtype == np.int64 else id_.tolist(), out.field(1).type), pa.array(score)], schema=out)

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, without an object for each number. A null component is NaN, so its vector matches nothing."""
    if pa.compute.any(pa.compute.not_equal(pa.compute.list_value_length(column), width)).as_py():
        raise ValueError(f"a vector has not the {width} components of the queries")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy() if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def vector_tool(questions: DataFrame, chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Hits of questions (qid, filters, limit and a vector) among chunks with vectors: the most similar that fit all filters.

    Questions without filters meet all vectors, in blocks. Those with filters meet just the chunks that fit, found by a
    join on what they filter by.
    """
    none = F.create_map().cast("map<string,array<string>>")
    c = with_item_fields(chunks)
    q = questions.where(F.col(vector).isNotNull()).select("qid", F.coalesce("filters", none).alias("filters"), P.clamp_limit(F.col("limit")).alias("limit"), F.col(vector).cast("array<double>").alias("asked"))
    free, bound = q.where(F.size("filters") <= 0), q.where(F.size("filters") > 0)
    most = free.agg(F.max("limit")).first()[0] or 1
    near = vector_search(free.select("qid", "asked"), c.select("chunk_id", F.col(vector).alias("asked")), vector="asked", limit=most).select("qid", "chunk_id", "score")
    found = near.join(free.select("qid", "limit"), "qid")
    pairs = _filtered(bound, c.where(F.col(vector).isNotNull()), fixed.KEYWORD_FIELDS, (vector,))
    score = F.round(cosine(F.col("asked"), F.col(vector)), 12)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    some = "score IS NOT NULL AND NOT isnan(score)"
    # As in ``_ranked``: of all chunks that fit, tasks keep what can be among the first.
    fit = pairs.select("qid", "chunk_id", score.alias("score"), "limit").where(some).withColumn("__place", F.dense_rank().over(w)).where(F.col("__place") <= P.MOST).drop("__place").distinct()
    found = found.unionByName(fit).where(some)
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("limit"))
    return best.join(c, "chunk_id").select("qid", F.lit("vector").alias("tool"), "rank", "score", *ITEM_FIELDS)


def merge_query_results(hits: DataFrame) -> DataFrame:
    """One list for each (qid, tool) from several queries (query_no): the first of each chunk stays, in order.

    A chunk without chunk_id is known by name, point and the first 80 characters of its text. A list from one query
    only is left as it is.
    """
    key = T.first_filled(F.col("chunk_id"), F.concat_ws(":", "doc_name", "point_number", F.left(F.col("text"), F.lit(80))))
    per = Window.partitionBy("qid", "tool")
    order = Window.partitionBy("qid", "tool", "__key").orderBy("query_no", "rank")
    kept = hits.withColumn("__key", key).withColumns({"__n": F.row_number().over(order), "__several": F.min("query_no").over(per) < F.max("query_no").over(per)}).where("__n = 1 OR NOT __several")
    return kept.withColumn("rank", F.row_number().over(per.orderBy("query_no", "rank"))).drop("__key", "__n", "__several")


def empty_reasons(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, candidates, empty_reason) for each question."""
    n = hits.groupBy("qid").agg(F.count("*").alias("candidates"))
    nothing = (F.trim(F.coalesce("query", F.lit(""))) == "") & (F.coalesce(F.size("filters"), F.lit(0)) <= 0)
    out = questions.select("qid", nothing.alias("__nothing")).join(n, "qid", "left")
    return out.select("qid", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("candidates") > 0, "").when(F.col("__nothing"), "empty_query_and_filters").otherwise("no_matches").alias("empty_reason"))
