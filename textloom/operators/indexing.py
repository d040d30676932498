"""The index: vectors of texts, records by stable id, its payload indexes, and the checks before and after."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import fixed, ids
from ..functions import text as T
from ..functions.vectors import normalized
from ..shipping import ship
from . import index_store

#: chunks to their encoder: made once a task, then called with lists of texts; gives a vector for each.
Encoder = Callable[[list[str]], list[list[float]]]


def word_encoder(size: int = 64) -> Encoder:
    """An encoder without a model: counts of hashed words, for tests and as a baseline."""
    import zlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h & 65536 else -1.0
            out.append(v)
        return out

    return encode


def embedded(chunks: DataFrame, load: Callable[[], Encoder], *, text_col: str = "text", out: str = "embedding", batch: int = 32) -> DataFrame:
    """Chunks with the unit vector of their text. ``load`` makes the encoder, once a task; it sees ``batch`` texts at a time. Null is ''."""
    ship(chunks.sparkSession)

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for part in texts:
            rows = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in encoder(rows[i : i + batch])])

    return chunks.withColumn(out, encode(F.col(text_col))).withColumn(out, normalized(F.col(out)))


#: Chunks of one text are joined to its vector in so many parts, so that a text that many chunks have is no hot key.
TEXT_PARTS = 64


def embedded_once(chunks: DataFrame, load: Callable[[], Encoder], path: str, encoder: str, *, text_col: str = "text", out: str = "embedding", batch: int = 32) -> DataFrame:
    """As ``embedded``, where a text that ``encoder`` has seen before, in this table or an earlier one, is not encoded again.

    Vectors are kept at ``path`` by the name of the encoder and the SHA-256 of the text; what is new is written there
    before it is used, so a build that fails later need not encode it again. Another name, or version, is another encoder. Texts
    of like length are encoded together.
    """
    spark, folder = chunks.sparkSession, f"{path}/encoder={hashlib.sha256(encoder.encode()).hexdigest()[:16]}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, part = F.sha2(text, 256).alias("__text"), F.pmod(F.xxhash64("chunk_id"), F.lit(TEXT_PARTS)).alias("__part")
    texts = chunks.select(key, text.alias("__own")).groupBy("__text").agg(F.first("__own").alias("__own"))
    done = index_store.complete(spark, folder)
    known = spark.read.parquet(*(f"{folder}/version={v}" for v in done)) if done else None
    new = texts if known is None else texts.join(known.select("__text"), "__text", "left_anti")
    new = embedded(new.sortWithinPartitions(F.length("__own")), load, text_col="__own", out="__vector", batch=batch).select("__text", "__vector")
    version = 1 + max([0, *index_store._numbers(spark, folder)])
    new.write.parquet(f"{folder}/version={version}")
    vectors = spark.read.parquet(*(f"{folder}/version={v}" for v in [*done, version]))
    own = chunks.withColumns({"__text": key, "__part": part})
    parts = own.select("__text", "__part").distinct().join(vectors, "__text")
    return own.join(parts, ["__text", "__part"]).withColumn(out, F.col("__vector")).drop("__text", "__part", "__vector")


def index_payload(chunks: DataFrame) -> DataFrame:
    """Chunks with text, chunk_id and schema_version filled in; reading one without chunk_id is an error."""
    version = F.coalesce(F.col("schema_version"), F.lit("")) if "schema_version" in chunks.columns else F.lit("")
    key = F.coalesce("chunk_id", F.lit(""))
    return chunks.withColumns({"text": F.coalesce("text", F.lit("")), "chunk_id": F.when(key == "", F.raise_error(F.lit("chunk_id is required before indexing"))).otherwise(key), "schema_version": version})


def point_records(chunks: DataFrame, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """id, vector and payload (a struct of all columns) of every chunk; ``vectors`` has chunk_id and the vector. A chunk without one is an error when it is read."""
    own = index_payload(chunks)
    both = own.join(vectors.select("chunk_id", F.col(vector).cast("array<float>").alias("__v")), "chunk_id", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for chunk "), "chunk_id"))
    return both.select(ids.index_point_id(F.col("chunk_id")).alias("id"), F.coalesce("__v", missing.cast("array<float>")).alias("vector"), F.struct(*(f"`{c}`" for c in own.columns)).alias("payload"))


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of both, where those of ``new`` replace those of ``old`` with the same id."""
    return old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def payload_postings(records: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """(field, value, id): the payload indexes. A keyword field is indexed by its value, a text field by each of its words."""
    kinds = fixed.EXPECTED_PAYLOAD_INDEXES if expected is None else expected
    fields = set(records.schema["payload"].dataType.fieldNames())
    parts = []
    for field, kind in kinds.items():
        if field in fields:
            value = F.col(f"payload.{field}").cast("string")
            values = T.search_tokens(value) if kind == "text" else F.array_compact(F.array(F.when(value != "", value)))
            parts.append(records.select(F.lit(field).alias("field"), F.explode(values).alias("value"), "id"))
    return reduce(DataFrame.unionByName, parts)


def index_schema(records: DataFrame) -> DataFrame:
    """(field_name, actual_schema) of the payload: text for the fields that are searched by words, keyword for other strings."""
    rows = [(f.name, "text" if f.name in fixed.TEXT_FIELDS else "keyword" if f.dataType.simpleString() == "string" else f.dataType.simpleString()) for f in records.schema["payload"].dataType]
    return records.sparkSession.createDataFrame(rows, "field_name string, actual_schema string")


def schema_kind(text: Column) -> Column:
    """keyword or text, if the name of a type says so; else that name, lower-cased."""
    t = F.lower(T.strip(F.coalesce(text, F.lit(""))))
    return F.when(t.contains("keyword"), "keyword").when(t.contains("text"), "text").otherwise(t)


def schema_differences(actual: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """(field_name, expected_schema, actual_schema, problem) of expected indexes that are missing or of another type; none: the index passes."""
    kinds = fixed.EXPECTED_PAYLOAD_INDEXES if expected is None else expected
    want = actual.sparkSession.createDataFrame(list(kinds.items()), "field_name string, expected_schema string")
    both = want.join(actual.select("field_name", schema_kind(F.col("actual_schema")).alias("actual_schema")), "field_name", "left")
    problem = F.when(F.col("actual_schema").isNull(), "missing").when(F.col("actual_schema") != F.col("expected_schema"), "wrong_type")
    return both.withColumn("problem", problem).where("problem IS NOT NULL")


def verify_index(chunks: DataFrame) -> DataFrame:
    """(section, metric, value) of chunks that are to be indexed. ``payload_keys`` are the keys that a chunk's payload has."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "") if c in chunks.columns else F.count_if(F.lit(False))
    counted = {
        "chunks_total": F.count("*"), "missing": F.count_if(F.size(F.array_except(F.array(*map(F.lit, fixed.REQUIRED_PAYLOAD)), "payload_keys")) > 0), "empty_text_chunks": F.count_if(T.strip(F.coalesce("text", F.lit(""))) == ""),
        **{f"chunks_with_{c}": filled(c) for c in ("filename", "doc_name", "heading_path_text", "chunk_id", "point_identity_key", "point_number")},
    }
    # Counted by id first, so that one pass over the chunks, which may be costly, gives all: an id that occurs n times is n - 1 times too many.
    by_id = chunks.groupBy(F.coalesce("chunk_id", F.lit("")).alias("__id")).agg(*(v.alias(k) for k, v in counted.items()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = by_id.agg(*(total(c).alias(c) for c in counted), total(F.when(F.col("__id") != "", F.col("chunks_total") - 1)).alias("repeated"))
    n = F.col("chunks_total")
    one = sums.withColumns({"required_payload_keys_coverage": F.when(n == 0, 1.0).otherwise((n - F.col("missing")) / n), "payload_errors": n - F.col("chunks_with_chunk_id"), "chunks_with_text": n - F.col("empty_text_chunks")})
    values = [
        ("chunks", "chunks_total", "chunks_total"), ("chunks", "chunks_missing_required_payload_keys", "missing"), ("chunks", "required_payload_keys_coverage", "required_payload_keys_coverage"), ("chunks", "payload_errors", "payload_errors"), ("chunks", "duplicate_index_ids", "repeated"),
        ("vector_readiness", "chunks_with_text", "chunks_with_text"), ("vector_readiness", "empty_text_chunks", "empty_text_chunks"),
        *(("payload_lookup_readiness", f"chunks_with_{c}", f"chunks_with_{c}") for c in ("filename", "doc_name", "heading_path_text")),
        *(("point_lookup_readiness", f"chunks_with_{c}", f"chunks_with_{c}") for c in ("chunk_id", "point_identity_key", "point_number")),
    ]
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for s, m, c in values))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def index_defects(report: DataFrame) -> DataFrame:
    """(position, code, stage, count) of what forbids indexing; none: it passes."""
    rules = report.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(fixed.INDEX_DEFECTS)], "position int, metric string, code string, stage string")
    bad = F.when(F.col("metric") == "chunks_total", F.col("value") == 0).otherwise(F.col("value") > 0)
    return report.join(rules, "metric").where(bad).select("position", "code", "stage", F.col("value").cast("long").alias("count"))


def build_index(chunks: DataFrame, load: Callable[[], Encoder], path: str, *, rebuild: bool = False, encoder: str | None = None) -> DataFrame:
    """Verifies, embeds and commits chunks as the next version of the index at ``path``; returns what forbade it, if anything.

    Without ``rebuild``, records that are there stay unless a chunk has their id. Readers of the version before are not
    disturbed, and a build that fails changes nothing and can be repeated (see ``index_store``). With the name of an
    ``encoder``, texts that it has encoded for this index before are not encoded again.
    """
    defects = index_defects(verify_index(chunks))
    if not defects.isEmpty():
        return defects
    own = index_payload(chunks)
    both = embedded(own, load) if encoder is None else embedded_once(own, load, f"{path}/texts", encoder)
    new = both.select(ids.index_point_id(F.col("chunk_id")).alias("id"), F.col("embedding").alias("vector"), F.struct(*(f"`{c}`" for c in own.columns)).alias("payload"))
    index_store.write_version(new, path, rebuild=rebuild)
    return defects


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The records (id, vector, payload) of the newest version of an index; None if there are none."""
    found = index_store.read_records(spark, path)
    return None if found is None else found.select("id", "vector", "payload")
