"""An index that commits, and payload search that reads it.

Records live in buckets by the leading digits of their id, so the order (bucket, place) is the order of ids. Each bucket
has its own postings, dealt out by a hash of (field, value): for each value, blocks of the places that have it. A version
writes only the buckets that its ids touch; a manifest says which version holds each bucket, and appears in one step. So
a reader sees the version that it began with, whole, and a build that fails leaves files that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, ids
from ..functions import text as T
from ..shipping import ship
from ..sources.tables import checkpoint_folder
from . import predicates as P
from .retrieval import ITEM_FIELDS

#: Records that a bucket should have, and the most buckets; a first build or a rebuild chooses their number by it.
BUCKET_ROWS, MOST_BUCKETS = 8_192, 4_096
#: Records of a bucket for each part of its postings, and the most parts of a bucket.
PART_ROWS, PARTS = 4_096, 64
#: Places of one block of postings.
BLOCK = 1 << 15
#: Values that a task holds while it makes blocks of them.
HELD = 1 << 21
#: So many words are handed to the Parquet reader by name; more are joined, up to WORDS_SENT of them as a broadcast.
WORDS_NAMED, WORDS_SENT = 1_000, 100_000
_TERM = "struct<field:string,value:string>"


# ---- Files


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers at the end of the names in a folder; none if there is no folder."""
    fs, p = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    ends = [n.removesuffix(".json").rpartition("=")[2] for n in names if not n.startswith(".")]
    return [int(x) for x in ends if x.isdigit()]


def complete(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions in a folder that were written to their end."""
    return [v for v in sorted(_numbers(spark, folder)) if (lambda fs, p: fs.exists(p))(*_fs(spark, f"{folder}/version={v}/_SUCCESS"))]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of ``version``, or the newest one: version, buckets, parts, and by bucket the version that holds it. None if nothing was committed."""
    done = _numbers(spark, f"{path}/manifests")
    if not done or version is not None and version not in done:
        return None
    text = spark.read.text(f"{path}/manifests/version={max(done) if version is None else version}.json", wholetext=True).first()[0]
    found = json.loads(text)
    return found | {"at": {int(b): v for b, v in found["at"].items()}}


def _commit(spark: SparkSession, path: str, found: dict) -> None:
    """Writes the manifest beside its place and moves it there. Of two writers of one version, the second gets an error."""
    fs, folder = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    fs, beside = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.writeBytes(json.dumps(found))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    files = hadoop.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(beside, hadoop.Path(f"{path}/manifests/version={found['version']}.json"), how)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Removes manifests but the newest ``keep``, and the files that none of these needs; returns the numbers of the versions whose files went.

    Readers of a version that goes lose its files, so ``keep`` must cover the versions that are still read.
    """
    done = sorted(_numbers(spark, f"{path}/manifests"))
    stay = done[-keep:]
    used = {v for m in stay for v in manifest(spark, path, m)["at"].values()}
    newest = max(stay, default=0)
    gone = sorted({v for kind in ("records", "postings", "incoming") for v in _numbers(spark, f"{path}/{kind}") if v not in used and v <= newest})
    for v in gone:
        for kind in ("records", "postings", "incoming"):
            fs, p = _fs(spark, f"{path}/{kind}/version={v}")
            fs.delete(p, True)
    for m in done[:-keep]:
        fs, p = _fs(spark, f"{path}/manifests/version={m}.json")
        fs.delete(p, False)
    return gone


# ---- Writing


def bucket_of(id_: Column, buckets: int) -> Column:
    """The bucket of an id whose first eight characters are hexadecimal digits: an equal share of their range each."""
    return F.shiftright(F.conv(F.left(id_, F.lit(8)), 16, 10).cast("long") * buckets, 32).cast("int")


def part_of(field: Column, value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(field, value), F.lit(parts)).cast("int")


def _term(field: str) -> Callable[[Column], Column]:
    return lambda value: F.struct(F.lit(field).alias("field"), value.alias("value"))


def payload_values(records: DataFrame, expected: dict[str, str] | None = None) -> dict[str, Column]:
    """By field, all values that a record is found by: keywords, words of texts, and for texts, as field "=name", the SHA-256 of the whole."""
    kinds = fixed.EXPECTED_PAYLOAD_INDEXES if expected is None else expected
    fields = set(records.schema["payload"].dataType.fieldNames())
    out = {}
    for field, kind in kinds.items():
        if field in fields:
            value = F.coalesce(F.col(f"payload.`{field}`").cast("string"), F.lit(""))
            out |= {field: T.search_tokens(value), f"={field}": F.array(F.sha2(value, 256))} if kind == "text" else {field: F.array(value)}
    return out


def write_version(records: DataFrame, path: str, *, rebuild: bool = False, removed: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS, parts: int | None = None, expected: dict[str, str] | None = None) -> dict:
    """Commits records (id, vector, payload) as the next version of the index at ``path``; returns its manifest.

    Records that are there stay, unless ``records`` has their id or ``removed`` (id) names it; with ``rebuild`` none
    stay. The first version, and a rebuild, choose the numbers of buckets and of ``parts`` of their postings; later ones
    keep them. Ids begin with eight hexadecimal digits. Of rows that repeat an id one stays. Only buckets with such ids are
    written. The number of a version is beyond all that were ever begun, so what a failed build left is in nobody's way.
    """
    spark = records.sparkSession
    before = None if rebuild else manifest(spark, path)
    version = 1 + max([0, *(n for kind in ("manifests", "records", "postings", "incoming") for n in _numbers(spark, f"{path}/{kind}"))])
    # Encoded once: both the choice of buckets and the records read this table.
    records.select("id", "vector", "payload").write.option("compression", "zstd").parquet(f"{path}/incoming/version={version}")
    new = spark.read.parquet(f"{path}/incoming/version={version}")
    if before:
        buckets, parts = before["buckets"], before["parts"]
    else:
        n = new.count()
        buckets = min(MOST_BUCKETS, max(1, -(-n // bucket_rows)))
        parts = parts or min(PARTS, max(1, n // buckets // PART_ROWS))
    own = new.withColumn("bucket", bucket_of(F.col("id"), buckets))
    changed = own.select("bucket", "id")
    if removed is not None:
        changed = changed.union(removed.select(bucket_of(F.col("id"), buckets).alias("bucket"), "id"))
    touched = sorted(r[0] for r in changed.select("bucket").distinct().collect())  # at most as many as there are buckets
    old = read_records(spark, path, before, touched) if before else None
    if old is not None:
        own = old.drop("place").join(changed.distinct(), ["bucket", "id"], "left_anti").unionByName(own)
    order = Window.partitionBy("bucket").orderBy("id")
    # Dealt out by bucket once: that is enough for both windows and for the files.
    once = own.repartition("bucket").withColumn("__n", F.row_number().over(Window.partitionBy("bucket", "id").orderBy(F.xxhash64("payload")))).where("__n = 1").drop("__n")
    once.withColumn("place", (F.row_number().over(order) - 1).cast("int")).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/records/version={version}")
    fs, p = _fs(spark, f"{path}/incoming/version={version}")
    fs.delete(p, True)
    _write_postings(spark, path, version, parts, expected)
    written = {b for b in _numbers(spark, f"{path}/records/version={version}")}
    at = {b: v for b, v in (before["at"] if before else {}).items() if b not in touched} | dict.fromkeys(sorted(written), version)
    found = {"version": version, "buckets": buckets, "parts": parts, "at": at}
    _commit(spark, path, found)
    return found


def _write_postings(spark: SparkSession, path: str, version: int, parts: int, expected: dict[str, str] | None) -> None:
    """Blocks of places, sorted by value within each part; Parquet keeps the sorted places as differences."""
    try:
        rows = spark.read.parquet(f"{path}/records/version={version}")
    except Exception:
        if _numbers(spark, f"{path}/records/version={version}"):
            raise
        return  # nothing is left in the buckets that were touched
    values = payload_values(rows, expected)
    if not values:
        raise ValueError("the payload has no field that can be searched")
    ship(spark)
    # Records are read as they lie, by bucket and place, so nothing is shuffled; words become blocks within the task.
    names = list(values)
    own = rows.select("bucket", "place", *(c.alias(f"v{i}") for i, c in enumerate(values.values())))
    blocks = own.mapInArrow(_blocks(names, BLOCK, HELD), "bucket int, field string, value string, block int, n int, first int, last int, places array<int>")
    out = blocks.withColumn("part", part_of(F.col("field"), F.col("value"), parts)).sortWithinPartitions("bucket", "part", "field", "value", "block").write.partitionBy("bucket", "part")
    out.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#places.list.element", "false").parquet(f"{path}/postings/version={version}")


def _blocks(names: list[str], size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (bucket, place, an array of values for each name) to blocks (bucket, field, value, block, n, first, last, places).

    About ``most`` values are held; then all rows go but those of the bucket that is not over. The rows of one block may
    come apart, if they are more than that or another task reads the rest, so a block is the sum of its rows.
    """

    def inverted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, place = (rows.column(c).to_numpy().astype(np.int64) for c in ("bucket", "place"))
        at, group = np.unique((bucket << 32) + place // size, return_inverse=True)
        for i, name in enumerate(names):
            lists = rows.column(f"v{i}").combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            if not len(row):
                continue
            coded = lists.flatten().dictionary_encode()
            n_values = len(coded.dictionary)
            # Group, value and place in one number each: sorted, they are the postings.
            marks = np.sort((group[row] * n_values + coded.indices.to_numpy()) * size + place[row] % size)
            key = marks // size
            start = np.flatnonzero(np.diff(key, prepend=-1))
            end = np.append(start[1:], len(key))
            of, value = at[key[start] // n_values], key[start] % n_values
            block = of & 0xFFFFFFFF
            places = (np.repeat(block * size, end - start) + marks % size).astype(np.int32)
            offsets = pa.array(np.append(start, len(key)), pa.int32())
            columns = [pa.array(of >> 32, pa.int32()), pa.repeat(name, len(start)), coded.dictionary.take(pa.array(value)), pa.array(block, pa.int32()), pa.array(end - start, pa.int32()), pa.array(places[start]), pa.array(places[end - 1]), pa.ListArray.from_arrays(offsets, pa.array(places))]
            out = pa.RecordBatch.from_arrays(columns, ["bucket", "field", "value", "block", "n", "first", "last", "places"])
            yield from (out.slice(at, 1 << 16) for at in range(0, out.num_rows, 1 << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += sum(len(batch.column(f"v{i}").flatten()) for i in range(len(names)))
            if n >= most:
                rows = pa.Table.from_batches(waiting)
                bucket = rows.column("bucket").to_numpy()
                cut = len(bucket) - int(np.argmax(bucket[::-1] != bucket[-1])) if (bucket != bucket[-1]).any() else len(bucket)
                yield from inverted(rows.slice(0, cut))
                waiting = rows.slice(cut).to_batches()
                n = sum(len(b.column(f"v{i}").flatten()) for b in waiting for i in range(len(names)))
        if waiting:
            yield from inverted(pa.Table.from_batches(waiting))

    return run


# ---- Reading


def _read(spark: SparkSession, path: str, kind: str, found: dict, buckets: list[int] | None) -> DataFrame | None:
    wanted = {b: v for b, v in found["at"].items() if buckets is None or b in set(buckets)}
    out = []
    for v in sorted(set(wanted.values())):
        out.append(spark.read.parquet(f"{path}/{kind}/version={v}").where(F.col("bucket").isin([b for b, w in wanted.items() if w == v])))
    return reduce(DataFrame.unionByName, out) if out else None


def read_records(spark: SparkSession, path: str, found: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """Records (id, vector, payload, bucket, place) of a manifest (default: the newest), of all or some buckets; None if there are none."""
    found = found or manifest(spark, path)
    return _read(spark, path, "records", found, buckets) if found else None


def read_postings(spark: SparkSession, path: str, found: dict | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """Blocks (field, value, block, n, first, last, places, bucket, part) of a manifest, of all or some parts: files of other parts are not opened."""
    found = found or manifest(spark, path)
    out = _read(spark, path, "postings", found, None) if found else None
    return out if out is None or parts is None else out.where(F.col("part").isin(parts))


# ---- Searching


def _words(field: str, text: Column) -> Column:
    return F.transform(T.search_tokens(text), lambda t: F.array(_term(field)(t)))


def search_clauses(questions: DataFrame) -> DataFrame:
    """Questions (qid, query, filters, limit) as (qid, variant, limit, clause, n_clauses, field, value).

    A chunk is found if, for some variant, it has a value of every clause. Variants are what the query may be: words of
    the text, words of the heading path, a document's name, a file's name; filters are clauses of each. A question without
    query has its filters as the one variant; one without both has none.
    """
    q = questions.select("qid", F.trim(F.coalesce("query", F.lit(""))).alias("query"), F.coalesce("filters", F.create_map().cast("map<string,array<string>>")).alias("filters"), P.clamp_limit(F.col("limit")).alias("limit"))
    clauses = f"array<array<{_TERM}>>"
    none, impossible = F.array().cast(clauses), F.array(F.array().cast(f"array<{_TERM}>"))
    parts = []
    for k in fixed.KEYWORD_FIELDS:
        want = F.col("filters")[k]
        want = F.array_distinct(F.concat(want, F.transform(want, F.upper))) if k == "doc_name" else want
        parts.append(F.when(want.isNull(), none).otherwise(F.array(F.transform(want, _term(k)))))
    for k in fixed.TEXT_FIELDS:
        want = F.col("filters")[k]
        words = F.when(F.size(T.search_tokens(want[0])) > 0, _words(k, want[0])).otherwise(impossible)
        whole = F.array(F.transform(F.transform(want, lambda v: F.sha2(v, 256)), _term(f"={k}")))
        parts.append(F.when(want.isNull(), none).when(F.size(want) == 1, words).otherwise(whole))
    filters = F.flatten(F.array(*parts))
    name = lambda k: F.array(F.array(_term(k)(F.col("query"))))
    text = [F.when(F.size(T.search_tokens(F.col("query"))) > 0, _words(k, F.col("query"))).otherwise(impossible) for k in fixed.TEXT_FIELDS]
    variants = F.when(F.col("query") == "", F.array(none)).otherwise(F.array(*text, name("doc_name"), name("filename")))
    each = q.withColumn("__filters", filters).select("qid", "limit", "__filters", F.posexplode(variants).alias("variant", "own")).select("qid", "limit", "variant", F.array_distinct(F.concat("own", "__filters")).alias("clauses"))
    each = each.where((F.size("clauses") > 0) & ~F.exists("clauses", lambda c: F.size(c) == 0))
    each = each.select("qid", "limit", "variant", F.size("clauses").alias("n_clauses"), F.posexplode("clauses").alias("clause", "terms"))
    return each.select("qid", "limit", "variant", "n_clauses", "clause", F.explode(F.array_distinct("terms")).alias("t")).select("qid", "limit", "variant", "n_clauses", "clause", "t.*")


def _asked_blocks(spark: SparkSession, path: str, found: dict, asked: DataFrame) -> DataFrame | None:
    """The blocks of values that are asked for. Only the parts that can hold them are opened."""
    terms = asked.select("field", "value", part_of(F.col("field"), F.col("value"), found["parts"]).alias("part")).distinct()
    parts = [r[0] for r in terms.select("part").distinct().collect()]
    blocks = read_postings(spark, path, found, parts)
    if blocks is None:
        return None
    n = terms.count()
    if n <= WORDS_NAMED:
        blocks = blocks.where(F.col("value").isin(sorted({r[0] for r in terms.select("value").collect()})))
    own = terms.select("field", "value")
    return blocks.join(F.broadcast(own) if n <= WORDS_SENT else own, ["field", "value"], "left_semi")


def indexed_hits(spark: SparkSession, path: str, questions: DataFrame, found: dict | None = None) -> DataFrame | None:
    """(qid, bucket, place, rank): for each question the first ``limit`` records that fit, in the order of their ids.

    The rarest clause names the blocks that can have hits. The other clauses are looked up in these blocks alone, first
    by their heads (which values a block has, and between which places), and only blocks that have all of them, in ranges
    that overlap, give up their places: those of the rarest clause first, and of the others what these have, too, so no
    question gets the whole lists of its frequent words. Where one clause is all, blocks behind the first ``limit`` hits
    are left. No record is read.
    """
    found = found or manifest(spark, path)
    if not found or not found["at"]:
        return None
    folder = f"{checkpoint_folder(spark)}/search-{uuid.uuid4().hex}"
    kept = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.schema(df.schema).parquet(f"{folder}/{name}"))[1]
    asked = kept(search_clauses(questions), "asked")
    blocks = _asked_blocks(spark, path, found, asked)
    heads = kept(blocks.select("field", "value", "bucket", "block", "n", "first", "last"), "heads")
    of, term = ["qid", "variant"], ["field", "value"]
    sizes = asked.join(heads.groupBy(*term).agg(F.sum("n").alias("size")), term, "left").groupBy(*of, "clause").agg(F.sum(F.coalesce("size", F.lit(0))).alias("size"))
    rarest = sizes.groupBy(*of).agg(F.min(F.struct("size", "clause")).alias("m")).where("m.size > 0").select(*of, F.col("m.clause").alias("seed"))
    live = kept(asked.join(rarest, of), "live")
    at = ["qid", "variant", "bucket", "block"]
    seeds = live.where("clause = seed").join(heads, term).groupBy(*at, "limit", "n_clauses").agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    # At least n hits of a block whose only clause this is come before those of later blocks.
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy("bucket", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = kept(seeds.withColumn("before", before).where("n_clauses > 1 OR before < limit").drop("before"), "seeds")
    rest = live.where("n_clauses > 1 AND clause <> seed").select(*of, "clause", *term)
    others = seeds.where("n_clauses > 1").select(*at, "n_clauses", F.col("first").alias("low"), F.col("last").alias("high")).join(rest, of).join(heads, [*term, "bucket", "block"])
    spans = others.groupBy(*at, "clause", "n_clauses", "low", "high").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    full = spans.groupBy(*at, "n_clauses", "low", "high").agg(F.count("*").alias("there"), F.max("first").alias("first"), F.min("last").alias("last"))
    full = full.where("there = n_clauses - 1 AND greatest(first, low) <= least(last, high)").select(*at)
    wanted = seeds.where("n_clauses = 1").select(*at).union(full)
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    lists = blocks.select(*term, "bucket", "block", "places")
    own = wanted.join(live.where("clause = seed").select(*of, "limit", "n_clauses", *term), of).join(lists, [*term, "bucket", "block"])
    own = kept(own.groupBy(*at, "limit", "n_clauses").agg(all_of("places").alias("own")), "own")
    more = kept(own.where("n_clauses > 1").join(rest, of), "more")
    both = more.join(lists, [*term, "bucket", "block"]).select(*at, "limit", "n_clauses", "clause", F.array_intersect("own", "places").alias("p")).where(F.size("p") > 0)
    clauses = both.groupBy(*at, "limit", "n_clauses", "clause").agg(all_of("p").alias("p"))
    full = clauses.groupBy(*at, "limit", "n_clauses").agg(F.collect_list("p").alias("l")).where(F.size("l") == F.col("n_clauses") - 1)
    left = F.aggregate(F.slice("l", 2, F.size("l")), F.col("l")[0], lambda a, x: F.array_intersect(a, x))
    hits = own.where("n_clauses = 1").select("qid", "limit", "bucket", F.explode("own").alias("place")).union(full.select("qid", "limit", "bucket", F.explode(left).alias("place"))).distinct()
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("bucket", "place"))
    ranked = hits.withColumn("rank", rank).where((F.col("rank") <= 100) & (F.col("rank") <= F.col("limit"))).select("qid", "bucket", "place", "rank")
    out = kept(ranked, "hits")
    for name in ("asked", "heads", "live", "seeds", "own", "more"):
        fs, p = _fs(spark, f"{folder}/{name}")
        fs.delete(p, True)
    return out


def indexed_search(questions: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """The hits of ``retrieval.payload_search`` over the chunks that the index at ``path`` holds, from its postings.

    Texts are read for the hits alone. Filters by an empty value find nothing. An index without records has no hits.
    """
    spark = questions.sparkSession
    found = manifest(spark, path, version)
    hits = indexed_hits(spark, path, questions, found)
    if hits is None:
        return questions.limit(0).select("qid", F.lit("payload").alias("tool"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("score"), *(F.lit("").alias(c) for c in ITEM_FIELDS))
    records = read_records(spark, path, found, sorted(r[0] for r in hits.select("bucket").distinct().collect()))
    if records is None:
        return hits.select("qid", F.lit("payload").alias("tool"), "rank", F.lit(None).cast("double").alias("score"), *(F.lit("").alias(c) for c in ITEM_FIELDS))
    fields = set(records.schema["payload"].dataType.fieldNames())
    items = [(F.coalesce(F.col(f"payload.{c}").cast("string"), F.lit("")) if c in fields else F.lit("")).alias(c) for c in ITEM_FIELDS]
    return hits.join(records.select("bucket", "place", *items), ["bucket", "place"]).select("qid", F.lit("payload").alias("tool"), "rank", F.lit(None).cast("double").alias("score"), *ITEM_FIELDS)


def chunk_records(chunks: DataFrame, vector: Column | None = None) -> DataFrame:
    """Records of chunks by their index id; without ``vector`` they can be searched by payload only."""
    payload = F.struct(*(f"`{c}`" for c in chunks.columns))
    return chunks.select(ids.index_point_id(F.col("chunk_id")).alias("id"), (F.lit(None).cast("array<float>") if vector is None else vector.cast("array<float>")).alias("vector"), payload.alias("payload"))
