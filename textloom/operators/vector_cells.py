"""Vectors stored by cell, and exact search that leaves out cells that are too far.

Centres are fitted on a bounded sample; every vector is stored in the cell of its nearest centre, with its angle to it. By
the triangle inequality of angles no vector of a cell can be nearer to a question than the angle between question and
centre allows for, so cells are read in the order of that bound, and only while it can beat what has been found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..shipping import ship
from ..sources.tables import checkpoint_folder

#: Vectors that centres are fitted on, rounds of fitting, and most cells.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1_024
#: Questions that go to the tasks at once, rows that a task scores at once, and what angles may be wrong by.
QUESTIONS, ROWS, SLACK = 4_096, 1_024, 1e-7


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` directions that the sample lies around, by rounds of assignment and averaging."""
    c = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1)
        c[length > 0] = sums[length > 0] / length[length > 0, None]  # a centre without vectors stays where it is
    return c


def store_cells(vectors: DataFrame, path: str, *, id_col: str = "chunk_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> None:
    """Writes vectors to ``path``: vectors/ (id, v, angle, by cell), centres/ and cells/ (cell, n, low, high).

    Centres come from the ``sample`` vectors whose ids have the smallest hashes, ``cells`` of them (default: the root of
    the number of vectors, MOST_CELLS at most); every vector has its cell. A cell with any share of all vectors is
    written by many tasks. Null vectors, those with a null or a component that is no finite number, and those of length
    zero are nobody's neighbour and are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    own = own.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    some = own.withColumn("__h", F.xxhash64("id")).orderBy("__h", "id").limit(sample).select("v").collect()
    centres = np.zeros((1, 1))
    if some:
        x = _units(np.array([r["v"] for r in some]))
        n = own.count()
        centres = _centres(x, min(len(x), cells or min(MOST_CELLS, max(1, round(n**0.5)))))
    shared = spark.sparkContext.broadcast(centres)
    kind = StructType([own.schema["id"], own.schema["v"], StructField("angle", DoubleType()), StructField("cell", IntegerType())])
    out = to_arrow_schema(kind)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cos = _units(np.array(part.column("v").to_pylist())) @ c.T
                near = cos.argmax(1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(np.arccos(np.clip(cos.max(1), -1, 1))), pa.array(near.astype(np.int32))], schema=out)

    order = ["cell", "angle", F.xxhash64("id")]
    own.mapInArrow(placed, kind).repartitionByRange(*order).sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] if some else [], "cell int, v array<double>").write.parquet(f"{path}/centres")
    if some:
        spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).write.parquet(f"{path}/cells")


def search_cells(questions: DataFrame, path: str, *, qid: str = "qid", vector: str = "embedding", limit: int = 10, seen: dict | None = None) -> DataFrame:
    """(qid, id, score, rank): the rows of ``retrieval.vector_search`` over the stored vectors; equal scores by id.

    For each block of QUESTIONS questions, the cells with the nearest centres are read first, as many as have ``limit``
    vectors several times over; then those whose bound still reaches the worst of a question's best. ``seen``, if given,
    gets the pairs of question and vector that were scored, and that there are.
    """
    spark = questions.sparkSession
    ship(spark)
    facts = spark.read.parquet(f"{path}/centres").join(spark.read.parquet(f"{path}/cells"), "cell").orderBy("cell").collect() if not spark.read.parquet(f"{path}/centres").isEmpty() else []
    asked = questions.where(F.col(vector).isNotNull()).select(F.col(qid).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    if not facts:
        return asked.select(F.col("qid").alias(qid), F.lit(None).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    stored = spark.read.parquet(f"{path}/vectors")
    kind = StructType([asked.schema["qid"], stored.schema["id"], StructField("score", DoubleType())])
    cell, n, low, high = (np.array([r[c] for r in facts]) for c in ("cell", "n", "low", "high"))
    centres = np.array([r["v"] for r in facts])
    folder, blocks, done = f"{checkpoint_folder(spark)}/near-{uuid.uuid4().hex}", max(1, -(-asked.count() // QUESTIONS)), []
    kept = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.schema(df.schema).parquet(f"{folder}/{name}"))[1]
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    for b in range(blocks):
        rows = [r for r in asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect() if any(r["v"])]
        if not rows:
            continue
        q, own = _units(np.array([r["v"] for r in rows])), pa.array([r["qid"] for r in rows], to_arrow_schema(kind).field("qid").type)
        angle = np.arccos(np.clip(q @ centres.T, -1, 1))
        bound = np.maximum(np.maximum(angle - high, low - angle), 0)
        near = np.argsort(angle, axis=1, kind="stable")
        first = np.zeros_like(angle, bool)
        before = np.cumsum(n[near], axis=1) - n[near]
        np.put_along_axis(first, near, before < 4 * limit, axis=1)
        found = kept(best(_scored(stored, cell, q, own, first, limit, kind)), f"{b}-first")
        # The limit-th best of each question so far: what is below cannot be among its best any more.
        worst = {r["qid"]: r["score"] for r in found.where(F.col("rank") == limit).select("qid", "score").collect()}
        reach = np.array([worst.get(r["qid"], -2.0) for r in rows])
        more = ~first & (np.cos(np.minimum(bound, np.pi)) >= reach[:, None] - SLACK)
        if seen is not None:
            seen["scored"] = seen.get("scored", 0) + int(((first | more) * n).sum())
            seen["all"] = seen.get("all", 0) + int(n.sum()) * len(rows)
        if more.any():
            found = kept(best(found.drop("rank").unionByName(_scored(stored, cell, q, own, more, limit, kind))), f"{b}-all")
        done.append(found)
    if not done:
        return asked.join(stored.select("id").limit(0)).select(F.col("qid").alias(qid), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out.select(F.col("qid").alias(qid), "id", "score", "rank")


def _scored(stored: DataFrame, cell: np.ndarray, q: np.ndarray, qids: pa.Array, wanted: np.ndarray, limit: int, kind: StructType) -> DataFrame:
    """Each task's best of the questions that want its cells; cells that nobody wants are not opened."""
    spark = stored.sparkSession
    place = {int(c): i for i, c in enumerate(cell)}
    shared, out = spark.sparkContext.broadcast((q, qids, wanted, place)), to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qids, wanted, place = shared.value
        least = np.full(len(q), -np.inf)
        held: list[list] = [[], [], []]  # question, score and id of the best so far

        def trim() -> None:
            ask, score, ids = (np.concatenate(h) if h else np.zeros(0, np.int64) for h in held)
            rank = np.unique(ids, return_inverse=True)[1]
            order = np.lexsort((rank, -score, ask))
            ask, score, ids = ask[order], score[order], ids[order]
            nth = np.arange(len(ask)) - np.searchsorted(ask, ask)
            full = nth == limit - 1
            least[ask[full]] = score[full]
            for h, x in zip(held, (ask[nth < limit], score[nth < limit], ids[nth < limit]), strict=True):
                h[:] = [x]

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, ids = np.array(part.column("v").to_pylist()), np.array(part.column("id").to_pylist(), object)
                cells = np.array([place[c] for c in part.column("cell").to_pylist()])
                length = np.linalg.norm(x, axis=1)
                for c in np.unique(cells):
                    rows, ask = np.flatnonzero(cells == c), np.flatnonzero(wanted[:, c])
                    if len(ask):
                        score = np.round((x[rows] @ q[ask].T) / length[rows, None], 12)
                        r, a = np.nonzero(score >= least[ask])
                        for h, y in zip(held, (ask[a], score[r, a], ids[rows[r]]), strict=True):
                            h.append(y)
                trim()
        if held[0] and len(held[0][0]):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(held[0][0])), pa.array(held[2][0].tolist(), out.field(1).type), pa.array(held[1][0])], schema=out)

    some = [int(c) for c, w in zip(cell, wanted.any(0), strict=True) if w]
    return stored.where(F.col("cell").isin(some)).select("id", "v", "cell").mapInArrow(run, kind)
