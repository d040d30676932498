"""Hard negatives by distributed radix selection.

For each anchor and positive, the best rows of a window of scores are wanted. Nobody sorts the scores: tasks count them
in buckets by their leading digit, the counts are summed, and the bucket that holds the k-th row is found; the next
round counts by the next digit inside that bucket alone, and so on. Ties of a score are told apart by the digits of the
id. Once so few rows are left that they can be taken whole, only those that qualify are gathered and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from ._common import Scratch

#: Values of one digit.
BASE = 1024
#: A bucket is split no further once it holds at most so many rows beyond those wanted from it.
SPARE = 64
#: Anchors and what is known of their windows go to tasks in blocks of about so many bytes; the rows are read once for each block.
BLOCK_BYTES = 16 << 20
#: A task adds up its bucket counts until it holds so many different ones, then sends them.
HELD = 1 << 20
#: Scores are worked on in tiles of so many rows by so many anchors.
TILE = 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of ``x`` with rows of ``y``. Those beyond the range of a long count as its ends."""
    most = x.shape[1] * int(max(-int(x.min(initial=0)), int(x.max(initial=0)))) * int(max(-int(y.min(initial=0)), int(y.max(initial=0))))
    if most < 1 << 24:
        return x.astype(np.float32) @ y.astype(np.float32).T
    if most < 1 << 53:
        return x.astype(np.float64) @ y.astype(np.float64).T
    if most < 1 << 62:
        return x @ y.T
    return np.array([[min(max(int(s), _LEAST + 1), _MOST) for s in r] for r in x.astype(object) @ y.astype(object).T], np.int64).reshape(len(x), len(y))


class Windows:
    """What is known of the windows of a block of anchors, ``slots`` for each: which rows are still candidates for the k-th place.

    A row's key is (minus score, id, row); smaller comes first. ``part`` says which part of the key is being told apart,
    ``low`` and ``high`` between which of its values the k-th row lies, ``score`` and ``id`` what the parts before are.
    ``first`` is where the window begins, ``need`` how many rows are wanted from between ``low`` and ``high``.
    """

    def __init__(self, anchors: dict, slots: int, same: bool, low: np.ndarray, high: np.ndarray, need: int, base: int, spare: int):
        self.row, self.id, self.label, self.vector = (anchors[c] for c in ("row", "id", "label", "vector"))
        self.slots, self.same, self.base, self.spare = slots, same, base, spare
        self.low, self.high, self.first = low.astype(np.int64), high.astype(np.int64), low.astype(np.int64).copy()
        n = len(low)
        self.part, self.score, self.tied = np.zeros(n, np.int8), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.need, self.open = np.full(n, need), low <= high
        self.some = self.open.copy()

    def width(self) -> np.ndarray:
        return np.array([-(-(int(b) - int(a) + 1) // self.base) for a, b in zip(self.low, self.high, strict=True)], np.uint64)

    def narrow(self, found: dict[int, tuple[int, int, int]], ends: tuple[tuple[int, int], ...]) -> None:
        """One digit further: ``found`` has (bucket, rows before it, rows in it) by window; a window without has fewer rows than wanted, and keeps all."""
        widths = self.width()
        for w in np.flatnonzero(self.open).tolist():
            if w not in found:
                self.open[w] = False
                continue
            bucket, before, inside = found[w]
            width, low = int(widths[w]), int(self.low[w]) + bucket * int(widths[w])
            high = min(int(self.high[w]), low + width - 1)
            self.need[w] -= before
            self.low[w], self.high[w] = low, high
            if inside <= self.need[w] + self.spare:
                self.open[w] = False
            elif low == high:
                if self.part[w] == 0:
                    self.score[w] = low
                else:
                    self.tied[w] = low
                self.part[w] += 1
                self.low[w], self.high[w] = ends[self.part[w] - 1]


def _pairs(own: Windows, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, wanted: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
    """(window, minus score, position of the row) wherever a score is between a wanted window's ``first`` and ``last``."""
    n, slots = len(own.row), own.slots
    if not n:
        return
    most = np.where(wanted, -own.first, _LEAST).reshape(n, slots).max(1)
    least = np.where(wanted, -last, _MOST).reshape(n, slots).min(1)
    some = np.flatnonzero(wanted.reshape(n, slots).any(1))
    for at in range(0, len(some), TILE):
        j = some[at : at + TILE]
        s = _products(x, own.vector[j])
        ok = (labels[:, None] == own.label[None, j]) == own.same
        ok &= (s >= least[j]) & (s <= most[j])
        if own.same:
            ok &= rows[:, None] != own.row[None, j]
        r, c = np.nonzero(ok)
        key, anchor = -(s[r, c].astype(np.int64)), j[c]
        for slot in range(slots):
            w = anchor * slots + slot
            k = np.flatnonzero(wanted[w] & (key >= own.first[w]) & (key <= last[w]))
            yield w[k], key[k], r[k]


def _scan(table: DataFrame, own: Windows, dim: int, fn: Callable, schema: str) -> DataFrame:
    """``fn`` over the tiles of a task's rows; the windows go to the tasks as a broadcast of bounded size."""
    spark = table.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(own)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                yield *(part.column(c).to_numpy() for c in ("id", "row", "label")), _matrix(part.column("vector"), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(sent.value, tiles(batches)):
            yield pa.RecordBatch.from_pydict(out)

    return table.mapInArrow(run, schema)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of ``dim`` numbers; shorter ones go on with zeros."""
    sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _last_scores(own: Windows) -> np.ndarray:
    """The last minus score that a window's candidates can have."""
    return np.where(own.part == 0, own.high, own.score)


def _select(table: DataFrame, own: Windows, dim: int, ends: tuple) -> None:
    """Narrows all windows, digit by digit, until the rows that are left can be gathered."""

    def counts(own: Windows, tiles: Iterator[tuple]) -> Iterator[dict]:
        last, width, base = _last_scores(own), own.width(), np.uint64(own.base)
        cells, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for ids, rows, labels, x in tiles:
            for w, key, r in _pairs(own, ids, rows, labels, x, own.open, last):
                part = own.part[w]
                value = np.where(part == 0, key, np.where(part == 1, ids[r], rows[r]))
                ok = (value >= own.low[w]) & (value <= own.high[w]) & ((part == 0) | (key == own.score[w])) & ((part < 2) | (ids[r] == own.tied[w]))
                w, value = w[ok], value[ok]
                bucket = (value - own.low[w]).view(np.uint64) // width[w]
                cell, n = np.unique(w.astype(np.uint64) * base + bucket, return_counts=True)
                cells, sums = _added(np.concatenate([cells, cell]), np.concatenate([sums, n]))
                if len(cells) > HELD:
                    yield _cells(cells, sums, base)
                    cells, sums = cells[:0], sums[:0]
        if len(cells):
            yield _cells(cells, sums, base)

    while own.open.any():
        need = own.need
        sums = _scan(table, own, dim, counts, "window long, bucket long, n long").groupBy("window", "bucket").agg(F.sum("n").alias("n"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("window").orderBy("bucket")))
        # `need` differs by window only after the first digit; the few windows of a block travel as a small table.
        spark = table.sparkSession
        wanted = spark.createDataFrame(pa.table({"window": pa.array(np.flatnonzero(own.open).astype(np.int64)), "need": pa.array(need[own.open].astype(np.int64))}))
        found = upto.join(wanted, "window").where("upto >= need AND upto - n < need").select("window", "bucket", (F.col("upto") - F.col("n")).alias("before"), "n").collect()
        own.narrow({r["window"]: (r["bucket"], r["before"], r["n"]) for r in found}, ends)


def _added(cells: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, with the sum of its numbers."""
    order = np.argsort(cells, kind="stable")  # both halves are in order already, which this sort makes use of
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    return cells[first], np.add.reduceat(sums[order], first) if len(first) else sums[:0]


def _cells(cells: np.ndarray, sums: np.ndarray, base: np.uint64) -> dict:
    return {"window": (cells // base).astype(np.int64), "bucket": (cells % base).astype(np.int64), "n": sums.astype(np.int64)}


def _gather(table: DataFrame, own: Windows, dim: int, k: int) -> DataFrame:
    """The first ``k`` rows of each window: window, rank, id, row, score."""

    def rows_of(own: Windows, tiles: Iterator[tuple]) -> Iterator[dict]:
        last = _last_scores(own)
        for ids, rows, labels, x in tiles:
            for w, key, r in _pairs(own, ids, rows, labels, x, own.some, last):
                part, i, n = own.part[w], ids[r], rows[r]
                tie = (part > 0) & (key == own.score[w])
                ok = ~tie | np.where(part == 1, i <= own.high[w], (i < own.tied[w]) | (i == own.tied[w]) & (n <= own.high[w]))
                if ok.any():
                    yield {"window": w[ok].astype(np.int64), "id": i[ok], "row": n[ok], "score": -key[ok]}

    found = _scan(table, own, dim, rows_of, "window long, id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame, *, anchor: Column | None = None, positives: int = 5, k: int = 10, least: int = 30, most: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_bytes: int = BLOCK_BYTES, base: int = BASE, spare: int = SPARE,
) -> DataFrame:
    """For each anchor and each of its positives, the best negatives that are neither too easy nor too hard.

    Components become floor(``scale`` * x), a score is the integer inner product with the anchor. Positives are the first
    ``positives`` other rows of the anchor's label; negatives are the first ``k`` rows of another label with
    ``least`` * positive_score <= 100 * negative_score <= ``most`` * positive_score. Higher scores come first, ties by
    smaller id. ``anchor`` says which rows are anchors (default: an id divisible by 100). Returns anchor_id, positive_id,
    rank, negative_id, positive_score and negative_score.

    All rows are scored against all anchors, exactly; nothing is sampled or capped. A task holds one tile of scores, and
    what tasks send is bucket counts (``base`` buckets for each digit), summed before they meet, then at most ``k`` +
    ``spare`` rows for each window, however many rows share a score or an id. Anchors go out in blocks of ``block_bytes``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows are told apart by where
    they are: one that repeats an id is another row. Shorter vectors count as if they went on with zeros. An empty table,
    an anchor without others of its label, a positive without negatives in its window: no rows. Components and scores
    beyond the range of a long count as its ends.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "negatives")
    vector = F.col("vector")
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), (F.col(id_col) % 100 == 0 if anchor is None else anchor).alias("anchor"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    table = scratch.write(clean.select("id", "label", F.transform(vector, lambda x: F.floor(x * scale).cast("long")).alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")))
    facts = table.agg(F.max(F.size("vector")).alias("dim"), F.max(F.array_max("vector")).alias("most"), F.min(F.array_min("vector")).alias("least"), F.min("id").alias("a"), F.max("id").alias("b"), F.max("row").alias("c"), F.count_if("anchor").alias("n")).first()
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts["n"]:
        scratch.drop(table)
        return spark.createDataFrame([], names)
    dim, ends = facts["dim"], ((facts["a"], facts["b"]), (0, facts["c"]))
    edge = min(max(dim, 1) * max(facts["most"] or 0, -(facts["least"] or 0)) ** 2, _MOST)
    blocks = math.ceil(facts["n"] * (8 * dim + 64 * positives) / block_bytes)
    anchors, done = table.where("anchor"), []
    for b in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "id", "label", "vector").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        block = {c: own.column(c).to_numpy() for c in ("row", "id", "label")} | {"vector": _matrix(own.column("vector").combine_chunks(), dim)}
        done.append(scratch.write(_block(table, block, dim, ends, edge, positives, k, least, most, base, spare)))
    out = done[0]
    for t in done[1:]:
        out = out.union(t)
    scratch.drop(table)
    return out


def _block(table: DataFrame, block: dict, dim: int, ends: tuple, edge: int, positives: int, k: int, least: int, most: int, base: int, spare: int) -> DataFrame:
    n = len(block["row"])
    near = Windows(block, 1, True, np.full(n, -edge), np.full(n, edge), positives, base, spare)
    _select(table, near, dim, ends)
    # At most `positives` rows for each anchor of the block.
    ids, scores, there = np.zeros(n * positives, np.int64), np.zeros(n * positives, np.int64), np.zeros(n * positives, bool)
    for r in _gather(table, near, dim, positives).collect():
        w = r["window"] * positives + r["rank"] - 1
        ids[w], scores[w], there[w] = r["id"], r["score"], True
    low = np.array([-(most * int(s) // 100) for s in scores], np.int64)
    high = np.array([-least * int(s) // 100 for s in scores], np.int64)
    low[~there], high[~there] = 1, 0
    hard = Windows(block, positives, False, low, high, k, base, spare)
    _select(table, hard, dim, ends)
    found = _gather(table, hard, dim, k)
    of = np.repeat(block["id"], positives)
    windows = pa.table({"window": np.flatnonzero(there).astype(np.int64), "anchor_id": of[there], "positive_id": ids[there], "positive_score": scores[there]})
    return found.join(table.sparkSession.createDataFrame(windows), "window").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
