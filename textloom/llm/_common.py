"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..shipping import ship
from ..sources.tables import checkpoint_folder

#: A broadcast is asked for only below this many bytes, measured or bounded beforehand.
BROADCAST_BYTES = 32 << 20
#: Rows of text handled at once inside a task.
SLICE_ROWS = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Only a local session may do without one and gets a temporary folder."""
    return checkpoint_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables of one run in the shared folder. Each is read from there, so a lost executor loses nothing of it, and goes once its readers have ended."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}.parquet"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = SLICE_ROWS, carry: str | None = None) -> DataFrame:
    """``fn`` over slices of at most ``rows`` rows; it returns the columns of ``schema`` by name.

    The column ``carry`` is handed through as it is, last.
    """
    ship(df.sparkSession)
    kind = _parse_datatype_string(schema)
    if carry:
        kind = kind.add(df.schema[carry])
    out = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cols = fn(part) | ({carry: part.column(carry)} if carry else {})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=out.field(k).type) for k, x in ((f.name, cols[f.name]) for f in out)], schema=out)

    return df.mapInArrow(run, kind)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def frequency_sketch(df: DataFrame, cells: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often the 64-bit numbers of all rows occur, in ``cells`` counters by their low bits: never less than the truth, at most more.

    A task adds up its own rows and sends its counters in blocks, which are summed by block: what moves does not depend
    on the rows, and what reaches the driver is ``cells`` numbers. ``cells`` is a power of two. Blocks go packed, first
    the low bytes of all counters, then the others, which are mostly 0.
    """
    size = min(cells, 1 << 14)
    pack = lambda x: zstandard.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
    unpack = lambda b: np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.uint32)
        for batch in batches:
            for x in hashes(batch):
                own = (x & np.uint64(cells - 1)).view(np.int64)
                if len(own) * 16 < cells:
                    cell, n = np.unique(own, return_counts=True)
                    held[cell] += n.astype(np.uint32)
                else:
                    held += np.bincount(own, minlength=cells).astype(np.uint32)
        blocks = held.reshape(-1, size)
        some = np.flatnonzero(blocks.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pack(blocks[i]) for i in some], pa.binary())], ["block", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        held = np.zeros(size, np.uint64)
        for x in table["counts"].to_pylist():
            held += unpack(x)
        most = np.minimum(held, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([pack(most)], pa.binary())})

    ship(df.sparkSession)
    out = np.zeros(cells, np.uint32)
    for r in df.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r["block"] * size : (r["block"] + 1) * size] = unpack(r["counts"])
    return out


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately; never more than ``most`` of them."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once for each row, also where ``then`` uses it inside a lambda."""
    return F.transform(F.array(value), then)[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Just the columns an operator needs, under fixed names, so that others cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in more))
