"""Continuous ingestion: a stream of documents becomes chunks, and the newest version of each document counts.

Every micro-batch writes folders of its own and overwrites just those, so a batch that runs twice after a failure leaves
the same rows. Beside the chunks it writes a row for each document's version, also for one that has no chunk, so an
emptied document stops serving its old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import plain_chunks


def newest_documents(docs: DataFrame, version: str | None = None) -> DataFrame:
    """One row for each doc_id: that of the greatest ``version`` (null is smallest), ties by text, then source, null last.

    Rows are reduced by the tasks that have them, so a document that comes a million times is no hot key.
    """
    row = F.struct(F.col(version).alias("version") if version else F.lit(0).cast("long").alias("version"), "text", *(F.col(c) for c in docs.columns if c not in ("doc_id", "text", version)))
    newest = docs.groupBy("doc_id").agg(F.max(row).alias("r"))
    return newest.select("doc_id", F.col("r.version").alias("__version"), *(F.col(f"r.{c}").alias(c) for c in ["text"] + [c for c in docs.columns if c not in ("doc_id", "text", version)]))


def ingest(docs: DataFrame, path: str, checkpoint: str, most: int = 1600, version: str | None = None) -> StreamingQuery:
    """Starts a stream (doc_id, text, source) that stops when all that is there has been read.

    ``version`` names a column that orders the versions of a document, whenever they arrive; without it the batch does.
    A document whose newest text is null or empty is deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = newest_documents(batch, version).persist()
        plain_chunks(newest.drop("__version").where(F.coalesce("text", F.lit("")) != ""), most).write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        newest.select(F.col("doc_id").alias("doc_key"), F.col("__version").alias("version")).write.mode("overwrite").parquet(f"{path}/versions/batch={batch_id}")
        newest.unpersist()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each document's newest version; of equal versions, those of the later batch."""
    newest = spark.read.parquet(f"{path}/versions").groupBy("doc_key").agg(F.max(F.struct("version", "batch")).alias("v")).select("doc_key", F.col("v.batch").alias("batch"))
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/chunks")
    return rows.join(newest, ["doc_key", "batch"]).drop("batch")


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n_events, total) of tumbling windows; works on streams, whose late rows are bounded by the watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total_cents"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total_cents")
