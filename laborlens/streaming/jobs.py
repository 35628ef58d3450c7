"""Feeds and feedback as streams; each micro-batch runs the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.skew import latest
from ..sources.sinks import ARCHIVE_KEY
from ..sources.snapshots import BUCKETS, SnapshotTable

RAW = "source_id string, external_id string, payload string"


def _files(spark: SparkSession, schema: str, landing: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(landing)


def _batch(df: DataFrame, batch_id: int) -> tuple[str, int]:
    """The stream, by the id that its checkpoint holds, and the batch: a new checkpoint is a new writer."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), batch_id


def archive_table(spark: SparkSession, archive: str, buckets: int = BUCKETS) -> SnapshotTable:
    """The raw archive: one row per source, id and payload hash."""
    return SnapshotTable(spark, archive, ARCHIVE_KEY, buckets)


def stream_ingest(
    spark: SparkSession, landing: str, archive: str, canonical: str, checkpoint: str,
    to_canonical: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """New feed files to the raw archive and to canonical rows, once per source, id and payload.

    The archive is a bucketed snapshot table with one version per batch and one writer at a time. A batch opens the buckets that its
    keys fall into and no others, and adds files without touching stored ones. A batch that is run again after a
    failure finds its version, or makes it; canonical rows follow from the rows that the version added and are
    written again to the same folder (``version=<n>``), so neither output ever holds a row twice.
    """
    table = archive_table(spark, archive, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        version = table.append(batch.withColumn("payload_hash", F.sha2("payload", 256)), _batch(batch, batch_id))
        to_canonical(table.added(version)).write.mode("overwrite").parquet(f"{canonical}/version={version}")

    feed = _files(spark, RAW, landing, files_per_batch)
    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FEEDBACK = "event_id long, user_id long, job_id long, type string, created_at timestamp"
FEEDBACK_KEY = ["user_id", "job_id"]


def merge_feedback(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Latest event per user and posting over the stored state and a new batch."""
    cols = ["user_id", "job_id", "created_at", "event_id", "type"]
    rows = batch.select(*cols) if state is None else state.select(*cols).unionByName(batch.select(*cols))
    return latest(rows, FEEDBACK_KEY, ["created_at", "event_id"], ["created_at", "event_id", "type"])


def feedback_table(spark: SparkSession, state: str, buckets: int = BUCKETS) -> SnapshotTable:
    return SnapshotTable(spark, state, FEEDBACK_KEY, buckets)


def stream_latest_feedback(
    spark: SparkSession, landing: str, state: str, checkpoint: str, files_per_batch: int | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the current feedback per key in a bucketed snapshot table, one version per batch.

    A batch is combined to one row per key first, then merged into the buckets it falls into; all other buckets keep
    their files. The merge takes the latest event, so a batch that is run again changes nothing.
    """
    table = feedback_table(spark, state, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        table.upsert(merge_feedback(None, batch), _batch(batch, batch_id), merge_feedback)

    events = _files(spark, FEEDBACK, landing, files_per_batch)
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = [
    "ARCHIVE_KEY", "FEEDBACK", "FEEDBACK_KEY", "RAW", "archive_table", "feedback_table", "merge_feedback", "stream_ingest",
    "stream_latest_feedback",
]
