"""Writers: raw archive and audit rows; keyed tables are in ``snapshots``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ARCHIVE_KEY = ["source_id", "external_id", "payload_hash"]


def archive_rows(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Raw payload rows not stored yet: one per source, id and payload hash."""
    rows = raw.withColumn("payload_hash", F.sha2("payload", 256)).dropDuplicates(ARCHIVE_KEY)
    return rows if stored is None else rows.join(stored.select(*ARCHIVE_KEY), ARCHIVE_KEY, "left_anti")


def match_audit(scored: DataFrame, model_version: Column) -> DataFrame:
    """One audit row per scored pair, also for pairs that are not stored."""
    return scored.select(
        F.lit("system").alias("actor_role"), F.lit("match.compute").alias("action"), F.lit("match").alias("entity_type"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("job_id").cast("string")).alias("entity_id"),
        model_version.alias("model_version"),
        F.struct(
            F.col("total_score").alias("score"), "label", "knocked_out", *[c for c in ("input_hash",) if c in scored.columns]
        ).alias("metadata"),
    )


def decision_audit(decisions: DataFrame) -> DataFrame:
    """One audit row per decision on a posting (job_id, new_status, note)."""
    return decisions.select(
        F.lit("admin").alias("actor_role"), F.concat(F.lit("job."), "new_status").alias("action"), F.lit("job").alias("entity_type"),
        F.col("job_id").cast("string").alias("entity_id"), F.lit(None).cast("int").alias("model_version"), F.struct("note").alias("metadata"),
    )


def write_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows, parted by action; what is particular to an action is JSON."""
    rows.withColumn("metadata", F.to_json("metadata")).write.mode("append").partitionBy("action").parquet(path)
