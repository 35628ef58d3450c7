"""Versioned tables: visibility, conflicts, reruns, and what a batch opens and writes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from laborlens.sources.snapshots import CommitConflict, SnapshotTable
from laborlens.streaming import jobs as J

ROWS = "k long, v string"


def content(df):
    return sorted(((r["k"], r["v"]) for r in df.collect()), key=str)


def test_versions_of_an_upsert(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert table.read() is None and table.manifest() is None
    first = [(k, "a") for k in range(40)] + [(None, "n")]
    assert table.upsert(spark.createDataFrame(first, ROWS)) == 0
    assert table.upsert(spark.createDataFrame([(3, "b"), (99, "c"), (None, "m")], ROWS)) == 1
    want = [(k, "a") for k in range(40) if k != 3] + [(3, "b"), (99, "c"), (None, "m")]
    assert content(table.read()) == sorted(want, key=str)
    assert content(table.read(0)) == sorted(first, key=str)  # the version before stays readable
    assert table.upsert(spark.createDataFrame([], ROWS)) == 2 and content(table.read()) == sorted(want, key=str)
    assert table.vacuum(keep=2) > 0 and content(table.read(1)) == sorted(want, key=str)


def test_a_commit_opens_and_writes_the_buckets_of_its_rows_only(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=32)
    table.upsert(spark.range(5000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    table.upsert(spark.createDataFrame([(7, "b")], ROWS))
    before, after = table.manifest(0), table.manifest(1)
    assert len(after["opened"]) == 1 and len(after["added"]) == 1
    assert sum(before["files"][b] != after["files"][b] for b in after["files"]) == 1
    assert table.read().count() == 5000 and table.added(1).count() < 5000 / 8


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.upsert(spark.createDataFrame([(1, "a")], ROWS))
    broken = spark.createDataFrame([(1, "x")], ROWS).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)

    def fails(old, new):
        return new.withColumn("v", F.raise_error(F.lit("merge lost")).cast("string"))

    with pytest.raises(Exception, match="merge lost"):
        table.upsert(spark.createDataFrame([(1, "x")], ROWS), merge=fails)
    assert table.versions() == [0] and content(table.read()) == [(1, "a")]
    assert table.upsert(spark.createDataFrame([(1, "b")], ROWS)) == 1 and content(table.read()) == [(1, "b")]


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=4) for _ in range(2))
    a.upsert(spark.createDataFrame([(1, "a")], ROWS))
    with pytest.raises(CommitConflict):

        def late(old, new):  # the other writer commits while this one is at work
            a.upsert(spark.createDataFrame([(2, "a")], ROWS))
            return new

        b.upsert(spark.createDataFrame([(1, "b")], ROWS), merge=late)
    assert content(a.read()) == [(1, "a"), (2, "a")]


def test_append_keeps_one_row_a_key(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.append(spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], ROWS), ("w", 0))
    assert table.append(spark.createDataFrame([(1, "b"), (2, "b"), (None, "x")], ROWS), ("w", 1)) == 1
    assert content(table.added(1)) == [(2, "b")]
    assert table.append(spark.createDataFrame([(9, "again")], ROWS), ("w", 1)) == 1  # a batch that was committed already
    assert content(table.read()) == sorted([(1, "a"), (2, "b"), (None, "n")], key=str)
    assert table.append(spark.createDataFrame([(9, "other")], ROWS), ("x", 0)) == 2  # another writer counts on its own
    assert content(table.added(2)) == [(9, "other")]


def events(seed, n, pairs):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        user, job = rnd.choice(pairs)
        rows.append({"event_id": seed * 10_000 + k, "user_id": user, "job_id": job, "type": rnd.choice(["saved", "applied", "dismissed"]),
                     "created_at": f"2026-01-{rnd.randrange(1, 28):02d}T00:00:00Z"})
    return rows


def test_feedback_stream_follows_the_batch(spark, tmp_path):
    land, dirs = tmp_path / "land", [str(tmp_path / n) for n in ("state", "ckpt")]
    land.mkdir()
    every = [(u, j) for u in range(30) for j in range(10)]
    batches = [events(1, 900, every), events(2, 40, [(1, 1)]), events(3, 40, [(1, 1), (2, 2)])]
    for k, rows in enumerate(batches):
        (land / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows))
        J.stream_latest_feedback(spark, str(land), *dirs, buckets=32).awaitTermination()
    table = J.feedback_table(spark, dirs[0])
    best = {}
    for r in (r for rows in batches for r in rows):
        key = (r["user_id"], r["job_id"])
        best[key] = max(best.get(key, ("", 0, "")), (r["created_at"], r["event_id"], r["type"]))
    assert {(r["user_id"], r["job_id"]): r["type"] for r in table.read().collect()} == {k: v[2] for k, v in best.items()}
    assert table.versions() == [0, 1, 2]
    assert len(table.manifest(1)["added"]) == 1 and len(table.manifest(2)["added"]) <= 2  # of 32 buckets


def test_a_new_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    land, dirs = tmp_path / "land", [str(tmp_path / n) for n in ("archive", "canon")]
    land.mkdir()
    for again in range(2):  # with the second checkpoint the old file comes again, together with a new one, as batch 0
        rows = [{"source_id": "s", "external_id": str(k), "payload": f"p{k}"} for k in range(again * 20, again * 20 + 20)]
        (land / f"{again}.json").write_text("\n".join(map(json.dumps, rows)))
        J.stream_ingest(spark, str(land), *dirs, str(tmp_path / f"ckpt{again}"), lambda d: d.select("external_id")).awaitTermination()
        want = 20 * (again + 1)
        assert J.archive_table(spark, dirs[0]).read().count() == want and spark.read.parquet(dirs[1]).count() == want
    assert len(J.archive_table(spark, dirs[0]).manifest()["writers"]) == 2
