"""Versioned keyed tables in a shared folder: data first, then a manifest that makes a version visible.

A table is a folder with ``data/`` and ``manifests/``. Rows lie in hash buckets of their key. A commit writes new
files and then renames one small manifest into place; the manifest names, for every bucket, the folders that
hold its rows. Until that rename, and if a writer dies before it, readers see the version before. Buckets that
a commit does not touch keep their folders, so the bytes read and written follow the incoming rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET = "snapshot_bucket"
BUCKETS = 64
Batch = tuple[str, int]  # a writer and the number of its batch


class CommitConflict(RuntimeError):
    """Another writer made the version first; its rows are not in this one, so the commit must be done again."""


class SnapshotTable:
    """A table of versions. ``buckets`` bounds the size of a manifest; choose it by the size of the table.

    The first commit fixes keys, columns and the number of buckets. A key may be null: null keys are equal.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # --- reading ---------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        names = (n for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit())
        return sorted(int(n[:-5]) for n in names)

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the last one; None where there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            return None
        stream = self._fs.open(self._path(f"{self.root}/manifests/{known[-1] if version is None else version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _open(self, folders: list[str], schema: dict) -> DataFrame:
        kind = StructType.fromJson(schema)
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None before the first commit."""
        m = self.manifest(version)
        return None if m is None else self._open(sorted({f for fs in m["files"].values() for f in fs}), m["schema"])

    def added(self, version: int) -> DataFrame | None:
        """The rows that a commit wrote: the touched buckets of an upsert, the new rows of an append."""
        m = self.manifest(version)
        return None if m is None else self._open(m["added"], m["schema"])

    # --- writing ---------------------------------------------------------------------------

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows by bucket; (bucket, folder) of what was written. At most ``buckets`` names reach the driver.

        With more shuffle partitions than buckets a bucket is split into several files, each by its own task.
        """
        splits = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int"))
        split = F.pmod(F.xxhash64(F.lit(BUCKET), *self.keys), F.lit(splits))
        folder = f"data/{uuid.uuid4().hex}"
        placed.repartition(F.col(BUCKET), split).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        names = [n for n in self._names(f"{self.root}/{folder}") if n.startswith(f"{BUCKET}=")]
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in names}

    def _publish(self, version: int, body: dict) -> int:
        folder, name = f"{self.root}/manifests", f"{version:020d}.json"
        self._fs.mkdirs(self._path(folder))
        draft = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:  # without the overwrite option a rename fails where the target exists
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(f"{folder}/{name}")), none)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise CommitConflict(f"version {version} of {self.root} exists") from e
            raise
        return version

    def _commit(
        self, incoming: DataFrame, batch: Batch | None, fold: Callable[[DataFrame | None, DataFrame], DataFrame], replace: bool
    ) -> int:
        last = self.manifest()
        number = last["version"] + 1 if last else 0
        writers = dict(last["writers"]) if last else {}
        if batch:
            done = writers.get(batch[0])
            if done and done["batch"] >= batch[1]:
                return done["version"]  # committed before a restart
            writers[batch[0]] = {"batch": batch[1], "version": number}
        buckets = last["buckets"] if last else self.buckets
        if last and last["keys"] != self.keys:
            raise ValueError(f"{self.root} has the keys {last['keys']}")
        files = dict(last["files"]) if last else {}
        columns = incoming.columns
        staged = self._write(incoming, buckets)
        schema = last["schema"] if last else json.loads(incoming.schema.json())
        fresh = self._open(list(staged.values()), schema).select(*columns)
        touched = [f for b in staged for f in files.get(b, [])]
        old = self._open(touched, schema).select(*columns) if touched else None
        written = self._write(fold(old, fresh).select(*columns), buckets) if staged else {}
        if replace:
            for b in staged:
                files.pop(b, None)
        for b, folder in written.items():
            files[b] = [*files.get(b, []), folder]
        return self._publish(
            number,
            {"version": number, "writers": writers, "keys": self.keys, "buckets": buckets, "schema": schema, "files": files,
             "added": sorted(written.values()), "opened": sorted(touched)},
        )

    def upsert(
        self, incoming: DataFrame, batch: Batch | None = None, merge: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None
    ) -> int:
        """Commit a version in which incoming rows replace stored rows with the same key.

        ``merge(stored, incoming)`` says otherwise how both become the new rows of the touched buckets; stored is None
        where nothing is. ``batch`` names a writer and the number of its batch: the last batch of a writer may be run
        again and is not committed twice.
        """
        return self._commit(incoming, batch, merge or (lambda old, new: replaced(old, new, self.keys)), True)

    def append(self, incoming: DataFrame, batch: Batch | None = None) -> int:
        """Commit a version with the incoming rows whose key is not stored yet, one a key; stored files stay."""
        return self._commit(incoming, batch, lambda old, new: missing(old, new, self.keys), False)

    def vacuum(self, keep: int = 1) -> int:
        """Drop the data folders that none of the last ``keep`` versions names; readers of older versions must be done.

        Staged rows of commits, and files of writers that died, go this way. Returns the number of dropped folders.
        """
        kept = set()
        for v in self.versions()[-keep:]:
            m = self.manifest(v)
            kept |= {f.split("/")[1] for f in [*m["added"], *(f for fs in m["files"].values() for f in fs)]}
        old = [n for n in self._names(f"{self.root}/data") if n not in kept]
        for n in old:
            self._fs.delete(self._path(f"{self.root}/data/{n}"), True)
        return len(old)


def _same(keys: list[str], a: str, b: str):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.alias("_a").join(others.select(*keys).alias("_b"), _same(keys, "_a", "_b"), "left_anti")


def replaced(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those of incoming keys, and the incoming rows; incoming keys must be unique."""
    return new if old is None else _without(old, new, keys).unionByName(new)


def missing(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """One incoming row for every key that is not stored."""
    one = new.dropDuplicates(keys)
    return one if old is None else _without(one, old, keys)


__all__ = ["BUCKETS", "CommitConflict", "SnapshotTable", "missing", "replaced"]
