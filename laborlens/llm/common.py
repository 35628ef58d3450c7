"""Reading tables, scratch tables in the shared folder, and vectorised word hashing for Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1 << 20  # text handled by one round of array operations inside a task


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset (tests), the warehouse folder is used; never a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs survive lost executors.

    What earlier writes shuffled is not needed again; collections on both sides of the driver, before
    the write, let Spark's cleaner drop these files now and not some time later.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- bytes of a column of texts -----------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + (1 << 16))
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer with good avalanche; works on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums of code * base**place before each place; differences give hashes of any span."""
    up, _ = POWERS.get(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span stands."""
    _, down = POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``limit`` bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


# --- words ----------------------------------------------------------------------------------------

_is_word = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _is_word[_a:_b] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text, with the total at the end).

    A word is a run of ASCII letters, digits and non-ASCII bytes; texts are lower-cased before.
    """
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _is_word[raw]
    edge = inside[1:] != inside[:-1]
    cutting = np.unique(offsets[1:-1])  # texts touch: a word never crosses from one to the next
    cutting = cutting[(cutting > 0) & (cutting < len(raw))]
    both = cutting[inside[cutting] & inside[cutting + 1]]
    places = np.flatnonzero(edge)
    if len(both):
        places = np.sort(np.concatenate([places, both, both]))
    start, end = places[0::2], places[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes = span_hash(prefix_sums(BYTE_CODE[raw]), start, end)
    return hashes, np.searchsorted(start, offsets, "left")


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words (as if all words were one text)."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(BASE)
        out += word_hashes[k : k + m]
    return mix(out)
