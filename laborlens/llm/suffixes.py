"""Suffix-array dedup of repeated substrings by bucket-pointer refinement.

Suffixes are sorted to a depth of ``length`` bytes only: whether a string of that length starts anywhere
else depends on nothing further. Buckets are refined in three steps, and each step passes on only what is
not decided yet:

1. The first bucket of a suffix is the smallest identifier of the q-grams at its next offsets. Suffixes
   that follow one another mostly share it, so a run of them is one row (about one for 70 bytes).
   Buckets with one run hold no repeat.
2. Runs are refined by the identifier of the whole span they cover. Where all runs of a bucket agree,
   all their suffixes repeat.
3. What is left are runs at the edges of repeats. Their bytes meet bucket by bucket, and their suffixes
   are sorted by q-gram buckets, then by pairs of bucket identifiers at doubled offsets, each round using
   the identifiers of the round before, until the depth is reached.

A bucket with very many different runs is not gathered in one task: its suffixes are counted by the
identifier of their whole string in a distributed aggregate instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTE_CODE, POWERS, chunks, cut, mix, prefix_sums, span_hash

LENGTH = 200
GRAM = 64  # bytes of the q-grams that make the first buckets
BITMAP_BITS = 26  # size of the bitmap of repeated buckets: 8 MB, whatever the data
GATHER_RUNS = 2000  # most different runs of a bucket whose bytes meet in one task
CHUNK = 1 << 18
RUN_DDL = "v long, sp long, id long, h long, s int, n int, loose boolean"


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        a = pick(a[:-size], a[size:])
        size *= 2
    return pick(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def window_runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(bucket, start, end, span identifier, loose) of the runs of suffixes that share their first bucket.

    ``start`` to ``end`` are places of suffixes with ``length`` bytes inside one text. A run is loose if
    the q-gram of its bucket stands in it more than once, so it may repeat itself.
    """
    width = length - gram + 1
    places = len(raw) - length + 1
    if places <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64), none.astype(bool)
    sums = prefix_sums(BYTE_CODE[raw])
    down = POWERS.get(len(raw) + 1)[1]
    ids = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    least = _slide(ids, width, np.minimum)
    inside = np.zeros(places + 1, np.int32)
    starts = offsets[:-1]
    ends = np.maximum(offsets[1:] - length + 1, starts)
    np.add.at(inside, np.minimum(starts, places), 1)
    np.add.at(inside, np.minimum(ends, places), -1)
    valid = np.cumsum(inside)[:places] > 0
    change = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])])
    end = np.r_[change[1:], places]
    good = valid[change]
    start, end = change[good], end[good]
    bucket = least[start]
    if not len(start):
        return bucket, start, end, bucket, np.zeros(0, bool)
    # places of q-grams that are the smallest of some valid suffix
    padded = np.r_[np.zeros(width - 1, np.uint64), np.where(valid, least, 0), np.zeros(width - 1, np.uint64)]
    anchors = np.flatnonzero(_slide(padded, width, np.maximum) == ids)
    value = ids[anchors]
    names, of_anchor = np.unique(value, return_inverse=True)
    order = np.argsort(of_anchor, kind="stable")  # by value, then by place
    step = np.int64(len(raw) + width + 1)
    sorted_key = of_anchor[order] * step + anchors[order]
    of_run = np.searchsorted(names, bucket) * step
    seen = np.searchsorted(sorted_key, of_run + end + width - 1) - np.searchsorted(sorted_key, of_run + start)
    return bucket, start, end, span_hash(sums, start, end - 1 + length), seen > 1


def run_rows(docs: DataFrame, length: int, gram: int, bitmap=None) -> DataFrame:
    """Runs of all texts (id, h, text); with a broadcast ``bitmap``, those whose bucket may repeat or that are loose."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h"))
            for row, raw, offsets in chunks(batch.column("text"), CHUNK):
                bucket, start, end, span, loose = window_runs(raw, offsets, length, gram)
                if bits is not None:
                    spot = bucket >> np.uint64(64 - BITMAP_BITS)
                    hit = (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)
                    pick = (hit > 0) | loose
                    bucket, start, end, span, loose = (x[pick] for x in (bucket, start, end, span, loose))
                owner = np.searchsorted(offsets, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.astype(np.int64)), pa.array(span.astype(np.int64)), pa.array(ids[row + owner]),
                        pa.array(hashes[row + owner]), pa.array((start - offsets[owner]).astype(np.int32)),
                        pa.array((end - start).astype(np.int32)), pa.array(loose),
                    ],
                    ["v", "sp", "id", "h", "s", "n", "loose"],
                )

    return docs.mapInArrow(found, RUN_DDL)


def bucket_bitmap(buckets: DataFrame) -> np.ndarray:
    """Bits of the leading digits of all buckets, gathered as 64-bit words: at most 2**(BITMAP_BITS - 6) of them."""
    spot = F.shiftrightunsigned("v", 64 - BITMAP_BITS)
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, (spot % 64).cast("int"))
    words = buckets.select(F.shiftright(spot, 6).cast("int").alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    got = words.toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy().astype(np.uint64)
    return out


# --- the last refinement ------------------------------------------------------------------------


def refine(raw: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Bucket of every place whose ``length`` bytes lie in one text; places alone in a bucket, and others, have -1.

    Rounds sort places by (bucket, bucket at a later offset) and number the pairs; a place that is alone
    in its bucket is decided and takes no part in later rounds.
    """
    n = len(raw)
    end = np.repeat(offsets[1:], np.diff(offsets))
    depth = 8
    padded = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= padded[k : k + n] << np.uint64(8 * k)
    live = np.flatnonzero(np.arange(n) + length <= end)
    # every place that a later round looks at needs a bucket: those within the strings of live places
    bucket = np.full(n, -1, np.int64)
    known = np.flatnonzero(np.arange(n) + depth <= end)
    bucket[known] = np.unique(key[known], return_inverse=True)[1]
    while depth < length:
        further = min(depth, length - depth)
        known = known[known + depth + further <= end[known]]
        pair = bucket[known] * np.int64(n + 1) + bucket[known + further]
        if depth + further == length:
            known = live
            pair = bucket[known] * np.int64(n + 1) + bucket[known + further]
        _, number, count = np.unique(pair, return_inverse=True, return_counts=True)
        fresh = np.full(n, -1, np.int64)
        fresh[known] = number
        depth += further
        if depth == length:
            fresh[known[count[number] == 1]] = -1
        bucket = fresh
    return bucket


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[0::2], edge[1::2]


SPAN_DDL = "id long, h long, s int, e int"


def gathered(rows: DataFrame, length: int) -> DataFrame:
    """Spans that repeat, from (v, id, h, s, asks, bytes) rows that are dealt out and sorted by bucket."""

    def decide(part: list[tuple]) -> list[tuple]:
        raw = np.frombuffer(b"".join(r[5] for r in part), np.uint8)
        offsets = np.r_[0, np.cumsum([len(r[5]) for r in part])].astype(np.int64)
        repeats = refine(raw, offsets, length) >= 0
        out = []
        for k, r in enumerate(part):
            if r[4]:
                for a, b in zip(*_stretches(repeats[offsets[k] : offsets[k + 1]])):
                    out.append((r[1], r[2], r[3] + int(a), r[3] + int(b) - 1 + length))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        size, out = 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("v", "id", "h", "s", "asks", "bytes"))):
                if size > CHUNK and part[-1][0] != row[0]:  # whole buckets only
                    out += decide(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[5])
            yield _spans(out)
            out = []
        if part:
            yield _spans(decide(part))

    return rows.select("v", "id", "h", "s", "asks", "bytes").mapInArrow(run, SPAN_DDL)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "h", "s", "e"])


def counted_spans(rows: DataFrame, length: int) -> DataFrame:
    """The same for buckets with very many runs: whole strings are counted by identifier, spread over tasks."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (raw_bytes, id_, h, s, asks) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("bytes", "id", "h", "s", "asks")))
            ):
                raw = np.frombuffer(raw_bytes, np.uint8)
                at = np.arange(len(raw) - length + 1)
                w = span_hash(prefix_sums(BYTE_CODE[raw]), at, at + length).astype(np.int64)
                k = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w), pa.array(np.full(k, id_)), pa.array(np.full(k, h)), pa.array((s + at).astype(np.int32)), pa.array(np.full(k, asks))],
                    ["w", "id", "h", "s", "asks"],
                )

    all_ = cut(rows.mapInArrow(strings, "w long, id long, h long, s int, asks boolean"), "suffix-strings")
    twice = all_.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
    return all_.filter("asks").join(twice, "w").select("id", "h", "s", (F.col("s") + length).alias("e"))


def bytes_of(docs: DataFrame, asks: DataFrame, length: int) -> DataFrame:
    """(v, id, h, s, asks, hot, bytes) of the asked runs, cut from their texts."""
    lists = asks.groupBy("id", "h").agg(F.collect_list(F.struct("v", "s", "n", "asks", "hot")).alias("runs"))
    rows = only_documents(docs, lists.select("id", "h")).join(lists, ["id", "h"])

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for id_, h, text, runs in zip(b["id"], b["h"], b["text"], b["runs"]):
                yield pd.DataFrame(
                    [(r["v"], id_, h, r["s"], r["asks"], r["hot"], text[r["s"] : r["s"] + r["n"] - 1 + length]) for r in runs],
                    columns=["v", "id", "h", "s", "asks", "hot", "bytes"],
                )

    return rows.mapInPandas(cut_out, "v long, id long, h long, s int, asks boolean, hot boolean, bytes binary")


def only_documents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of (id, h, text) that are wanted, with few others: a bitmap of fixed size before the shuffle."""
    bits = 1 << 22
    spot = F.pmod(F.xxhash64("id", "h"), F.lit(bits))
    one = F.lit(1).cast("long")
    word, bit = F.floor(spot / 64).cast("int"), (spot % 64).cast("int")
    bitmap = wanted.select(word.alias("_word"), F.call_function("shiftleft", one, bit).alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    marked = docs.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bitmap), "_word")  # 65536 rows at most
    return marked.filter(F.call_function("shiftleft", one, F.col("_bit")).bitwiseAND(F.col("_mask")) != 0).select("id", "h", "text")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, h, s, e): spans of the texts (id, h, text) whose every string of ``length`` bytes starts elsewhere too.

    Spans may touch or overlap.
    """
    spark = docs.sparkSession
    buckets = run_rows(docs, length, gram).groupBy("v").agg(
        F.count("*").alias("c"), (F.min("sp") != F.max("sp")).alias("differ")
    )
    buckets = cut(buckets.filter("c > 1"), "suffix-buckets")
    bitmap = spark.sparkContext.broadcast(bucket_bitmap(buckets))
    runs = run_rows(docs, length, gram, bitmap).join(buckets, "v", "left").filter("c is not null or loose")
    runs = cut(runs, "suffix-runs")
    ends = F.col("s") + F.col("n") - 1 + length
    same = runs.filter("c is not null and not differ").select("id", "h", "s", ends.alias("e"))
    rest = runs.filter("c is null or differ").select("v", "sp", "id", "h", "s", "n")
    # runs with equal spans repeat throughout; one of them stands for all when others are compared
    kinds = rest.groupBy("v", "sp").agg(F.count("*").alias("k"), F.min(F.struct("id", "h", "s")).alias("one"))
    many = kinds.groupBy("v").agg((F.count("*") > GATHER_RUNS).alias("hot"))
    kinds = cut(kinds.join(many, "v"), "suffix-kinds")
    told = rest.join(kinds, ["v", "sp"])
    equal = told.filter("k > 1").select("id", "h", "s", ends.alias("e"))
    asks = told.filter(F.col("one") == F.struct("id", "h", "s")).select("v", "id", "h", "s", "n", (F.col("k") == 1).alias("asks"), "hot")
    pieces = cut(bytes_of(docs, asks.distinct(), length), "suffix-bytes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_bucket = pieces.filter("not hot").repartition(parts, "v").sortWithinPartitions("v")
    edges = gathered(by_bucket, length)
    crowded = counted_spans(pieces.filter("hot"), length)
    return same.unionByName(equal).unionByName(edges).unionByName(crowded)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same
    document too, is removed; all strings are judged on the input. ``spans`` are the maximal removed
    runs as (start, end) in bytes. A null text counts as empty; texts shorter than ``length`` keep all;
    repeated rows are texts like others, so each loses what the other repeats; rows that share an id keep
    their own texts; an empty table gives an empty result; other columns are not read.
    """
    nothing = F.lit(-(2**63)).cast("long")  # stands for a null id inside
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    named = docs.select(F.col(id_col).cast("long").alias("own"), text.alias("text"))
    rows = named.select(F.coalesce("own", nothing).alias("id"), F.xxhash64("text").alias("h"), "text")
    spans = cut(repeated_spans(rows, length), "suffix-spans")
    per = spans.groupBy("id", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    touched = only_documents(rows, per.select("id", "h")).dropDuplicates(["id", "h"]).join(per, ["id", "h"])

    def cut_away(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for id_, h, body, found in zip(b["id"], b["h"], b["text"], b["spans"]):
                cover = np.zeros(len(body) + 1, np.int32)
                np.add.at(cover, [x["s"] for x in found], 1)
                np.add.at(cover, [x["e"] for x in found], -1)
                gone = np.cumsum(cover)[:-1] > 0
                start, end = _stretches(gone)
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                spans_ = [{"s": int(x), "e": int(y)} for x, y in zip(start, end)]
                out.append((id_, h, int(gone.sum()), len(start), hashlib.sha256(kept).hexdigest(), spans_))
            yield pd.DataFrame(out, columns=["id", "h", "n_removed", "n_spans", "sha", "spans"])

    done = touched.mapInPandas(cut_away, "id long, h long, n_removed long, n_spans long, sha string, spans array<struct<s:int,e:int>>")
    plain = named.select(
        F.col("own"), F.coalesce("own", nothing).alias("id"), F.xxhash64("text").alias("h"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"),
    )
    joined = plain.join(done, ["id", "h"], "left")
    return joined.select(
        F.col("own").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
    )
