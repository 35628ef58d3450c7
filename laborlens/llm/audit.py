"""Filter interaction audit from truth-table survival words.

A filter is a bit. Of the 32 subsets of five filters a document survives those that hold none of the
filters it fails; these subsets are the set bits of its word. Carry-save adders count every bit
position of the words of a part and label, and all figures of the audit follow from these counts: no
order of the filters is ever applied to a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_DISTINCT = 65  # percent of the words
MAX_UPPER = 5  # percent of the code points
MARKS = "[#$%&*|]"
SUBSETS = 1 << len(FILTERS)
GROUPS = 4096  # (part, label) counters that a task holds before it hands them on
#: The word of each set of failed filters: bit S is set where S and the failed filters are apart.
WORDS = [sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)]


def failed_by_text(text: Column) -> dict[str, Column]:
    """Filters A to D over whole texts; null is the empty text. Empty texts fail A only."""
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, SPACE)  # one empty piece before leading space and one after trailing space
    first, last = (F.element_at(parts, k) == "" for k in (1, -1))
    words = F.size(parts) - first.cast("int") - (last & (F.size(parts) > 1)).cast("int")
    distinct = F.size(F.array_distinct(parts)) - (first | last).cast("int")
    upper = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return {
        "A": words < MIN_WORDS,
        "B": distinct * 100 < words * MIN_DISTINCT,
        "C": upper.cast("long") * 100 > F.length(t).cast("long") * MAX_UPPER,
        "D": t.rlike(MARKS),
    }


def bits(failed: dict[str, Column]) -> Column:
    return sum((c.cast("int") * (1 << FILTERS.index(f)) for f, c in failed.items()), F.lit(0))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` (uint32) have each of the 32 bits set, by carry-save adders.

    Three words of one weight become a sum of that weight and a carry of twice the weight, until at
    most two words of each weight are left.
    """
    counts, weight = np.zeros(32, np.int64), 1
    places = np.arange(32, dtype=np.uint32)
    while len(words):
        carries = []
        while len(words) >= 3:
            k = len(words) // 3
            a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * k :]])
        for word in words:
            counts += weight * ((word >> places) & np.uint32(1)).astype(np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each subset by part and label; one row of counts for each pair a task has seen."""
    held: dict[tuple[str, int], np.ndarray] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        counts = pa.array([held[k].tolist() for k in keys], pa.list_(pa.int64()))
        part = pa.array([p for p, _ in keys], pa.string())
        labels = [pa.array([bool(c & bit) for _, c in keys], pa.bool_()) for bit in (1, 2)]
        held.clear()
        return pa.RecordBatch.from_arrays([part, *labels, counts], ["part", "good", "toxic", "counts"])

    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * 4 + batch.column("label").to_numpy(zero_copy_only=False)
        words = batch.column("word").to_numpy(zero_copy_only=False).astype(np.uint32)
        order = np.argsort(code, kind="stable")
        seen, starts = np.unique(code[order], return_index=True)
        for value, same in zip(seen.tolist(), np.split(words[order], starts[1:]), strict=True):
            key = (coded.dictionary[value // 4].as_py(), value % 4)
            held[key] = held.get(key, 0) + positional_popcount(same)
        if len(held) >= GROUPS:
            yield out()
    if held:
        yield out()


def survivors(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """(part, docs, good, toxic): for each subset of the filters, in an array, how many documents survive it.

    Copies are found by a digest of the text and one aggregate of its least id. Rows then meet the
    first of their copies by (digest, id), so a text that fills a third of the table is spread out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        bits(failed_by_text(F.col(text_col))).alias("failed"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = cut(rows, "audit")  # texts are read once; what follows are a few dozen bytes a row
    named, nameless = rows.filter("id is not null"), rows.filter("id is null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marked = marked.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    label = F.coalesce(F.col("good").cast("int"), F.lit(0)) + 2 * F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    judged = (
        named.join(first, ["id", "digest"], "left").join(marked, "id", "left")
        .select("part", (F.col("failed") + copy).alias("failed"), label.alias("label"))
        # a row without an id is no copy of a smaller id, and has no label
        .unionByName(nameless.select("part", "failed", F.lit(0).alias("label")))
    )
    word = F.element_at(F.lit(WORDS), F.col("failed") + 1)
    counted = judged.select("part", "label", word.alias("word")).mapInArrow(
        _count, "part string, good boolean, toxic boolean, counts array<long>"
    )

    def total(only: Column) -> Column:
        return F.array(*[F.sum(F.when(only, F.col("counts")[s]).otherwise(F.lit(0))) for s in range(SUBSETS)])

    return counted.groupBy("part").agg(
        total(F.lit(True)).alias("docs"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic")
    )


def shapley(n: Column, bit: int) -> Column:
    """Removed by one filter, summed over all orders: each subset before it, as often as it comes first."""
    size = len(FILTERS)
    terms = []
    for s in range(SUBSETS):
        if not s & bit:
            k = s.bit_count()
            terms.append((n[s] - n[s | bit]) * F.lit(factorial(k) * factorial(size - 1 - k)))
    return sum(terms[1:], terms[0])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part, order of the filters and step, zeros included. A null text is empty, a null
    part the part ''. Repeated rows count as often as they stand there; rows of one id are not copies
    of each other, and a row without an id is nobody's copy and has no label. Of several labels of a
    document any 1 counts. Equal texts are those with equal SHA-256 digests. Empty documents give no
    rows; missing labels lose nothing. Other columns of either table are not read.
    """
    counts = survivors(docs, labels, id_col, text_col, part_col)
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    shares = F.array(*[shapley(F.col("docs"), 1 << k) for k in range(len(FILTERS))])
    steps = counts.withColumn("shares", shares).withColumn("filter_order", F.explode(orders))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def subset(letters: Column) -> Column:
        return sum(((F.instr(letters, f) > 0).cast("int") * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))

    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumns(
        {
            "_before": subset(F.substr("filter_order", F.lit(1), F.col("step") - 1)),
            "_bit": subset(letter),
            "_letter": F.instr(F.lit(FILTERS), letter),
        }
    )
    before, after = F.col("_before"), F.col("_before") + F.col("_bit")
    every = SUBSETS - 1
    removed = F.col("docs")[before] - F.col("docs")[after]
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.col("docs")[after].alias("kept"),
        removed.alias("removed"),
        (F.col("docs")[0] - F.col("docs")[F.col("_bit")] - removed).alias("redundant"),
        (F.col("docs")[F.lit(every) - F.col("_bit")] - F.col("docs")[every]).alias("unique_fails"),
        (F.col("good")[before] - F.col("good")[after]).alias("good_lost"),
        (F.col("toxic")[before] - F.col("toxic")[after]).alias("toxic_lost"),
        F.element_at("shares", F.col("_letter")).alias("shapley"),
    )
