"""Benchmark decontamination by greedy string tiling.

Rolling Karp-Rabin hashes of ``MIN_MATCH`` words of a benchmark item and of a document that agree are
seeds. Seeds whose words before differ begin matches; the longest are marked first, words that are marked are
never used again, and what is left of a match is matched again. The share of an item's words under
tiles does not depend on their order, so reordered passages are found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, lowered, prefix_sums, shingles, span_hash, words

MIN_MATCH = 5  # words of the shortest tile
THRESHOLD = 0.5  # share of an item's words under tiles from which a document counts as contaminated
BLOCK_BYTES = 8 << 20  # benchmark text that tasks hold at a time
HITS = "array<struct<item:long,coverage:double,tiles:int>>"


def greedy_tiles(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, lengths: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles, from the longest matches at their first places.

    Longest first; of equal length, first in the item, then first in the document.
    """
    heap = list(zip((-lengths).tolist(), at_item.tolist(), at_doc.tolist(), strict=True))
    heapq.heapify(heap)
    used_item, used_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    left = len(item)  # words of the item that no tile holds yet
    tiles = []
    while heap and left >= least:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = used_item[a : a + n] | used_doc[b : b + n]
        if not taken.any():
            if np.array_equal(item[a : a + n], doc[b : b + n]):  # the hashes of the runs are verified word by word
                used_item[a : a + n] = used_doc[b : b + n] = True
                tiles.append((a, b, n))
                left -= n
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for lo, hi in zip(edges[0::2], edges[1::2]):
            if hi - lo >= least:
                heapq.heappush(heap, (-int(hi - lo), a + int(lo), b + int(lo)))
    return tiles


def common_lengths(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, least: int) -> np.ndarray:
    """Words that item and doc share from each pair of places on, at least ``least``: a search over span hashes."""
    x, y = prefix_sums(item), prefix_sums(doc)
    low = np.full(len(at_item), least)
    high = np.minimum(len(item) - at_item, len(doc) - at_doc)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = span_hash(x, at_item, at_item + middle) == span_hash(y, at_doc, at_doc + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


class Seeds:
    """Seeds of items, sorted by hash and the word before, behind a bitmap that most hashes fail."""

    BITS = 20

    def __init__(self, ids: list[int], items: list[np.ndarray], least: int):
        self.ids, self.least, self.items = ids, least, items
        grams = [shingles(item, least) for item in items]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        before = np.concatenate([word_before(item)[: len(g)] for item, g in zip(items, grams, strict=True)]) if grams else hashes
        order = np.lexsort((before, hashes))
        self.hash, self.before, self.owner, self.place = hashes[order], before[order], owner[order], place[order]

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << self.BITS, bool)
        out[(self.hash >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        return out

    def starts(self, doc: np.ndarray, places: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of a seed, place in doc) where a match begins: the words before differ, or there is none.

        Places inside a match are never listed, so a text that repeats one word meets an item that does
        so once per diagonal and not once per pair of places.
        """
        lo, hi = np.searchsorted(self.hash, grams, "left"), np.searchsorted(self.hash, grams, "right")
        before = word_before(doc)[places]
        # the entries of a hash are sorted by the word before; those with the document's word are left out
        same_lo, same_hi = lo.copy(), lo.copy()
        for k in np.flatnonzero(hi > lo):
            mine = self.before[lo[k] : hi[k]]
            same_lo[k] = lo[k] + np.searchsorted(mine, before[k], "left")
            same_hi[k] = lo[k] + np.searchsorted(mine, before[k], "right")
        first = (places == 0) | (before == 0)
        same_hi[first] = same_lo[first]
        counts = np.concatenate([same_lo - lo, hi - same_hi])
        from_, at = np.concatenate([lo, same_hi]), np.concatenate([places, places])
        entry = np.repeat(from_ - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        return entry, np.repeat(at, counts)

    def hits(self, doc: np.ndarray, places: np.ndarray, grams: np.ndarray) -> list[dict]:
        """Coverage of every item that shares a seed with a document."""
        entry, at_doc = self.starts(doc, places, grams)
        owner, at_item = self.owner[entry], self.place[entry]
        out = []
        for k in np.unique(owner):
            mine = owner == k
            item = self.items[k]
            lengths = common_lengths(item, doc, at_item[mine], at_doc[mine], self.least)
            tiles = greedy_tiles(item, doc, at_item[mine], at_doc[mine], lengths, self.least)
            if tiles:
                covered = sum(n for _, _, n in tiles) / len(item)
                out.append({"item": self.ids[k], "coverage": covered, "tiles": len(tiles)})
        return out


def word_before(words_: np.ndarray) -> np.ndarray:
    """The hash of the word before each place, 0 at the first."""
    out = np.zeros(len(words_), np.uint64)
    out[1:] = words_[:-1]
    return out


def _block(docs: DataFrame, block: list[Seeds]) -> DataFrame:
    """Adds the hits of one block of items to (id, text, hits) rows."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [seeds.bitmap() for seeds in block]
        for batch in batches:
            found = batch.column("hits").to_pylist()
            for row, raw, offsets in chunks(lowered(batch.column("text"))):
                hashes, starts = words(raw, offsets)
                for seeds, bitmap in zip(block, bitmaps, strict=True):
                    grams = shingles(hashes, seeds.least)
                    likely = np.flatnonzero(bitmap[(grams >> np.uint64(64 - seeds.BITS)).astype(np.int64)])
                    at = np.searchsorted(seeds.hash, grams[likely])
                    at[at == len(seeds.hash)] = 0
                    likely = likely[seeds.hash[at] == grams[likely]]
                    owner = np.searchsorted(starts, likely, "right") - 1
                    whole = likely + seeds.least <= starts[owner + 1]  # seeds never cross from one text to the next
                    likely, owner = likely[whole], owner[whole]
                    for k in np.unique(owner):
                        places = likely[owner == k]
                        doc = hashes[starts[k] : starts[k + 1]]
                        found[row + k] = found[row + k] + seeds.hits(doc, places - starts[k], grams[places])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array(found, HITS_ARROW)], ["id", "text", "hits"]
            )

    return docs.mapInArrow(match, docs.schema)


HITS_ARROW = pa.list_(pa.struct([("item", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))


def item_seeds(ids: list[int], texts: list[str], least: int) -> list[Seeds]:
    """Seeds of ``least`` words, and for shorter items of as many words as these have: they match as a whole."""
    by_length: dict[int, tuple[list, list]] = {}
    for row, raw, offsets in chunks(lowered(pa.array(texts, pa.large_string()))):
        found, starts = words(raw, offsets)
        for k in range(len(offsets) - 1):
            item = found[starts[k] : starts[k + 1]]
            if len(item):
                mine = by_length.setdefault(min(len(item), least), ([], []))
                mine[0].append(ids[row + k])
                mine[1].append(item)
    return [Seeds(mine_ids, items, n) for n, (mine_ids, items) in sorted(by_length.items())]


def benchmark_blocks(items: DataFrame, id_col: str, text_col: str, least: int) -> Iterator[list[Seeds]]:
    """Blocks of about ``BLOCK_BYTES`` of benchmark text, read one after the other."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        block = item_seeds([r["id"] for r in part], [r["text"] for r in part], least)
        if block:
            yield block


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, contaminated, coverage, n_items, items) of every document, with the columns of ``keep``.

    ``items`` lists the items at or over the threshold, ``coverage`` is the largest share found. Items
    with fewer than ``least`` words match as a whole or not at all; null items, items without words and
    null or empty texts match nothing; repeated rows stay as many; of repeated items each counts; an empty benchmark leaves
    every document clean. The documents are never shuffled; benchmark text is held block by block.
    """
    others = [c for c in keep if c not in (id_col, text_col)]
    body = F.struct(*[F.col(c) for c in (id_col, *others)])
    rows = docs.select(body.alias("id"), F.col(text_col).alias("text"), F.array().cast(HITS).alias("hits"))
    for block in benchmark_blocks(items, item_id, item_text, least):
        rows = _block(rows, block)
    over = F.filter("hits", lambda h: h["coverage"] >= threshold)
    listed = F.array_sort(F.transform(over, lambda h: h["item"]))
    text = [F.col("text").alias(text_col)] if text_col in keep else []
    return rows.select("id.*", *text, (F.size(over) > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["coverage"])), F.lit(0.0)).alias("coverage"),
        F.size(over).alias("n_items"), listed.alias("items"))
