"""MinHash near-duplicates with DartMinHash signatures.

Every unit of an element's weight carries a random stream of darts along the rank axis, the same in
every text that holds the element. A text looks at its darts in order of rank until each of ``K``
coordinates has met one, and keeps the earliest for each coordinate. Two texts agree in a coordinate with
the probability of their weighted Jaccard similarity. The work is one hash for each element and rank
range looked at, and about ``K ln K`` darts, not ``K`` hashes for each element.

Signatures are cut into bands; texts that share a band are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.dedup import components
from .common import chunks, cut, lowered, mix, shingles, words

K = 128  # coordinates of a signature
BANDS = 32  # bands of K / BANDS coordinates: a pair at 0.8 is missed with probability 5e-8
SHINGLE = 5  # words
SIMILARITY = 0.8

_FIRST = 2.0**-9  # length of the first rank range; each later range is as long as all before it


def _length(s: int) -> float:
    return _FIRST * 2.0 ** max(0, s - 1)


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulated Poisson probabilities as thresholds of a 64-bit hash."""
    n = int(mean + 12 * math.sqrt(mean) + 16)
    log = np.cumsum(np.r_[-mean, np.log(mean) - np.log(np.arange(1, n))])
    c = np.minimum(np.cumsum(np.exp(log)), 1.0)
    return np.minimum(c * 2.0**64, 2.0**64 - 2**12).astype(np.uint64)


_TABLES: dict[int, np.ndarray] = {}


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """(texts, k) dart ids. ``element`` of text ``text`` has ``weight`` > 0; elements are distinct in a text.

    A text without elements has only zeros.
    """
    out = np.zeros((texts, k), np.uint64).reshape(-1)
    missing = np.full(texts, k)
    total = np.bincount(text, weight, texts)
    missing[total <= 0] = 0
    # units of weight: a fractional rest is a unit whose darts count below the rest only
    units = np.ceil(weight).astype(np.int64)
    src = np.repeat(np.arange(len(text)), units)
    nth = np.arange(len(src)) - np.repeat(np.cumsum(units) - units, units)
    owner = text[src]
    room = weight[src] - nth
    base = mix(element[src] + mix(nth.astype(np.uint64)))
    s = 0
    while missing.any():
        length = _length(s)
        mine = np.flatnonzero((missing > 0)[owner])  # texts that still look for darts
        if s not in _TABLES:
            _TABLES[s] = _poisson_table(length)
        h = mix(base[mine] ^ mix(np.full(1, s + 1, np.uint64)))
        some = np.flatnonzero(h >= _TABLES[s][0])
        count = np.searchsorted(_TABLES[s], h[some], "right")
        dart = np.repeat(some, count)
        turn = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        ident = mix(h[dart] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        unit = mine[dart]
        if (room[unit] < 1).any():
            inside = _unit(mix(ident + np.uint64(3))) < room[unit]
            ident, unit = ident[inside], unit[inside]
        slot = owner[unit] * k + (ident >> np.uint64(32)).astype(np.int64) % k
        free = out[slot] == 0
        ident, slot = ident[free], slot[free]
        rank = mix(ident + np.uint64(7))  # place inside the range
        order = np.argsort(rank, kind="stable")[::-1]  # the earliest is written last
        out[slot[order]] = ident[order] | np.uint64(1)
        filled = np.unique(slot)
        missing -= np.bincount(filled // k, minlength=texts)
        s += 1
    return out.reshape(texts, k)


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands) hashes of the bands."""
    texts, k = signature.shape
    parts = signature.reshape(texts, bands, k // bands)
    out = np.zeros((texts, bands), np.uint64)
    for j in range(k // bands):
        out = mix(out + parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of a run of texts, with words and first words.

    A text of fewer than ``n`` words has its whole word sequence as its one shingle.
    """
    hashes, starts = words(raw, offsets)
    grams = shingles(hashes, n)
    text = np.searchsorted(starts, np.arange(len(grams)), "right") - 1
    whole = np.arange(len(grams)) + n <= starts[text + 1] if len(grams) else np.zeros(0, bool)
    text, grams = text[whole], grams[whole]
    size = np.diff(starts)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = np.array([shingles(hashes[starts[t] : starts[t + 1]], int(size[t]))[0] for t in short], np.uint64)
        text, grams = np.r_[text, short], np.r_[grams, own]
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])]) if len(text) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(text)])
    return text[first], grams[first], count, hashes, starts


def _sequence_hash(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the word sequence of each text."""
    place = (np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.uint64)
    out = []
    for seed in (0x1234567, 0x7654321):
        term = mix(hashes + mix(place + np.uint64(seed)))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)]
        out.append(mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64)).astype(np.int64))
    return out[0], out[1]


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, weighted: bool) -> DataFrame:
    """(id, n, h1, h2, bands) of every row: distinct shingles, hashes of its words, bands of its signature."""
    ddl = "id long, n int, h1 long, h2 long, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for row, raw, offsets in chunks(lowered(batch.column("text"))):
                texts = len(offsets) - 1
                text, gram, count, hashes, starts = shingle_sets(raw, offsets, shingle)
                weight = count.astype(np.float64) if weighted else np.ones(len(gram))
                bands = bands_of(signatures(text, gram, weight, texts)).astype(np.int64)
                h1, h2 = _sequence_hash(hashes, starts)
                flat = pa.ListArray.from_arrays(np.arange(0, texts * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1)))
                n = np.bincount(text, minlength=texts).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, texts), pa.array(n), pa.array(h1), pa.array(h2), flat], ["id", "n", "h1", "h2", "bands"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, ddl)


def shingle_lists(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, grams, counts) of (id, text) rows: the distinct shingles with their counts, sorted."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, offsets in chunks(lowered(batch.column("text"))):
                texts = len(offsets) - 1
                text, gram, count, _, _ = shingle_sets(raw, offsets, shingle)
                ends = np.r_[0, np.cumsum(np.bincount(text, minlength=texts))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, texts),
                        pa.ListArray.from_arrays(ends, pa.array(gram.astype(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))),
                    ],
                    ["id", "grams", "counts"],
                )

    return docs.mapInArrow(listed, "id long, grams array<long>, counts array<int>")


def exact_similarity(pairs: DataFrame, lists: DataFrame, weighted: bool) -> DataFrame:
    """(a, b, similarity) of (a, b) pairs, from the shingles of both texts."""
    a = lists.select(F.col("id").alias("a"), F.col("grams").alias("ga"), F.col("counts").alias("ca"))
    b = lists.select(F.col("id").alias("b"), F.col("grams").alias("gb"), F.col("counts").alias("cb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [batch.column(c) for c in ("ga", "ca", "gb", "cb")]
            out = np.zeros(len(batch))
            for i in range(len(batch)):
                ga, ca, gb, cb = (x[i].values.to_numpy() for x in part)
                if not weighted:
                    ca, cb = np.ones(len(ga), np.int64), np.ones(len(gb), np.int64)
                _, ia, ib = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
                both = int(np.minimum(ca[ia], cb[ib]).sum())
                union = int(ca.sum()) + int(cb.sum()) - both
                out[i] = both / union if union else 0.0
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "similarity"])

    return pairs.join(a, "a").join(b, "b").mapInArrow(compare, "a long, b long, similarity double")


def crossing_pairs(texts: DataFrame, lists: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """(a, b) of all pairs of (id, component) texts of different components that may be similar enough.

    A prefix-filtered join: shingles are ordered by how many of these texts have them, rarest first; two
    similar texts share a shingle among their first, at places after which enough shingles are left. What
    all near copies of a text have in common stands last and joins nothing.
    """
    each = lists.join(texts.select("id"), "id", "left_semi").select("id", F.explode(F.arrays_zip("grams", "counts")).alias("g"))
    turn = F.explode(F.sequence(F.lit(1), F.col("g.counts"))) if weighted else F.lit(1)  # a repeated shingle counts as several
    each = each.select("id", F.col("g.grams").alias("gram"), turn.alias("turn")).select("id", F.xxhash64("gram", "turn").alias("e"))
    each = cut(each, "dart-elements")
    spread = each.groupBy("e").agg(F.count("*").alias("df"))
    order = each.join(spread, "e").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    n = F.size("es")
    first = F.slice("es", F.lit(1), (n - F.ceil(n * similarity - 1e-9) + 1).cast("int"))
    posts = order.select("id", n.alias("n"), F.posexplode(first).alias("at", "x")).filter("x.df > 1")  # one alone joins nothing
    posts = posts.join(texts, "id").select("id", "component", "n", "at", F.col("x.e").alias("e"))
    a, b = posts.alias("a"), posts.alias("b")
    both, size = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")), F.col("a.n") + F.col("b.n")
    near = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity - 1e-9
    other = (F.col("a.id") > F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
    met = a.join(b, (F.col("a.e") == F.col("b.e")) & other & near & (both >= F.ceil(size * (similarity / (1 + similarity)) - 1e-9)))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    weighted: bool = False,
) -> DataFrame:
    """(id, class_id, class_size) of every document: the groups connected by similar texts.

    Texts are compared by the Jaccard similarity of their word shingles, of sets or, ``weighted``, of
    multisets. Equal texts form a class at once; of the others, those that share a band are compared,
    first with the smallest id of the band and with the text that shares most bands. Texts of bands that
    are not one group then are compared across groups, where their rarest shingles meet. A group is named
    by its smallest id. Texts without words, null or empty, are alone. Repeated rows
    stay as many; rows that share an id share a group; a row without id has no class. An empty table
    gives an empty result; other columns are not read.
    """
    rows = cut(signed(docs, id_col, text_col, shingle, weighted), "dart-signatures")
    solid = rows.filter("n > 0 and id is not null")
    firsts = solid.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    copies = solid.join(firsts, ["h1", "h2"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # one text of each class stands for it
    reps = solid.join(firsts, ["h1", "h2"]).filter("id = rep").dropDuplicates(["id", "h1", "h2"])
    slots = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = slots.groupBy("band", "key").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    met = cut(slots.join(shared, ["band", "key"]), "dart-bands")  # texts alone in a band are gone
    # the text that shares most bands stands in the middle of its near copies: it is the second pivot
    shares = met.groupBy("id").agg(F.sum("n").alias("shares"))
    middle = met.join(shares, "id").groupBy("band", "key").agg(F.max(F.struct("shares", "id"))["id"].alias("middle"))
    pivots = met.join(middle, ["band", "key"]).select("id", F.explode(F.array("least", "middle")).alias("pivot"))
    pairs = pivots.filter("id <> pivot").select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()
    pairs = cut(pairs, "dart-pairs")
    wanted = met.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lists = shingle_lists(texts.join(wanted, "id", "left_semi"), shingle).dropDuplicates(["id"])
    lists = cut(lists, "dart-shingles")
    tested = cut(exact_similarity(pairs, lists, weighted), "dart-tested")
    edges = tested.filter(F.col("similarity") >= similarity).select("a", "b").unionByName(copies).distinct()
    named = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # bands whose texts are not all of one group yet: compare what is left across the groups
    labelled = met.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
    mixed = mixed.filter("lo <> hi and n > 2").select("band", "key")  # two texts alone are compared already
    open_ = cut(labelled.join(mixed, ["band", "key"]).select("id", "component").distinct(), "dart-open")
    rest = crossing_pairs(open_, lists, similarity, weighted)
    rest = cut(rest.join(pairs, ["a", "b"], "left_anti"), "dart-rest")
    late = exact_similarity(rest, lists, weighted).filter(F.col("similarity") >= similarity).select("a", "b")
    late = cut(late, "dart-late")
    if not late.isEmpty():
        links = named.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(
            late.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        )
        named = components(links)
    groups = rows.select("id").join(named, "id", "left").withColumn("class_id", F.coalesce("component", "id"))
    groups = groups.select("id", "class_id")
    sizes = groups.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return groups.join(sizes, "class_id", "left").select(F.col("id").alias(id_col), "class_id", "class_size")
