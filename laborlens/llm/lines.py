"""Line dedup: an exact set-similarity join of lines with prefix, positional and length filters.

A line is the set of its words. Words get a global order, rarest first, from counts over the whole
table; two lines with a Jaccard similarity of at least ``SIMILARITY`` share a word among the first of
both. Lines with equal sets form one class, so copies never meet as pairs. Near copies of one line
would still meet all with all; most of them are settled before the join by a comparison with a few early
lines that share a sampled word, and a settled line looks for no further match. All steps are DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

SIMILARITY = 0.8
BUCKETS = 1 << 16  # word counts are kept by this many digests of words: the order of rarity
FILTER_WORDS = 1 << 16  # 64-bit words of the bitmap that holds the places of candidate lines

PAIRS_A_CLASS = 1  # up to so many pairs for each class are compared in one round
BROADCAST_ROWS = 1_000_000  # most settled lines that are broadcast; more are joined in a shuffle

_EPS = 1e-9


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, body) of every line of a document with an id; lines end at a line feed; a null text is one empty line."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.posexplode(parts).alias("line", "body"))


def line_words(body: Column) -> Column:
    """Pieces between spaces, repeated ones too; an empty piece may be among them."""
    return F.split(body, " ")


def rarity_ranks(lines: DataFrame) -> list[int]:
    """Rank of each word digest by its count over all lines: ``BUCKETS`` numbers, whatever the data."""
    words = lines.select(F.explode(line_words(F.col("body"))).alias("w"))
    bucket = F.shiftrightunsigned(F.xxhash64("w"), 48).cast("int").alias("bucket")
    counted = words.select(bucket).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    count = [0] * BUCKETS
    for r in counted:
        count[r["bucket"]] = r["n"]
    ranks = [0] * BUCKETS
    for rank, b in enumerate(sorted(range(BUCKETS), key=lambda b: (count[b], b))):
        ranks[b] = rank
    return ranks


def ordered_words(body: Column, ranks: list[int]) -> Column:
    """Distinct words of a line as numbers, rarest first: their hashes with the rank of the digest in place of the digest."""

    def signed(high: int) -> int:
        return (high << 48) - (1 << 64 if high >> 15 else 0)

    # folded into one constant; ranks are moved down by half, as longs have a sign
    table = F.split(F.lit(",".join(str(signed(b ^ r ^ (1 << 15))) for b, r in enumerate(ranks))), ",").cast("array<bigint>")

    def number(h: Column) -> Column:
        # the default is never taken; without nulls Spark sorts the numbers as plain longs
        return F.coalesce(F.get(table, F.shiftrightunsigned(h, 48)), F.lit(0).cast("long")).bitwiseXOR(h)

    pieces = F.array_remove(line_words(body), "")
    return F.sort_array(F.array_distinct(F.transform(F.transform(pieces, lambda w: F.xxhash64(w)), number)))


def prefix_length(n: Column, similarity: float) -> Column:
    return (n - F.ceil(n * similarity - _EPS) + 1).cast("int")


def least_overlap(a: Column, b: Column, similarity: float) -> Column:
    return F.ceil((a + b) * (similarity / (1 + similarity)) - _EPS)


def described_lines(lines: DataFrame, ranks: list[int], similarity: float) -> DataFrame:
    """(id, line, s, p0, p1, n, prefix) of every line with words.

    ``s`` hashes the set; ``p0`` and ``p1`` have the parity of the words in each of 128 places, so two sets differ in at
    least as many words as these differ in bits.
    Functions with a lambda run word by word outside the generated code, so each word goes through few of them.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    t = lines.filter(F.btrim("body") != "").select("id", "line", ordered_words(F.col("body"), ranks).alias("t"))
    n = F.size("t")
    t = t.select("id", "line", F.xxhash64("t").alias("s"), n.alias("n"), F.transform("t", lambda x: F.hash(x)).alias("w"))

    def parity(words: Column) -> Column:
        """A shift by a word shifts by its last six bits."""
        return F.aggregate(words, none, lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, x)))

    t = t.select(
        "id", "line", "s", parity(F.col("w")).alias("p"), parity(F.filter("w", lambda x: x < 0)).alias("p1"), "n",
        F.slice("w", F.lit(1), prefix_length(F.col("n"), similarity)).alias("prefix"),
    )
    return t.select("id", "line", "s", F.col("p").bitwiseXOR(F.col("p1")).alias("p0"), "p1", "n", "prefix")


def _differ(a: str, b: str) -> Column:
    """A lower bound of the number of words that only one of the two sets has."""
    p0, p1 = (F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in ("p0", "p1"))
    return p0 + p1


def _alike(a: str, b: str, similarity: float) -> Column:
    """Length filter and parity filter: true for every pair that is similar enough."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = F.least(na, nb) >= F.greatest(na, nb) * similarity - _EPS
    return near & (_differ(a, b) <= na + nb - 2 * least_overlap(na, nb, similarity))


def _earlier(a: str, b: str) -> Column:
    """Class ``b`` begins before class ``a``."""
    return (F.col(f"{b}.id") < F.col(f"{a}.id")) | ((F.col(f"{b}.id") == F.col(f"{a}.id")) & (F.col(f"{b}.line") < F.col(f"{a}.line")))


def _pair(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.id").alias("aid"), F.col(f"{a}.line").alias("aline"), F.col(f"{b}.id").alias("bid"), F.col(f"{b}.line").alias("bline")]


def only_hashed(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose columns hash like a row of ``wanted``, in front of a join with it.

    A bitmap of fixed size, built from all of ``wanted``, keeps most other rows out of the shuffle;
    those that slip through are dropped by the join.
    """
    bits = FILTER_WORDS * 64
    spot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    word, bit = F.floor(spot / 64).cast("int"), (spot % 64).cast("int")
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, bit)
    bitmap = wanted.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bitmap), "_word")  # FILTER_WORDS rows at most
    hit = F.call_function("shiftleft", one, F.col("_bit")).bitwiseAND(F.col("_mask")) != 0
    return marked.filter(hit).drop("_word", "_bit", "_mask")


def texts_of(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, line, body) of the lines at the given places; other documents are not cut into lines."""
    near = only_hashed(line_rows(only_hashed(docs, places, ["id"]), "id", "text"), places, ["id", "line"])
    # an inner join with distinct places: a semi join would be moved below the bitmap
    return near.join(places, ["id", "line"]).groupBy("id", "line").agg(F.min("body").alias("body"))


def verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose Jaccard similarity, counted on the words themselves, is high enough."""
    places = pairs.select(F.col("aid").alias("id"), F.col("aline").alias("line")).unionByName(
        pairs.select(F.col("bid").alias("id"), F.col("bline").alias("line"))
    ).distinct()
    texts = cut(texts_of(places, docs), "line-texts")
    a = texts.select(F.col("id").alias("aid"), F.col("line").alias("aline"), F.col("body").alias("abody"))
    b = texts.select(F.col("id").alias("bid"), F.col("line").alias("bline"), F.col("body").alias("bbody"))
    # the lines travel as they are; arrays of words take four times as much
    met = pairs.join(a, ["aid", "aline"]).join(b, ["bid", "bline"])

    def words(body: str) -> Column:
        return F.array_distinct(F.array_remove(line_words(F.col(body)), ""))

    def enough(w: Column) -> Column:
        a, b = w["a"], w["b"]
        return F.exists(F.array(F.size(F.array_intersect(a, b))), lambda both: F.try_divide(both, F.size(a) + F.size(b) - both) >= similarity)

    # as lambda variables, words and their overlap are made once; a filter on columns makes them at each mention
    return met.filter(F.exists(F.array(F.struct(words("abody").alias("a"), words("bbody").alias("b"))), enough)).select("aid", "aline", "bid", "bline")


def sampled_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """Each class with the first and the most frequent of the earlier classes that share a sampled word."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in range(2)])).alias("key")
    members = classes.select("id", "line", "p0", "p1", "n", "copies", keys).select("key.i", "key.k", F.struct("id", "line", "p0", "p1", "n").alias("x"), "copies")
    # both run along with the rows, so nothing is kept of a word that many classes share
    sofar = Window.partitionBy("i", "k").orderBy("x.id", "x.line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = F.min_by("x", F.struct(-F.col("copies"), F.col("x.id"), F.col("x.line"))).over(sofar)
    led = members.select("x", F.first("x").over(sofar).alias("first"), common.alias("common"))
    lead = led.select("x", F.explode(F.array("first", "common")).alias("y"))
    return lead.filter(_earlier("x", "y") & _alike("x", "y", similarity)).select(*_pair("x", "y")).distinct()


def prefix_pairs(classes: DataFrame, settled: DataFrame, similarity: float) -> DataFrame:
    """Pairs (later, earlier) that share a word of both prefixes and pass all filters; the later is not settled.

    ``off`` is the share of the words that surely differ, in thousandths. Parities of 128 places travel with the
    postings: with 64 places, lines near a group of near copies that match none of it met all of the group.
    """
    marks = settled.withColumn("_done", F.lit(1))
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    flagged = classes.join(marks, ["id", "line"], "left")
    done = F.coalesce("_done", F.lit(0)).alias("done")
    posts = flagged.select("id", "line", "p0", "p1", "n", done, F.posexplode("prefix").alias("at", "word"))
    # line, place in the prefix and mark share one number, as every column of a posting takes room in the shuffle
    spot = F.shiftleft(F.col("line").cast("long"), 32) + F.col("at") * 2 + F.col("done")
    columns = ["id", spot.alias("spot"), "p0", "p1", "n", "word"]
    # the shorter line meets the longer one by fewer words, as the pair must share more of it
    least = least_overlap(F.col("n"), F.col("n"), similarity)
    x, y = posts.select(*columns).alias("x"), posts.filter(F.col("at") <= F.col("n") - least).select(*columns).alias("y")
    (idx, spotx, nx), (idy, spoty, ny) = ([F.col(f"{side}.{c}") for c in ("id", "spot", "n")] for side in ("x", "y"))
    linex, liney = F.shiftright(spotx, 32).cast("int"), F.shiftright(spoty, 32).cast("int")
    rest = F.least(*[n - F.shiftright(s.bitwiseAND(F.lit((1 << 32) - 1)), 1) for n, s in ((nx, spotx), (ny, spoty))])
    later = (idy < idx) | ((idy == idx) & (liney < linex))
    met = x.join(
        y,
        (F.col("x.word") == F.col("y.word"))
        & ((ny < nx) | ((ny == nx) & later))
        & _alike("x", "y", similarity)
        & (rest >= least_overlap(nx, ny, similarity))
        & (F.when(later, spotx).otherwise(spoty) % 2 == 0),
    )
    off = _differ("x", "y") * 1000 / (nx + ny)
    places = [F.struct(i.alias("id"), k.alias("line")) for i, k in ((idx, linex), (idy, liney))]
    met = met.select(F.greatest(*places).alias("a"), F.least(*places).alias("b"), off.cast("int").alias("off"))
    return met.select(*_pair("a", "b"), "off").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, line) of every line that is similar to an earlier line of the table.

    Earlier is by document id, then by line number. Whether the earlier line is removed itself does not
    matter, so the result does not depend on the order of work.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    lines = line_rows(docs, "id", "text")
    ranks = rarity_ranks(lines)
    rows = cut(described_lines(lines, ranks, similarity), "line-sets")
    firsts = rows.groupBy("s", "p0").agg(F.min(F.struct("id", "line", "p1", "n", "prefix")).alias("first"), F.count("*").alias("copies"))
    sampled = {"k0": F.array_min("prefix"), "k1": F.array_max("prefix")}  # two words of the prefix, by their hashes
    classes = cut(firsts.select("s", "p0", "copies", "first.*").withColumns(sampled), "line-classes")
    early = cut(verified(cut(sampled_pairs(classes, similarity), "line-pairs"), docs, similarity), "line-settled")
    settled = early.select(F.col("aid").alias("id"), F.col("aline").alias("line")).distinct()
    pairs = cut(prefix_pairs(classes, settled, similarity), "line-pairs")
    if pairs.count() <= PAIRS_A_CLASS * classes.count():
        late = verified(pairs.drop("off"), docs, similarity).select("aid", "aline")
    else:
        # one match is enough: the likeliest is tried first, the others for lines that are still unmatched
        likeliest = pairs.groupBy("aid", "aline").agg(F.min(F.struct("off", "bid", "bline")).alias("y")).select("aid", "aline", "y.bid", "y.bline")
        near = cut(verified(likeliest, docs, similarity), "line-near").select("aid", "aline").distinct()
        others = cut(pairs.drop("off").join(near, ["aid", "aline"], "left_anti").join(likeliest, ["aid", "aline", "bid", "bline"], "left_anti"), "line-others")
        late = verified(others, docs, similarity).select("aid", "aline").unionByName(near)
    gone = settled.unionByName(late.select(F.col("aid").alias("id"), F.col("aline").alias("line"))).distinct()
    # a copy always goes, whatever becomes of the first line of its class
    repeated = classes.filter("copies > 1").select("s", "p0", F.col("id").alias("first_id"), F.col("line").alias("first_line"))
    copies = only_hashed(rows.select("id", "line", "s", "p0"), repeated, ["s"]).join(repeated, ["s", "p0"])
    first = (F.col("id") == F.col("first_id")) & (F.col("line") == F.col("first_line"))
    return gone.unionByName(copies.filter(~first).select("id", "line"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_lines, removed) of every document; ``removed`` lists the numbers of its removed lines, from 0.

    A line goes if an earlier line of the table has a Jaccard similarity of ``similarity`` or more on
    the sets of their pieces between spaces. Lines without words stay. A null text counts as one empty
    line; equal texts under other ids are later lines like any other. Ids name documents: equal rows
    under one id are one document, in each of them the same lines stay; of different texts under one id,
    the smallest line at a place stands for the others. Rows with a null id are not judged. Empty tables give empty results; other
    columns are not read.
    """
    gone = removed_lines(docs, id_col, text_col, similarity)
    listed = gone.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    rows = docs.select(
        F.col(id_col).alias(id_col), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("n_lines")
    )
    out = rows.join(listed, rows[id_col] == listed["id"], "left").drop("id")
    return out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The table without the removed lines; documents of which nothing is left keep an empty text."""
    gone = dedup_lines(docs, id_col, text_col, similarity).filter("size(removed) > 0")
    gone = gone.select(F.col(id_col).alias("_id"), "removed").dropDuplicates(["_id"])
    pieces = F.split(text_col, "\n")
    kept = F.filter(pieces, lambda x, i: ~F.array_contains("removed", i))
    joined = docs.join(gone, F.col(id_col) == F.col("_id"), "left")
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)
