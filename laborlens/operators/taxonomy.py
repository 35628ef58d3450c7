"""Finding taxonomy concepts in text and keeping the taxonomy's ids in step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import let
from ..functions.text import normalize_label
from .skew import salted_join

RUN = r"[\p{L}\p{N}]+"
MAX_RUNS = 4  # longer labels are looked up by their first four words and then verified


def label_entries(concepts: DataFrame) -> DataFrame:
    """(uri, label, norm, entry): one row per distinct label of a concept, in label order."""
    labels = F.array_distinct(
        F.filter(
            F.concat(F.array("label_en", "label_nl"), F.coalesce("alt_labels", F.array().cast("array<string>"))),
            lambda x: x.isNotNull() & (x != ""),
        )
    )
    rows = concepts.select("uri", F.posexplode(labels).alias("entry", "label"))
    return rows.withColumn("norm", normalize_label(F.col("label"))).filter(F.col("norm") != "")


def grams(text: Column, needed: Column, longest: int = MAX_RUNS) -> Column:
    """Distinct runs of one to ``longest`` neighbouring words, but no longer than ``needed``."""

    def of(runs: Column, n: int) -> Column:
        count = F.size(runs) - (n - 1)
        places = F.when((count > 0) & (needed >= n), F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(runs, i + k) for k in range(n)]))

    def all_of(runs: Column) -> Column:
        return F.array_distinct(F.concat(*[of(runs, n) for n in range(1, longest + 1)]))

    return let(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), all_of)


def place_in(text: Column, label: Column) -> Column:
    """1-based place of a label as whole tokens, in code points, 0 when absent."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), label, F.lit(r"\E(?![\p{L}\p{N}+#])"))
    before = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))  # a place of ``regexp_instr`` is in UTF-16 units
    return F.when(F.regexp_instr(text, pattern) > 0, before + 1).otherwise(F.lit(0))


FOUND_ROWS = 256  # texts whose hits are held at a time
DICTIONARY_BYTES = 64 << 20  # labels that tasks hold at most; a larger dictionary is joined


def find_concepts(docs: DataFrame, entries: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, uri, label, index): every concept named in a text, once, with its longest label.

    Labels of one or two characters are looked for in the raw text with their case, the others
    in the normalised text, as whole words. Labels without any letter or digit are left out. Rows that
    share an id are one text; places are in code points. A
    dictionary of up to ``DICTIONARY_BYTES`` goes to the tasks, and only hits leave them; the words of
    the texts meet a larger one in a join.
    """
    size = entries.agg(F.coalesce(F.sum(F.octet_length("label") + F.octet_length("norm") + 64), F.lit(0)).alias("n")).first()["n"]
    if size > DICTIONARY_BYTES:
        return joined_concepts(docs, entries, doc_id, text)
    known = entries.select("uri", "label", "norm", "entry").toPandas()
    kind = docs.schema[doc_id].dataType.simpleString()
    uri = entries.schema["uri"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(known)
        for b in batches:
            for at in range(0, len(b), FOUND_ROWS):
                part = b.iloc[at : at + FOUND_ROWS]
                rows = [(i, *hit) for i, raw, norm in zip(part[doc_id], part["_raw"], part["_norm"]) for hit in finder.hits(raw or "", norm)]
                yield pd.DataFrame(rows, columns=[doc_id, "uri", "label", "index", "size", "entry"])

    cased = known["norm"].str.len().le(2).any()  # only short labels are looked for in the raw text
    raw = F.col(text) if cased else F.lit(None).cast("string")
    work = docs.filter(F.col(text).isNotNull()).select(doc_id, raw.alias("_raw"), normalize_label(F.col(text)).alias("_norm"))
    found = work.mapInPandas(find, f"`{doc_id}` {kind}, uri {uri}, label string, index int, size int, entry int")
    return longest_labels(found.select(F.col(doc_id), F.struct("uri", "label", "size", "entry", "index").alias("h")), doc_id)


def longest_labels(found: DataFrame, doc_id: str) -> DataFrame:
    """One row per text and concept: the longest label, of equal ones the earlier entry, at its first place."""
    best = F.max_by(F.col("h"), F.struct(F.col("h.size"), -F.col("h.entry"), -F.col("h.index"))).alias("h")
    return found.groupBy(doc_id, F.col("h.uri").alias("uri")).agg(best).select(doc_id, "uri", "h.label", "h.index")


class Finder:
    """Looks the word runs of a text up in a dictionary and verifies hits at their place."""

    def __init__(self, known: pd.DataFrame):
        import regex

        self.run, self.letter, self.tail = regex.compile(RUN), regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"[\p{L}\p{N}+#]")
        self.by_key: dict[tuple[bool, tuple[str, ...]], list[tuple]] = {}
        for uri, label, norm, entry in known.itertuples(index=False):
            short = len(norm) <= 2
            key = tuple(self.run.findall(label if short else norm)[:MAX_RUNS])
            if key:
                self.by_key.setdefault((short, key), []).append((uri, label, norm, entry))
        self.lengths = {short: sorted({len(k) for s, k in self.by_key if s == short}) for short in (True, False)}

    def place(self, text: str, label: str) -> int:
        """0-based place of a label as whole tokens, -1 when absent."""
        at = text.find(label)
        while at >= 0:
            end = at + len(label)
            if not (at and self.letter.match(text, at - 1)) and not self.tail.match(text, end):
                return at
            at = text.find(label, at + 1)
        return -1

    def hits(self, raw: str, norm: str) -> list[tuple]:
        best: dict[object, tuple] = {}
        for short, text in ((True, raw), (False, norm)):
            if not self.lengths[short]:
                continue
            words = self.run.findall(text)
            seen = set()
            for n in self.lengths[short]:
                for key in zip(*(words[k:] for k in range(n))):
                    if key in seen or (short, key) not in self.by_key:
                        continue
                    seen.add(key)
                    for uri, label, normal, entry in self.by_key[short, key]:
                        at = self.place(text, label if short else normal)
                        rank = (len(normal), -entry)
                        if at >= 0 and (uri not in best or rank > best[uri][0]):
                            best[uri] = (rank, label, at)
        return [(uri, label, at, size, -entry) for uri, ((size, entry), label, at) in best.items()]


def joined_concepts(docs: DataFrame, entries: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``find_concepts`` for a dictionary of any size: word runs meet the labels in an equi-join.

    Labels and texts are much larger than the files Spark would judge them by, so neither is broadcast.
    """
    def key(c: Column) -> Column:
        return F.array_join(F.slice(F.regexp_extract_all(c, F.lit(RUN), F.lit(0)), 1, MAX_RUNS), " ")

    short = F.length("norm") <= 2
    known = entries.withColumn("short", short).withColumn(
        "key", F.concat(F.when(short, "r:").otherwise("n:"), key(F.when(short, F.col("label")).otherwise(F.col("norm"))))
    ).filter(~F.col("key").isin("r:", "n:"))
    words = F.size(F.regexp_extract_all("label", F.lit(RUN), F.lit(0)))
    longest = entries.agg(F.coalesce(F.max(words), F.lit(1)).alias("_w")).select("_w").scalar()
    shortest = entries.agg(F.coalesce(F.min(F.length("norm")), F.lit(9)).alias("_w")).select("_w").scalar()
    work = docs.select(doc_id, F.col(text).alias("_raw"), normalize_label(F.col(text)).alias("_norm"))
    sized = work.withColumn("_longest", longest).withColumn("_short", F.when(shortest <= 2, 2).otherwise(0))

    def tagged(tag: str, c: Column) -> Column:
        return F.transform(c, lambda g: F.concat(F.lit(tag), g))

    runs = F.concat(
        tagged("n:", grams(F.col("_norm"), F.col("_longest"))), tagged("r:", grams(F.col("_raw"), F.col("_short"), 2))
    )
    # the outer form: a plain explode adds a filter on the array's size, which computes it twice
    probes = sized.select(doc_id, F.explode_outer(runs).alias("key"))
    hits = probes.join(known.hint("merge"), "key").groupBy(doc_id).agg(
        F.collect_list(F.struct("uri", "label", "norm", "entry", "short")).alias("_hits")
    )
    placed = F.transform(
        "_hits",
        lambda h: F.struct(
            h["uri"].alias("uri"), h["label"].alias("label"), F.length(h["norm"]).alias("size"), h["entry"].alias("entry"),
            (F.when(h["short"], place_in(F.col("_raw"), h["label"])).otherwise(place_in(F.col("_norm"), h["norm"])) - 1).alias("index"),
        ),
    )
    found = work.hint("merge").join(hits, doc_id).select(doc_id, F.explode_outer(placed).alias("h")).filter(F.col("h.index") >= 0)
    return longest_labels(found, doc_id)


def best_concept(found: DataFrame, doc_id: str) -> DataFrame:
    """Earliest, then longest-labelled concept per text."""
    order = F.struct("index", -F.length("label"), "uri")
    return found.groupBy(doc_id).agg(F.min_by(F.struct("uri", "label"), order).alias("b")).select(doc_id, "b.*")


def lookup_labels(rows: DataFrame, entries: DataFrame, label: str) -> DataFrame:
    """Concept whose normalised label equals the text; the longest entry order wins by uri."""
    names = entries.groupBy("norm").agg(F.min("uri").alias("uri"))
    keyed = rows.withColumn("norm", normalize_label(F.col(label)))
    return keyed.join(names, "norm", "left").drop("norm")


def reconcile(skills: DataFrame, local: Column) -> DataFrame:
    """(uri, target): local concepts and the official one with the same normalised label."""
    named = skills.select("uri", normalize_label(F.col("label_en")).alias("norm"), local.alias("local"))
    official = named.filter(~F.col("local")).groupBy("norm").agg(F.max("uri").alias("target"))
    return named.filter("local").join(official, "norm", "left").select("uri", "target")


def remap_column(rows: DataFrame, mapping: DataFrame, column: str, spread_by: str) -> DataFrame:
    """Replace mapped uris; a hot uri is spread over tasks."""
    m = mapping.filter(F.col("target").isNotNull()).select(F.col("uri").alias(column), "target")
    changed = salted_join(rows.join(m.select(column), column, "left_semi"), m, column, spread_by)
    same = rows.join(m, column, "left_anti")
    return same.unionByName(changed.withColumn(column, F.col("target")).select(*rows.columns))
