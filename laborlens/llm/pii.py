"""Personal data: base patterns as seeds, and bootstrapped contextual extraction of what they miss.

Every token that might be an identifier is a slot with its words before and after. Slots that hold a
base match are seeds. Words around them make lexical patterns; patterns and slot values form a graph
that is scored in rounds: a pattern is as good as the share of its values that are known to be of one
kind, a value as likely as the patterns that hold it. Values of accepted patterns become known in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from laborlens.operators.skew import salted_join

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in forms that never look at a character run twice: lookbehinds stop searches inside a
#: run, possessive groups need no stack, and card runs outside 12 to 19 digits, which fail anyway, are left out.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
NUMBER = r"[0-9()+./-]*[0-9][0-9()+./-]*+"
SLOT = rf"(?<!\S)(?:{NUMBER}(?:\x20{NUMBER})*+[,;:!?]*(?!\S)|\S*(?:[0-9@]|\(at\)|\[at\])\S*+)"
#: Forms that an identifier of a kind may take when no base pattern knows it.
SHAPES = {
    "email": r"^[^@\s]+(?:@|\(at\)|\[at\])[^@\s]+\z",
    "ip": r"^(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}\z",
    "card": r"^[0-9 ./-]+\z",
    "phone": r"^[0-9()+ ./-]+\z",
}
DIGITS = {"ip": (2, 32), "card": (12, 19), "phone": (7, 15)}
BEFORE, AFTER = 64, 40  # characters around a slot in which its two words before and one after are read
ROUNDS = 3
MIN_VALUES = 3.0  # known values that a pattern needs
MIN_SCORE = 0.7  # of a pattern, and of a value
BLOCK = 256  # running sums that are gathered before they join the list of blocks


def running(a: Column) -> Column:
    """For each element of an array the sum of those before it, in one pass.

    Sums are gathered in blocks and the blocks in a list, so no long array is copied per element.
    """
    none = F.array().cast("array<int>")
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), none.alias("block"), F.lit(0).alias("sum"))

    def add(acc: Column, x: Column) -> Column:
        full = F.size(acc["block"]) >= BLOCK
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(acc["sum"])).otherwise(F.concat(acc["block"], F.array(acc["sum"]))).alias("block"),
            (acc["sum"] + x).alias("sum"),
        )

    return F.aggregate(a, start, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["block"]))))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    back = F.reverse(digits_of(value))
    twice = F.translate(back, "0123456789", "0246813579")  # the digit sum of the doubled digit
    places = F.sequence(F.lit(1), F.length(back))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda s, i: s + F.substr(F.when(i % 2 == 0, twice).otherwise(back), i, F.lit(1)).cast("int"),
    )
    return (F.length(back) > 0) & (total % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern counts."""
    n = F.length(digits_of(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{PART}(?:\.{PART}){{3}}\z"),
        "card": n.between(12, 19) & luhn(value),
        "phone": n.between(9, 15),
    }[kind]


def holds(kind: str, text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0))
    return F.exists(hits, lambda h: valid(kind, h))


def located(kind: str) -> Column:
    """Spans (start, kind, end) of the valid matches, from the columns ``hits_<kind>`` and ``gaps_<kind>``."""
    hits, gaps = F.col(f"hits_{kind}"), F.col(f"gaps_{kind}")
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: g + F.coalesce(F.length(h), F.lit(0)))
    ends = F.zip_with(running(sizes), sizes, lambda b, s: b + s)
    spans = F.zip_with(
        ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), e.alias("end"), h.alias("value"))
    )
    good = F.filter(spans, lambda s: valid(kind, s["value"]))
    plain = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(F.size(hits) > 0, plain).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def read_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, base, slots): what the operator needs of each text; the text itself is left behind."""
    t = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = {"key": F.unhex(F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit(" ")), F.lit(":"), t), 256))}
    for kind in KINDS:
        found[f"hits_{kind}"] = F.regexp_extract_all(t, F.lit(BASE[kind]), F.lit(0))
        found[f"gaps_{kind}"] = F.transform(F.split(t, BASE[kind]), lambda g: F.length(g))
    found["values"] = F.regexp_extract_all(t, F.lit(SLOT), F.lit(0))
    found["texts"] = F.split(t, SLOT)
    rows = rows.withColumns(found)
    values, texts = F.col("values"), F.col("texts")
    sizes = F.zip_with(F.slice(texts, F.lit(1), F.size(values)), values, lambda g, h: F.length(g) + F.length(h))
    rows = rows.withColumns({"base": F.sort_array(F.concat(*[located(k) for k in KINDS])), "sizes": sizes})
    # a slot's words are looked for up to the slots beside it, these included
    before = lambda i: F.right(F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), F.get(texts, i)), F.lit(BEFORE))
    after = lambda i: F.left(F.concat(F.get(texts, i + 1), F.coalesce(F.get(values, i + 1), F.lit(""))), F.lit(AFTER))
    slots = F.transform(
        running(F.col("sizes")),
        lambda b, i: F.struct(
            (b + F.length(F.get(texts, i))).alias("start"),
            F.get(values, i).alias("value"),
            before(i).alias("before"),
            after(i).alias("after"),
        ),
    )
    return rows.withColumn("slots", F.when(F.size("sizes") > 0, slots)).select("id", "key", "base", "slots")


def word(w: Column) -> Column:
    """A context word: lower case, without signs at its ends, any number as 9."""
    bare = F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")
    return F.regexp_replace(F.coalesce(bare, F.lit("")), r"[0-9]+", "9")


def occurrences(texts: DataFrame) -> DataFrame:
    """(key, start, end, value, seed, shapes, patterns) of every slot; equal rows of a table count once."""
    s = texts.select("key", F.explode("slots").alias("s")).select("key", "s.*").dropDuplicates(["key", "start"])
    lead = F.length(F.regexp_extract(F.col("value"), r"^[^\p{L}\p{N}+(\[]*", 0))
    # a trailing run of signs is looked for from its first sign only
    tail = F.length(F.regexp_extract(F.col("value"), r"(?<![^\p{L}\p{N})\]])[^\p{L}\p{N})\]]+\z", 0))
    inner = F.substr("value", lead + 1, F.greatest(F.length("value") - lead - tail, F.lit(0)))
    words = F.regexp_extract_all(F.col("before"), F.lit(r"\S+"), F.lit(0))
    s = s.withColumns(
        {
            "raw": F.col("value"),
            "value": inner,
            "start": F.col("start") + lead,
            "w1": word(F.get(words, F.size(words) - 1)),
            "w2": word(F.get(words, F.size(words) - 2)),
            "r1": word(F.regexp_extract(F.col("after"), r"^\s*(\S+)", 1)),
        }
    )
    seeds = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        seeds = F.when(holds(KINDS[k], F.col("raw")), F.lit(k)).otherwise(seeds)
    n = F.length(digits_of(F.col("value")))
    lower = F.lower("value")
    shapes = [
        F.when(lower.rlike(SHAPES[k]) & n.between(*DIGITS.get(k, (0, 1 << 30))), F.lit(i)) for i, k in enumerate(KINDS)
    ]
    two = F.when((F.col("w1") != "") & (F.col("w2") != ""), F.concat_ws(" ", F.col("w2"), F.col("w1"), F.lit("_")))
    around = F.when((F.col("w1") != "") & (F.col("r1") != ""), F.concat_ws(" ", F.col("w1"), F.lit("_"), F.col("r1")))
    return s.select(
        "key",
        "start",
        (F.col("start") + F.length("value")).alias("end"),
        lower.alias("value"),
        seeds.alias("seed"),
        F.array_compact(F.array(*shapes)).alias("shapes"),
        F.array_compact(F.array(two, around)).alias("patterns"),
    ).filter(F.col("value") != "")


def pattern_scores(known: DataFrame, learned: DataFrame | None) -> DataFrame:
    """(pattern, kind, score) of the accepted patterns: known values against values that cannot be of the kind."""
    rows = known
    if learned is not None:
        rows = known.unionByName(learned, allowMissingColumns=True)
    sums = rows.groupBy("pattern").agg(
        *[F.coalesce(F.sum(f"yes{k}"), F.lit(0.0)).alias(f"yes{k}") for k in range(len(KINDS))],
        *[F.coalesce(F.sum(f"no{k}"), F.lit(0.0)).alias(f"no{k}") for k in range(len(KINDS))],
    )
    each = F.array(
        *[
            F.struct(
                F.round(F.col(f"yes{k}") / (F.col(f"yes{k}") + F.col(f"no{k}") + 1), 9).alias("score"),
                F.lit(-k).alias("order"),
                F.lit(k).alias("kind"),
                F.round(F.col(f"yes{k}"), 9).alias("yes"),
            )
            for k in range(len(KINDS))
        ]
    )
    best = sums.select("pattern", F.array_max(each).alias("b"))
    return best.filter((F.col("b.yes") >= MIN_VALUES) & (F.col("b.score") >= MIN_SCORE)).select(
        "pattern", F.col("b.kind").alias("kind"), F.col("b.score").alias("score")
    )


def value_scores(open_edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, kind, score) of the values that accepted patterns vouch for; one kind each."""
    held = salted_join(open_edges, patterns, "pattern", "value").filter("array_contains(shapes, kind)")
    doubt = F.exp(F.sum(F.log(1 - F.col("score"))))
    likely = held.groupBy("value", "kind").agg(F.round(1 - doubt, 9).alias("score")).filter(F.col("score") >= MIN_SCORE)
    first = F.max(F.struct("score", (-F.col("kind")).alias("order"), "kind")).alias("b")
    return likely.groupBy("value").agg(first).select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))


def learned_values(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, score) of unseen identifiers after some rounds over the graph of patterns and values."""
    edges = seen.select("value", "seed", "shapes", F.explode("patterns").alias("pattern"))
    edges = cut(edges.dropDuplicates(["pattern", "value", "seed"]), "pii-edges")
    marks = {}
    for k in range(len(KINDS)):
        is_k = F.coalesce(F.col("seed") == k, F.lit(False))
        marks[f"yes{k}"] = is_k.cast("double")
        marks[f"no{k}"] = (~is_k & ~F.array_contains("shapes", F.lit(k))).cast("double")
    known = edges.select("pattern", *[c.alias(n) for n, c in marks.items()]).groupBy("pattern").agg(*[F.sum(n).alias(n) for n in marks])
    known = cut(known, "pii-patterns")
    open_edges = cut(edges.filter("seed is null and size(shapes) > 0").select("value", "shapes", "pattern"), "pii-open")
    found, learned = None, None
    for _ in range(rounds):
        if found is not None:
            again = salted_join(open_edges, found, "value", "pattern")
            learned = again.select(
                "pattern", *[F.when(F.col("kind") == k, F.col("score")).otherwise(0.0).alias(f"yes{k}") for k in range(len(KINDS))]
            )
        found = cut(value_scores(open_edges, pattern_scores(known, learned)), "pii-values")
    return found


def count_of(kind: int, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(each, ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, base, added): spans (start, kind, end) of every document in code points, the end not included.

    ``base`` holds the valid matches of the four base patterns, ``added`` what the patterns learned from
    them find besides; an added span never overlaps a base one. A null text is empty and has no spans.
    Rows with the same id and text are read as one for learning, and each gets the spans. Of two kinds
    with equal scores the earlier counts. An empty table gives an empty result, without seeds nothing
    is added, and other columns are not read.
    """
    texts = cut(read_texts(docs, id_col, text_col), "pii")
    seen = cut(occurrences(texts), "pii-slots")
    unknown = seen.filter("seed is null and size(shapes) > 0").select("key", "start", "end", "value")
    hits = salted_join(unknown, learned_values(seen, rounds).select("value", "kind"), "value", "key")
    spans = hits.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    both = texts.select("id", "key", "base").join(spans, "key", "left")
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return both.select(F.col("id").alias(id_col), "base", F.coalesce(F.sort_array(apart), none).alias("added"))


def describe(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    counts = [count_of(k, F.col("base")).alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]
    return found.select(
        id_col,
        *counts,
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
