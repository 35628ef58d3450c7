"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight, so documents sorted by key
are a weighted sample without replacement. A source is taken in complete epochs first; the rest of
its target is filled in key order up to the remaining words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in code point order, repeating
SHARE = 1.5  # words of the mix for each word of the input
EPOCHS = 2.0  # most words taken from a source, as a multiple of its own
BUCKET_ROWS = 4096  # rows of a source that one task sorts together, about


def quality_level(text: Column) -> Column:
    """1 to 10: the share of characters that are no digits or signs, squared; junk is lower."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(t, "0123456789#$%&*+/<=>@[\\]^_`{|}~!", "")).cast("double")
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    return F.greatest(F.lit(1), F.floor(10 * plain * plain / (n * n))).cast("int")


def uniform(id_col: Column, seed: int) -> Column:
    """(0, 1) from the id alone, so reruns agree: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sizes``, one row per source with its source_size, with its target.

    Water filling: sources whose cap lies below their weighted share get the cap. In the order of
    cap / weight, the capped ones are a prefix; the others share the rest by weight. The windows
    are over one row per source.
    """
    n = len(weights)
    w = F.element_at(F.lit([float(x) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(n)) + 1).cast("int"))
    s = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size") * F.lit(epochs))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "_rank")
    done = by.rowsBetween(Window.unboundedPreceding, -1)
    left = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(share))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(left)
    s = s.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that its cap does not hold down is the level of all after it
    s = s.withColumn("level", F.min(F.when(F.col("_free"), F.struct(F.col("cap") / F.col("weight"), F.col("_rank"), F.col("_level")))).over(all_rows)["_level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.withColumn("target", target).select(*sizes.columns, "target")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: int = 0,
) -> DataFrame:
    """(id, source, size, source_size, target, taken, key) of every document.

    ``size`` counts words (null text: 0), ``taken`` the words the mix takes, repeats counted: complete
    epochs of the source, and once more for the documents first in key order whose middle lies below
    the rest of the target. Null is a source of its own, the last. Equal keys (repeated ids) go by
    size and take their turn one after the other; a document without words takes nothing; an empty
    table gives an empty mix. Other columns are not read.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
        quality_level(F.col(text_col)).alias("level"),
    ).withColumn("key", -F.log(uniform(F.col("id"), seed)) / (F.col("level") / 10.0))
    rows = cut(rows, "mixing")  # the texts are read and measured once, whatever follows
    shares = F.array(*[F.avg((F.col("level") == c).cast("double")) for c in range(1, 11)])
    sums = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("docs"), shares.alias("shares")
    )
    per = source_targets(sums, weights, share, epochs).withColumns(
        {
            "whole": F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).cast("long"),
            "buckets": F.ceil(F.col("docs") / F.lit(float(BUCKET_ROWS))),
        }
    )
    per = per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # one row per source; the join is left to the optimizer, which broadcasts it when it is small
    at = rows.join(per.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # the distribution of the keys, known from the weights, spreads them evenly over [0, 1)
    spread = sum(F.col("shares")[c - 1] * (1 - F.exp(-F.col("key") * c / 10.0)) for c in range(1, 11))
    at = at.withColumn("bucket", F.floor(spread * F.col("buckets")).cast("long"))
    # pre-aggregated sums of the buckets, then the sum of the buckets before each
    part = at.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    at = at.join(part, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    again = (before + F.col("size") / 2.0 <= F.col("rest")).cast("long")
    return at.withColumn("taken", (F.col("size") * (F.col("whole") + again)).cast("long")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "key"
    )
