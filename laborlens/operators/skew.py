"""Joins and rankings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_SHARE = 1000  # a key is hot above 1/1000 of the rows, so there are fewer than 1000 of them
HOT_FLOOR = 50_000  # and never below this many rows


def hot_keys(df: DataFrame, key: str, floor: int = HOT_FLOOR) -> DataFrame:
    """(key, salts) of the keys above the limit: fewer than ``HOT_SHARE`` rows by construction."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_t")).select("_t").scalar()
    limit = F.greatest(F.lit(floor).cast("double"), total / F.lit(float(HOT_SHARE)))
    return (
        counts.withColumn("_limit", limit)
        .filter(F.col("_n") > F.col("_limit"))
        .select(F.col(key), F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias("_salts"))
    )


def salted_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, floor: int = HOT_FLOOR
) -> DataFrame:
    """Inner equi-join on ``key``; rows of a hot key on the left are spread over many tasks.

    The right rows of a hot key are repeated once per salt; other keys are left alone. The
    table of hot keys has fewer than 1000 rows whatever the data, so it may be broadcast.
    """
    hot = F.broadcast(hot_keys(left, key, floor))
    one = F.coalesce(F.col("_salts"), F.lit(1))
    a = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), one).cast("int"))
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1)))
    return a.drop("_salts").join(b.drop("_salts"), [key, "_salt"]).drop("_salt")


def rank_in_group(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """1-based rank within ``group`` without sorting a whole group in one task.

    ``bucket`` must grow with ``order``. Rows are numbered inside a bucket, and the sizes of
    the earlier buckets of the group are added.
    """
    local = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = df.withColumn("_bucket", bucket).withColumn("_rn", F.row_number().over(local))
    sizes = numbered.groupBy(*group, "_bucket").agg(F.max("_rn").cast("long").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        numbered.join(starts, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_rn")).cast("long"))
        .drop("_bucket", "_before", "_rn")
    )


def latest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Last row per key as an aggregate (combined before the shuffle), not as a window."""
    newest = F.max_by(F.struct(*keep), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """First row per key in the given order, as an aggregate."""
    o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), o).alias("_r")).select(*keys, "_r.*")
