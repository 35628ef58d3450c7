"""URL filters: a sort-merge range join of canonical keys with nested prefix rules.

A rule (host, path) becomes the interval of all keys that begin with its reversed host, a zero byte
and its path. Such intervals nest or are apart. Rules and keys are dealt out by key range and sorted;
one sweep per range keeps the stack of active rules, and the stack that is open where a range begins
is carried over from the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<size:int,labels:int,rule:string,verdict:string>>"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and for an address without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.translate(host, UPPER, LOWER), path


def key_of(labels: Column, path: Column) -> Column:
    """Binary key: top-level label first, a zero byte, then the path."""
    return F.concat(F.encode(F.array_join(labels, "."), "UTF-8"), F.unhex(F.lit("00")), F.encode(path, "UTF-8"))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): each rule opens its stack of nested rules and closes back to its parents."""
    clean = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .filter("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block wins over allow for the same rule
        .withColumn("labels", F.reverse(F.split("host", r"\.")))
        .withColumn("rule", F.concat("host", "path"))
    )
    lengths = clean.select(F.length("path").alias("n")).distinct()
    lengths = [r["n"] for r in lengths.collect()]  # at most as many as the longest rule has characters
    shorter = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda n: n < F.length("path"))
    entry = F.struct(
        F.length("rule").alias("size"), F.size("labels").alias("labels"), F.col("rule"), F.col("verdict")
    )
    base = clean.withColumn("entry", entry)
    outer = base.select("host", F.col("path").alias("outer_path"), F.col("entry").alias("outer_entry"))
    inner = base.select("host", "path", F.explode(shorter).alias("n")).withColumn("outer_path", F.expr("left(path, n)"))
    above = inner.join(outer, ["host", "outer_path"]).groupBy("host", "path").agg(F.sort_array(F.collect_list("outer_entry")).alias("above"))
    full = base.join(above, ["host", "path"], "left").withColumn(
        "above", F.coalesce("above", F.array().cast(STACK))
    )
    key = key_of(F.col("labels"), F.col("path"))
    opens = full.select(key.alias("key"), F.lit(0).alias("kind"), F.concat("above", F.array("entry")).cast(STACK).alias("stack"))
    # 0xFF stands in no UTF-8 text, so a closing key follows every key that begins with the rule
    closes = full.select(
        F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), F.col("above").cast(STACK).alias("stack")
    )
    return opens.unionByName(closes)


def swept(keys: DataFrame, events: DataFrame) -> DataFrame:
    """(key, size, labels, rule, verdict) of the innermost rule around each key that has one."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.unionByName(keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast(STACK).alias("stack")))
    # written once, so the sampled ranges are the same for all that follows
    ranged = cut(rows.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "urls")
    place = F.struct("key", "kind")
    last = ranged.filter("kind = 0").groupBy("part").agg(F.max_by("stack", place).alias("stack"))
    every = ranged.select("part").distinct().join(last, "part", "left")  # one row per range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    here = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.coalesce(F.last("stack", ignorenulls=True).over(here), "carried")
    top = F.element_at("stack", -1)
    return (
        ranged.join(F.broadcast(carried), "part")  # as many rows as ranges
        .withColumn("stack", stack)
        .filter("kind = 1 and size(stack) > 0")
        .select("key", top.alias("top"))
        .select("key", "top.*")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; ``rules`` has host, path, verdict.

    A rule fits its host and the hosts below it if the path begins with the rule's path. The longest
    rule wins, at equal length the longer host. Where no rule fits, rule is null and the verdict is
    ``default``. Null addresses and those without ``://`` have an empty host and path. Rules with a
    null are left out; of two equal rules with both verdicts, block counts. Repeated pages stay as
    many; empty tables give empty results; other columns of either table are not read.
    """
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    events = rule_events(rules)
    # how many labels the rules have decides which parent domains of a host are looked at
    depths = rules.filter("host is not null").select(F.size(F.split("host", r"\.")).alias("n")).distinct()
    depths = sorted(r["n"] for r in depths.collect())  # at most 127 for real hosts
    labels = F.reverse(F.split("host", r"\."))
    wanted = F.filter(F.lit(depths) if depths else F.array().cast("array<int>"), lambda n: n <= F.size("labels"))
    seen = judged.select("host", "path").distinct().withColumn("labels", labels)
    points = seen.withColumn("n", F.explode(wanted)).select(
        "host", "path", key_of(F.slice("labels", F.lit(1), F.col("n")), F.col("path")).alias("key")
    )
    hits = swept(points.select("key").distinct(), events)
    best = (
        points.join(hits, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct("size", "labels", "rule", "verdict")).alias("best"))
    )
    return judged.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
