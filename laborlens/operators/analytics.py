"""Counts, ratios and per-key summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numbers as N
from .serving import is_matchable


def kpis(profiles, jobs, matches, feedback, deletions, contacts) -> DataFrame:
    """Eleven counts in one row: one filtered aggregate per table, tables read once each."""

    def one(df: DataFrame, **counts: Column) -> DataFrame:
        return df.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])

    kind = F.col("type")
    parts = [
        one(profiles, users=F.col("role") == "user", onboarded=F.col("onboarded_at").isNotNull()),
        one(jobs, published=is_matchable(), review=F.col("status") == "pending_review", expired=F.col("status") == "expired"),
        one(matches, matches=~F.col("knocked_out")),
        one(feedback, saved=kind == "saved", applied=kind == "applied", dismissed=kind == "dismissed"),
        one(deletions, deletions=F.col("status") == "pending"),
        one(contacts, contacts=F.col("handled_at").isNull()),
    ]
    names = [n for p in parts for n in p.columns]
    long = None
    for p in parts:
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in p.columns]))
        rows = p.select(pairs.alias("r")).select("r.*")
        long = rows if long is None else long.unionByName(rows)
    return long.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])


def ratios(kpi: DataFrame) -> DataFrame:
    """Saved and applied per visible match, null without matches."""
    return kpi.select(
        F.try_divide(F.col("saved").cast("double"), F.col("matches").cast("double")).alias("saved_share"),
        F.try_divide(F.col("applied").cast("double"), F.col("matches").cast("double")).alias("applied_share"),
    )


def dismiss_reasons(feedback: DataFrame) -> DataFrame:
    rows = feedback.filter((F.col("type") == "dismissed") & F.col("reason").isNotNull())
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def coverage(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Published golden postings per source; postings without a source are manual."""
    live = jobs.filter(is_matchable()).groupBy(F.coalesce("source_id", F.lit("manual")).alias("source_id"))
    return live.agg(F.count("*").alias("n")).join(sources, "source_id", "left")


def source_counts(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    live = jobs.filter(F.col("status") == "published").groupBy("source_id").agg(F.count("*").alias("_n"))
    return sources.join(live, "source_id", "left").select("source_id", F.coalesce("_n", F.lit(0)).alias("n"))


def landing(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Published golden postings, distinct cities of published ones, first 24 company names."""
    counts = jobs.agg(
        F.count_if(is_matchable()).alias("jobs"),
        F.count_distinct(F.when(F.col("status") == "published", F.col("city"))).alias("cities"),
    )
    names = companies.select("name").orderBy("name").limit(24).agg(F.array_sort(F.collect_list("name")).alias("n"))
    return counts.withColumn("companies", F.array_join(names.select("n").scalar(), ","))


OUTCOMES = ("new", "updated", "unchanged", "duplicate", "failed", "expired")


def run_counts(items: DataFrame) -> DataFrame:
    """Outcome counters and final status per run."""
    counts = items.groupBy("run_id").agg(
        F.count_if(F.col("outcome") != "expired").alias("fetched"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
    )
    status = F.when(F.col("failed") == 0, "succeeded").when(F.col("failed") < F.col("fetched"), "partial")
    return counts.withColumn("status", status.otherwise("failed"))


def error_sample(items: DataFrame, k: int = 50) -> DataFrame:
    """The first ``k`` errors of every run (a report with a fixed length)."""
    w = Window.partitionBy("run_id").orderBy("item", "external_id")
    first = items.filter(F.col("outcome") == "failed").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return first.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("item", "external_id"))).alias("errors"))


def profile_strength(candidates, skills, languages) -> DataFrame:
    """Share of six completeness flags, in whole percent."""
    n_skills = skills.groupBy("user_id").agg(F.count("*").alias("_s"))
    n_lang = languages.groupBy("user_id").agg(F.count("*").alias("_l"))
    f = candidates.join(n_skills, "user_id", "left").join(n_lang, "user_id", "left")
    flags = [
        F.coalesce(F.col("_s") >= 5, F.lit(False)), F.size("past_codes") > 0, F.col("_l") > 0,
        F.col("lat").isNotNull(), F.col("riasec").isNotNull(), F.col("work_values").isNotNull(),
    ]
    done = sum((F.coalesce(x, F.lit(False)).cast("int") for x in flags), F.lit(0))
    return f.select("user_id", done.alias("done"), N.half_up(done / 6.0 * 100.0, 0).cast("int").alias("percent"))


ITEMS_PER_TYPE = 5


def interest_scores(answers: DataFrame) -> DataFrame:
    """Six interest scores of 30 items from answers (user_id, dimension, item, answer 1..5).

    An item without an answer counts as 3; a score is (sum - 5) / 20 in three decimals.
    """
    total = answers.groupBy("user_id").agg(
        *[F.sum(F.when(F.col("dimension") == k, F.col("answer") - 3)).alias(k) for k in N.RIASEC],
        F.count_distinct("dimension", "item").alias("answered"),
    )
    n = ITEMS_PER_TYPE

    def score(k: str) -> Column:
        points = F.coalesce(F.col(k), F.lit(0)) + 3 * n
        return N.half_up((points - n).cast("double") / (4.0 * n), 3).alias(f"score_{k.lower()}")

    return total.select("user_id", *[score(k) for k in N.RIASEC], (F.col("answered") == n * 6).alias("complete"))
