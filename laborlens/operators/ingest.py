"""From canonical postings to stored postings: hashing, outcome, enrichment, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, text as X
from ..functions.embed import embed
from .dedup import resolve_companies
from .language import language_column


def stable_hash(*names: str) -> Column:
    """sha256 over JSON with sorted keys; nulls are written, so adding one changes nothing else."""
    body = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def blend_values(occupation: Column, text: Column) -> Column:
    """Half the occupation's value, half the text signal, two decimals; unknown is 0.5."""
    half = F.lit(0.5)
    return N.half_up(half * F.coalesce(occupation, half) + half * F.coalesce(text, half), 2)


REVIEW_CONFIDENCE = 0.6
CONTENT = (
    "title", "description", "company_name", "company_domain", "apply_url", "source_url", "city", "region", "postal_code",
    "country", "lat", "lng", "remote_policy", "employment_types", "hours_min", "hours_max", "salary", "date_posted",
    "valid_through", "language",
)


def content_hash(rows: DataFrame) -> DataFrame:
    """Add the hash of everything but the external id."""
    return rows.withColumn("content_hash", stable_hash(*[c for c in CONTENT if c in rows.columns]))


def match_stored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows with the stored id, hash, status and golden flag of the same source id."""
    old = stored.select(
        "source_id", "external_id", F.col("job_id").alias("old_id"), F.col("content_hash").alias("old_hash"),
        F.col("status").alias("old_status"), F.col("is_golden").alias("old_golden"),
    )
    return incoming.join(old, ["source_id", "external_id"], "left")


def outcome(is_duplicate: Column) -> Column:
    """new, updated, unchanged or duplicate of a row joined to its stored version."""
    same = F.col("old_hash") == F.col("content_hash")
    return (
        F.when(same & F.col("old_golden"), "unchanged").when(same, "duplicate")
        .when(is_duplicate, "duplicate").when(F.col("old_id").isNotNull(), "updated").otherwise("new")
    )


def review_reasons(confidence: Column, skills: Column, isco: Column, unmapped: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(confidence < REVIEW_CONFIDENCE, F.lit("low_confidence")), F.when(skills == 0, F.lit("no_skills")),
            F.when(isco.isNull(), F.lit("no_occupation")), F.when(unmapped > 3, F.lit("unmapped_skills")),
        )
    )


def routed_status(reasons: Column) -> Column:
    """Unmapped skills alone flag a row but do not hold it back."""
    held = F.arrays_overlap(reasons, F.array(F.lit("low_confidence"), F.lit("no_skills"), F.lit("no_occupation")))
    return F.when(F.size(reasons) == 0, "published").when(held, "pending_review").otherwise("published")


def sticky_status(new: Column) -> Column:
    """Moderation survives updates; an unchanged expired row seen again is published."""
    old, same = F.col("old_status"), F.col("old_hash") == F.col("content_hash")
    return (
        F.when(same & (old == "expired"), "published").when(same, old)
        .when(old.isin("rejected", "archived"), old).otherwise(new)
    )


def geocode(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """Coordinates of the source win as a pair; otherwise the city's, with its region."""
    places = cities.select("norm", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("province").alias("_region"))
    f = rows.withColumn("norm", X.normalize_plain(F.col("city"))).join(places, "norm", "left").drop("norm")
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return f.withColumns(
        {
            "lat": F.when(own, F.col("lat")).otherwise(F.col("_lat")),
            "lng": F.when(own, F.col("lng")).otherwise(F.col("_lng")),
            "region": F.when(own, F.col("region")).otherwise(F.coalesce("_region", "region")),
        }
    ).drop("_lat", "_lng", "_region")


def named_companies(rows: DataFrame, companies: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, company_key, _company): the known or new company of every posting and its name.

    Only the columns that say so are read, so texts and whatever else a row holds stay where they are.
    """
    posts, new, _fills = resolve_companies(rows.select(key, "company_name", "apply_url"), companies)
    names = companies.select(F.col("company_id").cast("string").alias("company_key"), F.col("name").alias("_company"))
    names = names.unionByName(new.select("company_key", F.col("name").alias("_company"))).dropDuplicates(["company_key"])
    return posts.join(names, "company_key", "left").select(key, "company_key", "_company")


def enrich(
    rows: DataFrame, classified: DataFrame, cities: DataFrame, key: str = "doc_id", companies: DataFrame | None = None,
    profiles: DataFrame | None = None, today: Column | None = None,
) -> DataFrame:
    """Canonical rows to posting rows: the source's value first, then the classifier's, then lookups.

    ``classified`` is the output of the classifier; with ``cls_unmapped`` it also has the labels without a concept.
    ``salary`` is struct<min,max,unit,currency,text>. With ``companies`` (company_id, name, domain) every posting gets a
    ``company_key``, and the name behind it goes into the duplicate key. With the language ``profiles`` a posting
    without a language gets that of its text. ``today`` is the date of postings without one. ``embedding`` is the vector
    of title and description. ``key`` names a posting once. Companies are looked up beside the rows and texts are scored
    in place, so that what stands above is not made again for a later lookup.
    """
    f = geocode(rows.join(classified, key, "left"), cities)
    f = f.withColumn("_text", F.concat_ws("\n", "title", "description"))
    if companies is not None:
        f = f.join(named_companies(rows, companies, key), key, "left")
    else:
        f = f.withColumn("_company", F.lit(None).cast("string"))
    if profiles is not None:
        found = language_column(profiles, F.col("_text"))
        f = f.withColumn("language", F.coalesce("language", found) if "language" in rows.columns else found)
    if today is not None:
        f = f.withColumn("date_posted", F.coalesce("date_posted", today) if "date_posted" in rows.columns else today)
    hours = F.coalesce("hours_min", "cls_hours.min", "hours_max", "cls_hours.max")
    s = F.col("salary")
    money = N.salary_normalize(s["min"], s["max"], s["unit"], s["currency"], s["text"], hours)
    f = f.withColumn("_money", money)
    n_skills = F.coalesce(F.size("cls_skills"), F.lit(0))
    unmapped = F.coalesce(F.size("cls_unmapped"), F.lit(0)) if "cls_unmapped" in classified.columns else F.lit(0)
    reasons = review_reasons(F.col("cls_confidence"), n_skills, F.col("cls_isco"), unmapped)
    f = f.withColumn("review_reasons", reasons)
    return f.withColumns(
        {
            "employment_types": F.when(F.size("employment_types") > 0, F.col("employment_types")).otherwise(F.col("cls_employment")),
            "remote_policy": F.coalesce("remote_policy", "cls_remote"),
            "hours_min": F.coalesce("hours_min", "cls_hours.min"),
            "hours_max": F.coalesce("hours_max", "cls_hours.max"),
            "salary_min_month": F.col("_money.min_month"),
            "salary_max_month": F.col("_money.max_month"),
            "country": F.left(F.coalesce("country", F.lit("NL")), F.lit(2)),
            "isco_code": F.col("cls_isco"),
            "seniority": F.col("cls_seniority"),
            "apply_url_normalized": X.url_canonical(F.col("apply_url")),
            "dedup_key": X.dedup_key(F.col("title"), F.coalesce("_company", "company_name"), F.col("city")),
            "classification_confidence": N.half_up(F.col("cls_confidence"), 2),
            "needs_review": F.size("review_reasons") > 0,
            "status": routed_status(F.col("review_reasons")),
            "embedding": embed(F.col("_text")),
        }
    ).drop("_money", "_company", "_text")


def manual_rows(entries: DataFrame) -> DataFrame:
    """Manual postings enter the same path without a source and with the highest priority."""
    return entries.withColumns({"source_id": F.lit(None).cast("string"), "source_priority": F.lit(100)})
