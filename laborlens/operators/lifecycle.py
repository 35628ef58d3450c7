"""State over time: versions, consent, expiry, retention, erasure, applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .serving import LIVE
from .skew import first_by, latest

# Source types whose feed is a full snapshot, so an absent posting has been closed.
SNAPSHOT_TYPES = ("greenhouse", "lever", "recruitee", "personio", "generic_feed")
CONSENT_TYPES = ("terms_privacy", "ai_processing", "employer_sharing", "marketing")
STAGES = ("saved", "applied", "interview", "offer", "rejected")


def current_consents(consents: DataFrame) -> DataFrame:
    return latest(consents, ["user_id", "type"], ["created_at", "event_id"], ["granted", "policy_version", "created_at"])


def golden(jobs: DataFrame) -> DataFrame:
    """Golden posting per duplicate group: highest source priority, then last seen, then id."""
    alive = jobs.filter(F.col("status").isin("published", "pending_review", "draft") & F.col("dedup_group_id").isNotNull())
    best = F.max(F.struct("source_priority", "last_seen", "job_id")).alias("_b")
    return alive.groupBy("dedup_group_id").agg(best).select("dedup_group_id", F.col("_b.job_id").alias("golden_job_id"))


def mark_golden(jobs: DataFrame) -> DataFrame:
    """Set ``is_golden``: the winner of its group, or any posting without a group."""
    winners = golden(jobs).select(F.col("golden_job_id").alias("job_id")).withColumn("_g", F.lit(True))
    flag = F.col("dedup_group_id").isNull() | F.coalesce("_g", F.lit(False))
    return jobs.drop("is_golden").join(winners, "job_id", "left").withColumn("is_golden", flag).drop("_g")


def next_versions(versions: DataFrame, drafts: DataFrame, owner: str) -> DataFrame:
    """Append one new active version per owner with a draft and retire its older ones."""
    top = versions.groupBy(owner).agg(F.max("version").alias("_top"))
    new = drafts.join(top, owner, "left").select(
        owner, (F.coalesce("_top", F.lit(0)) + 1).alias("version"), F.lit(True).alias("is_active"), "payload"
    )
    touched = drafts.select(owner).distinct().withColumn("_t", F.lit(True))
    old = versions.join(touched, owner, "left").withColumn(
        "is_active", F.col("is_active") & F.col("_t").isNull()
    ).select(owner, "version", "is_active", "payload")
    return old.unionByName(new)


def active_versions(versions: DataFrame, owner: str) -> DataFrame:
    live = versions.filter("is_active")
    return live.groupBy(owner).agg(F.max("version").alias("version"), F.max(F.struct("version", "payload")).alias("_b")).select(owner, "version", F.col("_b.payload").alias("payload"))


def since_last_ok(runs: DataFrame) -> DataFrame:
    """Start of the last good run per source; null for snapshot sources, which read everything."""
    ok = F.col("status").isin("succeeded", "partial")
    last = runs.groupBy("connector_id", "connector_type").agg(F.max(F.when(ok, F.col("started_at"))).alias("last_ok"))
    snapshot = F.col("connector_type").isin(*SNAPSHOT_TYPES)
    return last.withColumn("since", F.when(~snapshot, F.col("last_ok")))


def expired_jobs(jobs: DataFrame, now: Column, stale_days: int = 45) -> DataFrame:
    """Published postings past their end date, or from a source and not seen for 45 days."""
    live = jobs.filter(F.col("status") == "published")
    old = F.col("source_id").isNotNull() & (F.col("last_seen") < now - F.make_dt_interval(days=F.lit(stale_days)))
    return live.filter((F.col("valid_through") < now) | old)


def expire(jobs: DataFrame, matches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(postings with new status, matches that remain)."""
    gone = expired_jobs(jobs, now).select("job_id")
    marked = jobs.join(gone.withColumn("_x", F.lit(True)), "job_id", "left").withColumn(
        "status", F.when(F.col("_x"), "expired").otherwise(F.col("status"))
    ).drop("_x")
    return marked, matches.join(gone, "job_id", "left_anti")


def absence(jobs: DataFrame, seen: DataFrame, sources: DataFrame) -> DataFrame:
    """Count runs without a posting; expire at the source's limit, start again when seen.

    ``seen`` is (source_id, external_id) of this run; a source that delivered nothing is left
    alone, and so are sources that do not deliver snapshots.
    """
    ran = seen.select("source_id").distinct().withColumn("_ran", F.lit(True))
    here = seen.select("source_id", "external_id").distinct().withColumn("_here", F.lit(True))
    rules = sources.filter(F.col("connector_type").isin(*SNAPSHOT_TYPES)).join(ran, "source_id").select(
        "source_id", "expire_after", "_ran"
    )
    f = jobs.join(rules, "source_id", "left").join(here, ["source_id", "external_id"], "left")
    live = F.col("status").isin(*LIVE)
    missed = F.col("_ran").isNotNull() & F.col("_here").isNull() & live
    count = F.when(F.col("_here"), 0).when(missed, F.col("missed_runs") + 1).otherwise(F.col("missed_runs"))
    status = (
        F.when(missed & (F.col("missed_runs") + 1 >= F.col("expire_after")), "expired")
        .when(F.col("_here") & (F.col("status") == "expired"), "published")
        .otherwise(F.col("status"))
    )
    return f.withColumn("new_status", status).withColumn("new_missed", count).drop("_ran", "_here", "expire_after")


def absent_jobs(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored live postings of the delivered sources that the snapshot lacks."""
    ran = seen.select("source_id").distinct()
    live = jobs.filter(F.col("status").isin(*LIVE)).join(ran, "source_id", "left_semi")
    return live.join(seen, ["source_id", "external_id"], "left_anti")


def retention(profiles: DataFrame, now: Column, months: int, warning_days: int) -> DataFrame:
    """Users to warn and to delete. Month arithmetic clamps to the month's end."""
    cutoff = F.add_months(now.cast("date"), -months).cast("timestamp")
    day = F.make_dt_interval(days=F.lit(warning_days))
    quiet = F.col("role") == "user"
    warn = quiet & (F.col("last_active_at") < cutoff + day) & F.col("warned_at").isNull()
    drop = quiet & (F.col("last_active_at") < cutoff) & (F.col("warned_at") < now - day)
    return profiles.withColumn("cohort", F.when(drop, "delete").when(warn, "warn")).filter(F.col("cohort").isNotNull())


def withdraw(consents: DataFrame, matches: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users whose latest processing consent is a refusal lose matches and onboarding."""
    now = current_consents(consents)
    refused = now.filter((F.col("type") == "ai_processing") & ~F.col("granted")).select("user_id")
    flagged = profiles.join(refused.withColumn("_r", F.lit(True)), "user_id", "left")
    reset = flagged.withColumn("onboarded_at", F.when(F.col("_r").isNull(), F.col("onboarded_at"))).drop("_r")
    return matches.join(refused, "user_id", "left_anti"), reset


def signup_consents(signups: DataFrame, meta: str = "meta") -> DataFrame:
    """One consent row per known type in the sign-up JSON."""
    m = F.from_json(F.col(meta), "consents map<string,boolean>, policy_version string")
    rows = signups.select(
        "user_id", F.coalesce(m["policy_version"], F.lit("unknown")).alias("policy_version"), F.explode(m["consents"]).alias("type", "granted")
    )
    return rows.filter(F.col("type").isin(*CONSENT_TYPES))


def advance_activity(profiles: DataFrame, visits: DataFrame) -> DataFrame:
    """Last activity moves when the newest visit is more than an hour later; the warning clears."""
    seen = visits.groupBy("user_id").agg(F.max("visited_at").alias("_v"))
    f = profiles.join(seen, "user_id", "left")
    moved = F.coalesce(F.col("last_active_at") < F.col("_v") - F.expr("INTERVAL 1 HOUR"), F.lit(False))
    return f.withColumns(
        {
            "warned_at": F.when(~moved, F.col("warned_at")),
            "last_active_at": F.when(moved, F.col("_v")).otherwise(F.col("last_active_at")),
        }
    ).drop("_v")


# --- application state as a mergeable fold ------------------------------------------------------

def _state(status: Column | None = None, saved: Column | None = None, applied: Column | None = None) -> Column:
    none = F.lit(None)
    status = none.cast("string") if status is None else F.nullif(status, F.lit(""))  # a nullable field in every form
    return F.struct(
        status.alias("status"),
        (none if saved is None else saved).cast("timestamp").alias("saved_at"),
        (none if applied is None else applied).cast("timestamp").alias("applied_at"),
    )


def event_summary(kind: Column, at: Column) -> Column:
    """What one event makes of no row (``fresh``) and of a saved row (``held``); an applied row never changes.

    In ``held`` a null ``saved_at`` stands for the date that the row had before.
    """
    makes, applies = kind.isin("saved", "applied"), kind == "applied"
    fresh = _state(F.when(makes, kind), F.when(makes, at), F.when(applies, at))
    held = _state(F.when(applies, "applied").when(kind != "unsaved", "saved"), None, F.when(applies, at))
    return F.struct(fresh.alias("fresh"), held.alias("held"))


def then(a: Column, b: Column) -> Column:
    """The summary of ``a`` followed by ``b``; any grouping of neighbours gives the same."""

    def after(start: Column) -> Column:
        s = b["held"]
        kept = F.struct(s["status"].alias("status"), F.coalesce(s["saved_at"], start["saved_at"]).alias("saved_at"), s["applied_at"].alias("applied_at"))
        # a row that is deleted and made again within b has its own date, which is not null
        return F.when(start["status"].isNull(), b["fresh"]).when(start["status"] == "applied", start).otherwise(kept)

    return F.struct(after(a["fresh"]).alias("fresh"), after(a["held"]).alias("held"))


def folded(parts: Column) -> Column:
    """Summaries in order (``s`` of each element) as one."""
    same = F.struct(_state().alias("fresh"), _state(F.lit("saved")).alias("held"))
    return F.aggregate(parts, same, lambda acc, x: then(acc, x["s"]))


def application_state(feedback: DataFrame, span: str = "hour") -> DataFrame:
    """(user_id, job_id, status, saved_at, applied_at) that follows from the feedback log.

    ``saved`` creates a row when there is none, ``unsaved`` removes it only while it is saved, ``applied``
    creates or promotes it. ``saved_at`` is the date of the event that created the row. Events of a pair
    are folded to one summary per ``span`` of time, and the summaries of the spans are merged in order:
    a pair with many events is never gathered whole. Ties of the date go by event id.
    """
    key = ["user_id", "job_id"]
    at = F.col("created_at").cast("timestamp")
    events = feedback.filter(F.col("type").isin("saved", "unsaved", "applied")).select(
        *key, F.date_trunc(span, at).alias("_span"), F.struct(at.alias("at"), F.col("event_id"), event_summary(F.col("type"), at).alias("s")).alias("e")
    )
    spans = events.groupBy(*key, "_span").agg(folded(F.array_sort(F.collect_list("e"))).alias("s"))
    whole = spans.groupBy(*key).agg(folded(F.array_sort(F.collect_list(F.struct("_span", "s")))).alias("s"))
    return whole.filter(F.col("s.fresh.status").isNotNull()).select(*key, "s.fresh.*")


def stage_dates(moves: DataFrame) -> DataFrame:
    """Latest status per application and the first date of every stage."""
    return moves.groupBy("application_id").agg(
        F.max_by("status", F.struct("moved_at", "event_id")).alias("status"),
        *[F.min(F.when(F.col("status") == s, F.col("moved_at"))).alias(f"{s}_at") for s in STAGES],
    )


def mark_seen(matches: DataFrame, opens: DataFrame) -> DataFrame:
    """First opening stamps ``seen_at``; a stamp is never replaced."""
    first = opens.groupBy("user_id", "job_id").agg(F.min("opened_at").alias("_o"))
    return matches.join(first, ["user_id", "job_id"], "left").withColumn("seen_at", F.coalesce("seen_at", "_o")).drop("_o")


def moderate(jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply the last decision per posting; publishing clears the review flag."""
    last = latest(decisions, ["job_id"], ["decided_at", "event_id"], ["new_status", "note"])
    f = jobs.join(last, "job_id", "left")
    return f.withColumns(
        {
            "needs_review": F.col("needs_review") & ~F.coalesce(F.col("new_status") == "published", F.lit(False)),
            "status": F.coalesce("new_status", "status"),
        }
    ).drop("new_status")


def reclassify(jobs: DataFrame, overrides: DataFrame, occupations: DataFrame) -> DataFrame:
    """Manual classification: occupation and its code, seniority, confidence 1, no review reasons.

    Of several overrides of a posting the last counts (``decided_at``, then ``event_id``, where they are
    columns). ``occupation_uri`` and ``review_reasons`` are renewed where the postings have them.
    """
    order = [c for c in ("decided_at", "event_id") if c in overrides.columns] or ["occupation_uri"]
    last = latest(overrides, ["job_id"], order, ["occupation_uri", "new_seniority", "publish"])
    o = last.join(occupations, "occupation_uri", "left").select(
        "job_id", F.lit(True).alias("_o"), F.col("occupation_uri").alias("_uri"), F.col("isco").alias("_isco"),
        F.col("new_seniority").alias("_sen"), "publish",
    )
    f, hit = jobs.join(o, "job_id", "left"), F.col("_o").isNotNull()
    new = {
        "isco_code": F.when(hit, F.col("_isco")).otherwise(F.col("isco_code")),
        "seniority": F.when(hit, F.col("_sen")).otherwise(F.col("seniority")),
        "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
        "needs_review": F.col("needs_review") & ~hit,
        "status": F.when(hit & F.col("publish"), "published").otherwise(F.col("status")),
    }
    if "occupation_uri" in jobs.columns:
        new["occupation_uri"] = F.when(hit, F.col("_uri")).otherwise(F.col("occupation_uri"))
    if "review_reasons" in jobs.columns:
        new["review_reasons"] = F.when(hit, F.array().cast("array<string>")).otherwise(F.col("review_reasons"))
    return f.withColumns(new).drop("_o", "_uri", "_isco", "_sen", "publish")


MAX_EXPERIENCES = 15
SKILL_SIZES = {"label": 200, "evidence": 300}  # characters kept of texts that a CV gives
EXPERIENCE_SIZES = {"title": 200, "organisation": 200, "description": 2000}


def _shortened(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    return rows.withColumns({c: F.left(F.col(c), F.lit(n)) for c, n in sizes.items() if c in rows.columns})


def merge_cv_skills(stored: DataFrame, parsed: DataFrame, users: DataFrame) -> DataFrame:
    """Unconfirmed CV skills of the users are replaced by the parsed ones; all others stay and win."""
    ids = users.select("user_id").distinct()
    old = F.coalesce((F.col("source") == "cv") & ~F.col("confirmed"), F.lit(False))
    stays = stored.filter(~old).unionByName(stored.filter(old).join(ids, "user_id", "left_anti").select(*stored.columns))
    key = F.coalesce(F.col("uri").cast("string"), F.lower("label"))
    have = stays.select("user_id", key.alias("_k"))
    mine = parsed.join(ids, "user_id", "left_semi")
    new = _shortened(mine.withColumn("_k", key).join(have, ["user_id", "_k"], "left_anti").drop("_k"), SKILL_SIZES)
    new = new.withColumns({"source": F.lit("cv"), "confirmed": F.lit(False)})
    return stays.unionByName(new.select(*stays.columns))


def merge_cv(stored: dict[str, DataFrame], parsed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stored ``skills``, ``experiences``, ``languages`` and ``profiles`` after the parsed CVs of some users.

    ``parsed["profiles"]`` has one row per parsed CV (user_id, summary, seniority, education_level); only these users
    change. Experiences are replaced by the first fifteen of the CV in the order of ``pos``, numbered from 0; a
    current one has no end. Languages are taken only where a user has none. An empty summary becomes null.
    Rows of CVs that are not in ``profiles`` are left aside. Rows keep the columns of the stored tables.
    """
    users = parsed["profiles"].select("user_id").distinct()
    out = {"skills": merge_cv_skills(stored["skills"], parsed["skills"], users)}

    had = stored["experiences"]
    mine = parsed["experiences"].join(users, "user_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("pos", "title")) - 1
    mine = mine.withColumn("sort_order", place).filter(F.col("sort_order") < MAX_EXPERIENCES)
    mine = mine.withColumn("end_date", F.when(~F.coalesce("is_current", F.lit(False)), F.col("end_date")))
    kept = had.join(users, "user_id", "left_anti").select(*had.columns)
    out["experiences"] = kept.unionByName(_shortened(mine, EXPERIENCE_SIZES).select(*had.columns))

    had = stored["languages"]
    without = users.join(had, "user_id", "left_anti")
    out["languages"] = had.unionByName(parsed["languages"].join(without, "user_id", "left_semi").select(*had.columns))

    cols = ["summary", "seniority", "education_level"]
    new = parsed["profiles"].select("user_id", F.lit(True).alias("_p"), *[F.col(c).alias(f"_{c}") for c in cols])
    new = new.withColumn("_summary", F.nullif("_summary", F.lit("")))
    f = stored["profiles"].join(new, "user_id", "left")
    fresh = {c: F.when(F.col("_p"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}
    out["profiles"] = f.withColumns(fresh).select(*stored["profiles"].columns)
    return out


def keep_one(rows: DataFrame, keys: list[str], position: str, keep: list[str], last: bool = False) -> DataFrame:
    """First (or last) row per key by position."""
    order = F.col(position).desc() if last else F.col(position)
    if last:
        return latest(rows, keys, [position], keep)
    return first_by(rows, keys, [order], keep)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """New snapshot: incoming rows replace stored rows with the same key."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)
