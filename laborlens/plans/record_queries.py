"""Counts, windows, versions, lifecycle and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A, lifecycle as L, subjects as J
from ..session import new_folder
from ..sources.sinks import decision_audit, match_audit, write_audit
from ..sources.snapshots import SnapshotTable
from .match_queries import csv, riasec, scored
from .registry import query
from .views import SUBJECTS

NOW = "2026-09-01"


def now():
    return F.lit(NOW).cast("timestamp")


DELETIONS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'completed' END AS status FROM customer"
CONTACTS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS handled_at FROM orders"
KPIS = f"""SELECT (SELECT count(*) FROM v_profiles WHERE role = 'user') AS users,
 (SELECT count(*) FROM v_profiles WHERE onboarded_at IS NOT NULL) AS onboarded,
 (SELECT count(*) FROM v_jobs WHERE status = 'published' AND is_golden) AS published,
 (SELECT count(*) FROM v_jobs WHERE status = 'pending_review') AS review, (SELECT count(*) FROM v_jobs WHERE status = 'expired') AS expired,
 (SELECT count(*) FROM v_matches WHERE NOT knocked_out) AS matches, (SELECT count(*) FROM v_feedback WHERE type = 'saved') AS saved,
 (SELECT count(*) FROM v_feedback WHERE type = 'applied') AS applied, (SELECT count(*) FROM v_feedback WHERE type = 'dismissed') AS dismissed,
 (SELECT count(*) FROM ({DELETIONS}) d WHERE status = 'pending') AS deletions,
 (SELECT count(*) FROM ({CONTACTS}) c WHERE handled_at IS NULL) AS contacts"""


def kpis(t):
    return A.kpis(t("v_profiles"), t("v_jobs"), t("v_matches"), t("v_feedback"), t.sql(DELETIONS), t.sql(CONTACTS))


@query("agg_kpis", KPIS)
def _(t):
    return kpis(t)


@query("agg_ratios", f"SELECT CAST(saved AS DOUBLE) / matches AS saved_share, CAST(applied AS DOUBLE) / matches AS applied_share FROM ({KPIS}) k")
def _(t):
    return A.ratios(kpis(t))


@query("agg_dismiss_reasons", "SELECT reason, count(*) AS n FROM v_feedback WHERE type = 'dismissed' AND reason IS NOT NULL GROUP BY reason")
def _(t):
    return A.dismiss_reasons(t("v_feedback"))


def sources(t):
    return t("v_jobs").select("source_id").dropna().distinct().withColumn("name", F.concat(F.lit("Source "), "source_id"))


@query("agg_coverage", """SELECT coalesce(source_id, 'manual') AS source_id, count(*) AS n,
 CASE WHEN source_id IS NOT NULL THEN 'Source ' || source_id END AS name FROM v_jobs WHERE status = 'published' AND is_golden GROUP BY source_id""")
def _(t):
    return A.coverage(t("v_jobs"), sources(t))


@query("agg_source_counts", "SELECT source_id, count(*) FILTER (status = 'published') AS n FROM v_jobs WHERE source_id IS NOT NULL GROUP BY 1")
def _(t):
    return A.source_counts(sources(t).select("source_id"), t("v_jobs"))


@query("agg_landing", """SELECT (SELECT count(*) FROM v_jobs WHERE status = 'published' AND is_golden) AS jobs,
 (SELECT count(DISTINCT city) FROM v_jobs WHERE status = 'published') AS cities,
 (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM v_companies ORDER BY name LIMIT 24) c) AS companies""")
def _(t):
    return A.landing(t("v_jobs"), t("v_companies"))


RUNS = """SELECT run_id, count(*) AS fetched, count(*) FILTER (outcome = 'new') AS new, count(*) FILTER (outcome = 'updated') AS updated,
 count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'duplicate') AS duplicate,
 count(*) FILTER (outcome = 'failed') AS failed, 0 AS expired FROM v_run_items GROUP BY run_id"""


@query("agg_run_counts", f"""SELECT *, CASE WHEN failed = 0 THEN 'succeeded' WHEN failed < fetched THEN 'partial' ELSE 'failed' END AS status
 FROM ({RUNS}) r""")
def _(t):
    return A.run_counts(t("v_run_items"))


@query("agg_error_sample", """SELECT run_id, string_agg(external_id, ',' ORDER BY item, external_id) AS errors FROM (SELECT *, row_number() OVER
 (PARTITION BY run_id ORDER BY item, external_id) AS rn FROM v_run_items WHERE outcome = 'failed') x WHERE rn <= 50 GROUP BY run_id""")
def _(t):
    out = A.error_sample(t("v_run_items"))
    return out.select("run_id", F.array_join(F.transform("errors", lambda e: e["external_id"]), ",").alias("errors"))


@query("agg_broader", """SELECT uri, string_agg(CAST(broader_uri AS STRING), ',' ORDER BY broader_uri) AS parents FROM v_skill_broader GROUP BY uri""")
def _(t):
    from ..operators.matching import skill_families

    out = skill_families(t("v_skill_broader"))
    return out.select("uri", F.array_join(F.transform("parents", lambda p: p.cast("string")), ",").alias("parents"))


@query("agg_profile_strength", """SELECT user_id, done, CAST(floor(CAST(done AS DOUBLE) / 6 * 100 + 0.5) AS INT) AS percent FROM (
 SELECT c.user_id, CAST(coalesce(s.n >= 5, FALSE) AS INT) + CAST(past_codes IS NOT NULL AS INT) + CAST(l.n IS NOT NULL AS INT)
 + CAST(lat IS NOT NULL AS INT) + CAST(r_r IS NOT NULL AS INT) + CAST(values_csv IS NOT NULL AS INT) AS done FROM v_candidates c
 LEFT JOIN (SELECT user_id, count(*) n FROM v_candidate_skills GROUP BY 1) s ON s.user_id = c.user_id
 LEFT JOIN (SELECT user_id, count(*) n FROM v_candidate_languages GROUP BY 1) l ON l.user_id = c.user_id) x""")
def _(t):
    c = t("v_candidates").withColumns({"past_codes": csv("past_codes"), "riasec": riasec(), "work_values": csv("values_csv")})
    return A.profile_strength(c, t("v_candidate_skills"), t("v_candidate_languages"))


# 30 items: five per dimension, numbered 0..29; the newest event of an item is its answer.
ANSWERS = """SELECT user_id, substr('RIASEC', CAST(item % 6 AS INT) + 1, 1) AS dimension, item, answer FROM (
 SELECT user_id, k % 30 AS item, event_id % 5 + 1 AS answer, row_number() OVER (PARTITION BY user_id, k % 30 ORDER BY event_id DESC) AS rn
 FROM (SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e) a WHERE rn = 1"""


@query("agg_interest_scores", "SELECT user_id, " + ", ".join(
    f"floor(CAST(coalesce(sum(answer - 3) FILTER (dimension = '{k}'), 0) + 10 AS DOUBLE) / 20 * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS score_{k.lower()}"
    for k in "RIASEC") + f", count(*) = 30 AS complete FROM ({ANSWERS}) a GROUP BY user_id")
def _(t):
    return A.interest_scores(t.sql(ANSWERS))


# --- latest per key ---------------------------------------------------------------------


@query("win_current_consent", """SELECT user_id, type, granted, policy_version, created_at FROM (SELECT *, row_number() OVER
 (PARTITION BY user_id, type ORDER BY created_at DESC, event_id DESC) AS rn FROM v_consents) c WHERE rn = 1""")
def _(t):
    return L.current_consents(t("v_consents"))


@query("win_latest_feedback", "SELECT user_id, job_id, feedback FROM f_state")
def _(t):
    from ..operators.serving import latest_feedback

    return latest_feedback(t("v_feedback"))


@query("win_golden", """SELECT dedup_group_id, job_id AS golden_job_id FROM (SELECT *, row_number() OVER (PARTITION BY dedup_group_id
 ORDER BY source_priority DESC, last_seen DESC, job_id DESC) AS rn FROM v_jobs WHERE status IN ('published', 'pending_review', 'draft')) g WHERE rn = 1""")
def _(t):
    return L.golden(t("v_jobs"))


VERSIONED = "SELECT l_orderkey AS owner, CAST(l_linenumber AS INT) AS version, l_linenumber = 2 AS is_active, 'p' || CAST(l_partkey AS STRING) AS payload FROM lineitem"
DRAFTS = "SELECT o_orderkey AS owner, 'draft' AS payload FROM orders WHERE o_orderstatus = 'F'"


@query("win_next_version", f"""SELECT v.owner, v.version, v.is_active AND d.owner IS NULL AS is_active, v.payload FROM ({VERSIONED}) v
 LEFT JOIN ({DRAFTS}) d ON d.owner = v.owner UNION ALL
 SELECT d.owner, coalesce((SELECT max(version) FROM ({VERSIONED}) v WHERE v.owner = d.owner), 0) + 1, TRUE, d.payload FROM ({DRAFTS}) d""")
def _(t):
    return L.next_versions(t.sql(VERSIONED), t.sql(DRAFTS), "owner")


@query("win_active_version", f"""SELECT owner, version, payload FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY version DESC, payload DESC) AS rn
 FROM ({VERSIONED}) v WHERE is_active) a WHERE rn = 1""")
def _(t):
    return L.active_versions(t.sql(VERSIONED), "owner")


@query("win_last_ok_run", """SELECT connector_id, connector_type, max(started_at) FILTER (status IN ('succeeded', 'partial')) AS last_ok,
 CASE WHEN connector_type = 'adzuna' THEN max(started_at) FILTER (status IN ('succeeded', 'partial')) END AS since
 FROM v_runs GROUP BY 1, 2""")
def _(t):
    return L.since_last_ok(t("v_runs"))


@query("win_keep_one", """SELECT user_id, uri, first_line, last_line FROM (SELECT o_custkey AS user_id, l_partkey AS uri,
 arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_line, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_line
 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) k""")
def _(t):
    rows = t.sql("SELECT o_custkey AS user_id, l_partkey AS uri, l_orderkey AS line, l_orderkey * 10 + l_linenumber AS pos FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
    key = ["user_id", "uri"]
    first = L.keep_one(rows, key, "pos", ["line"]).withColumnRenamed("line", "first_line")
    return first.join(L.keep_one(rows, key, "pos", ["line"], last=True).withColumnRenamed("line", "last_line"), key)


# --- lifecycle --------------------------------------------------------------------------

EXPIRED = f"""status = 'published' AND coalesce(valid_through < TIMESTAMP '{NOW} 00:00:00', FALSE)
 OR status = 'published' AND source_id IS NOT NULL AND last_seen < TIMESTAMP '{NOW} 00:00:00' - INTERVAL 45 DAY"""


@query("set_expired_union", f"SELECT job_id FROM v_jobs WHERE {EXPIRED}")
def _(t):
    return L.expired_jobs(t("v_jobs"), now()).select("job_id")


@query("life_expire", f"""SELECT m.user_id, m.job_id, CASE WHEN {EXPIRED} THEN 'expired' ELSE status END AS status FROM v_matches m
 JOIN v_jobs j ON j.job_id = m.job_id WHERE NOT ({EXPIRED})""")
def _(t):
    jobs, left = L.expire(t("v_jobs"), t("v_matches"), now())
    return left.select("user_id", "job_id").join(jobs.select("job_id", "status"), "job_id")


SEEN = "SELECT source_id, external_id FROM v_jobs WHERE source_id <> 'src5' AND remote_policy IS NOT NULL"
SOURCES = """SELECT DISTINCT source_id, CASE WHEN source_id = 'src0' THEN 'adzuna' WHEN source_id = 'src1' THEN 'lever'
 ELSE 'greenhouse' END AS connector_type, 3 AS expire_after FROM v_jobs WHERE source_id IS NOT NULL"""


@query("life_absence", f"""SELECT j.job_id, CASE WHEN s.external_id IS NOT NULL AND status = 'expired' THEN 'published'
  WHEN gone AND missed_runs + 1 >= 3 THEN 'expired' ELSE status END AS new_status,
 CASE WHEN s.external_id IS NOT NULL THEN 0 WHEN gone THEN missed_runs + 1 ELSE missed_runs END AS new_missed
 FROM (SELECT *, coalesce(source_id IN (SELECT source_id FROM ({SEEN}) x) AND source_id <> 'src0' AND status IN ('published', 'pending_review')
  AND remote_policy IS NULL, FALSE) AS gone FROM v_jobs) j LEFT JOIN ({SEEN}) s ON s.source_id = j.source_id AND s.external_id = j.external_id""")
def _(t):
    return L.absence(t("v_jobs"), t.sql(SEEN), t.sql(SOURCES)).select("job_id", "new_status", "new_missed")


@query("join_absent", f"""SELECT job_id FROM v_jobs j WHERE status IN ('published', 'pending_review') AND source_id IN (SELECT source_id FROM ({SEEN}) x)
 AND NOT EXISTS (SELECT 1 FROM ({SEEN}) s WHERE s.source_id = j.source_id AND s.external_id = j.external_id)""")
def _(t):
    return L.absent_jobs(t("v_jobs"), t.sql(SEEN)).select("job_id")


COHORTS = f"""SELECT user_id, email, CASE WHEN last_active_at < TIMESTAMP '2024-09-01 00:00:00' AND warned_at < TIMESTAMP '{NOW} 00:00:00' - INTERVAL 30 DAY
  THEN 'delete' WHEN last_active_at < TIMESTAMP '2024-10-01 00:00:00' AND warned_at IS NULL THEN 'warn' END AS cohort FROM v_profiles WHERE role = 'user'"""


@query("life_retention", f"SELECT user_id, cohort FROM ({COHORTS}) c WHERE cohort IS NOT NULL")
def _(t):
    return L.retention(t("v_profiles"), now(), 24, 30).select("user_id", "cohort")


GONE = f"SELECT user_id FROM ({COHORTS}) c WHERE cohort = 'delete'"
HASH = "sha256(lower(coalesce(email, CAST(user_id AS STRING))))"


def sql_left(entry) -> str:
    """Rows and people that a table holds after an erasure."""
    view, key, gone = SUBJECTS[entry.name], entry.key, f"{entry.key} IN ({GONE})"
    if entry.on_erase == "delete":
        return f"SELECT '{entry.name}' AS source, count(*) AS n, count(DISTINCT {key}) AS people FROM {view} WHERE NOT coalesce({gone}, FALSE)"
    people = f"CASE WHEN {gone} THEN NULL ELSE {key} END" if entry.on_erase == "forget" else key
    return f"SELECT '{entry.name}', count(*), count(DISTINCT {people}) FROM {view}"


@query("life_erase", " UNION ALL ".join(sql_left(e) for e in J.CATALOGUE if e.name in SUBJECTS)
       + f""" UNION ALL SELECT {HASH}, -1, -1 FROM ({COHORTS}) c WHERE cohort = 'delete' UNION ALL SELECT 'account.delete:system:' || left({HASH}, 16), coalesce(f.n, 0), -1
 FROM ({COHORTS}) c LEFT JOIN (SELECT user_id AS u, count(*) AS n FROM v_cv_files GROUP BY 1) f ON f.u = c.user_id WHERE cohort = 'delete'""")
def _(t):
    gone = L.retention(t("v_profiles"), now(), 24, 30).filter(F.col("cohort") == "delete")
    entries = [e for e in J.CATALOGUE if e.name in SUBJECTS]
    left = J.erase({e.name: t(SUBJECTS[e.name]) for e in entries}, gone)
    none = F.lit(-1).cast("bigint")
    proof = J.erasure_proof(gone).select(F.col("email_hash").alias("source"), none.alias("n"), none.alias("people"))
    audit = J.erasure_audit(gone, "retention", t("v_cv_files")).select(
        F.concat_ws(":", "action", "actor_role", "entity_id").alias("source"), F.col("metadata.cv_files").alias("n"), none.alias("people"))
    out = proof.unionByName(audit)
    for e in entries:
        out = out.unionByName(left[e.name].agg(F.count("*").alias("n"), F.count_distinct(e.key).alias("people")).select(F.lit(e.name).alias("source"), "n", "people"))
    return out


@query("life_consent", """WITH r AS (SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY created_at DESC, event_id DESC) AS rn
  FROM v_consents) c WHERE rn = 1 AND type = 'ai_processing' AND NOT granted)
 SELECT p.user_id, CASE WHEN r.user_id IS NULL THEN onboarded_at END AS onboarded_at, CASE WHEN r.user_id IS NULL THEN coalesce(m.n, 0) ELSE 0 END AS matches
 FROM v_profiles p LEFT JOIN r ON r.user_id = p.user_id LEFT JOIN (SELECT user_id, count(*) n FROM v_matches GROUP BY 1) m ON m.user_id = p.user_id""")
def _(t):
    left, profiles = L.withdraw(t("v_consents"), t("v_matches"), t("v_profiles"))
    n = left.groupBy("user_id").agg(F.count("*").alias("_n"))
    return profiles.join(n, "user_id", "left").select("user_id", "onboarded_at", F.coalesce("_n", F.lit(0)).alias("matches"))


SIGNUPS = """SELECT c_custkey AS user_id, '{"locale":"nl","consents":{"terms_privacy":true,"ai_processing":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END
 || ',"other":true}' || CASE WHEN c_custkey % 3 = 0 THEN '}' ELSE ',"policy_version":"2026-09"}' END AS meta FROM customer"""


@query("life_signup_fanout", """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE '2026-09' END AS policy_version,
 'terms_privacy' AS type, TRUE AS granted FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE '2026-09' END,
 'ai_processing', c_custkey % 2 = 0 FROM customer""")
def _(t):
    return L.signup_consents(t.sql(SIGNUPS))


@query("life_activity", """SELECT p.user_id, CASE WHEN p.last_active_at < v.v - INTERVAL 1 HOUR THEN v.v ELSE p.last_active_at END AS last_active_at,
 CASE WHEN p.last_active_at < v.v - INTERVAL 1 HOUR THEN NULL ELSE p.warned_at END AS warned_at FROM v_profiles p
 LEFT JOIN (SELECT user_id, max(ts) AS v FROM events GROUP BY 1) v ON v.user_id = p.user_id""")
def _(t):
    visits = t("events").select("user_id", F.col("ts").cast("timestamp").alias("visited_at"))
    return L.advance_activity(t("v_profiles"), visits).select("user_id", "last_active_at", "warned_at")


@query("app_state", """WITH f AS (SELECT *, ROW(created_at, event_id) AS w FROM v_feedback WHERE type IN ('saved', 'unsaved', 'applied')),
 a AS (SELECT user_id, job_id, min(w) FILTER (type = 'applied') AS ap FROM f GROUP BY 1, 2),
 u AS (SELECT f.user_id, f.job_id, any_value(a.ap) AS ap, max(f.w) FILTER (f.type = 'unsaved' AND (a.ap IS NULL OR f.w < a.ap)) AS us
  FROM f JOIN a ON a.user_id = f.user_id AND a.job_id = f.job_id GROUP BY 1, 2),
 s AS (SELECT f.user_id, f.job_id, any_value(u.ap) AS ap, min(f.created_at) FILTER (f.type = 'saved' AND (u.us IS NULL OR f.w > u.us) AND (u.ap IS NULL OR f.w < u.ap)) AS sv,
  min(f.created_at) FILTER (f.type = 'applied') AS applied_at FROM f JOIN u ON u.user_id = f.user_id AND u.job_id = f.job_id GROUP BY 1, 2)
 SELECT user_id, job_id, CASE WHEN ap IS NOT NULL THEN 'applied' ELSE 'saved' END AS status, CAST(coalesce(sv, applied_at) AS TIMESTAMP) AS saved_at,
 CAST(applied_at AS TIMESTAMP) AS applied_at FROM s WHERE ap IS NOT NULL OR sv IS NOT NULL""")
def _(t):
    return L.application_state(t("v_feedback"))


MOVES = """SELECT event_id, user_id * 100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS application_id, ts AS moved_at,
 CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'interview' WHEN 'signup' THEN 'offer' ELSE 'rejected' END AS status FROM events"""


@query("app_move", f"""SELECT application_id, arg_max(status, ROW(moved_at, event_id)) AS status, min(moved_at) FILTER (status = 'saved') AS saved_at,
 min(moved_at) FILTER (status = 'applied') AS applied_at, min(moved_at) FILTER (status = 'interview') AS interview_at,
 min(moved_at) FILTER (status = 'offer') AS offer_at, min(moved_at) FILTER (status = 'rejected') AS rejected_at FROM ({MOVES}) m GROUP BY 1""")
def _(t):
    return L.stage_dates(t.sql(MOVES))


@query("match_mark_seen", """SELECT m.user_id, m.job_id, coalesce(m.seen_at, o.o) AS seen_at FROM v_matches m LEFT JOIN
 (SELECT user_id, job_id, min(created_at) AS o FROM v_feedback GROUP BY 1, 2) o ON o.user_id = m.user_id AND o.job_id = m.job_id""")
def _(t):
    opens = t("v_feedback").select("user_id", "job_id", F.col("created_at").cast("timestamp").alias("opened_at"))
    return L.mark_seen(t("v_matches"), opens).select("user_id", "job_id", "seen_at")


DECISIONS = """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS job_id, ts AS decided_at, 'note' || CAST(event_id AS STRING) AS note,
 CASE event_id % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'rejected' WHEN 2 THEN 'archived' ELSE 'pending_review' END AS new_status
 FROM events WHERE event_type = 'signup'"""


@query("job_moderate", f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY decided_at DESC, event_id DESC) AS rn FROM ({DECISIONS}) x) y WHERE rn = 1)
 SELECT j.job_id, coalesce(d.new_status, j.status) AS status, j.needs_review AND coalesce(d.new_status, '') <> 'published' AS needs_review, d.note
 FROM v_jobs j LEFT JOIN d ON d.job_id = j.job_id""")
def _(t):
    return L.moderate(t("v_jobs"), t.sql(DECISIONS)).select("job_id", "status", "needs_review", "note")


OVERRIDES = """SELECT s_suppkey AS job_id, s_nationkey AS occupation_uri, 'lead' AS new_seniority, s_suppkey % 4 = 0 AS publish, 2 AS event_id
 FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_suppkey, s_nationkey + 1, 'junior', TRUE, 1 FROM supplier WHERE s_acctbal > 6000"""
OCCUPATIONS = "SELECT n_nationkey AS occupation_uri, CAST(2000 + n_nationkey AS STRING) AS isco FROM nation WHERE n_nationkey % 5 <> 0"


@query("job_reclassify", """SELECT s.job_id, CASE WHEN o.s_suppkey IS NULL THEN s.isco_code WHEN o.s_nationkey % 5 <> 0 THEN CAST(2000 + o.s_nationkey AS STRING) END AS isco_code,
 CASE WHEN o.s_suppkey IS NULL THEN s.seniority ELSE 'lead' END AS seniority, CASE WHEN o.s_suppkey IS NULL THEN 0.5 ELSE 1 END AS confidence,
 s.needs_review AND o.s_suppkey IS NULL AS needs_review, CASE WHEN o.s_suppkey % 4 = 0 THEN 'published' ELSE s.status END AS status,
 coalesce(o.s_nationkey, -1) AS occupation_uri, CASE WHEN o.s_suppkey IS NULL AND s.needs_review THEN 'low_confidence' ELSE '' END AS review_reasons
 FROM v_jobs s LEFT JOIN supplier o ON o.s_suppkey = s.job_id AND o.s_acctbal > 5000""")
def _(t):
    reasons = F.when(F.col("needs_review"), F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    jobs = t("v_jobs").withColumns({"confidence": F.lit(0.5), "occupation_uri": F.lit(-1), "review_reasons": reasons})
    out = L.reclassify(jobs, t.sql(OVERRIDES), t.sql(OCCUPATIONS))
    return out.select("job_id", "isco_code", "seniority", "confidence", "needs_review", "status", "occupation_uri", F.array_join("review_reasons", ",").alias("review_reasons"))


# customers of three in four have a new CV; skills used before 1999 are stored already
CV_USERS = "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 4 <> 3"
STORED = "SELECT user_id, esco_uri AS uri, label, last_used_year, source, confirmed FROM v_skill_rows WHERE last_used_year <= 1998"
PARSED = "SELECT user_id, esco_uri AS uri, label, last_used_year FROM v_skill_rows"
OLD_EXPERIENCES = """SELECT user_id, CAST(0 AS INT) AS sort_order, title, organisation, start_date, end_date, is_current, description FROM v_experiences WHERE pos % 16 = 1"""
OLD_LANGUAGES = "SELECT user_id, language, level FROM v_candidate_languages WHERE user_id % 5 <> 0"
NEW_PROFILES = f"""SELECT user_id, CASE WHEN user_id % 6 = 0 THEN '' ELSE 'cv of ' || CAST(user_id AS STRING) END AS summary, 'senior' AS seniority,
 CAST(user_id % 3 + 5 AS INT) AS education_level FROM ({CV_USERS}) u"""


@query("cv_merge", f"""WITH u AS ({CV_USERS}),
 st AS (SELECT * FROM ({STORED}) s WHERE NOT (source = 'cv' AND NOT confirmed AND user_id IN (SELECT user_id FROM u))),
 sk AS (SELECT * FROM st UNION ALL SELECT user_id, uri, label, last_used_year, 'cv', FALSE FROM ({PARSED}) p WHERE user_id IN (SELECT user_id FROM u)
  AND NOT EXISTS (SELECT 1 FROM st WHERE st.user_id = p.user_id AND st.uri = p.uri)),
 ex AS (SELECT * FROM ({OLD_EXPERIENCES}) o WHERE user_id NOT IN (SELECT user_id FROM u) UNION ALL
  SELECT user_id, CAST(rn - 1 AS INT), title, left(organisation, 200), start_date, CASE WHEN NOT is_current THEN end_date END, is_current, left(description, 2000)
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos, title) AS rn FROM v_experiences WHERE user_id IN (SELECT user_id FROM u)) r WHERE rn <= 15),
 la AS (SELECT * FROM ({OLD_LANGUAGES}) o UNION ALL SELECT user_id, language, level FROM v_candidate_languages WHERE user_id IN (SELECT user_id FROM u)
  AND user_id NOT IN (SELECT user_id FROM ({OLD_LANGUAGES}) o))
 SELECT user_id, 'skill' AS part, concat_ws('|', CAST(uri AS VARCHAR), label, CAST(last_used_year AS VARCHAR), source, CAST(confirmed AS VARCHAR)) AS item FROM sk
 UNION ALL SELECT user_id, 'experience', concat_ws('|', CAST(sort_order AS VARCHAR), title, organisation, start_date, end_date, CAST(is_current AS VARCHAR), description) FROM ex
 UNION ALL SELECT user_id, 'language', language || '|' || level FROM la
 UNION ALL SELECT c.user_id, 'profile', concat_ws('|', CASE WHEN n.user_id IS NULL THEN c.summary ELSE nullif(n.summary, '') END, CASE WHEN n.user_id IS NULL THEN c.seniority ELSE n.seniority END,
  CAST(CASE WHEN n.user_id IS NULL THEN c.education_level ELSE n.education_level END AS VARCHAR)) FROM v_candidate_profiles c LEFT JOIN ({NEW_PROFILES}) n ON n.user_id = c.user_id""")
def _(t):
    profiles = t("v_candidate_profiles").select("user_id", "summary", "seniority", "education_level")
    stored = {"skills": t.sql(STORED), "experiences": t.sql(OLD_EXPERIENCES), "languages": t.sql(OLD_LANGUAGES), "profiles": profiles}
    parsed = {"skills": t.sql(PARSED), "experiences": t("v_experiences"), "languages": t("v_candidate_languages"), "profiles": t.sql(NEW_PROFILES)}
    out = None
    for name, df in L.merge_cv(stored, parsed).items():
        item = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c != "user_id"])
        rows = df.select("user_id", F.lit(name.removesuffix("s")).alias("part"), item.alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("sink_upsert", """SELECT job_id, title, status FROM v_jobs WHERE NOT needs_review UNION ALL
 SELECT job_id, title || ' (new)', 'published' FROM v_jobs WHERE needs_review""")
def _(t):
    jobs = t("v_jobs").select("job_id", "title", "status")
    new = t("v_jobs").filter("needs_review").select("job_id", F.concat("title", F.lit(" (new)")).alias("title"), F.lit("published").alias("status"))
    table = SnapshotTable(t.spark, f"{new_folder(t.spark)}/jobs", ["job_id"])
    table.upsert(jobs)
    table.upsert(new)
    return table.read()


@query("sink_audit", f"""SELECT 'match.compute' AS action, CAST(t.user_id AS STRING) || ':' || CAST(t.job_id AS STRING) AS entity_id, CAST(total_score AS DOUBLE) AS score, label, knocked_out,
 NULL AS note FROM o_total t JOIN o_ko k ON k.user_id = t.user_id AND k.job_id = t.job_id
 UNION ALL SELECT 'job.' || new_status, CAST(job_id AS STRING), NULL, NULL, NULL, note FROM ({DECISIONS}) d""")
def _(t):
    path = f"{new_folder(t.spark)}/audit"
    write_audit(match_audit(scored(t), F.lit(1)), path)
    write_audit(decision_audit(t.sql(DECISIONS)), path)
    m = F.from_json("metadata", "score double, label string, knocked_out boolean, note string")
    return t.spark.read.parquet(path).select("action", "entity_id", m.alias("m")).select("action", "entity_id", "m.*")
