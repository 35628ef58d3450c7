"""Filters, serving joins, top lists and label lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import serving as S, subjects as J
from .registry import query
from .views import SUBJECTS


def feed(t):
    return S.feed(t("v_matches"), t("v_jobs"), t("v_companies"), t("v_feedback"))


from .oracle import ORACLE_PARTS  # noqa: E402

ORACLE_PARTS["f_state"] = """
SELECT user_id, job_id, CASE WHEN type = 'unsaved' THEN NULL ELSE type END AS feedback FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY created_at DESC, event_id DESC) AS rn FROM v_feedback) x WHERE rn = 1
"""
ORACLE_PARTS["f_feed"] = """
SELECT m.user_id, m.job_id, m.total_score, m.label, m.knocked_out, m.limited_data, m.seen_at IS NULL AS is_new, j.title, j.city,
 j.remote_policy, j.salary_min, j.salary_max, j.date_posted, coalesce(c.name, j.hiring_name) AS company_name, s.feedback
FROM v_matches m JOIN v_jobs j ON j.job_id = m.job_id AND j.status = 'published'
LEFT JOIN v_companies c ON c.company_id = j.company_id LEFT JOIN f_state s ON s.user_id = m.user_id AND s.job_id = m.job_id
"""


@query("scan_matchable", """SELECT j.job_id, j.title, c.name AS company_name, c.size, c.type FROM v_jobs j
 LEFT JOIN v_companies c ON c.company_id = j.company_id WHERE j.status = 'published' AND j.is_golden""")
def _(t):
    firms = t("v_companies").select("company_id", F.col("name").alias("company_name"), "size", "type")
    jobs = t("v_jobs").filter(S.is_matchable()).select("job_id", "title", "company_id")
    return jobs.join(firms, "company_id", "left").drop("company_id")


@query("join_job_dims", """SELECT j.job_id, c.name AS company_name, c.domain, n.n_name AS nation, r.r_name AS region FROM v_jobs j
 LEFT JOIN v_companies c ON c.company_id = j.company_id LEFT JOIN nation n ON n.n_name = j.city
 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def _(t):
    firms = t("v_companies").select("company_id", F.col("name").alias("company_name"), "domain")
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    jobs = t("v_jobs").select("job_id", "company_id", "city").join(firms, "company_id", "left")
    return jobs.join(places, F.col("city") == F.col("nation"), "left").select("job_id", "company_name", "domain", "nation", "region")


@query("flt_matchable", "SELECT job_id FROM v_jobs WHERE status = 'published' AND is_golden")
def _(t):
    return t("v_jobs").filter(S.is_matchable()).select("job_id")


@query("flt_onboarded", "SELECT user_id FROM v_profiles WHERE onboarded_at IS NOT NULL")
def _(t):
    return t("v_profiles").filter(F.col("onboarded_at").isNotNull()).select("user_id")


@query("flt_feed", """SELECT user_id, job_id FROM f_feed WHERE feedback IN ('saved', 'applied') AND NOT knocked_out
 AND label IN ('strong', 'good') AND contains(lower(title || ' ' || coalesce(company_name, '') || ' ' || coalesce(city, '')), 'data')""")
def _(t):
    return S.filter_feed(feed(t), "saved", labels=("strong", "good"), needle="Data").select("user_id", "job_id")


@query("flt_moderation", """SELECT 'published' AS tab, job_id FROM v_jobs WHERE status = 'published' AND title ILIKE '%er%'
 UNION ALL SELECT 'review', job_id FROM v_jobs WHERE (status = 'pending_review' OR needs_review) AND title ILIKE '%er%'
 UNION ALL SELECT 'expired', job_id FROM v_jobs WHERE status = 'expired' AND title ILIKE '%er%'
 UNION ALL SELECT 'rejected', job_id FROM v_jobs WHERE status IN ('rejected', 'archived') AND title ILIKE '%er%'""")
def _(t):
    tabs = F.array_compact(F.array(*[F.when(S.moderation_tab(n), F.lit(n)) for n in ("published", "review", "expired", "rejected")]))
    return t("v_jobs").filter(F.col("title").ilike("%er%")).select(F.explode(tabs).alias("tab"), "job_id")


@query("flt_audit", "SELECT id, action, entity_id FROM v_audit WHERE action ILIKE 'job.%' AND entity_id ILIKE '%1%'")
def _(t):
    return t("v_audit").filter(F.col("action").ilike("job.%") & F.col("entity_id").ilike("%1%")).select("id", "action", "entity_id")


@query("flt_users", "SELECT user_id, email FROM v_profiles WHERE email ILIKE '%12%'")
def _(t):
    return t("v_profiles").filter(F.col("email").ilike("%12%")).select("user_id", "email")


FEED_COLUMNS = ("user_id", "job_id", "total_score", "label", "knocked_out", "is_new", "title", "city", "company_name", "feedback")


@query("join_feed", f"SELECT {', '.join(FEED_COLUMNS)} FROM f_feed")
def _(t):
    return feed(t).select(*FEED_COLUMNS)


@query("sort_feed", """SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY knocked_out,
 coalesce(salary_max, salary_min, 0) DESC, job_id) AS place FROM f_feed""")
def _(t):
    return S.sort_feed(feed(t), "salary").select("user_id", "job_id", "place")


@query("agg_feed_counters", """SELECT user_id, count(*) FILTER (knocked_out AND coalesce(feedback <> 'dismissed', TRUE)) AS hidden,
 count(*) AS total, count(*) FILTER (is_new AND NOT knocked_out) AS new,
 count(*) FILTER (NOT knocked_out AND coalesce(feedback <> 'dismissed', TRUE)) AS visible,
 count(*) FILTER (label = 'strong' AND NOT knocked_out) AS strong FROM f_feed GROUP BY user_id""")
def _(t):
    return S.feed_counters(feed(t))


@query("join_detail", """SELECT p.user_id, p.job_id, j.title, j.status AS job_status, c.name AS company_name, m.total_score, m.label,
 m.knocked_out, a.application_id, a.status AS application_status, s.feedback FROM v_pairs p JOIN v_jobs j ON j.job_id = p.job_id
 LEFT JOIN v_companies c ON c.company_id = j.company_id LEFT JOIN v_matches m ON m.user_id = p.user_id AND m.job_id = p.job_id
 LEFT JOIN v_applications a ON a.user_id = p.user_id AND a.job_id = p.job_id
 LEFT JOIN f_state s ON s.user_id = p.user_id AND s.job_id = p.job_id""")
def _(t):
    return S.match_detail(t("v_pairs"), t("v_jobs"), t("v_companies"), t("v_matches"), t("v_applications"), t("v_feedback"))


@query("join_tracker", """SELECT a.application_id, a.user_id, a.job_id, a.status, a.position, coalesce(j.title, '–') AS title,
 coalesce(c.name, j.hiring_name, '') AS company, j.city FROM v_applications a LEFT JOIN v_jobs j ON j.job_id = a.job_id
 LEFT JOIN v_companies c ON c.company_id = j.company_id""")
def _(t):
    return S.tracker(t("v_applications"), t("v_jobs"), t("v_companies"))


@query("win_positions", """SELECT application_id, user_id, status, row_number() OVER (PARTITION BY user_id, status
 ORDER BY position, application_id) - 1 AS new_position FROM v_applications""")
def _(t):
    return S.renumber(t("v_applications")).select("application_id", "user_id", "status", "new_position")


@query("join_visible", """SELECT job_id, status FROM v_jobs j WHERE (status = 'published' AND is_golden)
 OR EXISTS (SELECT 1 FROM v_matches m WHERE m.job_id = j.job_id) OR EXISTS (SELECT 1 FROM v_applications a WHERE a.job_id = j.job_id)""")
def _(t):
    return S.visible_jobs(t("v_jobs"), t("v_matches"), t("v_applications")).select("job_id", "status")


@query("join_labels_i18n", """SELECT j.job_id, j.uri, trim(coalesce(s.label_nl, s.label_en, CAST(j.uri AS STRING))) AS shown
 FROM v_job_skills j LEFT JOIN v_skills s ON s.uri = j.uri""")
def _(t):
    uses = t("v_job_skills").select("job_id", "uri").withColumn("label", F.lit(None).cast("string"))
    return S.skill_labels(uses, t("v_skills"), "nl").drop("label")


@query("join_group_members", """SELECT j.job_id, j.dedup_group_id, count(o.job_id) AS other_members,
 (SELECT k.job_id FROM v_jobs k WHERE k.dedup_group_id = j.dedup_group_id ORDER BY k.source_priority DESC, k.job_id DESC LIMIT 1) AS top_member,
 'Source ' || j.source_id AS source_name, (SELECT count(*) FROM v_matches m WHERE m.job_id = j.job_id) AS matches
 FROM v_jobs j LEFT JOIN v_jobs o ON o.dedup_group_id = j.dedup_group_id AND o.job_id <> j.job_id
 GROUP BY j.job_id, j.dedup_group_id, j.source_id""")
def _(t):
    names = t("v_jobs").select("source_id").dropna().distinct().withColumn("source_name", F.concat(F.lit("Source "), "source_id"))
    return S.group_members(t("v_jobs"), t("v_matches"), names)


@query("agg_group_match_count", "SELECT job_id, count(*) AS matches FROM v_matches GROUP BY job_id")
def _(t):
    return t("v_matches").groupBy("job_id").agg(F.count("*").alias("matches"))


@query("topk_lists", "SELECT job_id, date_posted FROM v_jobs ORDER BY date_posted DESC, job_id LIMIT 100")
def _(t):
    return t("v_jobs").select("job_id", "date_posted").orderBy(F.desc("date_posted"), "job_id").limit(100)


@query("page_offset", """SELECT id, action, (SELECT count(*) FROM v_audit WHERE action ILIKE 'job.%') AS total FROM v_audit
 WHERE action ILIKE 'job.%' ORDER BY id DESC LIMIT 50 OFFSET 50""")
def _(t):
    rows = t("v_audit").filter(F.col("action").ilike("job.%"))
    total = rows.agg(F.count("*")).scalar()
    return rows.select("id", "action").orderBy(F.desc("id")).offset(50).limit(50).withColumn("total", total)


# the fields of a section that its view has; the others are null in the export
EXPORTED = {
    "profile": "email locale role created_at last_active_at", "candidateProfile": "headline summary seniority education_level onboarding_completed_at created_at",
    "skills": "esco_uri label last_used_year source confirmed",
    "experiences": "title organisation esco_occupation_uri isco_code start_date end_date is_current description", "languages": "language level",
    "cvFiles": "version file_name mime_type size_bytes parse_status created_at", "matches": "job_id total_score label knocked_out created_at",
    "matchFeedback": "job_id type reason created_at", "applications": "job_id status saved_at", "alertSettings": "enabled frequency min_score updated_at",
    "consents": "type granted policy_version created_at", "deletionRequests": "status requested_at processed_at",
}


def sql_item(entry) -> str:
    """All fields of an exported row by name, as ``field=value``."""
    parts = []
    for f in sorted(entry.fields):
        shown = f"strftime(CAST({f} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')" if f.endswith("_at") else f"CAST({f} AS VARCHAR)"
        parts.append(f"'{f}=' || coalesce({shown}, '-')" if f in EXPORTED[entry.name].split() else f"'{f}=-'")
    return " || '|' || ".join(parts)


@query("export_subject", " UNION ALL ".join(
    f"SELECT user_id, '{e.name}' AS section, {sql_item(e)} AS item FROM {SUBJECTS[e.name]} WHERE user_id IN (SELECT user_id FROM v_profiles)"
    for e in J.CATALOGUE if e.fields))
def _(t):
    sections = [e for e in J.CATALOGUE if e.fields]
    docs = J.export_documents(t("v_profiles"), {e.name: t(SUBJECTS[e.name]) for e in sections})
    kinds = {e.name: "struct<" + ", ".join(f"`{f}`: string" for f in e.fields) + ">" for e in sections}
    schema = ", ".join(f"`{e.name}` {kinds[e.name] if e.single else f'array<{kinds[e.name]}>'}" for e in sections)
    d = docs.select("user_id", F.from_json("document", schema).alias("d"))

    def item(e, r):
        def field(f):
            at = F.date_format(F.try_to_timestamp(r[f]), "yyyy-MM-dd HH:mm:ss") if f.endswith("_at") else r[f]
            return F.concat(F.lit(f"{f}="), F.coalesce(at, F.lit("-")))

        return F.concat_ws("|", *[field(f) for f in sorted(e.fields)])

    def items(e):
        rows = F.array_compact(F.array(F.col("d")[e.name])) if e.single else F.col("d")[e.name]
        return F.struct(F.lit(e.name).alias("section"), F.transform(rows, lambda r: item(e, r)).alias("items"))

    d = d.select("user_id", F.explode(F.array(*[items(e) for e in sections])).alias("s"))
    return d.select("user_id", "s.section", F.explode("s.items").alias("item"))


# --- label lookup -------------------------------------------------------------------------

LABELS = """SELECT uri, label_en, label_nl, lower(label_en || ' ' || coalesce(label_nl, '') || ' ' ||
 coalesce(replace(alts_csv, '|', ' '), '')) AS search_text FROM v_skills"""
TERMS = "SELECT DISTINCT p_name AS q FROM part UNION SELECT DISTINCT substr(p_name, 1, 6) AS q FROM part"


@query("label_search_text", LABELS.replace("uri, label_en, label_nl,", "uri,"))
def _(t):
    s = t("v_skills")
    return s.select("uri", X.label_search_text(F.col("label_en"), F.col("label_nl"), F.split("alts_csv", r"\|")).alias("search_text"))


def labels(t):
    return t("v_skills").select("uri", "label_en", X.label_search_text(
        F.col("label_en"), F.col("label_nl"), F.split("alts_csv", r"\|")).alias("search_text"))


GRAMS = """list_distinct(flatten(list_transform(list_filter(split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
 lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query("set_trigrams", f"""SELECT a.uri, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS together
 FROM (SELECT uri, label_nl, {GRAMS.format('label_en')} AS g FROM v_skills) a JOIN (SELECT uri, {GRAMS.format('label_nl')} AS g FROM v_skills) b
 ON b.uri = a.uri WHERE a.label_nl IS NOT NULL""")
def _(t):
    s = t("v_skills").filter(F.col("label_nl").isNotNull())
    a, b = S.trigrams(F.col("label_en")), S.trigrams(F.col("label_nl"))
    both = F.size(F.array_intersect(a, b))
    return s.select("uri", both.cast("bigint").alias("shared"), (F.size(a) + F.size(b) - both).cast("bigint").alias("together"))


@query("topk_autocomplete_trgm", f"""WITH lab AS ({LABELS}), lt AS (SELECT *, {GRAMS.format('search_text')} AS g FROM lab),
 qs AS (SELECT q, {GRAMS.format('q')} AS g FROM ({TERMS}) x),
 sc AS (SELECT q, uri, label_en, contains(search_text, lower(q)) AS inside,
  CAST(len(list_intersect(qs.g, lt.g)) AS DOUBLE) / (len(qs.g) + len(lt.g) - len(list_intersect(qs.g, lt.g))) AS sim FROM qs, lt)
 SELECT q, uri, score, rank FROM (SELECT q, uri, greatest(sim, CASE WHEN inside THEN CAST(0.5 AS DOUBLE) ELSE 0 END) AS score,
  row_number() OVER (PARTITION BY q ORDER BY greatest(sim, CASE WHEN inside THEN CAST(0.5 AS DOUBLE) ELSE 0 END) DESC, length(label_en), uri) AS rank
  FROM sc WHERE sim > CAST(0.3 AS DOUBLE) OR inside) r WHERE rank <= 10""")
def _(t):
    return S.autocomplete(t.sql(TERMS), labels(t))


@query("topk_search_lexical", f"""WITH e AS (SELECT uri, lower(label_en) AS norm FROM v_skills UNION SELECT uri, lower(label_nl) FROM v_skills
  WHERE label_nl IS NOT NULL),
 sc AS (SELECT q, uri, max(CASE WHEN norm = lower(q) THEN 3 WHEN starts_with(norm, lower(q)) THEN 2 ELSE 1 END) AS score
  FROM ({TERMS}) x JOIN e ON contains(norm, lower(trim(q))) GROUP BY 1, 2)
 SELECT q, uri, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, uri) AS rank FROM sc) r WHERE rank <= 10""")
def _(t):
    s = t("v_skills")
    names = F.explode(F.array_compact(F.array("label_en", "label_nl")))
    entries = s.select("uri", names.alias("label")).select("uri", X.normalize_label(F.col("label")).alias("norm"))
    return S.lexical_search(t.sql(TERMS), entries)


@query("join_label_exact", """SELECT s.uri, o.uri AS found FROM v_skills s JOIN v_skills o ON lower(o.label_en) = lower(replace(s.label_nl, 'nl ', ''))""")
def _(t):
    s = t("v_skills")
    wanted = s.filter(F.col("label_nl").isNotNull()).select("uri", X.normalize_label(F.regexp_replace("label_nl", "nl ", "")).alias("norm"))
    known = s.select(F.col("uri").alias("found"), X.normalize_label(F.col("label_en")).alias("norm"))
    return wanted.join(known, "norm").drop("norm")


@query("txt_short_label", "SELECT uri, trim(regexp_replace(label_en || ' (' || label_en || ') x', '\\s*\\([^)]*\\)\\s*', ' ', 'g')) AS short FROM v_skills")
def _(t):
    return t("v_skills").select("uri", X.short_label(F.expr("label_en || ' (' || label_en || ') x'")).alias("short"))
