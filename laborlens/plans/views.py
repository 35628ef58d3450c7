"""Labour-market views over the given tables, in SQL that Spark and DuckDB both read.

The tables are not labour-market data, so keys are spread over the value ranges with integer
arithmetic: customers are candidates, suppliers are postings, parts are skills, order lines link
them, events are the feedback and consent logs, documents are posting texts.
"""

from __future__ import annotations

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def pick(expr: str, *values: str | None) -> str:
    """CASE over ``expr`` modulo the number of values."""
    n = len(values)
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else v) for i, v in enumerate(values)
    )
    return f"CASE ({expr}) % {n} {arms} END"


def q(*values: str | None) -> tuple[str | None, ...]:
    return tuple(None if v is None else f"'{v}'" for v in values)


def dbl(expr: str, by: int = 1) -> str:
    return f"CAST({expr} AS DOUBLE) / CAST({by} AS DOUBLE)"


DAY = "CAST(DATE '{0}' + CAST({1} AS INT) AS TIMESTAMP)"

VIEWS: dict[str, str] = {}

VIEWS["v_profiles"] = f"""
SELECT c_custkey AS user_id,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE lower(c_name) || '@mail.example' END AS email,
  CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
  {pick("c_custkey", *q("nl", "en", "nl"))} AS locale,
  {DAY.format("2022-01-01", "(c_custkey * 17) % 1500")} AS last_active_at,
  CASE WHEN c_custkey % 3 = 0 THEN {DAY.format("2026-05-01", "(c_custkey * 7) % 110")} END AS warned_at,
  {DAY.format("2021-01-01", "(c_custkey * 13) % 900")} AS created_at,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE {DAY.format("2021-06-01", "(c_custkey * 11) % 900")} END AS onboarded_at,
  {pick("c_custkey", *q("data person", "care worker", None, "engineer in Delft"))} AS headline
FROM customer
"""

VIEWS["v_candidates"] = f"""
SELECT c_custkey AS user_id,
  {pick("c_custkey", *q("intern", "junior", "medior", "senior", "lead", "executive", None))} AS seniority,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 8 + 1 END AS education_level,
  CASE WHEN c_custkey % 10 = 0 THEN NULL
       WHEN c_custkey % 2 = 0 THEN CAST(2000 + (c_custkey * 13) % 600 AS STRING)
       ELSE CAST(2000 + (c_custkey * 13) % 600 AS STRING) || ',' || CAST(2100 + (c_custkey * 7) % 300 AS STRING)
  END AS desired_codes,
  CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE CAST(2000 + (c_custkey * 29) % 600 AS STRING) END AS past_codes,
  CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 51 + {dbl("(c_nationkey * 7) % 25", 20)} END AS lat,
  CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 4 + {dbl("(c_nationkey * 11) % 25", 12)} END AS lng,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {dbl("15 + (c_custkey * 5) % 90")} END AS max_travel,
  {pick("c_custkey", *q("public_transport", "car", "bike", None))} AS travel_mode,
  {pick("c_custkey * 3 + c_nationkey", *q("any", "onsite", "hybrid", "remote", None))} AS remote_pref,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {dbl("2200 + (c_custkey * 91) % 3600")} END AS min_salary,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {dbl("8 + (c_custkey * 3) % 25")} END AS hours_min,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {dbl("30 + (c_custkey * 5) % 11")} END AS hours_max,
  {pick("c_custkey", *q("full_time", "part_time,full_time", None, "freelance,contract", "temporary"))} AS employment_csv,
  {pick("c_custkey", *q(None, "small,medium", "large", "micro,enterprise", None))} AS sizes_csv,
  {pick("c_custkey * 2 + 1", *q("sme", None, "corporate,public", "startup,scaleup", "agency", None, "nonprofit"))} AS types_csv,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {dbl("(c_custkey * 3) % 11", 10)} END AS r_r,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {dbl("(c_custkey * 5 + 2) % 11", 10)} END AS r_i,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {dbl("(c_custkey * 7 + 4) % 11", 10)} END AS r_a,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {dbl("(c_custkey * 2 + 6) % 11", 10)} END AS r_s,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {dbl("(c_custkey * 4 + 1) % 11", 10)} END AS r_e,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {dbl("(c_custkey * 6 + 3) % 11", 10)} END AS r_c,
  {pick("c_custkey", *q(
      "achievement,independence,recognition,relationships,support,working_conditions",
      "support,working_conditions,relationships,achievement,recognition,independence",
      None,
      "independence,achievement,working_conditions,support,recognition,relationships",
      "relationships,relationships,achievement,support,independence,recognition"))} AS values_csv
FROM customer
"""

VIEWS["v_candidate_skills"] = """
SELECT o_custkey AS user_id, l_partkey AS uri, CAST(max(year(l_shipdate)) AS INT) AS last_used_year
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_custkey, l_partkey
"""

VIEWS["v_job_skills"] = """
SELECT job_id, uri, CAST(rn AS INT) AS pos, CASE WHEN rn <= 5 THEN 'must' ELSE 'nice' END AS importance
FROM (
  SELECT job_id, uri, row_number() OVER (PARTITION BY job_id ORDER BY qty DESC, uri) AS rn
  FROM (SELECT l_suppkey AS job_id, l_partkey AS uri, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey, l_partkey) s
) r
"""

# Small families: every parent has at most four children, however large the table is.
VIEWS["v_skill_broader"] = """
SELECT p_partkey AS uri, 1000000000000 + CAST(floor(p_partkey / 4) AS BIGINT) AS broader_uri FROM part
UNION ALL
SELECT p_partkey AS uri, p_partkey - 5 AS broader_uri FROM part WHERE p_partkey % 9 = 5
"""

VIEWS["v_skills"] = f"""
SELECT p_partkey AS uri, p_name || ' ' || CAST(p_partkey AS STRING) AS label_en,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'nl ' || p_name || ' ' || CAST(p_partkey AS STRING) END AS label_nl,
  {pick("p_partkey", "p_type", "p_type || '|' || p_brand", None)} AS alts_csv
FROM part
"""

VIEWS["v_companies"] = f"""
SELECT s_suppkey AS company_id, s_name AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE lower(s_name) || '.example' END AS domain,
  {pick("s_suppkey", *q(None, "micro", "small", "medium", "large", "enterprise"))} AS size,
  {pick("s_suppkey * 3", *q("startup", "scaleup", "sme", "corporate", "public", "nonprofit", "agency", None))} AS type
FROM supplier WHERE s_suppkey % 3 = 0
"""

VIEWS["v_jobs"] = f"""
SELECT s_suppkey AS job_id,
  {pick("s_suppkey", *q("Senior Data Engineer (m/v/x)", "Verpleegkundige", "Sr. Backend Developer", "Lead UX Designer",
                        "Junior Accountant", "Head of Sales", "Warehouse worker", "Stagiair marketing"))} AS title,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'src' || CAST(s_suppkey % 6 AS STRING) END AS source_id,
  'x' || CAST(s_suppkey AS STRING) AS external_id,
  (s_suppkey * 37) % 101 AS source_priority,
  {pick("s_suppkey", *q("published", "published", "pending_review", "published", "expired", "published", "published",
                        "rejected", "published", "published", "archived", "draft"))} AS status,
  s_suppkey % 5 <> 2 AS is_golden,
  s_suppkey % 7 = 1 AS needs_review,
  CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE CAST(floor(s_suppkey / 3) * 3 AS BIGINT) END AS company_id,
  s_name AS hiring_name,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 'NATION_' || CAST(s_nationkey AS STRING) END AS city,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 51 + {dbl("(s_nationkey * 7) % 25", 20)} END AS lat,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 4 + {dbl("(s_nationkey * 11) % 25", 12)} END AS lng,
  {pick("s_suppkey", *q(None, "onsite", "hybrid", "remote", "onsite"))} AS remote_policy,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE {dbl("2500 + (s_suppkey * 131) % 4000")} END AS salary_min,
  CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 17 = 3 THEN NULL
       ELSE {dbl("2500 + (s_suppkey * 131) % 4000 + (s_suppkey * 17) % 1500")} END AS salary_max,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE {dbl("16 + (s_suppkey * 3) % 20")} END AS hours_min,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE {dbl("24 + (s_suppkey * 7) % 17")} END AS hours_max,
  {pick("s_suppkey", *q("full_time", "part_time", "full_time,part_time", None, "contract", "freelance,temporary"))} AS employment_csv,
  CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE CAST(2000 + (s_suppkey * 13) % 600 AS STRING) END AS isco_code,
  {pick("s_suppkey * 5", *q("intern", "junior", "medior", "senior", "lead", "executive", None))} AS seniority,
  {pick("s_suppkey", "6", "7", None, "4", None, None)} AS min_eqf,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE {dbl("(s_suppkey * 7) % 11", 10)} END AS r_r,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE {dbl("(s_suppkey * 2 + 5) % 11", 10)} END AS r_i,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE {dbl("(s_suppkey * 3 + 1) % 11", 10)} END AS r_a,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE {dbl("(s_suppkey * 4 + 7) % 11", 10)} END AS r_s,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE {dbl("(s_suppkey * 6 + 2) % 11", 10)} END AS r_e,
  CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE {dbl("(s_suppkey * 5 + 3) % 11", 10)} END AS r_c,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE {dbl("(s_suppkey * 3) % 21", 20)} END AS w_achievement,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE {dbl("(s_suppkey * 5 + 3) % 21", 20)} END AS w_independence,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE {dbl("(s_suppkey * 7 + 6) % 21", 20)} END AS w_recognition,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE {dbl("(s_suppkey * 2 + 9) % 21", 20)} END AS w_relationships,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE {dbl("(s_suppkey * 4 + 12) % 21", 20)} END AS w_support,
  CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE {dbl("(s_suppkey * 6 + 15) % 21", 20)} END AS w_working_conditions,
  {pick("s_suppkey", *q("nl", "en", None))} AS language,
  CAST(DATE '2026-01-01' + CAST((s_suppkey * 3) % 240 AS INT) AS DATE) AS date_posted,
  CASE WHEN s_suppkey % 4 = 3 THEN {DAY.format("2026-06-01", "(s_suppkey * 5) % 200")} END AS valid_through,
  {DAY.format("2026-05-01", "(s_suppkey * 7) % 125")} AS last_seen,
  CAST(s_suppkey % 4 AS INT) AS missed_runs,
  CAST(floor(s_suppkey / 4) AS BIGINT) AS dedup_group_id
FROM supplier
"""

VIEWS["v_candidate_languages"] = f"""
SELECT c_custkey AS user_id, 'nl' AS language, {pick("c_custkey", *q("A2", "B1", "B2", "C1", "C2"))} AS level
FROM customer WHERE c_custkey % 6 <> 0
UNION ALL
SELECT c_custkey AS user_id, 'en' AS language, {pick("c_custkey * 3 + 1", *q("A1", "B1", "B2", "C1", "C2", "A2"))} AS level
FROM customer WHERE c_custkey % 4 <> 0
"""

VIEWS["v_job_languages"] = f"""
SELECT s_suppkey AS job_id, 1 AS pos, 'nl' AS language, {pick("s_suppkey", *q("B1", "B2", "C1"))} AS level,
  s_suppkey % 4 <> 1 AS required FROM supplier WHERE s_suppkey % 3 <> 2
UNION ALL
SELECT s_suppkey AS job_id, 2 AS pos, 'en' AS language, {pick("s_suppkey * 5", *q("A2", "B2", "C1", "B1"))} AS level,
  s_suppkey % 5 <> 3 AS required FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL
SELECT s_suppkey AS job_id, 3 AS pos, 'de' AS language, 'B1' AS level, TRUE AS required
FROM supplier WHERE s_suppkey % 10 = 7
"""

# A vector per experience of a candidate, and one per posting.
VIEWS["v_candidate_vectors"] = """
SELECT vec_id AS user_id, 1 AS pos, embedding AS vector FROM embeddings
UNION ALL
SELECT vec_id * 2 AS user_id, 2 AS pos, embedding AS vector FROM embeddings
"""

VIEWS["v_job_vectors"] = """
SELECT vec_id AS job_id, embedding AS vector FROM embeddings
"""

# Candidate and posting pairs that occur together in the order lines; similarity in 0.70..0.999.
VIEWS["v_pairs"] = f"""
SELECT user_id, job_id, qty,
  CASE WHEN qty % 10 = 0 THEN NULL ELSE {dbl("700 + (qty * 7) % 300", 1000)} END AS similarity
FROM (
  SELECT o_custkey AS user_id, l_suppkey AS job_id, CAST(sum(l_quantity) AS BIGINT) AS qty
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_suppkey
) t
"""

VIEWS["v_matches"] = f"""
SELECT user_id, job_id, total_score,
  CASE WHEN total_score >= 75 THEN 'strong' WHEN total_score >= 60 THEN 'good'
       WHEN total_score >= 45 THEN 'possible' ELSE 'weak' END AS label,
  (user_id + job_id) % 6 = 0 AS knocked_out,
  (user_id + job_id) % 5 = 0 AS limited_data,
  CASE WHEN qty % 4 = 0 THEN NULL ELSE {DAY.format("2026-07-01", "qty % 60")} END AS seen_at,
  {DAY.format("2026-06-01", "qty % 30")} AS created_at
FROM (SELECT user_id, job_id, qty, {dbl("(qty * 13) % 1000", 10)} AS total_score FROM v_pairs) p
"""

VIEWS["v_feedback"] = f"""
SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS job_id, ts AS created_at,
  CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'click' THEN 'saved' WHEN 'error' THEN 'dismissed'
       ELSE 'unsaved' END AS type,
  CASE WHEN event_type = 'error' THEN {pick("event_id", *q("salary", "location", None, "skills", "other"))} END AS reason
FROM events WHERE event_type <> 'signup'
"""

VIEWS["v_consents"] = f"""
SELECT event_id, user_id, {pick("event_id", *q("terms_privacy", "ai_processing", "employer_sharing", "marketing"))} AS type,
  value >= 5 AS granted, {pick("user_id", *q("2026-01", "2026-09"))} AS policy_version, ts AS created_at
FROM events
"""

VIEWS["v_audit"] = f"""
SELECT event_id AS id, user_id AS actor_id,
  {pick("event_id", *q("match.compute", "job.published", "connector.sync", "account.delete", "job.rejected", "cv.parse"))} AS action,
  'user-' || CAST(user_id AS STRING) || ':' || event_type AS entity_id, ts AS created_at
FROM events
"""

VIEWS["v_applications"] = f"""
SELECT application_id, user_id, job_id,
  {pick("application_id", *q("saved", "applied", "interview", "offer", "rejected"))} AS status,
  CAST(application_id % 17 AS INT) AS position,
  {DAY.format("2026-01-01", "application_id % 200")} AS saved_at
FROM (SELECT min(o_orderkey) AS application_id, o_custkey AS user_id, 1 + o_orderkey % (SELECT max(s_suppkey) FROM supplier) AS job_id
      FROM orders GROUP BY o_custkey, 1 + o_orderkey % (SELECT max(s_suppkey) FROM supplier)) t
"""

# --- what is stored about a candidate, beside the tables above ---

VIEWS["v_experiences"] = f"""
SELECT o_custkey AS user_id, CAST(o_orderkey AS BIGINT) AS pos,
  {pick("o_orderkey", *q("Data Engineer", "Nurse", "Tester", "Cook"))} AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Firm ' || CAST(o_orderkey % 97 AS STRING) END AS organisation,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'o:' || CAST(o_orderkey % 7 AS STRING) END AS esco_occupation_uri,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(2500 + o_orderkey % 7 AS STRING) END AS isco_code,
  CAST(2000 + o_orderkey % 15 AS STRING) || '-01-01' AS start_date,
  CAST(2015 + o_orderkey % 9 AS STRING) || '-06-01' AS end_date,
  o_orderkey % 8 = 0 AS is_current, o_orderpriority AS description
FROM orders
"""

VIEWS["v_candidate_profiles"] = """
SELECT c.user_id, p.headline, CASE WHEN c.user_id % 4 = 0 THEN NULL ELSE 'about ' || CAST(c.user_id AS STRING) END AS summary, c.seniority,
  CAST(c.education_level AS INT) AS education_level, p.onboarded_at AS onboarding_completed_at, p.created_at
FROM v_candidates c JOIN v_profiles p ON p.user_id = c.user_id
"""

VIEWS["v_skill_rows"] = """
SELECT user_id, uri AS esco_uri, 'skill ' || CAST(uri AS STRING) AS label, last_used_year,
  CASE WHEN uri % 3 = 0 THEN 'manual' ELSE 'cv' END AS source, uri % 4 = 0 AS confirmed
FROM v_candidate_skills
"""

VIEWS["v_cv_files"] = f"""
SELECT o_custkey AS user_id, CAST(o_orderkey % 100 AS INT) AS version, 'cv-' || CAST(o_orderkey AS STRING) || '.pdf' AS file_name,
  'application/pdf' AS mime_type, CAST(1000 + o_orderkey % 5000 AS BIGINT) AS size_bytes,
  {pick("o_orderkey", *q("parsed", "failed", "pending"))} AS parse_status, {DAY.format("2025-01-01", "o_orderkey % 500")} AS created_at
FROM orders WHERE o_orderkey % 7 = 0
"""

VIEWS["v_alert_settings"] = f"""
SELECT c_custkey AS user_id, c_custkey % 2 = 0 AS enabled, {pick("c_custkey", *q("daily", "weekly"))} AS frequency,
  CAST(50 + c_custkey % 40 AS INT) AS min_score, {DAY.format("2025-03-01", "c_custkey % 300")} AS updated_at
FROM customer WHERE c_custkey % 5 <> 0
"""

VIEWS["v_alert_deliveries"] = """
SELECT user_id, event_id AS id, CAST(ts AS TIMESTAMP) AS sent_at FROM events WHERE event_type = 'view'
"""

VIEWS["v_deletion_requests"] = f"""
SELECT c_custkey AS user_id, {pick("c_custkey", *q("pending", "completed", "processing"))} AS status,
  {DAY.format("2026-01-01", "c_custkey % 200")} AS requested_at,
  CASE WHEN c_custkey % 3 = 1 THEN {DAY.format("2026-02-01", "c_custkey % 200")} END AS processed_at
FROM customer WHERE c_custkey % 11 = 0
"""

VIEWS["v_runs"] = f"""
SELECT o_orderkey AS run_id, 'src' || CAST(o_custkey % 40 AS STRING) AS connector_id,
  {pick("o_custkey", *q("adzuna", "greenhouse", "lever", "recruitee", "personio", "generic_feed"))} AS connector_type,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status,
  o_orderdate AS started_at
FROM orders
"""

VIEWS["v_run_items"] = f"""
SELECT l_orderkey AS run_id, l_linenumber AS item,
  {pick("l_partkey + l_linenumber", *q("new", "updated", "unchanged", "duplicate", "failed", "unchanged", "new", "unchanged"))} AS outcome,
  'x' || CAST(l_partkey AS STRING) AS external_id
FROM lineitem
"""

VIEWS["v_postings"] = f"""
SELECT doc_id, source AS source_id, 'x' || CAST(doc_id AS STRING) AS external_id, lang,
  {pick("doc_id", *q("Senior Data Engineer (m/v/x) – 32-40 uur!", "Vacature: Verpleegkundige", "Sr. Backend Developer",
                     "Lead UX Designer", "Junior Accountant", "Head of Sales", "Warehouse worker (m/f/d)",
                     "Stagiair marketing", "Manager Logistics", "Medior Tester", "Data Engineer"))} AS title,
  text || chr(10) || {pick("doc_id",
    "'We work fully remote with a great team. Full-time, 32-40 hours per week. Fluent English required. Master degree required.'",
    "'Hybride werken, 2 dagen per week op kantoor. Parttime of fulltime. Nederlands goed; Engels is een plus. Bonus points for python.'",
    "'On-site in the office. Freelance or interim. Salary 20 euro. German B2 and Dutch native. HBO diploma vereist.'",
    "'Nice to have: SQL. Coaching and learning budget, flexible hours, pension. 24 uur per week.'",
    "'Tijdelijk contract, op locatie. Impact, growth and autonomy. French (basic), Spanish fluent.'",
    "'Stage. Doorgroei en waardering; samenwerking met collega.'")} AS description,
  {pick("doc_id * 3", *q("Canal Analytics B.V.", "Dijk Zorg Groep", "Noord Software", "Haven Logistics N.V.", None,
                         "canal analytics", "Polder Media GmbH"))} AS company_name,
  {pick("doc_id * 5", *q("Amsterdam", "Rotterdam", "utrecht", "Den Haag", None, "Breda"))} AS city,
  CASE WHEN doc_id % 5 = 4 THEN NULL
       WHEN doc_id % 5 = 3 THEN 'https://boards.greenhouse.io/acme/jobs/' || CAST(doc_id % 40 AS STRING)
       ELSE 'https://WWW.Jobs.Example.com/Job/' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING) || '/?utm_source=x&b=2&a=' || CAST(doc_id % 2 AS STRING) || '#apply'
  END AS apply_url,
  {pick("doc_id", *q("published", "published", "published", "pending_review", "published", "expired", "published", "rejected",
                     "published", "archived"))} AS status,
  (doc_id * 37) % 101 AS source_priority,
  {DAY.format("2026-05-01", "(doc_id * 7) % 125")} AS last_seen,
  CAST(doc_id % 13 AS BIGINT) AS company_id,
  {pick("doc_id", *q("€ 3.500 - € 4.500 bruto per maand", "€45k–€55k per year", "€ 22,50 per uur", "Marktconform salaris",
                     "45.000 – 55.000 per jaar", "1200 per week", "250 per dag", "4000", "€ 2 per month", None))} AS salary_text
FROM documents
"""

VIEWS["v_salaries"] = f"""
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {dbl("(o_custkey * 7 + o_orderkey) % 90000 + 5")} END AS lo,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {dbl("(o_custkey * 11 + o_orderkey) % 90000 + 5")} END AS hi,
  {pick("o_orderkey", *q(None, "hour", "day", "week", "month", "year"))} AS unit,
  {pick("o_orderkey", *q("EUR", "eur", None, "USD", "EUR", "EUR", "EUR"))} AS currency,
  {pick("o_custkey", *q(None, "€ 3.500 - € 4.500 bruto per maand", "€45k–€55k per year", "€ 22,50 per uur", "1 500 per week",
                        "Marktconform salaris", "250 per dag", "7.500,00 p/m", "12,50 - 15 / uur"))} AS salary_text,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {dbl("16 + o_orderkey % 25")} END AS hours
FROM orders
"""

NL = "chr(10)"
VIEWS["v_cvs"] = f"""
SELECT c_custkey AS doc_id,
  'Jan de Smit' || {NL} || 'Profile' || {NL} || 'Data person number ' || CAST(c_custkey AS STRING) || {NL} || 'Experience' || {NL} ||
  'Data Engineer at Acme (' || CAST(2000 + c_custkey % 10 AS STRING) || ' - ' || CAST(2001 + c_custkey % 10 + c_custkey % 7 AS STRING) || ')' || {NL} ||
  'Built pipelines in python and airflow daily.' || {NL} ||
  CASE WHEN c_custkey % 2 = 0 THEN 'Senior Tester bij Noord 2016 – present' || {NL} ELSE '' END ||
  'Worked with sql' || {NL} || 'Education' || {NL} ||
  {pick("c_custkey", *q("PhD in physics", "Master of science", "Bachelor of arts", "MBO 4 diploma", "School"))} || {NL} ||
  'Languages' || {NL} || 'Dutch native, English (fluent)' || {NL} || 'German B1' AS text
FROM customer
"""

VIEWS["v_cities"] = f"""
SELECT lower(replace(n_name, '_', ' ')) AS norm, 51 + {dbl("(n_nationkey * 7) % 25", 20)} AS lat,
  4 + {dbl("(n_nationkey * 11) % 25", 12)} AS lng, 'province ' || CAST(n_regionkey AS STRING) AS province
FROM nation
"""

# Sections of the subject catalogue and the view that holds each.
SUBJECTS = {
    "profile": "v_profiles", "candidateProfile": "v_candidate_profiles", "skills": "v_skill_rows", "experiences": "v_experiences",
    "languages": "v_candidate_languages", "cvFiles": "v_cv_files", "matches": "v_matches", "matchFeedback": "v_feedback",
    "applications": "v_applications", "alertSettings": "v_alert_settings", "consents": "v_consents",
    "deletionRequests": "v_deletion_requests", "alertDeliveries": "v_alert_deliveries", "auditLog": "v_audit",
}
