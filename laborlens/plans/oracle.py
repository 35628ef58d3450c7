"""Parts used only by the SQL side, written apart from the operators."""

from __future__ import annotations

ORACLE_PARTS: dict[str, str] = {}


def level(col: str) -> str:
    return f"list_position(['A1','A2','B1','B2','C1','C2'], {col})"


def rank_of(col: str) -> str:
    return f"list_position(['intern','junior','medior','senior','lead','executive'], {col})"


def up(x: str, d: int) -> str:
    m = f"CAST({10 ** d} AS DOUBLE)"
    return f"(floor(({x}) * {m} + CAST(0.5 AS DOUBLE)) / {m})"


def code(prefix: str) -> str:
    """Three letters of the highest of six scores, ties in R-I-A-S-E-C order."""
    rows = ", ".join(f"{{'v': -{prefix}r_{k.lower()}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate("RIASEC"))
    return f"list_transform(list_sort([{rows}])[1:3], lambda s: s.k)"


PAIR_COLUMNS = """
  c.seniority AS c_seniority, c.education_level, c.lat AS c_lat, c.lng AS c_lng, c.max_travel, c.travel_mode,
  coalesce(c.remote_pref, 'any') AS pref, c.min_salary, c.hours_min AS c_lo, c.hours_max AS c_hi,
  c.employment_csv AS c_emp, c.sizes_csv, c.types_csv, c.values_csv, c.desired_codes, c.past_codes,
  c.r_r AS cr_r, c.r_i AS cr_i, c.r_a AS cr_a, c.r_s AS cr_s, c.r_e AS cr_e, c.r_c AS cr_c,
  j.lat AS j_lat, j.lng AS j_lng, j.remote_policy AS policy, j.salary_min, j.salary_max, j.hours_min AS j_lo,
  j.hours_max AS j_hi, j.employment_csv AS j_emp, j.isco_code, j.seniority AS j_seniority, j.min_eqf,
  j.r_r AS jr_r, j.r_i AS jr_i, j.r_a AS jr_a, j.r_s AS jr_s, j.r_e AS jr_e, j.r_c AS jr_c,
  j.w_achievement AS w1, j.w_independence AS w2, j.w_recognition AS w3, j.w_relationships AS w4, j.w_support AS w5,
  j.w_working_conditions AS w6, k.size, k.type
"""

ORACLE_PARTS["o_factor"] = """
SELECT user_id, uri, CASE WHEN 2002 - last_used_year <= 2 THEN CAST(1 AS DOUBLE)
  WHEN 2002 - last_used_year <= 5 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS factor
FROM v_candidate_skills
"""
ORACLE_PARTS["o_related"] = """
SELECT uri AS a, broader_uri AS b FROM v_skill_broader
UNION SELECT broader_uri, uri FROM v_skill_broader
UNION SELECT x.uri, y.uri FROM v_skill_broader x JOIN v_skill_broader y ON x.broader_uri = y.broader_uri
"""


def scored(tag: str, pairs: str, similarity: str, weights: tuple[float, ...]) -> None:
    """Parts ``<tag>_pair`` .. ``<tag>_total`` for one pair set and one set of weights."""
    names = ("skills", "experience", "occupation", "interests", "values", "practical")
    P = ORACLE_PARTS
    P[f"{tag}_pair"] = f"""
SELECT p.user_id, p.job_id, {similarity} AS sim, {PAIR_COLUMNS}
FROM {pairs} p JOIN v_candidates c ON c.user_id = p.user_id JOIN v_jobs j ON j.job_id = p.job_id
LEFT JOIN v_companies k ON k.company_id = j.company_id
"""
    P[f"{tag}_travel"] = f"""
SELECT *, CASE WHEN km < 0.5 THEN 5 ELSE {up('''km * CASE coalesce(travel_mode, 'public_transport') WHEN 'car' THEN CAST(1.3 AS DOUBLE)
   WHEN 'bike' THEN CAST(1.25 AS DOUBLE) ELSE CAST(1.2 AS DOUBLE) END
   / CASE coalesce(travel_mode, 'public_transport') WHEN 'car' THEN 70 WHEN 'bike' THEN 16 ELSE 75 END * 60
   + CASE coalesce(travel_mode, 'public_transport') WHEN 'car' THEN 8 WHEN 'bike' THEN 3 ELSE 20 END''', 0)} END AS minutes
FROM (SELECT *, 2 * 6371 * asin(sqrt(power(sin(radians(j_lat - c_lat) / 2), 2)
   + cos(radians(c_lat)) * cos(radians(j_lat)) * power(sin(radians(j_lng - c_lng) / 2), 2))) AS km FROM {tag}_pair) t
"""
    P[f"{tag}_need"] = f"""
SELECT p.user_id, p.job_id, l.pos, l.language, l.level AS required, s.level AS actual,
  coalesce({level('s.level')} >= {level('l.level')}, FALSE) AS met
FROM {tag}_pair p JOIN v_job_languages l ON l.job_id = p.job_id AND l.required
LEFT JOIN v_candidate_languages s ON s.user_id = p.user_id AND s.language = l.language
"""
    P[f"{tag}_lang"] = f"""
SELECT p.user_id, p.job_id,
  CASE WHEN n.n IS NULL THEN 'pass' WHEN s.user_id IS NULL THEN 'unknown' WHEN n.miss IS NOT NULL THEN 'fail' ELSE 'pass' END AS st,
  CASE WHEN n.n IS NULL THEN 'none' WHEN s.user_id IS NULL THEN 'unknown' WHEN n.miss IS NOT NULL THEN 'below' ELSE 'met' END AS why,
  CASE WHEN n.n IS NOT NULL AND s.user_id IS NOT NULL THEN n.miss END AS miss, coalesce(n.gaps, 0) AS gaps
FROM {tag}_pair p
LEFT JOIN (SELECT user_id, job_id, count(*) AS n, count(*) FILTER (NOT met) AS gaps,
   arg_min(language || ' ' || required || ' ' || coalesce(actual, '–'), pos) FILTER (NOT met) AS miss
   FROM {tag}_need GROUP BY 1, 2) n USING (user_id, job_id)
LEFT JOIN (SELECT DISTINCT user_id FROM v_candidate_languages) s ON s.user_id = p.user_id
"""
    P[f"{tag}_rules"] = f"""
SELECT t.user_id, t.job_id, l.st AS language, l.why AS language_why,
  CASE WHEN policy = 'remote' THEN 'remote' WHEN pref = 'remote' AND policy = 'onsite' THEN 'remoteOnly'
    WHEN pref = 'remote' AND policy = 'hybrid' THEN 'remoteOnlyHybrid' WHEN max_travel IS NULL THEN 'noLimit'
    WHEN minutes IS NULL THEN 'unknown'
    WHEN minutes > max_travel * (CASE WHEN policy = 'hybrid' THEN CAST(1.25 AS DOUBLE) ELSE 1 END) + 10 THEN 'tooFar'
    ELSE 'within' END AS location,
  CASE WHEN min_salary IS NULL THEN 'noMinimum' WHEN coalesce(salary_max, salary_min) IS NULL THEN 'unknown'
    WHEN coalesce(salary_max, salary_min) < min_salary * CAST(0.95 AS DOUBLE) THEN 'below' ELSE 'met' END AS salary,
  CASE WHEN c_emp IS NOT NULL AND j_emp IS NOT NULL AND NOT list_has_any(split(c_emp, ','), split(j_emp, ',')) THEN 'type'
    WHEN j_lo > c_hi THEN 'tooManyHours' WHEN j_hi < c_lo THEN 'tooFewHours'
    WHEN j_emp IS NULL AND j_lo IS NULL AND j_hi IS NULL THEN 'unknown' ELSE 'met' END AS contract,
  CASE WHEN min_eqf IS NULL THEN 'none' WHEN education_level IS NULL THEN 'unknown'
    WHEN education_level < min_eqf THEN 'below' ELSE 'met' END AS education, l.gaps
FROM {tag}_travel t JOIN {tag}_lang l ON l.user_id = t.user_id AND l.job_id = t.job_id
"""
    P[f"{tag}_ko"] = f"""
SELECT *, (language = 'fail' OR location IN ('remoteOnly', 'remoteOnlyHybrid', 'tooFar') OR salary = 'below'
  OR contract IN ('type', 'tooManyHours', 'tooFewHours') OR education = 'below') AS knocked_out,
  CAST(language = 'unknown' AS INT) + CAST(location = 'unknown' AS INT) + CAST(salary = 'unknown' AS INT)
  + CAST(contract = 'unknown' AS INT) + CAST(education = 'unknown' AS INT) AS unknowns FROM {tag}_rules
"""
    P[f"{tag}_exact"] = f"""
SELECT p.user_id, p.job_id, s.pos, s.uri, s.importance, e.factor AS exact
FROM {tag}_pair p JOIN o_factor e ON e.user_id = p.user_id JOIN v_job_skills s ON s.job_id = p.job_id AND s.uri = e.uri
"""
    P[f"{tag}_near"] = f"""
SELECT m.*, f.factor * CAST(0.5 AS DOUBLE) AS near FROM (
  SELECT p.user_id, p.job_id, s.pos, s.uri, s.importance, min(c.uri) AS first_uri
  FROM {tag}_pair p JOIN v_candidate_skills c ON c.user_id = p.user_id JOIN o_related r ON r.a = c.uri
  JOIN v_job_skills s ON s.job_id = p.job_id AND s.uri = r.b GROUP BY 1, 2, 3, 4, 5) m
JOIN o_factor f ON f.user_id = m.user_id AND f.uri = m.first_uri
"""
    P[f"{tag}_hit"] = f"""
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.pos, b.pos) AS pos,
  coalesce(a.uri, b.uri) AS uri, coalesce(a.importance, b.importance) AS importance,
  CASE WHEN coalesce(a.importance, b.importance) = 'must' THEN 2 ELSE 1 END AS w, a.exact, b.near
FROM {tag}_exact a FULL JOIN {tag}_near b ON a.user_id = b.user_id AND a.job_id = b.job_id AND a.pos = b.pos
"""
    P[f"{tag}_credit"] = f"""
SELECT p.user_id, p.job_id, s.pos, s.uri, s.importance, CASE WHEN s.importance = 'must' THEN 2 ELSE 1 END AS w,
  e.factor AS exact, f.factor * CAST(0.5 AS DOUBLE) AS near
FROM {tag}_pair p JOIN v_job_skills s ON s.job_id = p.job_id
LEFT JOIN o_factor e ON e.user_id = p.user_id AND e.uri = s.uri
LEFT JOIN (SELECT p2.user_id, p2.job_id, s2.uri, min(c2.uri) AS first_uri
   FROM {tag}_pair p2 JOIN v_job_skills s2 ON s2.job_id = p2.job_id JOIN o_related r ON r.b = s2.uri
   JOIN v_candidate_skills c2 ON c2.user_id = p2.user_id AND c2.uri = r.a GROUP BY 1, 2, 3) m
  ON m.user_id = p.user_id AND m.job_id = p.job_id AND m.uri = s.uri
LEFT JOIN o_factor f ON f.user_id = p.user_id AND f.uri = m.first_uri
"""
    P[f"{tag}_skill"] = f"""
SELECT p.user_id, p.job_id, coalesce(h.earned, 0) / j.w AS s_skills, coalesce(h.earned, CAST(0 AS DOUBLE)) AS earned, j.w AS total,
  j.n AS skills_total, coalesce(h.matched, 0) AS matched, j.musts AS must_total, coalesce(h.must_matched, 0) AS must_matched,
  coalesce(h.related, 0) AS related, j.n - coalesce(h.matched, 0) - coalesce(h.related, 0) AS missing
FROM {tag}_pair p
JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (importance = 'must') AS musts,
        CAST(sum(CASE WHEN importance = 'must' THEN 2 ELSE 1 END) AS DOUBLE) AS w FROM v_job_skills GROUP BY job_id) j ON j.job_id = p.job_id
LEFT JOIN (SELECT user_id, job_id, sum(w * coalesce(exact, near) ORDER BY pos) AS earned, count(exact) AS matched,
        count(exact) FILTER (importance = 'must') AS must_matched, count(*) FILTER (exact IS NULL AND near > 0) AS related
        FROM {tag}_hit GROUP BY 1, 2) h ON h.user_id = p.user_id AND h.job_id = p.job_id
"""
    P[f"{tag}_family"] = f"""
SELECT user_id, job_id, max(CASE WHEN c = isco_code THEN CAST(1 AS DOUBLE) WHEN left(c, 3) = left(isco_code, 3) THEN 0.75
  WHEN left(c, 2) = left(isco_code, 2) THEN 0.5 WHEN left(c, 1) = left(isco_code, 1) THEN 0.25 ELSE 0 END) AS family
FROM (SELECT user_id, job_id, isco_code, unnest(split(concat_ws(',', desired_codes, past_codes), ',')) AS c FROM {tag}_pair
      WHERE isco_code IS NOT NULL AND (desired_codes IS NOT NULL OR past_codes IS NOT NULL)) x GROUP BY 1, 2
"""
    weight = " + ".join(
        f"coalesce(CAST(7 - (7 - list_position(list_reverse(split(values_csv, ',')), '{v}')) AS DOUBLE) / 21"
        f" * least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), w{i})), 0)"
        for i, v in enumerate(
            ("achievement", "independence", "recognition", "relationships", "support", "working_conditions"), 1)
    )
    P[f"{tag}_raw"] = f"""
SELECT t.user_id, t.job_id, t.minutes, t.policy, t.pref, t.salary_min, t.salary_max, s.* EXCLUDE (user_id, job_id), f.family,
  CASE WHEN sim IS NOT NULL THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE),
    (sim - CAST(0.72 AS DOUBLE)) / (CAST(0.9 AS DOUBLE) - CAST(0.72 AS DOUBLE)))) END AS s_experience,
  CASE abs({rank_of('c_seniority')} - {rank_of('j_seniority')}) WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN 0.8 WHEN 2 THEN 0.5
    WHEN 3 THEN 0.2 WHEN 4 THEN 0.2 WHEN 5 THEN 0.2 END AS level_fit,
  CASE WHEN cr_r IS NOT NULL AND jr_r IS NOT NULL THEN {code('cr_').replace('cr_r_', 'cr_')} END AS person,
  CASE WHEN jr_r IS NOT NULL THEN {code('jr_').replace('jr_r_', 'jr_')} END AS env,
  CASE WHEN values_csv IS NOT NULL AND w1 IS NOT NULL THEN least(CAST(1 AS DOUBLE), {weight}) END AS s_values,
  CASE WHEN values_csv IS NOT NULL AND w1 IS NOT NULL THEN list_filter(split(values_csv, ','), lambda v:
    CASE v WHEN 'achievement' THEN w1 WHEN 'independence' THEN w2 WHEN 'recognition' THEN w3 WHEN 'relationships' THEN w4
    WHEN 'support' THEN w5 ELSE w6 END >= CAST(0.6 AS DOUBLE))[1] END AS top_value,
  CASE WHEN min_salary IS NOT NULL AND coalesce(salary_min, salary_max) IS NOT NULL THEN
    CASE WHEN coalesce(salary_min, salary_max) >= min_salary THEN CAST(1 AS DOUBLE)
      WHEN coalesce(salary_max, salary_min) >= min_salary THEN CASE WHEN salary_max = salary_min THEN CAST(1 AS DOUBLE)
        ELSE CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * ((salary_max - min_salary) / (salary_max - salary_min)) END
      ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce(salary_max, salary_min) / min_salary - CAST(0.5 AS DOUBLE))) END END AS q_salary,
  CASE WHEN policy = 'remote' THEN CAST(1 AS DOUBLE) WHEN minutes IS NOT NULL AND max_travel > 0 THEN
    least(CAST(1 AS DOUBLE), CASE WHEN minutes / max_travel <= 0.5 THEN CAST(1 AS DOUBLE)
      WHEN minutes / max_travel <= 1 THEN CAST(1 AS DOUBLE) - (minutes / max_travel - CAST(0.5 AS DOUBLE)) ELSE CAST(0.2 AS DOUBLE) END
      + CASE WHEN policy = 'hybrid' THEN CAST(0.15 AS DOUBLE) ELSE 0 END) END AS q_travel,
  CASE WHEN policy IS NULL THEN NULL WHEN pref = 'any' OR pref = policy THEN CAST(1 AS DOUBLE)
    WHEN pref = 'onsite' AND policy = 'hybrid' THEN 0.8 WHEN pref = 'onsite' THEN 0.6
    WHEN pref = 'hybrid' AND policy = 'onsite' THEN 0.4 WHEN pref = 'hybrid' THEN 0.9
    WHEN policy = 'onsite' THEN 0 ELSE 0.4 END AS q_remote,
  CASE WHEN (c_lo IS NOT NULL OR c_hi IS NOT NULL) AND (j_lo IS NOT NULL OR j_hi IS NOT NULL) THEN
    CASE WHEN least(coalesce(c_hi, 60), coalesce(j_hi, j_lo)) >= greatest(coalesce(c_lo, 0), coalesce(j_lo, j_hi))
      THEN CAST(1 AS DOUBLE) ELSE 0.3 END END AS q_hours,
  CASE WHEN sizes_csv IS NOT NULL AND size IS NOT NULL THEN CASE WHEN list_contains(split(sizes_csv, ','), size) THEN CAST(1 AS DOUBLE) ELSE 0.4 END END AS q_size,
  CASE WHEN types_csv IS NOT NULL AND type IS NOT NULL THEN CASE WHEN list_contains(split(types_csv, ','), type) THEN CAST(1 AS DOUBLE) ELSE 0.4 END END AS q_type
FROM {tag}_travel t
LEFT JOIN {tag}_skill s ON s.user_id = t.user_id AND s.job_id = t.job_id
LEFT JOIN {tag}_family f ON f.user_id = t.user_id AND f.job_id = t.job_id
"""
    iachan = " + ".join(
        f"coalesce(CASE list_position(env, person[{i + 1}]) WHEN 1 THEN {r[0]} WHEN 2 THEN {r[1]} WHEN 3 THEN {r[2]} END, 0)"
        for i, r in enumerate(((22, 10, 4), (10, 5, 2), (4, 2, 1)))
    )
    P[f"{tag}_part"] = f"""
SELECT *, CASE WHEN family IS NULL THEN level_fit WHEN level_fit IS NULL THEN family
    ELSE CAST(0.75 AS DOUBLE) * family + CAST(0.25 AS DOUBLE) * level_fit END AS s_occupation,
  CASE WHEN person IS NOT NULL AND env IS NOT NULL THEN CAST({iachan} AS DOUBLE) / 28 END AS s_interests,
  (coalesce(q_size, 0) + coalesce(q_type, 0)) / nullif(CAST(q_size IS NOT NULL AS INT) + CAST(q_type IS NOT NULL AS INT), 0) AS q_company
FROM {tag}_raw
"""
    P[f"{tag}_comp"] = f"""
SELECT *, {up('''(coalesce(q_salary, 0) + coalesce(q_travel, 0) + coalesce(q_remote, 0) + coalesce(q_hours, 0) + coalesce(q_company, 0))
  / nullif(CAST(q_salary IS NOT NULL AS INT) + CAST(q_travel IS NOT NULL AS INT) + CAST(q_remote IS NOT NULL AS INT)
  + CAST(q_hours IS NOT NULL AS INT) + CAST(q_company IS NOT NULL AS INT), 0)''', 2)} AS s_practical FROM {tag}_part
"""
    avail = " + ".join(f"CASE WHEN s_{n} IS NULL THEN 0 ELSE CAST({w} AS DOUBLE) END" for n, w in zip(names, weights))
    P[f"{tag}_avail"] = f"SELECT *, {avail} AS avail FROM {tag}_comp"
    shares = ", ".join(
        f"CASE WHEN s_{n} IS NULL OR avail = 0 THEN 0 ELSE CAST({w} AS DOUBLE) / nullif(avail, 0) END AS w_{n}"
        for n, w in zip(names, weights))
    P[f"{tag}_share"] = f"SELECT *, {shares} FROM {tag}_avail"
    points = ", ".join(f"coalesce(w_{n} * s_{n} * 100, 0) AS p_{n}" for n in names)
    P[f"{tag}_point"] = f"SELECT *, {points} FROM {tag}_share"
    P[f"{tag}_total"] = f"""
SELECT *, CASE WHEN total_score >= 75 THEN 'strong' WHEN total_score >= 60 THEN 'good' WHEN total_score >= 45 THEN 'possible'
  ELSE 'weak' END AS label, 1 - avail / 100 > CAST(0.35 AS DOUBLE) AS limited_data
FROM (SELECT *, {up(' + '.join(f'p_{n}' for n in names), 1)} AS total_score FROM {tag}_point) t
"""


DEFAULT_WEIGHTS = (35.0, 20.0, 15.0, 10.0, 10.0, 10.0)
SKILL_LED_WEIGHTS = (60.0, 10.0, 10.0, 5.0, 5.0, 10.0)
scored("o", "v_pairs", "p.similarity", DEFAULT_WEIGHTS)
scored("l", "v_pairs", "p.similarity", SKILL_LED_WEIGHTS)

# Every onboarded candidate with every published golden posting, for the full recompute.
ORACLE_PARTS["x_all"] = """
SELECT p.user_id, j.job_id, s.sim AS similarity FROM v_profiles p CROSS JOIN v_jobs j LEFT JOIN (
  SELECT c.user_id, b.job_id,
    floor(max(list_dot_product(c.v, b.v) / sqrt(list_dot_product(c.v, c.v) * list_dot_product(b.v, b.v))) * 10000 + CAST(0.5 AS DOUBLE)) / 10000 AS sim
  FROM (SELECT user_id, CAST(vector AS DOUBLE[]) AS v FROM v_candidate_vectors) c
  CROSS JOIN (SELECT job_id, CAST(vector AS DOUBLE[]) AS v FROM v_job_vectors WHERE job_id IN (SELECT job_id FROM v_jobs)) b
  GROUP BY 1, 2) s ON s.user_id = p.user_id AND s.job_id = j.job_id
WHERE p.onboarded_at IS NOT NULL AND j.status = 'published' AND j.is_golden
"""
scored("x", "x_all", "p.similarity", DEFAULT_WEIGHTS)

# All pairs meet here, so skills meet by key alone, before any pair is formed.
LIVE_SKILLS = "(SELECT s.* FROM v_job_skills s JOIN v_jobs j ON j.job_id = s.job_id WHERE j.status = 'published' AND j.is_golden)"
LIVE_USERS = "(SELECT user_id FROM v_profiles WHERE onboarded_at IS NOT NULL)"
ORACLE_PARTS["x_exact"] = f"""
SELECT e.user_id, s.job_id, s.pos, s.uri, s.importance, e.factor AS exact
FROM o_factor e JOIN {LIVE_USERS} u ON u.user_id = e.user_id JOIN {LIVE_SKILLS} s ON s.uri = e.uri
"""
ORACLE_PARTS["x_near"] = f"""
SELECT m.*, f.factor * CAST(0.5 AS DOUBLE) AS near FROM (
  SELECT c.user_id, s.job_id, s.pos, s.uri, s.importance, min(c.uri) AS first_uri
  FROM (SELECT c.* FROM v_candidate_skills c JOIN {LIVE_USERS} u ON u.user_id = c.user_id) c
  JOIN o_related r ON r.a = c.uri JOIN {LIVE_SKILLS} s ON s.uri = r.b GROUP BY 1, 2, 3, 4, 5) m
JOIN o_factor f ON f.user_id = m.user_id AND f.uri = m.first_uri
"""
