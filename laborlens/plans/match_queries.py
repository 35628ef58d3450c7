"""Matching queries: rules, components, scores, explanations, recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import COMPONENTS, DEFAULT, SKILL_LED, validate_versions
from ..functions import numbers as N
from ..operators import matching as M
from .registry import query

YEAR = 2002  # the newest order lines end in 2001


def csv(name: str):
    return F.split(F.col(name), ",")


def riasec():
    made = F.struct(*[F.col(f"r_{k.lower()}").alias(k) for k in N.RIASEC])
    return F.when(F.col("r_r").isNotNull(), made)


def work_values():
    made = F.struct(*[F.col(f"w_{v}").alias(v) for v in N.WORK_VALUES])
    return F.when(F.col("w_achievement").isNotNull(), made)


def candidates(t, cfg=DEFAULT, vectors: bool = False) -> DataFrame:
    profiles = t("v_candidates").withColumns(
        {
            "employment": csv("employment_csv"), "sizes": csv("sizes_csv"), "types": csv("types_csv"),
            "codes": F.concat(M.arr(csv("desired_codes")), M.arr(csv("past_codes"))),
            "work_values": csv("values_csv"), "riasec": riasec(),
        }
    )
    skills = t("v_candidate_skills").withColumn("pos", F.col("uri"))
    vectors = t("v_candidate_vectors") if vectors else None
    return M.candidate_side(profiles, skills, t("v_candidate_languages"), t("v_skill_broader"), cfg, YEAR, vectors)


def postings(t, jobs: DataFrame | None = None, vectors: bool = False) -> DataFrame:
    jobs = t("v_jobs") if jobs is None else jobs
    jobs = jobs.withColumns(
        {"employment": csv("employment_csv"), "riasec": riasec(), "work_values": work_values()}
    )
    skills = t("v_job_skills").join(t("v_skills").select("uri", F.col("label_en").alias("label")), "uri", "left")
    vectors = t("v_job_vectors") if vectors else None
    return M.posting_side(jobs, skills, t("v_job_languages"), t("v_companies"), t("v_skill_broader"), vectors)


def pairs(t, cfg=DEFAULT, listed: bool = False, named: bool = False, hits: bool = False) -> DataFrame:
    """The joined pairs; ``hits`` where skill hits are read, which reasons need ``named`` and gaps with the postings' lists."""
    return M.join_pairs(t("v_pairs").drop("qty"), candidates(t, cfg), postings(t), listed, named or listed, cells=hits or listed)


def scored(t, cfg=DEFAULT, told: bool = False, listed: bool = False) -> DataFrame:
    """The scored pairs, with reasons if ``told`` and gaps if ``listed``."""
    return M.score_pairs(pairs(t, cfg, listed, told, hits=True), cfg, told)


def matchable(t) -> DataFrame:
    return t("v_jobs").filter((F.col("status") == "published") & F.col("is_golden"))


def onboarded(t) -> DataFrame:
    return t("v_profiles").filter(F.col("onboarded_at").isNotNull()).select("user_id")


# --- rules ------------------------------------------------------------------------------


def rule(t, fn):
    r = fn(DEFAULT)
    why = F.substring_index(F.col("r.key"), ".", -1)
    return pairs(t).withColumn("r", r).select("user_id", "job_id", F.col("r.status").alias("status"), why.alias("why"))


@query("ko_language", """SELECT user_id, job_id, st AS status, why, miss FROM o_lang""")
def _(t):
    out = pairs(t).withColumn("r", M.ko_language())
    p = F.col("r.params")
    miss = F.concat_ws(" ", *[F.try_element_at(p, F.lit(k)) for k in ("language", "required", "actual")])
    return out.select("user_id", "job_id", F.col("r.status").alias("status"),
                      F.substring_index("r.key", ".", -1).alias("why"), F.nullif(miss, F.lit("")).alias("miss"))


@query("ko_location", """SELECT user_id, job_id, CASE WHEN location IN ('remoteOnly','remoteOnlyHybrid','tooFar') THEN 'fail'
 WHEN location = 'unknown' THEN 'unknown' ELSE 'pass' END AS status, location AS why FROM o_rules""")
def _(t):
    return rule(t, M.ko_location)


@query("ko_salary", """SELECT user_id, job_id, CASE salary WHEN 'below' THEN 'fail' WHEN 'unknown' THEN 'unknown' ELSE 'pass' END
 AS status, salary AS why FROM o_rules""")
def _(t):
    return rule(t, M.ko_salary)


@query("ko_contract", """SELECT user_id, job_id, CASE contract WHEN 'met' THEN 'pass' WHEN 'unknown' THEN 'unknown' ELSE 'fail' END
 AS status, contract AS why FROM o_rules""")
def _(t):
    return rule(t, M.ko_contract)


@query("ko_education", """SELECT user_id, job_id, CASE education WHEN 'below' THEN 'fail' WHEN 'unknown' THEN 'unknown' ELSE 'pass' END
 AS status, education AS why FROM o_rules""")
def _(t):
    return rule(t, M.ko_education)


@query("ko_all", """SELECT user_id, job_id, language_why || ',' || location || ',' || salary || ',' || contract || ',' || education
 AS outcome, knocked_out FROM o_ko""")
def _(t):
    whys = F.transform("k", lambda r: F.substring_index(r["key"], ".", -1))
    return pairs(t).withColumn("k", M.ko_all()).select(
        "user_id", "job_id", F.array_join(whys, ",").alias("outcome"),
        F.exists("k", lambda r: r["status"] == "fail").alias("knocked_out"))


@query("set_overlap", """SELECT user_id, job_id, coalesce(NOT list_has_any(split(c_emp, ','), split(j_emp, ',')), FALSE) AS clash FROM o_pair""")
def _(t):
    return pairs(t).select("user_id", "job_id", M.types_clash().alias("clash"))


@query("join_language_req", """SELECT user_id, job_id, language, required, actual, met FROM o_need""")
def _(t):
    need = t("v_job_languages").filter("required").select("job_id", "language", F.col("level").alias("required"))
    have = t("v_candidate_languages").withColumnRenamed("level", "actual")
    out = t("v_pairs").select("user_id", "job_id").join(need, "job_id").join(have, ["user_id", "language"], "left")
    return out.withColumn("met", N.cefr_meets(F.col("actual"), F.col("required")))


@query("cefr_meets", f"""SELECT user_id, job_id, language, met AS strict,
 coalesce(list_position(['A1','A2','B1','B2','C1','C2'], actual) >= list_position(['A1','A2','B1','B2','C1','C2'], required) - 1, FALSE) AS one_below
 FROM o_need""")
def _(t):
    need = t("v_job_languages").filter("required").select("job_id", "language", F.col("level").alias("required"))
    have = t("v_candidate_languages").withColumnRenamed("level", "actual")
    out = t("v_pairs").select("user_id", "job_id").join(need, "job_id").join(have, ["user_id", "language"], "left")
    a, r = F.col("actual"), F.col("required")
    return out.select("user_id", "job_id", "language", N.cefr_meets(a, r).alias("strict"), N.cefr_meets(a, r, 1).alias("one_below"))


# --- components -------------------------------------------------------------------------


def parts(t, hits: bool = True):
    return M.with_components(pairs(t, hits=hits))


@query("comp_skills", """SELECT user_id, job_id, s_skills AS score, matched, must_matched, related, missing FROM o_skill""")
def _(t):
    def n(cond):
        return F.size(F.filter("skill_credits", cond)).cast("bigint")

    return parts(t).select(
        "user_id", "job_id", F.col("s_skills").alias("score"),
        n(lambda s: s["status"] == "matched").alias("matched"),
        n(lambda s: (s["status"] == "matched") & (s["importance"] == "must")).alias("must_matched"),
        n(lambda s: s["status"] == "related").alias("related"), (F.col("j_listed") - F.size("skill_credits")).cast("bigint").alias("missing"))


@query("agg_skill_credit", "SELECT user_id, job_id, earned, total FROM o_skill")
def _(t):
    f = pairs(t, hits=True).withColumn("skill_credits", M.skill_credits())
    return f.select("user_id", "job_id", M.skills_earned().alias("earned"), M.skills_weight().alias("total"))


def credit_rows(t, status):
    f = pairs(t, hits=True).withColumn("skill_credits", M.skill_credits())
    rows = f.select("user_id", "job_id", F.explode_outer("skill_credits").alias("s")).filter(F.col("s.status") == status)
    return rows.select("user_id", "job_id", "s.uri", "s.importance", "s.credit")


@query("join_skill_exact", """SELECT user_id, job_id, uri, importance, exact AS credit FROM o_exact""")
def _(t):
    return credit_rows(t, "matched")


@query("join_skill_related", """SELECT user_id, job_id, uri, importance, near AS credit FROM o_hit WHERE exact IS NULL AND near > 0""")
def _(t):
    return credit_rows(t, "related")


@query("recency_factor", "SELECT user_id, uri, factor FROM o_factor")
def _(t):
    return t("v_candidate_skills").select("user_id", "uri", M.recency_factor(F.col("last_used_year"), DEFAULT, YEAR).alias("factor"))


@query("comp_experience", """SELECT user_id, job_id, s_experience AS score, CASE WHEN s_experience >= 0.66 THEN 'high'
 WHEN s_experience >= 0.33 THEN 'medium' WHEN s_experience IS NOT NULL THEN 'low' END AS band FROM o_raw""")
def _(t):
    s = F.col("score")
    band = F.when(s >= 0.66, "high").when(s >= 0.33, "medium").when(s.isNotNull(), "low")
    return t("v_pairs").select("user_id", "job_id", M.experience_score().alias("score")).withColumn("band", band)


@query("comp_occupation", "SELECT user_id, job_id, family, s_occupation AS score FROM o_part")
def _(t):
    return pairs(t).withColumn("family", M.family_similarity()).select("user_id", "job_id", "family", M.occupation_score().alias("score"))


@query("agg_max_family", "SELECT user_id, job_id, family FROM o_family")
def _(t):
    return pairs(t).select("user_id", "job_id", M.family_similarity().alias("family")).filter(F.col("family").isNotNull())


@query("isco_similarity", """SELECT user_id, job_id, CASE WHEN c = isco_code THEN CAST(1 AS DOUBLE) WHEN left(c, 3) = left(isco_code, 3) THEN 0.75
  WHEN left(c, 2) = left(isco_code, 2) THEN 0.5 WHEN left(c, 1) = left(isco_code, 1) THEN 0.25 ELSE 0 END AS similarity
 FROM (SELECT user_id, job_id, isco_code, past_codes AS c FROM o_pair) t WHERE c IS NOT NULL AND isco_code IS NOT NULL""")
def _(t):
    c = t("v_candidates").select("user_id", "past_codes").dropna()
    j = t("v_jobs").select("job_id", "isco_code").dropna()
    f = t("v_pairs").join(c, "user_id").join(j, "job_id")
    return f.select("user_id", "job_id", N.isco_similarity(F.col("past_codes"), F.col("isco_code")).alias("similarity"))


@query("seniority_fit", "SELECT user_id, job_id, level_fit AS fit FROM o_raw")
def _(t):
    return pairs(t).select("user_id", "job_id", N.seniority_fit(F.col("c_seniority"), F.col("j_seniority")).alias("fit"))


@query("set_codes_union", """SELECT user_id, concat_ws(',', desired_codes, past_codes) AS codes FROM v_candidates""")
def _(t):
    return t("v_candidates").select("user_id", F.array_join(F.concat(M.arr(csv("desired_codes")), M.arr(csv("past_codes"))), ",").alias("codes"))


@query("comp_interests", """SELECT user_id, job_id, array_to_string(person, '') AS person, s_interests AS score FROM o_part""")
def _(t):
    f = pairs(t)
    both = F.col("c_riasec").isNotNull() & F.col("j_riasec").isNotNull()
    return f.select("user_id", "job_id", F.when(both, F.array_join(M.codes_of("c_riasec"), "")).alias("person"), M.interests_score().alias("score"))


@query("riasec_congruence", """SELECT user_id, job_id, s_interests * 28 AS agreement FROM o_part WHERE s_interests IS NOT NULL""")
def _(t):
    f = pairs(t).filter(F.col("c_riasec").isNotNull() & F.col("j_riasec").isNotNull())
    m = N.riasec_congruence(M.codes_of("c_riasec"), M.codes_of("j_riasec"))
    return f.select("user_id", "job_id", (m * 28.0).alias("agreement"))


@query("win_holland", """SELECT job_id, array_to_string(list_transform(list_sort([{'v': -r_r, 'i': 0, 'k': 'R'}, {'v': -r_i, 'i': 1, 'k': 'I'},
 {'v': -r_a, 'i': 2, 'k': 'A'}, {'v': -r_s, 'i': 3, 'k': 'S'}, {'v': -r_e, 'i': 4, 'k': 'E'}, {'v': -r_c, 'i': 5, 'k': 'C'}])[1:3],
 lambda s: s.k), '') AS code FROM v_jobs WHERE r_r IS NOT NULL""")
def _(t):
    j = t("v_jobs").filter(F.col("r_r").isNotNull())
    return j.select("job_id", F.array_join(N.holland_code([F.col(f"r_{k.lower()}") for k in N.RIASEC]), "").alias("code"))


@query("comp_values", "SELECT user_id, job_id, s_values AS score, top_value FROM o_raw")
def _(t):
    return pairs(t).select("user_id", "job_id", M.values_score().alias("score"), M.top_value().alias("top_value"))


@query("value_weights", """SELECT user_id, v AS value, CAST(7 - max(i) AS DOUBLE) / 21 AS weight
 FROM (SELECT user_id, unnest(split(values_csv, ',')) AS v, generate_subscripts(split(values_csv, ','), 1) AS i FROM v_candidates
 WHERE values_csv IS NOT NULL) t GROUP BY 1, 2""")
def _(t):
    c = t("v_candidates").filter(F.col("values_csv").isNotNull())
    weights = F.array(*[F.struct(F.lit(v).alias("value"), N.value_weight(csv("values_csv"), v).alias("weight")) for v in N.WORK_VALUES])
    return c.select("user_id", F.explode(weights).alias("w")).select("user_id", "w.*").filter(F.col("weight") > 0)


@query("comp_practical", """SELECT user_id, job_id, q_salary AS salary, q_travel AS travel, q_remote AS remote, q_hours AS hours,
 q_company AS company, s_practical AS score FROM o_comp""")
def _(t):
    return parts(t, hits=False).select("user_id", "job_id", "practical_parts.*", F.col("s_practical").alias("score"))


@query("agg_mean_known", "SELECT user_id, job_id, s_practical AS mean_known FROM o_comp WHERE s_practical IS NOT NULL")
def _(t):
    f = pairs(t).withColumn("practical_parts", M.practical_parts())
    f = M.settle(f.select("user_id", "job_id", M.practical_score().alias("mean_known")), "mean_known")
    return f.filter(F.col("mean_known").isNotNull())


@query("geo_haversine", "SELECT user_id, job_id, floor(km * 1000 + 0.5) AS metres FROM o_travel WHERE km IS NOT NULL")
def _(t):
    km = N.haversine_km(*[F.col(c) for c in ("c_lat", "c_lng", "j_lat", "j_lng")])
    return pairs(t).select("user_id", "job_id", F.floor(km * 1000 + 0.5).alias("metres")).filter(F.col("metres").isNotNull())


@query("geo_travel", "SELECT user_id, job_id, minutes FROM o_travel")
def _(t):
    return pairs(t).select("user_id", "job_id", F.col("travel_minutes").alias("minutes"))


# --- results ----------------------------------------------------------------------------


@query("agg_reweight", """SELECT user_id, job_id, w_skills, w_experience, w_occupation, w_interests, w_values, w_practical,
 avail AS available_weight, limited_data FROM o_total""")
def _(t):
    return M.reweight(parts(t)).select("user_id", "job_id", *[f"w_{k}" for k in COMPONENTS], "available_weight", "limited_data")


@query("match_score", """SELECT t.user_id, t.job_id, total_score, label, knocked_out, limited_data, s_skills, s_experience, s_occupation,
 s_interests, s_values, s_practical, gaps AS language_gaps FROM o_total t JOIN o_ko k ON k.user_id = t.user_id AND k.job_id = t.job_id""")
def _(t):
    return scored(t).select("user_id", "job_id", "total_score", "label", "knocked_out", "limited_data",
                            *[f"s_{k}" for k in COMPONENTS], F.size("language_gaps").cast("bigint").alias("language_gaps"))


@query("match_label", "SELECT label, count(*) AS n, min(total_score) AS lowest, max(total_score) AS highest FROM o_total GROUP BY label")
def _(t):
    return scored(t).groupBy("label").agg(F.count("*").alias("n"), F.min("total_score").alias("lowest"), F.max("total_score").alias("highest"))


GAPS = """SELECT user_id, job_id, string_agg(CAST(uri AS STRING) || CASE WHEN coalesce(near, 0) > 0 THEN 'r' ELSE 'm' END, ','
 ORDER BY CASE WHEN importance = 'must' THEN 0 ELSE 1 END, pos) AS gaps FROM o_credit WHERE exact IS NULL GROUP BY 1, 2"""
MISSED = """SELECT user_id, job_id, string_agg(language || ' ' || required || ' ' || coalesce(actual, '–'), ',' ORDER BY pos) AS language_gaps
 FROM o_need WHERE NOT met GROUP BY 1, 2"""


@query("match_gaps", f"""SELECT coalesce(g.user_id, l.user_id) AS user_id, coalesce(g.job_id, l.job_id) AS job_id, coalesce(gaps, '') AS gaps,
 coalesce(language_gaps, '') AS language_gaps FROM ({GAPS}) g FULL JOIN ({MISSED}) l ON l.user_id = g.user_id AND l.job_id = g.job_id""")
def _(t):
    f = pairs(t, listed=True).withColumn("skill_credits", M.skill_credits())
    text = F.transform(M.skill_gaps(), lambda g: F.concat(g["uri"].cast("string"), F.left(g["status"], F.lit(1))))
    missed = F.transform(M.unmet_languages(0), lambda r: F.concat_ws(" ", r["language"], r["required"], F.coalesce(r["actual"], F.lit("–"))))
    out = f.select("user_id", "job_id", F.array_join(text, ",").alias("gaps"), F.array_join(missed, ",").alias("language_gaps"))
    return M.settle(out, "gaps", "language_gaps").filter((F.col("gaps") != "") | (F.col("language_gaps") != ""))


REASONS = """
SELECT user_id, job_id, string_agg(key, ',' ORDER BY strength DESC, key) AS reasons FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY strength DESC, key) AS rn FROM (
  SELECT user_id, job_id, 'reason.skillsAllMust' AS key, {p_skills} + 2 AS strength FROM o_total WHERE {s_skills} >= 0.5 AND must_total > 0 AND must_matched = must_total
  UNION ALL SELECT user_id, job_id, 'reason.skills', {p_skills} FROM o_total WHERE {s_skills} >= 0.5 AND NOT (must_total > 0 AND must_matched = must_total)
  UNION ALL SELECT user_id, job_id, 'reason.experience', {p_experience} FROM o_total WHERE {s_experience} >= 0.6
  UNION ALL SELECT user_id, job_id, 'reason.occupationSame', {p_occupation} FROM o_total WHERE s_occupation IS NOT NULL AND family >= 1
  UNION ALL SELECT user_id, job_id, 'reason.occupationRelated', {p_occupation} * CAST(0.8 AS DOUBLE) FROM o_total WHERE s_occupation IS NOT NULL AND family >= 0.5 AND family < 1
  UNION ALL SELECT user_id, job_id, 'reason.interests', {p_interests} FROM o_total WHERE {s_interests} >= 0.5
  UNION ALL SELECT user_id, job_id, 'reason.values', {p_values} FROM o_total WHERE s_values IS NOT NULL AND top_value IS NOT NULL
  UNION ALL SELECT user_id, job_id, 'reason.salary', {w_practical} * 100 * CAST(0.5 AS DOUBLE) FROM o_total WHERE q_salary = 1
  UNION ALL SELECT user_id, job_id, 'reason.remote', {w_practical} * 100 * CAST(0.45 AS DOUBLE) FROM o_total WHERE policy = 'remote' AND pref <> 'onsite'
  UNION ALL SELECT user_id, job_id, 'reason.travel', {w_practical} * 100 * CAST(0.4 AS DOUBLE) FROM o_total WHERE NOT (coalesce(policy, '') = 'remote' AND pref <> 'onsite')
    AND q_travel >= 0.8 AND (minutes IS NOT NULL OR policy = 'remote')
 ) r) ranked WHERE rn <= 3 GROUP BY user_id, job_id
"""


def _shown(sql: str) -> str:
    from .oracle import up

    names = {f"p_{k}": up(f"p_{k}", 1) for k in COMPONENTS}
    names |= {f"s_{k}": up(f"s_{k}", 3) for k in COMPONENTS}
    names |= {"w_practical": up("w_practical", 3)}
    return sql.format(**names)


@query("match_reasons", "SELECT p.user_id, p.job_id, coalesce(r.reasons, 'reason.fallback') AS reasons FROM v_pairs p LEFT JOIN ("
       + _shown(REASONS) + ") r ON r.user_id = p.user_id AND r.job_id = p.job_id")
def _(t):
    return scored(t, told=True).select("user_id", "job_id", F.array_join(F.transform("reasons", lambda r: r["key"]), ",").alias("reasons"))


@query("win_top_reasons", "SELECT key AS reason, count(*) AS n FROM (SELECT unnest(split(reasons, ',')) AS key FROM ("
       + _shown(REASONS) + ") a) b GROUP BY key")
def _(t):
    rows = scored(t, told=True).select(F.explode_outer("reasons").alias("r")).filter(F.col("r.key") != "reason.fallback")
    return rows.groupBy(F.col("r.key").alias("reason")).agg(F.count("*").alias("n"))


@query("match_notes", """SELECT t.user_id, t.job_id, k.unknowns + CAST(k.knocked_out AS INT) + CAST(t.limited_data AS INT) AS notes,
 k.knocked_out, t.limited_data FROM o_total t JOIN o_ko k ON k.user_id = t.user_id AND k.job_id = t.job_id""")
def _(t):
    return scored(t).select("user_id", "job_id", F.size("notes").alias("notes"), "knocked_out", "limited_data")


@query("win_rank_matches", """SELECT t.user_id, t.job_id, total_score, knocked_out, row_number() OVER (PARTITION BY t.user_id
 ORDER BY knocked_out, total_score DESC, t.job_id) AS rank FROM o_total t JOIN o_ko k ON k.user_id = t.user_id AND k.job_id = t.job_id""")
def _(t):
    return M.rank_matches(scored(t).select("user_id", "job_id", "total_score", "knocked_out"))


@query("match_explain_export", _shown("""SELECT t.user_id, t.job_id, total_score, label, t.limited_data, {p_skills} AS skill_points,
 {s_practical} AS practical_score, coalesce(r.reasons, 'reason.fallback') AS reasons, coalesce(g.gaps, '') AS gaps FROM o_total t LEFT JOIN (""")
       + _shown(REASONS) + f") r ON r.user_id = t.user_id AND r.job_id = t.job_id LEFT JOIN ({GAPS}) g ON g.user_id = t.user_id AND g.job_id = t.job_id")
def _(t):
    rows = M.match_rows(scored(t, told=True, listed=True))
    c = F.col("component_scores")
    points = F.coalesce(F.get_json_object(c, "$.skills.points"), F.lit("0"))
    told = F.from_json("explanation", "reasons array<struct<key:string>>, gaps array<struct<uri:string,status:string>>")
    return rows.withColumn("told", told).select(
        "user_id", "job_id", "total_score", "label", "limited_data", points.cast("double").alias("skill_points"),
        F.get_json_object(c, "$.practical.score").cast("double").alias("practical_score"),
        F.array_join(F.transform("told.reasons", lambda r: r["key"]), ",").alias("reasons"),
        F.array_join(F.transform("told.gaps", lambda g: F.concat(g["uri"], F.left(g["status"], F.lit(1)))), ",").alias("gaps"),
    )


# --- recomputation ----------------------------------------------------------------------


def full(t, jobs: DataFrame | None = None) -> DataFrame:
    """All onboarded candidates against the matchable postings under the default model."""
    people = candidates(t, vectors=True).join(onboarded(t), "user_id", "left_semi")
    return M.recompute(people, postings(t, matchable(t) if jobs is None else jobs, vectors=True), DEFAULT)


KEPT = """SELECT t.user_id, t.job_id, total_score, label, knocked_out, limited_data
 FROM x_total t JOIN x_ko k ON k.user_id = t.user_id AND k.job_id = t.job_id WHERE total_score >= 45"""
RESULT = ("user_id", "job_id", "total_score", "label", "knocked_out", "limited_data")


@query("match_recompute_all", KEPT)
def _(t):
    return full(t).select(*RESULT)


@query("join_pairs", """SELECT DISTINCT c.user_id, s.job_id FROM v_candidate_skills c JOIN
 (SELECT uri AS a, uri AS b FROM v_skills UNION SELECT a, b FROM o_related) r ON r.a = c.uri
 JOIN v_job_skills s ON s.uri = r.b JOIN v_profiles p ON p.user_id = c.user_id JOIN v_jobs j ON j.job_id = s.job_id
 WHERE p.onboarded_at IS NOT NULL AND j.status = 'published' AND j.is_golden""")
def _(t):
    people = candidates(t, SKILL_LED).join(onboarded(t), "user_id", "left_semi")
    return M.candidate_pairs(people, postings(t, matchable(t)), SKILL_LED)


def changed_postings(t) -> DataFrame:
    """Postings whose digest differs from that of a month ago, when those last seen since did not exist."""
    jobs = t("v_jobs")
    newest = jobs.agg(F.max("last_seen")).scalar()
    before = jobs.filter(F.col("last_seen") < newest - F.expr("INTERVAL 30 DAYS"))
    return M.changed_keys(digests(t, "job_id", before), digests(t, "job_id"), "job_id")


@query("match_recompute_delta", KEPT.replace("WHERE", """JOIN v_jobs j ON j.job_id = t.job_id
 WHERE j.last_seen >= (SELECT max(last_seen) FROM v_jobs) - INTERVAL 30 DAY AND""").replace(" AND total_score", " AND total_score"))
def _(t):
    people = candidates(t, vectors=True).join(onboarded(t), "user_id", "left_semi")
    jobs = postings(t, matchable(t), vectors=True)
    return M.recompute_changed(people, jobs, None, changed_postings(t), DEFAULT).select(*RESULT)


@query("sink_match_sync", f"""SELECT user_id, job_id, total_score, label, knocked_out, limited_data FROM ({KEPT}) a
 UNION ALL SELECT m.user_id, m.job_id, m.total_score, m.label, m.knocked_out, m.limited_data FROM v_matches m
 LEFT JOIN v_profiles p ON p.user_id = m.user_id AND p.onboarded_at IS NOT NULL
 LEFT JOIN v_jobs j ON j.job_id = m.job_id AND j.status = 'published' AND j.is_golden
 WHERE p.user_id IS NULL OR j.job_id IS NULL""")
def _(t):
    return M.sync_matches(t("v_matches").select(*RESULT), full(t), matchable(t), onboarded(t))


@query("set_dropped", f"""SELECT m.user_id, m.job_id FROM v_matches m JOIN v_profiles p ON p.user_id = m.user_id AND p.onboarded_at IS NOT NULL
 JOIN v_jobs j ON j.job_id = m.job_id AND j.status = 'published' AND j.is_golden
 LEFT JOIN ({KEPT}) k ON k.user_id = m.user_id AND k.job_id = m.job_id WHERE k.user_id IS NULL""")
def _(t):
    scope = t("v_matches").select("user_id", "job_id").join(onboarded(t), "user_id", "left_semi")
    scope = scope.join(matchable(t).select("job_id"), "job_id", "left_semi")
    return scope.join(full(t).select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


@query("match_whatif", """SELECT user_id, job_id, active_score, draft_score, active_label, draft_label, knocked_out FROM (
 SELECT a.user_id, a.job_id, a.total_score AS active_score, b.total_score AS draft_score, a.label AS active_label, b.label AS draft_label,
 k.knocked_out FROM o_total a JOIN l_total b ON b.user_id = a.user_id AND b.job_id = a.job_id
 JOIN o_ko k ON k.user_id = a.user_id AND k.job_id = a.job_id) t""")
def _(t):
    f = M.with_components(pairs(t, hits=True))
    both = M.reweight(f, DEFAULT).withColumnRenamed("total_score", "active_score")
    both = M.reweight(both, SKILL_LED).withColumnRenamed("total_score", "draft_score")
    a, d = F.col("active_score"), F.col("draft_score")
    return both.select("user_id", "job_id", "active_score", "draft_score", M.match_label(a, DEFAULT).alias("active_label"),
                       M.match_label(d, SKILL_LED).alias("draft_label"),
                       F.exists(M.ko_all(), lambda k: k["status"] == "fail").alias("knocked_out"))


@query("topk_whatif", """SELECT user_id, job_id, total_score, rn AS rank FROM (SELECT t.user_id, t.job_id, t.total_score, row_number() OVER
 (PARTITION BY t.user_id ORDER BY k.knocked_out, t.total_score DESC, t.job_id) AS rn FROM l_total t JOIN o_ko k
 ON k.user_id = t.user_id AND k.job_id = t.job_id) r WHERE rn <= 12""")
def _(t):
    from pyspark.sql import Window

    s = scored(t, SKILL_LED).select("user_id", "job_id", "total_score", "knocked_out")
    w = Window.partitionBy("user_id").orderBy("knocked_out", F.desc("total_score"), "job_id")
    return s.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 12").drop("knocked_out")


# --- what a score was computed from ------------------------------------------------------

CANDIDATE_INPUTS = ("candidate_languages", "candidate_skills", "candidate_vectors")
POSTING_INPUTS = ("job_languages", "job_skills", "job_vectors")
KEYS = {"user_id": ("v_candidates", CANDIDATE_INPUTS), "job_id": ("v_jobs", POSTING_INPUTS)}


def digests(t, key: str, rows: DataFrame | None = None) -> DataFrame:
    """Digests of a side, or of some rows of it."""
    base, children = KEYS[key]

    def child(name):
        rows = t(f"v_{name}")
        if "vector" in rows.columns:  # six decimals are what a stored vector has
            rows = rows.withColumn("vector", F.array_join(F.transform("vector", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), " "))
        return rows

    return M.input_digest(t(base) if rows is None else rows, key, {name: child(name) for name in children})


def _text(columns) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS STRING), '')" for c in sorted(columns)) + ")"


def _digest_sql(key: str) -> str:
    """The digest of a side; columns are those of the views, in name order."""
    base, children = KEYS[key]
    vector = "array_to_string(list_transform(vector, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS STRING)), ' ')"
    columns = {
        "v_candidates": CANDIDATE_COLUMNS, "v_jobs": POSTING_COLUMNS, "candidate_languages": ("language", "level"),
        "candidate_skills": ("uri", "last_used_year"), "candidate_vectors": ("pos", "vector"), "job_languages": ("pos", "language", "level", "required"),
        "job_skills": ("uri", "pos", "importance"), "job_vectors": ("vector",),
    }
    joins, parts = "", ["b.t"]
    for name in sorted(children):
        rows = f"SELECT {key}, {_text(columns[name])} AS t FROM v_{name}"
        if "vector" in columns[name]:
            rows = f"SELECT {key}, {_text(columns[name])} AS t FROM (SELECT * REPLACE ({vector} AS vector) FROM v_{name}) x"
        joins += f" LEFT JOIN (SELECT {key}, string_agg(t, ',' ORDER BY t) AS t FROM ({rows}) r GROUP BY {key}) {name} ON {name}.{key} = b.{key}"
        parts.append(f"coalesce({name}.t, '')")
    return f"SELECT b.{key}, sha256(concat_ws('#', {', '.join(parts)})) AS digest FROM (SELECT {key}, {_text(columns[base])} AS t FROM {base}) b{joins}"


CANDIDATE_COLUMNS = (
    "seniority", "education_level", "desired_codes", "past_codes", "lat", "lng", "max_travel", "travel_mode", "remote_pref", "min_salary",
    "hours_min", "hours_max", "employment_csv", "sizes_csv", "types_csv", "r_r", "r_i", "r_a", "r_s", "r_e", "r_c", "values_csv",
)
POSTING_COLUMNS = (
    "title", "source_id", "external_id", "source_priority", "status", "is_golden", "needs_review", "company_id", "hiring_name", "city", "lat", "lng",
    "remote_policy", "salary_min", "salary_max", "hours_min", "hours_max", "employment_csv", "isco_code", "seniority", "min_eqf", "r_r", "r_i", "r_a",
    "r_s", "r_e", "r_c", "w_achievement", "w_independence", "w_recognition", "w_relationships", "w_support", "w_working_conditions", "language",
    "date_posted", "valid_through", "last_seen", "missed_runs", "dedup_group_id",
)


@query("hash_input", f"""SELECT p.user_id, p.job_id, sha256(concat_ws('|', c.digest, j.digest,
 coalesce(CAST(CAST(floor(similarity * 10000 + 0.5) AS BIGINT) AS STRING), ''), '{M.model_digest(DEFAULT)}', '{YEAR}')) AS input_hash
 FROM v_pairs p JOIN ({_digest_sql('user_id')}) c ON c.user_id = p.user_id JOIN ({_digest_sql('job_id')}) j ON j.job_id = p.job_id""")
def _(t):
    out = M.with_input_hash(t("v_pairs"), digests(t, "user_id"), digests(t, "job_id"), DEFAULT, 1, YEAR)
    return out.select("user_id", "job_id", "input_hash")


VERSIONS = """
SELECT c_custkey AS version, '{"weights":{"skills":' || CAST(30 + c_custkey % 8 AS STRING)
 || ',"experience":20,"occupation":15,"interests":10,"values":10,"practical":10},"knockouts":{"language":{"enabled":true,"toleranceLevels":'
 || CAST(c_custkey % 4 AS STRING) || '},"location":{"enabled":true,"graceMinutes":10,"hybridTravelFactor":1.25},"salary":{"enabled":true,"tolerancePct":'
 || CAST(c_custkey % 40 AS STRING) || '},"contract":{"enabled":true},"education":{"enabled":true}},"thresholds":{"strong":75,"good":'
 || CAST(40 + c_custkey % 40 AS STRING) || ',"possible":45},"skills":{"mustWeight":2,"niceWeight":1,"relatedCredit":0.5,"recency":[{"maxYears":2,"factor":1},{"maxYears":null,"factor":0.6}],"unknownRecencyFactor":0.85},"experience":{"similarityFloor":0.72,"similarityCeil":0.'
 || CAST(7 + c_custkey % 3 AS STRING) || '},"limitedDataThreshold":0.35}' AS config FROM customer
"""


@query("match_config", """SELECT c_custkey AS version, concat_ws(',',
 CASE WHEN c_custkey % 8 <> 5 THEN 'weights' END, CASE WHEN c_custkey % 4 > 2 THEN 'knockouts.language' END,
 CASE WHEN c_custkey % 40 > 30 THEN 'knockouts.salary' END,
 CASE WHEN NOT (40 + c_custkey % 40 < 75 AND 40 + c_custkey % 40 > 45) THEN 'thresholds' END,
 CASE WHEN c_custkey % 3 = 0 THEN 'experience' END) AS errors FROM customer""")
def _(t):
    return validate_versions(t.sql(VERSIONS, ("customer",))).select("version", F.array_join("errors", ",").alias("errors"))
