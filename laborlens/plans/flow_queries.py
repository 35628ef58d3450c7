"""Sources, mapping, assembly, CVs, ingest, duplicates and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N, text as X
from ..functions.embed import embed
from ..operators import assemble as A, cv as V, dedup as D, ingest as I
from ..session import new_folder
from ..sources import feeds as S, mapping as P, taxonomy_files as TX
from ..sources.sinks import archive_rows
from ..streaming import jobs as J
from .oracle import ORACLE_PARTS
from .registry import query
from .text_queries import sql_canonical, sql_company, sql_detected, sql_title

# --- feeds: raw JSON or XML made from the posting texts, then parsed and mapped -------------


def shared_folder(t) -> str:
    return new_folder(t.spark)


def landed(t, payload, head="", tail="") -> str:
    """The raw records of all postings as landed pages of about a hundred, one a line: the folder they are in."""
    page = F.floor(F.col("doc_id") / 100).alias("page")
    pages = t("v_postings").select(page, payload.alias("raw")).groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("raw")), ",").alias("raw"))
    folder = shared_folder(t)
    pages.select(F.concat(F.lit(head), "raw", F.lit(tail))).write.text(f"{folder}/pages")
    return f"{folder}/pages"


def numbered(df):
    return df.withColumn("doc_id", F.col("id").cast("bigint"))


def j(*cols):
    return F.to_json(F.struct(*cols))


def show(df, *extra):
    """The canonical columns that the SQL side can state."""
    s = F.col("salary")
    cols = {
        "title": F.col("title"), "company_name": F.col("company_name"), "city": F.col("city"), "country": F.col("country"),
        "remote_policy": F.col("remote_policy"), "types": F.array_join("employment_types", ","), "lo": s["min"], "hi": s["max"],
        "unit": s["unit"], "date_posted": F.col("date_posted").cast("string"), "apply_url": F.col("apply_url"),
        "description": F.col("description"),
    }
    return df.select("doc_id", "external_id", *[cols[e].alias(e) for e in extra])


@query("src_adzuna", """SELECT doc_id, CAST(doc_id AS STRING) AS external_id, title, company_name, coalesce(CASE WHEN doc_id % 2 = 0 THEN city END, 'Delft') AS city,
 CASE WHEN doc_id % 3 = 0 THEN 'full_time,contract' ELSE 'part_time' END AS types, CASE WHEN doc_id % 4 <> 0 THEN CAST(30000 + doc_id AS DOUBLE) END AS lo,
 CASE WHEN doc_id % 4 <> 0 THEN 'year' END AS unit, '2026-05-0' || CAST(doc_id % 9 + 1 AS STRING) AS date_posted FROM v_postings""")
def _(t):
    p, i = t("v_postings"), F.col("doc_id")
    raw = j(
        i.cast("string").alias("id"), F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), "description",
        F.concat(F.lit("2026-05-0"), (i % 9 + 1).cast("string"), F.lit("T08:00:00Z")).alias("created"), F.col("apply_url").alias("redirect_url"),
        F.struct(F.col("company_name").alias("display_name")).alias("company"),
        F.struct(F.lit("Delft, Zuid-Holland").alias("display_name"), F.when((i % 2 == 0) & F.col("city").isNotNull(), F.array(F.lit("NL"), F.lit("R"), F.col("city")))
                 .otherwise(F.array(F.lit("NL"), F.lit("R"))).alias("area")).alias("location"),
        F.when(i % 4 != 0, 30000 + i).otherwise(0).alias("salary_min"), F.lit("0").alias("salary_is_predicted"),
        F.when(i % 3 == 0, "full_time").otherwise("part_time").alias("contract_time"), F.when(i % 3 == 0, "contract").alias("contract_type"))
    files = S.read_adzuna(t.spark, landed(t, raw, '{"count":1,"results":[', "]}"), lines=True)
    out = S.map_adzuna(numbered(files), ["doc_id"])
    return show(out, "title", "company_name", "city", "types", "lo", "unit", "date_posted")


@query("src_greenhouse", """SELECT doc_id, CAST(doc_id AS STRING) AS external_id, title, coalesce(company_name, 'Acme') AS company_name, 'Utrecht' AS city,
 CASE WHEN doc_id % 3 = 0 THEN 'remote' WHEN doc_id % 3 = 1 THEN 'hybrid' END AS remote_policy, CASE WHEN doc_id % 2 = 0 THEN 'full_time' ELSE 'internship' END AS types,
 'Role ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || '• a & b' AS description FROM v_postings""")
def _(t):
    p, i = t("v_postings"), F.col("doc_id")

    def m(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    content = F.concat(F.lit("&lt;p&gt;Role "), i.cast("string"), F.lit("&lt;/p&gt;&lt;ul&gt;&lt;li&gt;a &amp;amp; b&lt;/li&gt;&lt;/ul&gt;"))
    raw = j(
        i.cast("string").alias("id"), F.concat(F.lit(" "), "title").alias("title"), F.lit("2026-05-01").alias("updated_at"), F.col("company_name"),
        F.struct(F.lit("Utrecht / NL").alias("name")).alias("location"),
        F.array(m("Workplace Type", F.when(i % 3 == 0, "Remote").when(i % 3 == 1, "Hybrid").otherwise("-")),
                m("Employment Type", F.when(i % 2 == 0, "Full-time").otherwise("Internship"))).alias("metadata"),
        content.alias("content"))
    files = S.read_greenhouse(t.spark, landed(t, raw, '{"jobs":[', "]}"), lines=True)
    out = S.map_greenhouse(numbered(files), "Acme", ["doc_id"])
    return show(out, "title", "company_name", "city", "remote_policy", "types", "description")


@query("src_lever", """SELECT doc_id, CAST(doc_id AS STRING) AS external_id, title, 'Acme' AS company_name, coalesce(city, 'Delft') AS city,
 CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' END AS remote_policy, 'plain ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || 'You' || chr(10) || '• code' || chr(10) || chr(10) || 'bye' AS description,
 CASE WHEN doc_id % 2 = 0 THEN CAST(4000 AS DOUBLE) END AS lo, CASE WHEN doc_id % 2 = 0 THEN 'month' END AS unit, '2026-05-01' AS date_posted FROM v_postings""")
def _(t):
    p, i = t("v_postings"), F.col("doc_id")
    raw = j(
        i.cast("string").alias("id"), F.col("title").alias("text"), F.lit(1777593600000).alias("createdAt"), F.col("apply_url").alias("hostedUrl"),
        F.when(i % 3 == 0, "remote").when(i % 3 == 1, "onsite").otherwise("unspecified").alias("workplaceType"),
        F.struct(F.concat(F.coalesce("city", F.lit("Delft")), F.lit(", NL")).alias("location"), F.lit("Full-time").alias("commitment")).alias("categories"),
        F.concat(F.lit("plain "), i.cast("string")).alias("descriptionPlain"), F.lit("bye").alias("additionalPlain"),
        F.array(F.struct(F.lit("You").alias("text"), F.lit("<ul><li>code</li></ul>").alias("content"))).alias("lists"),
        F.when(i % 2 == 0, F.struct(F.lit(4000).alias("min"), F.lit("per-month-salary").alias("interval"))).alias("salaryRange"))
    files = S.read_lever(t.spark, landed(t, raw, "[", "]"), lines=True)
    out = S.map_lever(numbered(files), "Acme", ["doc_id"])
    return show(out, "title", "company_name", "city", "remote_policy", "description", "lo", "unit", "date_posted")


@query("src_recruitee", """SELECT doc_id, CAST(doc_id AS STRING) AS external_id, title, company_name, city, 'NL' AS country,
 CASE WHEN doc_id % 4 = 0 THEN 'hybrid' WHEN doc_id % 2 = 0 THEN 'remote' ELSE 'onsite' END AS remote_policy, 'part_time' AS types,
 CASE WHEN doc_id % 3 = 0 THEN CAST(20 AS DOUBLE) END AS lo, CASE WHEN doc_id % 3 = 0 THEN 'hour' END AS unit FROM v_postings WHERE doc_id % 5 <> 1""")
def _(t):
    p, i = t("v_postings"), F.col("doc_id")
    raw = j(
        i.cast("string").alias("id"), "title", "description", F.lit("<p>x</p>").alias("requirements"), "city", F.lit("nl").alias("country_code"),
        (i % 4 == 0).alias("hybrid"), (i % 2 == 0).alias("remote"), F.lit(True).alias("on_site"), F.lit("part_time").alias("employment_type_code"),
        F.when(i % 3 == 0, F.struct(F.lit("20").alias("min"), F.lit("hour").alias("period"))).alias("salary"),
        "company_name", F.when(i % 5 == 1, "closed").when(i % 5 != 2, "published").alias("status"))
    files = S.read_recruitee(t.spark, landed(t, raw, '{"offers":[', "]}"), lines=True)
    out = S.map_recruitee(numbered(files), ["doc_id"])
    return show(out, "title", "company_name", "city", "country", "remote_policy", "types", "lo", "unit")


@query("src_personio", """SELECT doc_id, CAST(doc_id AS STRING) AS external_id, 'Job ' || CAST(doc_id AS STRING) AS title, 'acme' AS company_name, 'Breda' AS city,
 CASE WHEN doc_id % 2 = 0 THEN 'full_time,internship' ELSE 'full_time' END AS types, 'You' || chr(10) || 'do things' AS description,
 'https://acme.jobs.personio.de/job/' || CAST(doc_id AS STRING) AS apply_url FROM v_postings""")
def _(t):
    i = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit("<position><id>"), i, F.lit("</id><office>Breda</office><name>Job "), i, F.lit("</name><jobDescriptions><jobDescription><name>You</name>"
        "<value><![CDATA[<p>do things</p>]]></value></jobDescription></jobDescriptions><employmentType>"),
        F.when(F.col("doc_id") % 2 == 0, "intern").otherwise("permanent"), F.lit("</employmentType><schedule>full-time</schedule></position>"))
    folder = shared_folder(t)  # a file is one document, of a thousand positions
    feed = t("v_postings").groupBy(F.floor(F.col("doc_id") / 1000).alias("page")).agg(F.concat(
        F.lit("<workzag-jobs>"), F.array_join(F.collect_list(xml), ""), F.lit("</workzag-jobs>")).alias("value"))
    feed.repartition("page").write.partitionBy("page").text(f"{folder}/positions")
    raw = numbered(S.read_personio(t.spark, f"{folder}/positions"))
    return show(S.map_personio(raw, "acme", keep=["doc_id"]), "title", "company_name", "city", "types", "description", "apply_url")


SINCE = "2026-07-01"
AGE = "DATE '2026-07-01' + CAST(doc_id % 21 - 10 AS INT)"


@query("flt_since", f"""SELECT 'greenhouse' AS source, doc_id FROM v_postings WHERE doc_id % 6 <> 5 AND doc_id % 21 >= 10
 UNION ALL SELECT 'lever', doc_id FROM v_postings WHERE doc_id % 21 >= 10 UNION ALL SELECT 'adzuna', doc_id FROM v_postings WHERE doc_id % 6 <> 5 AND doc_id % 21 >= 10
 UNION ALL SELECT 'recruitee', doc_id FROM v_postings WHERE doc_id % 6 = 5 OR doc_id % 21 >= 10 UNION ALL SELECT 'personio', doc_id FROM v_postings WHERE doc_id % 6 = 5 OR doc_id % 21 >= 10""")
def _(t):
    i, since = F.col("doc_id"), F.lit(SINCE).cast("timestamp")
    p = t("v_postings").select("doc_id", F.expr(f"CAST({AGE} AS TIMESTAMP)").alias("at"))
    day = F.when(i % 6 != 5, F.date_format("at", "yyyy-MM-dd"))
    none = F.lit(None).cast("string")
    feeds = {
        "greenhouse": p.select("doc_id", day.alias("updated_at")), "lever": p.select("doc_id", F.unix_millis("at").alias("createdAt")),
        "adzuna": p.select("doc_id", day.alias("created")), "personio": p.select("doc_id", F.coalesce(day, F.lit("")).alias("createdAt")),
        "recruitee": p.select("doc_id", F.when(i % 2 == 0, day).alias("updated_at"), none.alias("published_at"), day.alias("created_at")),
    }
    now = since + F.expr("INTERVAL 20 DAYS")
    out = None
    for source, raw in feeds.items():
        rows = S.changed_since(raw, source, since, now).select(F.lit(source).alias("source"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


MAPPING = {
    "externalId": {"path": "$.ref"}, "title": {"path": "$.functie", "transform": "trim"}, "description": {"path": "$.tekst", "transform": "html_to_text"},
    "companyName": {"path": "$.bedrijf", "default": "Unknown"}, "city": {"template": "{{$.plaats}}"}, "applyUrl": {"path": "$.link"},
    "country": {"path": "$.land", "default": "nl"}, "employmentTypes": {"path": "$.soort", "transform": "split_comma"},
    "salaryText": {"path": "$.salaris", "transform": "salary_text"}, "hoursMin": {"path": "$.uren", "transform": "number"},
    "companyDomain": {"path": "$.link", "transform": "domain"}, "datePosted": {"path": "$.datum", "transform": "date"},
    "remotePolicy": {"path": "$.tekst", "transform": "remote_text"},
}


def items(t):
    p, i = t("v_postings"), F.col("doc_id")
    body = j(
        F.when(i % 7 != 0, i.cast("string")).alias("ref"), F.concat(F.lit("  "), "title").alias("functie"),
        F.concat(F.lit("<p>werk "), F.when(i % 2 == 0, "remote").otherwise("op locatie"), F.lit("</p>")).alias("tekst"), F.col("company_name").alias("bedrijf"),
        F.col("city").alias("plaats"), F.col("apply_url").alias("link"), F.lit("full_time, zzp; stage").alias("soort"), F.col("salary_text").alias("salaris"),
        F.concat((i % 40).cast("string"), F.lit(",5 uur")).alias("uren"), F.lit("2026-05-01").alias("datum"))
    return p.select("doc_id", F.try_parse_json(body).alias("item"))


@query("src_generic_feed", """SELECT doc_id, CAST(doc_id AS STRING) AS external_id, title, coalesce(company_name, 'Unknown') AS company_name, city, 'NL' AS country,
 CASE WHEN doc_id % 2 = 0 THEN 'remote' ELSE 'onsite' END AS remote_policy, 'full_time,freelance,internship' AS types, '2026-05-01' AS date_posted, apply_url
 FROM v_postings WHERE doc_id % 7 <> 0""")
def _(t):
    good = P.accepted(P.map_items(items(t), "item", MAPPING))
    return show(good, "title", "company_name", "city", "country", "remote_policy", "types", "date_posted", "apply_url")


@query("map_rule", """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS STRING) END AS ref, coalesce(company_name, 'Unknown') AS company,
 CASE WHEN city IS NULL AND doc_id % 7 = 0 THEN NULL ELSE coalesce(city, '') || coalesce(CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id AS STRING) END, '') END AS filled FROM v_postings""")
def _(t):
    v = F.col("item")
    return items(t).select("doc_id", P.rule_value(v, {"path": "$.ref"}).alias("ref"), P.rule_value(v, MAPPING["companyName"]).alias("company"),
                           P.rule_value(v, {"template": "{{$.plaats}}{{$.ref}}"}).alias("filled"))


@query("map_transform", """SELECT doc_id, lower(title) AS low, CAST(doc_id % 40 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS num, 'full_time|zzp|stage' AS list,
 CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 3 THEN 'boards.greenhouse.io' ELSE 'jobs.example.com' END AS domain, CASE WHEN city IS NOT NULL THEN CAST(0 AS DOUBLE) END AS no_digits FROM v_postings""")
def _(t):
    v = F.col("item")

    def r(path, transform):
        return P.rule_value(v, {"path": path, "transform": transform})

    domain = F.regexp_replace(r("$.link", "domain"), r"^www\.", "")
    return items(t).select("doc_id", r("$.functie", "lowercase").alias("low"), r("$.uren", "number").alias("num"),
                           F.array_join(r("$.soort", "split_comma"), "|").alias("list"), domain.alias("domain"), r("$.plaats", "number").alias("no_digits"))


@query("map_record", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'externalId: required field is empty' ELSE '' END AS errors FROM v_postings""")
def _(t):
    return P.map_items(items(t), "item", MAPPING).select("doc_id", F.array_join("errors", ",").alias("errors"))


def taxonomy_doc(t):
    s = t("v_skills").select(
        F.col("uri").cast("string").alias("uri"), F.col("label_en").alias("preferredLabelEn"), F.col("label_nl").alias("preferredLabelNl"),
        F.split("alts_csv", r"\|").alias("altLabels"), F.when(F.col("uri") % 2 == 0, "knowledge").alias("skillType"))
    o = F.array(F.struct(F.col("uri"), F.when(F.col("uri").cast("bigint") % 2 == 0, "2511").otherwise("25").alias("iscoCode"), F.col("preferredLabelEn")))
    return s.select(F.array(F.struct("uri", "preferredLabelEn", "preferredLabelNl", "altLabels", "skillType")).alias("skills"), o.alias("occupations"))


@query("src_taxonomy_json", """SELECT CAST(uri AS STRING) AS uri, label_en, label_nl, CASE WHEN uri % 2 = 0 THEN 'knowledge' ELSE 'skill/competence' END AS skill_type,
 CASE WHEN alts_csv IS NULL THEN 0 ELSE len(split(alts_csv, '|')) END AS alts, CASE WHEN uri % 2 = 0 THEN '2511' END AS isco_code FROM v_skills""")
def _(t):
    ddl = f"skills array<struct<{TX.SKILL}>>, occupations array<struct<{TX.OCCUPATION}>>"
    doc = taxonomy_doc(t).select(F.from_json(F.to_json(F.struct("skills", "occupations")), ddl).alias("d")).select("d.*")
    skills, jobs = TX.taxonomy_tables(doc)
    return skills.join(jobs.select("uri", "isco_code"), "uri", "left").select(
        "uri", "label_en", "label_nl", "skill_type", F.size("alt_labels").cast("bigint").alias("alts"), "isco_code")


@query("src_taxonomy_csv", """SELECT CAST(s.uri AS STRING) AS uri, label_en, label_nl, array_to_string(list_filter(split(coalesce(alts_csv, ''), '|'), lambda x: x <> ''), ',') AS alts,
 (SELECT string_agg(CAST(b.broader_uri AS STRING), ',' ORDER BY CAST(b.broader_uri AS STRING)) FROM v_skill_broader b WHERE b.uri = s.uri) AS broader FROM v_skills s""")
def _(t):
    s = t("v_skills")
    uri = F.col("uri").cast("string").alias("conceptUri")
    en = s.select(uri, F.col("label_en").alias("preferredLabel"), F.regexp_replace("alts_csv", r"\|", "\n").alias("altLabels"), F.lit("knowledge").alias("skillType"))
    nl = s.filter(F.col("label_nl").isNotNull()).select(uri, F.col("label_nl").alias("preferredLabel"))
    up = t("v_skill_broader").select(uri, F.col("broader_uri").cast("string").alias("broaderUri"))
    out = TX.skills_from_rows(en, nl, up)
    return out.select("uri", "label_en", "label_nl", F.array_join("alt_labels", ",").alias("alts"), F.array_join("broader_uris", ",").alias("broader"))


RAW_ROWS = """SELECT source_id, external_id, '{"title":"' || title || '","v":' || CAST(doc_id % 2 AS STRING) || '}' AS payload FROM v_postings
 UNION ALL SELECT source_id, external_id, '{"title":"' || title || '","v":0}' AS payload FROM v_postings"""


@query("sink_raw_archive", f"""SELECT DISTINCT source_id, external_id, sha256(payload) AS payload_hash FROM ({RAW_ROWS}) r WHERE NOT EXISTS
 (SELECT 1 FROM v_postings p WHERE p.status = 'published' AND p.source_id = r.source_id AND p.external_id = r.external_id AND r.payload LIKE '%"v":0}}')""")
def _(t):
    stored = archive_rows(t.sql("""SELECT source_id, external_id, '{"title":"' || title || '","v":0}' AS payload FROM v_postings WHERE status = 'published'"""))
    return archive_rows(t.sql(RAW_ROWS), stored).select("source_id", "external_id", "payload_hash")


# --- assembly -------------------------------------------------------------------------------

STORED_PROFILES = """SELECT c_custkey AS user_id, c_name AS name, 'secret' AS birth_date, CASE WHEN c_custkey % 3 = 0 THEN 'senior' END AS seniority,
 CAST(c_custkey % 8 + 1 AS INT) AS education_level,
 '{"remote":"' || CASE WHEN c_custkey % 5 = 0 THEN 'sometimes' ELSE 'hybrid' END || '","minSalaryMonth":' || CASE WHEN c_custkey % 7 = 0 THEN '90000' ELSE '3000' END
  || ',"maxTravelMinutes":' || CASE WHEN c_custkey % 11 = 0 THEN '"30"' ELSE '30' END || ',"gender":"x"}' AS preferences,
 CASE WHEN c_custkey % 2 = 0 THEN '{"R":0.1,"I":0.2,"A":0.3,"S":0.4,"E":0.5,"C":0.6}' ELSE '{"R":0.1}' END AS riasec,
 CASE c_custkey % 3 WHEN 0 THEN '["achievement","independence","recognition","relationships","support","working_conditions"]'
  WHEN 1 THEN '["achievement","achievement","achievement","achievement","support","support"]' ELSE '["achievement","fame"]' END AS work_values FROM customer"""
EXPERIENCES = """SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(2500 + o_orderkey % 7 AS STRING) END AS isco_code FROM orders"""
PREF_OK = "c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0"


@query("parse_prefs", f"SELECT c_custkey AS user_id, CASE WHEN {PREF_OK} THEN 'hybrid' END AS remote, CASE WHEN {PREF_OK} THEN CAST(3000 AS DOUBLE) END AS min_salary FROM customer")
def _(t):
    p = t.sql(STORED_PROFILES).select("user_id", A.preferences(F.col("preferences")).alias("p"))
    return p.select("user_id", F.col("p.remote").alias("remote"), F.col("p.minSalaryMonth").alias("min_salary"))


@query("parse_profiles", """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(0.4 AS DOUBLE) END AS s, CASE WHEN c_custkey % 3 < 2 THEN 6 END AS ranked FROM customer""")
def _(t):
    p = t.sql(STORED_PROFILES)
    r = A.value_ranking(F.col("work_values"))
    return p.select("user_id", A.riasec(F.col("riasec"))["S"].alias("s"), F.when(r.isNotNull(), F.size(r)).cast("bigint").alias("ranked"))


JOB_JSON = """SELECT s_suppkey AS job_id, '[{"uri":"a' || CAST(s_suppkey AS STRING) || '","importance":"must"},{"uri":5,"importance":"must"},{"uri":"b","importance":"maybe"},{"uri":"c","importance":"nice","label":"C"}]' AS skills_json,
 '[{"language":"nl","level":"B2","required":true},{"language":"en","level":"Z9","required":true},{"language":"de","level":"A1"}]' AS languages_json FROM supplier"""


@query("parse_each", "SELECT s_suppkey AS job_id, 'a' || CAST(s_suppkey AS STRING) || ',c' AS uris, 'nl' AS languages FROM supplier")
def _(t):
    r = t.sql(JOB_JSON)
    uris = F.transform(A.posting_skills(F.col("skills_json")), lambda s: s["uri"])
    langs = F.transform(A.language_demands(F.col("languages_json")), lambda s: s["language"])
    return r.select("job_id", F.array_join(uris, ",").alias("uris"), F.array_join(langs, ",").alias("languages"))


@query("project_allowlist", """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'senior' END AS seniority, CAST(c_custkey % 8 + 1 AS INT) AS education_level, FALSE AS leaks FROM customer""")
def _(t):
    safe = A.allow(t.sql(STORED_PROFILES))
    nested = F.to_json(A.allow_json(F.col("preferences"), A.PREFERENCES))
    leak = F.lit(any(c in safe.columns for c in ("name", "birth_date"))) | nested.contains("gender")
    return safe.select("user_id", "seniority", "education_level", leak.alias("leaks"))


def stored_candidates(t):
    skills = t("v_candidate_skills").select("user_id", F.when(F.col("uri") % 9 != 0, F.col("uri")).alias("uri"), F.col("uri").alias("pos"), F.col("uri").cast("string").alias("label"), "last_used_year")
    langs = t("v_candidate_languages").withColumn("level", F.when(F.col("user_id") % 4 == 1, "native").otherwise(F.col("level")))
    return A.candidate_rows(t.sql(STORED_PROFILES), skills, t.sql(EXPERIENCES), langs)


CANDIDATES = """SELECT p.c_custkey AS user_id, coalesce(s.n, 0) AS skills, coalesce(e.codes, '') AS codes, coalesce(l.n, 0) AS languages, {extra} FROM customer p
 LEFT JOIN (SELECT user_id, count(*) AS n FROM v_candidate_skills WHERE uri % 9 <> 0 GROUP BY 1) s ON s.user_id = p.c_custkey
 LEFT JOIN (SELECT user_id, string_agg(DISTINCT isco_code, ',' ORDER BY isco_code) AS codes FROM ({exp}) x WHERE isco_code IS NOT NULL GROUP BY 1) e ON e.user_id = p.c_custkey
 LEFT JOIN (SELECT user_id, count(*) AS n FROM v_candidate_languages WHERE user_id % 4 <> 1 GROUP BY 1) l ON l.user_id = p.c_custkey"""


def sizes(c):
    return [F.coalesce(F.size("skills"), F.lit(0)).cast("bigint").alias("skills"), F.coalesce(F.array_join("experience_codes", ","), F.lit("")).alias("codes"),
            F.coalesce(F.size("languages"), F.lit(0)).cast("bigint").alias("languages")]


@query("assemble_candidate", CANDIDATES.format(exp=EXPERIENCES, extra=f"{PREF_OK} AS has_preferences, c_custkey % 2 = 0 AS has_riasec"))
def _(t):
    c = stored_candidates(t)
    return c.select("user_id", *sizes(c), F.col("preferences").isNotNull().alias("has_preferences"), F.col("riasec").isNotNull().alias("has_riasec"))


@query("scan_candidate", CANDIDATES.format(exp=EXPERIENCES, extra="CAST(coalesce(m.best, -1) AS BIGINT) AS last_year")
       + " LEFT JOIN (SELECT user_id, max(last_used_year) AS best FROM v_candidate_skills WHERE uri % 9 <> 0 GROUP BY 1) m ON m.user_id = p.c_custkey")
def _(t):
    c = stored_candidates(t)
    newest = F.array_max(F.transform("skills", lambda s: s["last_used_year"]))
    return c.select("user_id", *sizes(c), F.coalesce(newest, F.lit(-1)).cast("bigint").alias("last_year"))


@query("assemble_job", """SELECT s.s_suppkey AS job_id, k.name AS company, CAST(0.3 AS DOUBLE) AS a, CASE WHEN s_suppkey % 2 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS support,
 CASE WHEN s_suppkey % 10 BETWEEN 1 AND 8 THEN s_suppkey % 10 END AS min_eqf, 2 AS skills FROM supplier s LEFT JOIN v_companies k ON k.company_id = s.s_suppkey""")
def _(t):
    k = F.col("job_id")
    wv = '{"achievement":0.1,"independence":0.1,"recognition":0.1,"relationships":0.1,"support":%s,"working_conditions":0.1}'
    jobs = t.sql(JOB_JSON).withColumns({
        "company_id": k, "title": F.lit("x"), "occupation_uri": F.concat(F.lit("o"), (k % 25).cast("string")), "work_values": F.when(k % 2 == 0, wv % "0.9").otherwise('{"support":1}'),
        "education_requirement": F.concat(F.lit('{"min_eqf":'), (k % 10).cast("string"), F.lit("}"))})
    occ = t("nation").select(F.concat(F.lit("o"), F.col("n_nationkey").cast("string")).alias("occupation_uri"), F.lit('{"R":0.1,"I":0.2,"A":0.3,"S":0.4,"E":0.5,"C":0.6}').alias("riasec"), F.lit(wv % "0.1").alias("work_values"))
    out = A.posting_rows(jobs, t("v_companies"), occ)
    return out.select("job_id", F.col("company.name").alias("company"), F.col("riasec.A").alias("a"), F.col("work_values.support").alias("support"),
                      F.col("min_eqf").cast("bigint").alias("min_eqf"), F.size("skills").cast("bigint").alias("skills"))


# --- CVs --------------------------------------------------------------------------------------


def cv_texts(t):
    """The texts, dealt to all cores: they are made of a narrow table, which may lie in a single split."""
    return t.sql("SELECT * FROM v_cvs", spread_out=("customer",))


def cvs(t):
    return cv_texts(t).withColumn("blocks", V.cv_blocks(F.col("text"), 2026))


@query("cv_blocks", """SELECT c_custkey AS doc_id, 0 AS k, 'Data Engineer' AS title, 'Acme' AS org, CAST(2000 + c_custkey % 10 AS INT) AS start,
 CAST(2001 + c_custkey % 10 + c_custkey % 7 AS INT) AS end, FALSE AS is_current, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 5 END AS lines FROM customer
 UNION ALL SELECT c_custkey, 1, 'Senior Tester', 'Noord', 2016, 2026, TRUE, 4 FROM customer WHERE c_custkey % 2 = 0""")
def _(t):
    b = V.block_rows(cvs(t), "doc_id")
    return b.select("doc_id", "k", "title", "org", "start", "end", "is_current", F.size("body").alias("lines"))


def cv_entries(t):
    """The whole skills dictionary, and three words of the texts."""
    words = t.spark.createDataFrame([("python",), ("airflow",), ("sql",)], "label string")
    words = words.unionByName(t("v_skills").select(F.col("label_en").alias("label")))
    return words.select(F.concat(F.lit("s:"), "label").alias("uri"), "label", F.lower("label").alias("norm"), F.lit(0).alias("entry"))


RECENT = """SELECT c_custkey AS doc_id, w AS uri, CASE WHEN w = 's:sql' AND c_custkey % 2 = 0 THEN 2026 ELSE 2001 + c_custkey % 10 + c_custkey % 7 END AS last_used_year,
 CASE WHEN w = 's:sql' AND c_custkey % 2 = 0 THEN 'Senior Tester' ELSE 'Data Engineer' END AS evidence FROM customer, (VALUES ('s:python'), ('s:airflow'), ('s:sql')) v(w)"""


@query("cv_skill_recency", RECENT)
def _(t):
    return V.skill_recency(cvs(t), cv_entries(t)).select("doc_id", "uri", "last_used_year", "evidence")


@query("cv_seniority", """SELECT c_custkey AS doc_id, CASE WHEN 1 + c_custkey % 7 + CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 0 END >= 6 THEN 'senior'
 WHEN 1 + c_custkey % 7 >= 2 THEN 'medior' ELSE 'junior' END AS seniority FROM customer""")
def _(t):
    return cvs(t).select("doc_id", V.cv_seniority(F.col("blocks")).alias("seniority"))


@query("cv_education", "SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 8 WHEN 1 THEN 7 WHEN 2 THEN 6 WHEN 3 THEN 4 END AS eqf FROM customer")
def _(t):
    return cv_texts(t).select("doc_id", V.education_level(F.col("text")).alias("eqf"))


@query("cv_sections", """SELECT c_custkey AS doc_id, 'Dutch native, English (fluent)' || chr(10) || 'German B1' AS languages, 'Data person number ' || CAST(c_custkey AS STRING) AS summary FROM customer""")
def _(t):
    return cv_texts(t).select("doc_id", V.section(F.col("text"), V.LANGUAGE_HEADING).alias("languages"), V.summary(F.col("text")).alias("summary"))


@query("cv_ground", """SELECT c_custkey AS doc_id, 3 AS skills, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS experiences, '2511' AS isco,
 'de B1,en C1,nl C2' AS languages FROM customer""")
def _(t):
    name = F.when(F.col("r_regionkey") == 0, "data engineer").otherwise(F.lower("r_name"))
    occ = t("region").select(F.concat(F.lit("o:"), name).alias("uri"), name.alias("label"), name.alias("norm"), F.lit(0).alias("entry"),
                             (F.col("r_regionkey") + 2511).cast("string").alias("isco_code"))
    skills, exp, langs = V.ground_cv(cvs(t), cv_entries(t), occ)
    s = skills.groupBy("doc_id").agg(F.count("*").alias("skills"))
    e = exp.groupBy("doc_id").agg(F.count("*").alias("experiences"), F.max("isco_code").alias("isco"))
    lang = langs.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "language", "level"))), ",").alias("languages"))
    return s.hint("merge").join(e, "doc_id").join(lang.hint("merge"), "doc_id")


@query("embed_candidates")
def _(t):
    """A vector for every profile, where ``pos`` is null, and one for each experience."""
    skills = t("v_candidate_skills").join(t("v_skills").select("uri", F.col("label_en").alias("label")), "uri")
    lived = t.sql("SELECT user_id, pos, title, description FROM v_experiences", spread_out=("orders",))
    texts = V.candidate_texts(t("v_candidate_profiles"), lived, skills)
    return texts.select("user_id", "pos", embed(F.col("text")).alias("embedding"))


# --- ingest -----------------------------------------------------------------------------------


@query("join_geocode", """SELECT p.job_id, CASE WHEN p.job_id % 2 = 0 AND p.lat IS NOT NULL THEN p.lat ELSE c.lat END AS lat,
 CASE WHEN p.job_id % 2 = 0 AND p.lat IS NOT NULL THEN 'own' ELSE coalesce(c.province, 'own') END AS region FROM v_jobs p
 LEFT JOIN v_cities c ON c.norm = lower(replace(p.city, '_', ' '))""")
def _(t):
    own = F.col("job_id") % 2 == 0
    jobs = t("v_jobs").withColumns({"lat": F.when(own, F.col("lat")), "lng": F.when(own, F.col("lng")), "region": F.lit("own")})
    return I.geocode(jobs, t("v_cities")).select("job_id", "lat", "region")


ORACLE_PARTS["d_named"] = f"""
SELECT p.doc_id, p.company_name, p.norm, u.dom, n.id
FROM (SELECT *, {sql_company('company_name')} AS norm FROM v_postings) p
JOIN (SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 'example.com' END AS dom FROM v_postings) u ON u.doc_id = p.doc_id
LEFT JOIN (SELECT {sql_company('name')} AS norm, min(id) AS id FROM (SELECT 7 AS id, 'Canal Analytics' AS name UNION ALL SELECT 8, 'Noord Software' UNION ALL SELECT company_id, name FROM v_companies) k GROUP BY 1) n ON n.norm = p.norm
"""
ORACLE_PARTS["d_company"] = """
SELECT p.doc_id, CASE WHEN p.id IS NOT NULL THEN CAST(p.id AS STRING) WHEN p.norm IS NOT NULL THEN 'new:' || coalesce(m.main, p.norm)
  WHEN p.dom IS NOT NULL THEN 'new:' || p.dom END AS company_key
FROM d_named p LEFT JOIN (SELECT norm, min(dom) AS main FROM d_named WHERE id IS NULL GROUP BY norm) m ON m.norm = p.norm
"""


def known_companies(t):
    """All companies of the table, and two that the postings name."""
    two = t.spark.createDataFrame([(7, "Canal Analytics", None), (8, "Noord Software", None)], "company_id long, name string, domain string")
    return two.unionByName(t("v_companies").select("company_id", "name", "domain"))


@query("join_company_resolve", "SELECT doc_id, company_key FROM d_company")
def _(t):
    posts, _new, _fills = D.resolve_companies(t("v_postings"), known_companies(t))
    return posts.select("doc_id", "company_key")


@query("dedup_company", "SELECT company_key, count(*) AS postings FROM d_company WHERE company_key IS NOT NULL GROUP BY 1")
def _(t):
    posts, _new, _fills = D.resolve_companies(t("v_postings"), known_companies(t))
    return posts.filter(F.col("company_key").isNotNull()).groupBy("company_key").agg(F.count("*").alias("postings"))


INCOMING = "SELECT doc_id, source_id, external_id, title, company_name, city, apply_url FROM v_postings"
# postings without a city are new, every third of the rest has a changed title
STORED = """SELECT doc_id AS job_id, source_id, external_id, CASE WHEN doc_id % 3 = 0 THEN title || ' old' ELSE title END AS title, company_name, city, apply_url, status,
 doc_id % 5 <> 0 AS is_golden FROM v_postings WHERE city IS NOT NULL"""


def joined(t):
    return I.match_stored(I.content_hash(t.sql(INCOMING)), I.content_hash(t.sql(STORED)))


@query("join_existing", """SELECT doc_id, CASE WHEN city IS NOT NULL THEN doc_id END AS old_id, CASE WHEN city IS NOT NULL THEN status END AS old_status FROM v_postings""")
def _(t):
    return joined(t).select("doc_id", "old_id", "old_status")


@query("ing_outcome", f"""WITH k AS (SELECT doc_id, {sql_title('title')} || '|' || {sql_company("coalesce(company_name, '')")} || '|' || lower(coalesce(city, '')) AS key FROM v_postings),
 d AS (SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY key) AS dup FROM k)
 SELECT p.doc_id, CASE WHEN p.city IS NOT NULL AND p.doc_id % 3 <> 0 THEN CASE WHEN p.doc_id % 5 <> 0 THEN 'unchanged' ELSE 'duplicate' END
 WHEN dup THEN 'duplicate' WHEN p.city IS NOT NULL THEN 'updated' ELSE 'new' END AS outcome FROM v_postings p JOIN d ON d.doc_id = p.doc_id""")
def _(t):
    keyed = t("v_postings").select("doc_id", X.dedup_key(F.col("title"), F.col("company_name"), F.col("city")).alias("key"))
    dup = D.same_key_edges(keyed, "key", "doc_id").select(F.col("src").alias("doc_id"), F.lit(True).alias("_dup"))
    return joined(t).join(dup, "doc_id", "left").select("doc_id", I.outcome(F.coalesce("_dup", F.lit(False))).alias("outcome"))


@query("ing_sticky", """SELECT doc_id, CASE WHEN city IS NULL THEN 'pending_review' WHEN doc_id % 3 <> 0 AND status = 'expired' THEN 'published' WHEN doc_id % 3 <> 0 THEN status
 WHEN status IN ('rejected', 'archived') THEN status ELSE 'pending_review' END AS status FROM v_postings""")
def _(t):
    return joined(t).select("doc_id", I.sticky_status(F.lit("pending_review")).alias("status"))


@query("ing_review", """SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 10 < 6 THEN 'low_confidence' END, CASE WHEN o_orderkey % 4 = 0 THEN 'no_skills' END,
 CASE WHEN o_orderkey % 3 = 0 THEN 'no_occupation' END, CASE WHEN o_orderkey % 6 > 3 THEN 'unmapped_skills' END) AS reasons,
 CASE WHEN o_orderkey % 10 < 6 OR o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'pending_review' ELSE 'published' END AS status FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    r = I.review_reasons((k % 10).cast("double") / 10.0, (k % 4).cast("int"), F.when(k % 3 != 0, "2511"), (k % 6).cast("int"))
    return t("orders").select(k.alias("id"), r.alias("r")).select("id", F.array_join("r", ",").alias("reasons"), I.routed_status(F.col("r")).alias("status"))


def canonical_rows(t):
    p, i = t("v_postings"), F.col("doc_id")
    none = F.lit(None)
    return p.select(
        "doc_id", "source_id", "external_id", "title", "description", "company_name", "apply_url", "city",
        F.when(i % 3 == 0, "onsite").alias("remote_policy"), F.when(i % 2 == 0, F.array(F.lit("contract"))).otherwise(F.array().cast("array<string>")).alias("employment_types"),
        F.when(i % 4 == 0, 20.0).alias("hours_min"), none.cast("double").alias("hours_max"), none.cast("double").alias("lat"), none.cast("double").alias("lng"),
        none.cast("string").alias("region"), none.cast("string").alias("country"), F.when(i % 3 == 0, "fy").alias("language"),
        F.when(i % 4 != 1, F.lit("2026-03-04").cast("date")).alias("date_posted"),
        F.struct(none.cast("double").alias("min"), none.cast("double").alias("max"), none.cast("string").alias("unit"), F.lit("EUR").alias("currency"), F.col("salary_text").alias("text")).alias("salary"))


# labels that no concept answers to: as many as the number leaves over six; and one that the dictionary has
FREE_LABELS = """SELECT doc_id, CAST(n AS INT) AS pos, 'zqx' || CAST(n AS STRING) AS label, 'nice' AS importance FROM v_postings JOIN (SELECT n_nationkey AS n FROM nation) k
 ON n >= 1 AND n <= doc_id % 6"""


def enriched(t, rows):
    from ..operators import classify as C, language as G
    from .text_queries import entries, title_entries

    known = entries(t)
    cls = C.classify(rows.select("doc_id", "title", "description"), known, title_entries(t))
    named = rows.select("doc_id", F.lit(0).alias("pos"), F.lit(known.agg(F.min("label")).scalar()).alias("label"), F.lit("must").alias("importance"))
    cls = cls.join(C.unmapped_labels(t.sql(FREE_LABELS).unionByName(named), known, "doc_id"), "doc_id", "left")
    profiles = G.language_profiles(t("documents").select("doc_id", "lang", "text"))
    return I.enrich(rows, cls, t("v_cities"), companies=known_companies(t), profiles=profiles, today=F.lit("2026-09-01").cast("date"))


ENRICHED = f"""SELECT p.doc_id, CASE WHEN p.doc_id % 3 = 0 THEN 'onsite' ELSE CASE p.doc_id % 6 WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 4 THEN 'onsite' END END AS remote_policy,
 CASE WHEN p.doc_id % 2 = 0 THEN 'contract' ELSE concat_ws(',', CASE WHEN p.doc_id % 6 = 1 THEN 'full_time,part_time' END,
 CASE WHEN p.doc_id % 6 = 5 OR p.doc_id % 11 = 7 THEN 'internship' END) END AS types, 'NL' AS country, '2511' AS isco_code,
 CASE WHEN p.doc_id % 3 = 0 THEN 'fy' WHEN r.same = 1 THEN r.lang END AS language, k.company_key, p.doc_id % 6 > 3 AS unmapped,
 {sql_title('title')} || '|' || {sql_company("coalesce(n.name, c.name, p.company_name, '')")} || '|' || lower(coalesce(city, '')) AS dedup_key,
 CASE WHEN p.doc_id % 4 = 1 THEN '2026-09-01' ELSE '2026-03-04' END AS date_posted @more
 FROM v_postings p LEFT JOIN rk r ON r.doc_id = p.doc_id AND r.rn = 1 JOIN d_company k ON k.doc_id = p.doc_id
 LEFT JOIN (SELECT company_key, min(coalesce(d.company_name, dom)) AS name FROM d_company e JOIN d_named d ON d.doc_id = e.doc_id WHERE company_key LIKE 'new:%' GROUP BY 1) n
  ON n.company_key = k.company_key
 LEFT JOIN (SELECT '7' AS id, 'Canal Analytics' AS name UNION ALL SELECT '8', 'Noord Software' UNION ALL SELECT CAST(company_id AS STRING), name FROM v_companies) c ON c.id = k.company_key"""
DETECTED = sql_detected("(SELECT doc_id, title || chr(10) || description AS text FROM v_postings) q")


def shown(out):
    return out.select("doc_id", "remote_policy", F.array_join("employment_types", ",").alias("types"), "country", "isco_code", "language", "company_key",
                      F.array_contains("review_reasons", "unmapped_skills").alias("unmapped"), "dedup_key", F.col("date_posted").cast("string").alias("date_posted"),
                      *[c for c in ("source_id", "source_priority") if c in out.columns and "source_priority" in out.columns])


@query("ing_enrich", f"WITH {DETECTED} {ENRICHED.replace('@more', '')}")
def _(t):
    return shown(enriched(t, canonical_rows(t)))


@query("job_manual", f"WITH {DETECTED} {ENRICHED.replace('@more', ', NULL AS source_id, 100 AS source_priority')}")
def _(t):
    return shown(enriched(t, I.manual_rows(canonical_rows(t))))


# --- duplicates -------------------------------------------------------------------------------

LIVE = "status IN ('published', 'pending_review')"
ORACLE_PARTS["d_url"] = sql_canonical("(SELECT doc_id, apply_url AS url FROM v_postings WHERE " + LIVE + ") z", "doc_id")
ORACLE_PARTS["d_urledge"] = "SELECT src, dst FROM (SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY canonical) AS dst FROM d_url WHERE canonical IS NOT NULL) e WHERE src <> dst"
ORACLE_PARTS["d_key"] = f"""SELECT doc_id, {sql_title('title')} || '|' || {sql_company("coalesce(company_name, '')")} || '|' || lower(coalesce(city, '')) AS key FROM v_postings WHERE {LIVE}"""
ORACLE_PARTS["d_keyedge"] = """SELECT src, dst FROM (SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY key) AS dst FROM d_key
 WHERE doc_id NOT IN (SELECT src FROM d_urledge)) e WHERE src <> dst"""


@query("dedup_url", "SELECT src, dst FROM d_urledge")
def _(t):
    p = D.live_rows(t("v_postings")).withColumn("u", X.url_canonical(F.col("apply_url")))
    return D.same_key_edges(p, "u", "doc_id")


@query("dedup_exact_key", "SELECT src, dst FROM (SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY key) AS dst FROM d_key) e WHERE src <> dst")
def _(t):
    p = D.live_rows(t("v_postings")).withColumn("k", X.dedup_key(F.col("title"), F.col("company_name"), F.col("city")))
    return D.same_key_edges(p, "k", "doc_id")


DOT = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
# all vectors whole, and a near copy of each: every third number is a little larger
VECS = """(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings UNION ALL
 SELECT 1000000000 + vec_id, label, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN (i - 1 + vec_id) % 3 = 0 THEN CAST(1.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) FROM embeddings)"""


def vectors(t):
    e = t("embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    near = F.transform("embedding", lambda x, i: x * F.when((i + F.col("vec_id")) % 3 == 0, 1.25).otherwise(1.0))
    return e.unionByName(e.select((F.lit(1000000000) + F.col("vec_id")).alias("vec_id"), "label", near.alias("embedding")))


# a vector for every posting with a number in the table, and a near copy for a later posting of the same company
ORACLE_PARTS["d_vector"] = """SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings UNION ALL
 SELECT CAST(vec_id + (SELECT 13 * (floor(max(vec_id) / 13) + 1) FROM embeddings) AS BIGINT) AS doc_id,
  list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * CASE WHEN (i - 1 + vec_id) % 3 = 0 THEN CAST(1.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS v FROM embeddings"""
ORACLE_PARTS["d_rest"] = f"""SELECT p.doc_id, p.company_id, v.v FROM v_postings p JOIN d_vector v ON v.doc_id = p.doc_id
 WHERE {LIVE} AND company_id IS NOT NULL AND p.doc_id NOT IN (SELECT src FROM d_urledge) AND p.doc_id NOT IN (SELECT src FROM d_keyedge)"""
ORACLE_PARTS["d_nearedge"] = f"SELECT b.doc_id AS src, a.doc_id AS dst FROM d_rest a JOIN d_rest b ON a.company_id = b.company_id AND a.doc_id < b.doc_id WHERE {DOT} > CAST(0.9 AS DOUBLE)"


def posting_vectors(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    near = F.transform("embedding", lambda x, i: x * F.when((i + F.col("vec_id")) % 3 == 0, 1.25).otherwise(1.0))
    step = 13 * (F.floor(e.agg(F.max("vec_id").alias("m")).select("m").scalar() / 13) + 1)
    copies = e.select((F.col("vec_id") + step).cast("long").alias("doc_id"), near.alias("embedding"))
    return e.withColumnRenamed("vec_id", "doc_id").unionByName(copies)


@query("dedup_components", """WITH RECURSIVE edges AS (SELECT src, dst FROM d_urledge UNION SELECT src, dst FROM d_keyedge UNION SELECT src, dst FROM d_nearedge),
 both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
 reach(id, r) AS (SELECT a, a FROM both_ways UNION SELECT reach.id, b FROM reach JOIN both_ways ON both_ways.a = reach.r)
 SELECT id, min(r) AS component FROM reach GROUP BY id""")
def _(t):
    return D.components(D.duplicate_edges(t("v_postings"), posting_vectors(t)).select("src", "dst"))


@query("dedup_near", f"""SELECT a.vec_id AS a, b.vec_id AS b FROM {VECS} a JOIN {VECS} b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {DOT} > CAST(0.9 AS DOUBLE)""")
def _(t):
    return D.similar_pairs(vectors(t), "vec_id", "embedding", 0.9, block="label").select("a", "b")


@query("join_knn", f"""SELECT id, other, rank FROM (SELECT a.vec_id AS id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT} DESC, b.vec_id) AS rank
 FROM {VECS} a JOIN {VECS} b ON a.vec_id <> b.vec_id WHERE {DOT} > CAST(0.9 AS DOUBLE)) k WHERE rank <= 5""")
def _(t):
    return D.nearest(D.similar_pairs(vectors(t), "vec_id", "embedding", 0.9), 5).select("id", "other", "rank")


# --- streams ----------------------------------------------------------------------------------


@query("stream_ingest", f"SELECT DISTINCT source_id, external_id, sha256(payload) AS payload_hash, json_extract_string(payload, '$.title') AS title FROM ({RAW_ROWS}) r")
def _(t):
    root = shared_folder(t)
    t.sql(RAW_ROWS).write.json(f"{root}/landing")

    def to_canonical(rows):
        return rows.select("source_id", "external_id", "payload_hash", F.get_json_object("payload", "$.title").alias("title"))

    J.stream_ingest(t.spark, f"{root}/landing", f"{root}/archive", f"{root}/canonical", f"{root}/ckpt", to_canonical).awaitTermination()
    return t.spark.read.parquet(f"{root}/canonical").select("source_id", "external_id", "payload_hash", "title")


@query("stream_latest_feedback", """SELECT user_id, job_id, type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id ORDER BY created_at DESC, event_id DESC) AS rn
 FROM v_feedback) f WHERE rn = 1""")
def _(t):
    root = shared_folder(t)
    t("v_feedback").select("event_id", "user_id", "job_id", "type", F.col("created_at").cast("timestamp").alias("created_at")).write.json(f"{root}/landing")
    J.stream_latest_feedback(t.spark, f"{root}/landing", f"{root}/state", f"{root}/ckpt").awaitTermination()
    return J.feedback_table(t.spark, f"{root}/state").read().select("user_id", "job_id", "type")
