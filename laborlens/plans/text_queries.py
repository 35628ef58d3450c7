"""Text, URL, salary, vector and classification queries over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N, text as X
from ..functions.embed import embed
from ..operators import classify as C, language as G, taxonomy as T
from .oracle import ORACLE_PARTS, up
from .registry import query

WS = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def sql_plain(c: str) -> str:
    marks = f"lower(strip_accents({c}))"
    return f"trim(regexp_replace(regexp_replace({marks}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_title(c: str) -> str:
    hours = f"regexp_replace({c}, '\\b\\d{{1,2}}\\s*(?:[-–]|tot|to)\\s*\\d{{1,2}}\\s*(?:uur|hours|u)\\b', ' ', 'gi')"
    noise = ("\\((?:m/v/x|m/v|v/m|m/f/d|m/w/d|f/m/x|m/f|all genders|h/f)\\)|\\b(?:m/v/x|m/f/d|m/w/d)\\b|"
             "\\b(?:vacature|vacancy|job|gezocht|wanted|urgent|nieuw|new)\\b|[!*|]")
    plain = sql_plain(f"regexp_replace({hours}, '{noise}', ' ', 'gi')")
    return f"regexp_replace(regexp_replace({plain}, '\\bsr\\b', 'senior', 'g'), '\\bjr\\b', 'junior', 'g')"


def sql_company(c: str) -> str:
    end = "\\b(b\\.?v\\.?|n\\.?v\\.?|v\\.?o\\.?f\\.?|gmbh|ltd|llc|inc|holding|group|groep|nederland|netherlands)\\b\\.?"
    return sql_plain(f"regexp_replace({c}, '{end}', ' ', 'gi')")


@query("txt_normalize", f"SELECT doc_id, {sql_plain('text')} AS plain FROM documents")
def _(t):
    return t("documents").select("doc_id", X.normalize_plain(F.col("text")).alias("plain"))


@query("txt_normalize_title", f"SELECT doc_id, {sql_title('title')} AS plain FROM v_postings")
def _(t):
    return t("v_postings").select("doc_id", X.normalize_title(F.col("title")).alias("plain"))


@query("txt_normalize_company", f"SELECT doc_id, {sql_company('company_name')} AS plain FROM v_postings WHERE company_name IS NOT NULL")
def _(t):
    p = t("v_postings").filter(F.col("company_name").isNotNull())
    return p.select("doc_id", X.normalize_company(F.col("company_name")).alias("plain"))


@query("txt_normalize_label", "SELECT doc_id, trim(regexp_replace(translate(regexp_replace(lower(strip_accents(text)), "
       "'[^\\p{L}\\p{N}+#.\\s-]', ' ', 'g'), '-', ' '), '\\s+', ' ', 'g')) AS plain FROM documents")
def _(t):
    return t("documents").select("doc_id", X.normalize_label(F.col("text")).alias("plain"))


@query("dedup_key", f"SELECT doc_id, {sql_title('title')} || '|' || {sql_company('''coalesce(company_name, '')''')} || '|' || {sql_plain('''coalesce(city, '')''')} AS key FROM v_postings")
def _(t):
    return t("v_postings").select("doc_id", X.dedup_key(F.col("title"), F.col("company_name"), F.col("city")).alias("key"))


@query("url_domain", """SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', ''),
 '^(jobs|careers|werkenbij|karriere|apply)\\.', '') AS domain FROM pages""")
def _(t):
    return t("pages").select("page_id", X.url_domain(F.col("url")).alias("domain"))


CANONICAL = """lower(regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', '')
 || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN len(qs) = 0 THEN '' ELSE '?' || array_to_string(list_sort(qs), '&') END)"""


def sql_canonical(source: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN url IS NOT NULL THEN {CANONICAL} END AS canonical FROM (SELECT {key}, url, list_filter(
 string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1),
 '^(utm_[a-z]+|gclid|fbclid|ref|source|src|campaign|trk|mc_[a-z]+|_ga)$', 'i')) AS qs FROM {source}) x"""


@query("url_canonical", sql_canonical("pages", "page_id"))
def _(t):
    return t("pages").select("page_id", X.url_canonical(F.col("url")).alias("canonical"))


@query("url_mask", "SELECT page_id, regexp_replace(url || '?api_key=' || CAST(page_id AS STRING) || '&x=1', '([?&](?:app_key|app_id|api_key|key|token|secret)=)[^&]+', '\\1***', 'gi') AS masked FROM pages")
def _(t):
    return t("pages").select("page_id", X.url_mask(F.expr("url || '?api_key=' || CAST(page_id AS STRING) || '&x=1'")).alias("masked"))


ENTITY = "&(#x?[0-9a-fA-F]+|[a-zA-Z]+);"
DECODED = """array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || CASE WHEN i > len(ents) THEN '' ELSE
 CASE lower(ents[i]) WHEN 'amp' THEN '&' WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'quot' THEN '"' WHEN 'apos' THEN '''' WHEN 'nbsp' THEN ' '
 WHEN 'euro' THEN '€' WHEN 'rsquo' THEN '’' WHEN 'lsquo' THEN '‘' WHEN 'ndash' THEN '–' WHEN 'mdash' THEN '—' WHEN 'hellip' THEN '…'
 ELSE CASE WHEN regexp_matches(ents[i], '^#[0-9]+$') THEN chr(CAST(substr(ents[i], 2) AS INT)) ELSE '&' || ents[i] || ';' END END END), '')"""
HTML = f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<script[\\s\\S]*?</script>|<style[\\s\\S]*?</style>', '', 'gi'), '<li[^>]*>', chr(10) || '• ', 'gi'), '<br\\s*/?>', chr(10), 'gi'),
  '</(p|div|h[1-6]|ul|ol|section|tr)>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS b FROM pages),
 c AS (SELECT page_id, string_split_regex(b, '{ENTITY}') AS pieces, regexp_extract_all(b, '{ENTITY}', 1) AS ents FROM a),
 d AS (SELECT page_id, {DECODED} AS b FROM c)
 SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[ \\t\\x{{A0}}]+', ' ', 'g'), ' *\\n *', chr(10), 'g'),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+', '', 'g'), '{WS}+$', '', 'g') AS text FROM d"""


@query("html_to_text", HTML)
def _(t):
    return t("pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query("txt_ws", f"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(description, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{WS}*\\n{WS}*\\n+',
 chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS tidy FROM v_postings""")
def _(t):
    return t("v_postings").select("doc_id", X.tidy_blanks(F.col("description")).alias("tidy"))


def hit(words: str, c: str = "description") -> str:
    return f"regexp_matches({c}, '{words}', 'i')"


@query("txt_remote", f"""SELECT doc_id, CASE WHEN {hit('hybrid|hybride')} THEN 'hybrid' WHEN {hit('remote|thuiswerk|work from home|wfh|anywhere')} THEN 'remote'
 WHEN {hit('on[- ]?site|office|kantoor|op locatie')} THEN 'onsite' END AS remote FROM v_postings""")
def _(t):
    return t("v_postings").select("doc_id", X.remote_class(F.col("description")).alias("remote"))


@query("txt_employment", f"""SELECT doc_id, concat_ws(',', CASE WHEN {hit('full[ _-]?time|fulltime|voltijd')} THEN 'full_time' END,
 CASE WHEN {hit('part[ _-]?time|parttime|deeltijd')} THEN 'part_time' END, CASE WHEN {hit('freelance|zzp|contractor|interim')} THEN 'freelance' END,
 CASE WHEN {hit('intern(ship)?|stage|trainee')} THEN 'internship' END, CASE WHEN {hit('temporary|temp\\b|tijdelijk|fixed[- ]term')} THEN 'temporary' END,
 CASE WHEN {hit('\\bcontract\\b')} AND NOT {hit('freelance|zzp|contractor|interim')} THEN 'contract' END) AS types FROM v_postings""")
def _(t):
    return t("v_postings").select("doc_id", F.array_join(X.employment_types(F.col("description")), ",").alias("types"))


# --- salary -----------------------------------------------------------------------------

ORACLE_PARTS["s_numbers"] = """
SELECT id, lo, hi, unit, currency, salary_text, hours, list_filter(list_transform(range(1, len(raws) + 1), lambda i:
  CAST(CASE WHEN regexp_matches(raws[i], '^\\d{1,3}([.,\\d ]*)$') AND regexp_matches(replace(raws[i], ' ', ''), '^\\d{1,3}([.,]\\d{3})+$')
    THEN regexp_replace(raws[i], '[., ]', '', 'g') ELSE replace(replace(raws[i], ' ', ''), ',', '.') END AS DOUBLE)
  * CASE WHEN kilos[i] = 'k' THEN 1000 ELSE 1 END), lambda n: n >= 5) AS nums,
 CASE WHEN regexp_matches(lower(salary_text), 'per uur|/ ?uur|per hour|/ ?h(ou)?r|hourly|uurloon') THEN 'hour'
  WHEN regexp_matches(lower(salary_text), 'per dag|per day|daily|dagtarief') THEN 'day' WHEN regexp_matches(lower(salary_text), 'per week|weekly') THEN 'week'
  WHEN regexp_matches(lower(salary_text), 'per maand|p/m|p\\.m\\.|per month|monthly') THEN 'month'
  WHEN regexp_matches(lower(salary_text), 'per jaar|per year|annual|yearly') THEN 'year' END AS text_unit
FROM (SELECT *, regexp_extract_all(lower(salary_text), '€?\\s?(\\d{1,3}(?:[.,\\s]\\d{3})+|\\d+(?:[.,]\\d{1,2})?)\\s?(k)?', 1) AS raws,
  regexp_extract_all(lower(salary_text), '€?\\s?(\\d{1,3}(?:[.,\\s]\\d{3})+|\\d+(?:[.,]\\d{1,2})?)\\s?(k)?', 2) AS kilos FROM v_salaries) x
"""


@query("txt_salary_parse", "SELECT id, nums[1] AS min, coalesce(nums[2], nums[1]) AS max, text_unit AS unit FROM s_numbers WHERE salary_text IS NOT NULL")
def _(t):
    s = t("v_salaries").filter(F.col("salary_text").isNotNull())
    return s.select("id", N.salary_from_text(F.col("salary_text")).alias("s")).select("id", "s.*")


@query("salary_unit_guess", "SELECT id, CASE WHEN hi < 200 THEN 'hour' WHEN hi < 1500 THEN 'week' WHEN hi < 15000 THEN 'month' WHEN hi IS NOT NULL THEN 'year' END AS unit FROM v_salaries")
def _(t):
    return t("v_salaries").select("id", N.salary_unit_guess(F.col("hi")).alias("unit"))


MONTHLY = """CASE {u} WHEN 'hour' THEN {x} * coalesce(hours, 40) * 52 / 12 WHEN 'day' THEN {x} * 5 * 52 / 12 WHEN 'week' THEN {x} * 52 / 12
 WHEN 'month' THEN {x} WHEN 'year' THEN {x} / (12 * CAST(1.08 AS DOUBLE)) END"""


@query("salary_monthly", f"SELECT id, {up(MONTHLY.format(u='unit', x='hi'), 2)} AS monthly FROM v_salaries WHERE unit IS NOT NULL")
def _(t):
    s = t("v_salaries").filter(F.col("unit").isNotNull())
    return s.select("id", N.half_up(N.salary_monthly(F.col("hi"), F.col("unit"), F.col("hours")), 2).alias("monthly"))


@query("salary_normalize", f"""WITH a AS (SELECT *, CASE WHEN lo IS NULL AND hi IS NULL THEN nums[1] ELSE lo END AS l0,
  CASE WHEN lo IS NULL AND hi IS NULL THEN coalesce(nums[2], nums[1]) ELSE hi END AS h0,
  coalesce(unit, CASE WHEN lo IS NULL AND hi IS NULL THEN text_unit END) AS u0 FROM s_numbers),
 b AS (SELECT *, coalesce(u0, CASE WHEN coalesce(h0, l0) < 200 THEN 'hour' WHEN coalesce(h0, l0) < 1500 THEN 'week'
  WHEN coalesce(h0, l0) < 15000 THEN 'month' ELSE 'year' END) AS u FROM a),
 c AS (SELECT *, {up(MONTHLY.format(u='u', x='l0'), 0)} AS l1, {up(MONTHLY.format(u='u', x='h0'), 0)} AS h1 FROM b),
 d AS (SELECT id, currency, CASE WHEN l1 > h1 THEN h1 ELSE l1 END AS l2, CASE WHEN l1 > h1 THEN l1 ELSE h1 END AS h2 FROM c)
 SELECT id, CASE WHEN ok THEN l2 END AS min_month, CASE WHEN ok THEN h2 END AS max_month FROM (SELECT *, (currency IS NULL OR upper(currency) = 'EUR')
  AND coalesce(l2 BETWEEN 800 AND 40000, TRUE) AND coalesce(h2 BETWEEN 800 AND 40000, TRUE) AS ok FROM d) e""")
def _(t):
    cols = [F.col(c) for c in ("lo", "hi", "unit", "currency", "salary_text", "hours")]
    return t("v_salaries").select("id", N.salary_normalize(*cols).alias("s")).select("id", "s.*")


@query("date_parse", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate END AS parsed,
 CASE o_orderkey % 3 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) || '-01-01' WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-01' END AS month FROM orders""")
def _(t):
    d, day = F.col("o_orderdate"), F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, day).when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd")).when(k % 4 == 2, F.concat(day, F.lit("T00:00:00Z"))).otherwise("not a date")
    month = F.when(k % 3 == 0, F.date_format(d, "yyyy")).when(k % 3 == 1, F.date_format(d, "yyyy-MM")).otherwise("soon")
    return t("orders").select(k.alias("id"), X.parse_date(raw).alias("parsed"), X.month_to_date(month).alias("month"))


# --- redaction, language ----------------------------------------------------------------


@query("pii_redact")
def _(t):
    return X.redact_text(t("documents").select("doc_id", "text"), "text")


@query("agg_redaction_counts")
def _(t):
    rows = X.redact_steps(t("documents").select("doc_id", "source", "text"), "text")
    return rows.groupBy("source").agg(*[F.sum(f"n_{k}").alias(k) for k in X.REDACTION_KINDS])


GRAM3 = """unnest(list_transform(range(1, greatest(length(x) - 2, 1) + 1), lambda i: substr(x, i, 3)))"""
LOWER = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' '"
PROFILE = f"""prof AS (SELECT lang, gram, 301 - rn AS weight FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS rn
  FROM (SELECT lang, {GRAM3} AS gram FROM (SELECT lang, {LOWER} AS x FROM documents) d) g GROUP BY lang, gram) r WHERE rn <= 300)"""


def sql_detected(source: str) -> str:
    """CTEs that end in ``rk``: the best language of each text of ``source`` (doc_id, text), ``same`` best ones."""
    return f"""{PROFILE},
 sc AS (SELECT doc_id, p.lang, sum(weight) AS score FROM (SELECT doc_id, {GRAM3} AS gram FROM (SELECT doc_id, {LOWER} AS x FROM {source}
   WHERE length(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) >= 40) d) g JOIN prof p ON p.gram = g.gram GROUP BY 1, 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS rn, count(*) OVER (PARTITION BY doc_id, score) AS same FROM sc)"""


@query("lang_detect", f"""WITH {sql_detected('documents')}
 SELECT d.doc_id, CASE WHEN r.same = 1 THEN r.lang END AS detected FROM documents d LEFT JOIN rk r ON r.doc_id = d.doc_id AND r.rn = 1""")
def _(t):
    docs = t("documents").select("doc_id", "lang", "text")
    return G.detect_language(docs, G.language_profiles(docs), "doc_id", "text")


# --- hashes, vectors --------------------------------------------------------------------


@query("hash_content", """SELECT doc_id, sha256('{"apply_url":' || coalesce('"' || apply_url || '"', 'null') || ',"city":' || coalesce('"' || city || '"', 'null')
 || ',"company_name":' || coalesce('"' || company_name || '"', 'null') || ',"title":"' || title || '"}') AS content_hash FROM v_postings""")
def _(t):
    from ..operators.ingest import stable_hash

    return t("v_postings").select("doc_id", stable_hash("title", "company_name", "city", "apply_url").alias("content_hash"))



VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
NEXT = f"(SELECT vec_id, {VEC} AS v, lead({VEC}) OVER (ORDER BY vec_id) AS w FROM embeddings) e"


def neighbours(t):
    """Each vector beside the one with the next id."""
    e = t("embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query("vec_cosine", f"SELECT vec_id, floor(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)) * 1000000 + 0.5) AS cosine6 FROM {NEXT} WHERE w IS NOT NULL")
def _(t):
    return neighbours(t).select("vec_id", F.floor(N.cosine(F.col("embedding"), F.col("other")) * 1000000 + 0.5).alias("cosine6"))


@query("vec_normalize", f"SELECT vec_id, floor(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))[1] * 1000000 + 0.5) AS first6, len(v) AS dims FROM {NEXT}")
def _(t):
    u = N.unit_vector(F.col("embedding"))
    return t("embeddings").select("vec_id", F.floor(F.get(u, F.lit(0)) * 1000000 + 0.5).alias("first6"), F.size(u).cast("bigint").alias("dims"))


@query("parse_vector", f"SELECT vec_id, len(v) AS dims, '[' || printf('%.6f', v[1]) AS head FROM {NEXT}")
def _(t):
    lit = N.vector_literal(F.col("embedding"))
    back = N.parse_vector(lit)
    return t("embeddings").select("vec_id", F.size(back).cast("bigint").alias("dims"), F.substring_index(lit, ",", 1).alias("head"))


@query("agg_max_cosine", f"""SELECT a.label, max(CAST(floor(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) * 10000 + 0.5) AS BIGINT)) AS best4
 FROM (SELECT label, {VEC} AS v FROM embeddings) a JOIN (SELECT label, {VEC} AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) b
 ON b.label = (a.label + 1) % 10 GROUP BY a.label""")
def _(t):
    e = t("embeddings")
    target = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("target")).select(
        F.pmod(F.col("label") - 1, F.lit(10)).alias("label"), "target")
    c = N.cosine(F.col("embedding"), F.col("target"))
    return e.join(target, "label").groupBy("label").agg(F.max(F.floor(c * 10000 + 0.5)).alias("best4"))


@query("vec_hash_embed")
def _(t):
    v = t("documents").select("doc_id", embed(F.col("text")).alias("embedding"))
    return v


@query("embed_postings")
def _(t):
    p = t("v_postings")
    return p.select("doc_id", embed(F.concat_ws("\n", "title", "description")).alias("embedding"))


@query("blend_values", "SELECT user_id, job_id, " + ", ".join(
    up(f"CAST(0.5 AS DOUBLE) * coalesce(w{i}, 0.5) + CAST(0.5 AS DOUBLE) * 0.85", 2) + f" AS v{i}" for i in range(1, 7)) + " FROM o_pair")
def _(t):
    from ..operators.ingest import blend_values

    jobs = t("v_jobs").select("job_id", *[F.col(f"w_{v}").alias(v) for v in N.WORK_VALUES])
    f = t("v_pairs").select("user_id", "job_id").join(jobs, "job_id")
    out = [blend_values(F.col(v), F.lit(0.85)).alias(f"v{i}") for i, v in enumerate(N.WORK_VALUES, 1)]
    return f.select("user_id", "job_id", *out)


# --- classification ---------------------------------------------------------------------


def entries(t):
    """Dictionary of the words of four or more letters of the benchmark texts; stems are concepts."""
    words = t("benchmark").select(F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " ")).alias("label"))
    words = words.filter(F.length("label") >= 4).distinct()
    return words.select(F.concat(F.lit("c:"), F.left("label", F.lit(6))).alias("uri"), "label", F.col("label").alias("norm"), F.lit(0).alias("entry"))


ORACLE_PARTS["c_terms"] = """SELECT DISTINCT 'c:' || left(w, 6) AS uri, w AS label FROM (SELECT unnest(split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ')) AS w
 FROM benchmark) x WHERE length(w) >= 4"""


def c_found(source: str, key: str, text: str) -> str:
    return f"""SELECT {key}, uri, arg_max(label, length(label) * 1000000 - first) AS label FROM (SELECT {key}, label, uri, 0 AS first FROM (SELECT DISTINCT {key},
 unnest(regexp_extract_all(regexp_replace(lower(strip_accents({text})), '[^\\p{{L}}\\p{{N}}+#.\\s-]', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+[+#]?')) AS w FROM {source}) d JOIN c_terms ON label = w) h GROUP BY 1, 2"""


@query("join_dictionary", "SELECT doc_id, uri, length(label) AS size FROM (" + c_found("documents", "doc_id", "text") + ") f")
def _(t):
    found = T.find_concepts(t("documents"), entries(t), "doc_id", "text")
    return found.select("doc_id", "uri", F.length("label").alias("size"))


def posting_text(t):
    return t("v_postings").select("doc_id", "title", "description", F.concat_ws("\n", "title", "description").alias("text"))


@query("cls_skills")
def _(t):
    return C.posting_skills(posting_text(t), entries(t), "doc_id", "text").select("doc_id", "uri", "importance")


@query("cls_remote", f"""SELECT doc_id, CASE WHEN {hit('fully remote|100% remote|remote[- ]first|volledig (?:vanuit huis|thuis|remote)|work from anywhere')} THEN 'remote'
 WHEN {hit('hybrid|hybride|\\d days? (?:a week )?(?:in|at) the office|dagen (?:per week )?op kantoor|deels thuis|thuiswerken')} THEN 'hybrid'
 WHEN {hit('on[- ]site|op locatie|on location|in de winkel|in het ziekenhuis|op de werkvloer')} THEN 'onsite' END AS policy FROM v_postings""")
def _(t):
    return posting_text(t).select("doc_id", C.remote_policy(F.col("text")).alias("policy"))


@query("cls_employment", f"""SELECT doc_id, concat_ws(',', CASE WHEN {hit('full[- ]?time|fulltime|voltijd')} THEN 'full_time' END,
 CASE WHEN {hit('part[- ]?time|parttime|deeltijd')} THEN 'part_time' END, CASE WHEN {hit('freelance|\\bzzp\\b|interim')} THEN 'freelance' END,
 CASE WHEN {hit('internship|\\bstage\\b|stagiair', 'd')} THEN 'internship' END, CASE WHEN {hit('temporary|tijdelijk|fixed[- ]term')} THEN 'temporary' END) AS types
 FROM (SELECT *, title || chr(10) || description AS d FROM v_postings) p""")
def _(t):
    return posting_text(t).select("doc_id", F.array_join(C.employment(F.col("text")), ",").alias("types"))


HOURS = "(\\d{2})\\s*(?:-|–|tot|to)\\s*(\\d{2})\\s*(?:uur|hours|hrs|u\\b)"
SINGLE = "(\\d{2})\\s*(?:uur|hours|hrs)"


@query("cls_hours", f"""WITH a AS (SELECT doc_id, try_cast(regexp_extract(d, '{HOURS}', 1, 'i') AS DOUBLE) AS lo, try_cast(regexp_extract(d, '{HOURS}', 2, 'i') AS DOUBLE) AS hi,
 try_cast(regexp_extract(d, '{SINGLE}', 1, 'i') AS DOUBLE) AS one FROM (SELECT doc_id, title || chr(10) || description AS d FROM v_postings) p)
 SELECT doc_id, CASE WHEN coalesce(lo, one) BETWEEN 4 AND 60 THEN coalesce(lo, one) END AS min, CASE WHEN coalesce(lo, one) BETWEEN 4 AND 60 THEN coalesce(hi, one) END AS max FROM a""")
def _(t):
    return posting_text(t).select("doc_id", C.hours(F.col("text")).alias("h")).select("doc_id", "h.*")


@query("cls_education", f"""SELECT doc_id, CASE WHEN {hit("(?:\\bwo\\b|master''?s?|msc|universitair)[- ]?(?:diploma|degree|opleiding)?\\s*(?:is\\s*)?(?:vereist|verplicht|required|mandatory)")} THEN 7
 WHEN {hit("(?:\\bhbo\\b|bachelor''?s?|bsc)[- ]?(?:diploma|degree)\\s*(?:is\\s*)?(?:vereist|verplicht|required|mandatory)")} THEN 6
 WHEN {hit("\\bmbo\\b[- ]?(?:\\d\\s*)?(?:diploma)\\s*(?:is\\s*)?(?:vereist|verplicht|required)")} THEN 4 END AS min_eqf FROM v_postings""")
def _(t):
    return posting_text(t).select("doc_id", C.education_required(F.col("text")).alias("min_eqf"))


@query("cls_seniority", f"""SELECT doc_id, CASE WHEN {hit('\\b(intern|stagiair)\\b', 'title')} THEN 'intern' WHEN {hit('\\b(junior|starter|graduate|trainee)\\b', 'title')} THEN 'junior'
 WHEN {hit('\\b(head of|director|chief|cto|cfo|vp)\\b', 'title')} THEN 'executive' WHEN {hit('\\b(lead|principal|manager|teamleider|staff)\\b', 'title')} THEN 'lead'
 WHEN {hit('\\b(senior|sr\\.?)\\b', 'title')} THEN 'senior' WHEN {hit('\\b(medior|mid[- ]level)\\b', 'title')} THEN 'medior' END AS seniority FROM v_postings""")
def _(t):
    return t("v_postings").select("doc_id", C.title_seniority(F.col("title")).alias("seniority"))


VALUES = (("achievement", "impact|challeng|uitdag|groei|growth|ambiti|ownership", 0.85), ("independence", "autonom|zelfstandig|ownership|vrijheid|freedom|self[- ]directed", 0.85),
          ("recognition", "career|carrière|doorgroei|recognition|waardering|leadership|promotion", 0.75), ("relationships", "team|collega|colleague|samenwerk|collaborat|community", 0.8),
          ("support", "training|coaching|mentor|begeleiding|opleidingsbudget|learning budget|onboarding", 0.85),
          ("working_conditions", "flexib|thuiswerk|work[- ]life|balance|pensioen|pension|vakantiedagen|holiday|secondary benefits|arbeidsvoorwaarden", 0.85))


@query("cls_work_values", "SELECT doc_id, " + ", ".join(f"CAST(CASE WHEN {hit(w, 'd')} THEN {h} ELSE 0.5 END AS DOUBLE) AS {n}" for n, w, h in VALUES)
       + " FROM (SELECT doc_id, title || chr(10) || description AS d FROM v_postings) p")
def _(t):
    return posting_text(t).select("doc_id", C.work_values(F.col("text")).alias("v")).select("doc_id", "v.*")


@query("cls_languages", """SELECT doc_id, language, level, required FROM (
 SELECT doc_id, 'en' AS language, CASE doc_id % 6 WHEN 0 THEN 'C1' WHEN 1 THEN 'B2' END AS level, doc_id % 6 = 0 AS required FROM documents WHERE doc_id % 6 IN (0, 1)
 UNION ALL SELECT doc_id, 'nl', CASE doc_id % 6 WHEN 1 THEN 'B2' ELSE 'C2' END, doc_id % 6 = 2 FROM documents WHERE doc_id % 6 IN (1, 2)
 UNION ALL SELECT doc_id, 'de', 'C2', TRUE FROM documents WHERE doc_id % 6 = 2
 UNION ALL SELECT doc_id, 'fr', 'A2', TRUE FROM documents WHERE doc_id % 6 = 4 UNION ALL SELECT doc_id, 'es', 'C1', TRUE FROM documents WHERE doc_id % 6 = 4) x""")
def _(t):
    return C.mentioned_languages(posting_text(t), "doc_id", "text", "B2", True)


def title_entries(t):
    """Occupation labels: the distinct first words of the normalised titles."""
    w = t("v_postings").select(X.normalize_title(F.col("title")).alias("n")).select(F.explode(F.split("n", " ")).alias("label")).filter(F.length("label") > 4).distinct()
    return w.select(F.concat(F.lit("o:"), "label").alias("uri"), "label", F.col("label").alias("norm"), F.lit(0).alias("entry"), F.lit("2511").alias("isco_code"))


@query("cls_occupation", f"""WITH w AS (SELECT DISTINCT unnest(split({sql_title('title')}, ' ')) AS w FROM v_postings)
 SELECT doc_id, 'o:' || arg_min(w, strpos(n, w)) AS uri FROM (SELECT doc_id, lower(title) AS n FROM v_postings) p JOIN w ON length(w) > 4 AND regexp_matches(n, '\\b' || w || '\\b')
 GROUP BY doc_id""")
def _(t):
    found = T.find_concepts(t("v_postings"), title_entries(t).drop("isco_code"), "doc_id", "title")
    return T.best_concept(found, "doc_id").select("doc_id", "uri")


@query("cls_confidence", "SELECT d.doc_id, least(CAST(0.9 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * least(coalesce(n, 0), 4)) AS confidence FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ("
       + c_found("documents", "doc_id", "text") + ") f GROUP BY 1) c ON c.doc_id = d.doc_id")
def _(t):
    n = T.find_concepts(t("documents"), entries(t), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"))
    return t("documents").select("doc_id").join(n, "doc_id", "left").select("doc_id", C.confidence(F.coalesce("n", F.lit(0))).alias("confidence"))


LABELS = """SELECT p_partkey AS doc_id, 1 AS pos, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN 'must' ELSE 'nice' END AS importance FROM part
 UNION ALL SELECT p_partkey AS doc_id, 2 AS pos, upper(p_name) AS label, 'nice' AS importance FROM part
 UNION ALL SELECT p_partkey AS doc_id, 3 AS pos, 'a ' || p_type || ' thing' AS label, 'must' AS importance FROM part
 UNION ALL SELECT p_partkey AS doc_id, 4 AS pos, 'nothing known' AS label, 'must' AS importance FROM part"""


@query("cls_ground", """SELECT p_partkey AS doc_id, 'n:' || p_name AS uri, CASE WHEN p_partkey % 2 = 0 THEN 'must' ELSE 'nice' END AS importance, NULL AS unmapped FROM part
 UNION ALL SELECT p_partkey, 't:' || p_type, 'must', NULL FROM part UNION ALL SELECT p_partkey, NULL, 'must', 'nothing known' FROM part""")
def _(t):
    part = t("part")
    known = part.select(F.concat(F.lit("n:"), "p_name").alias("uri"), F.col("p_name").alias("label")).unionByName(
        part.select(F.concat(F.lit("t:"), "p_type").alias("uri"), F.col("p_type").alias("label"))).distinct()
    known = known.select("uri", "label", X.normalize_label(F.col("label")).alias("norm"), F.lit(0).alias("entry"))
    return C.ground_labels(t.sql(LABELS), known, "doc_id").drop("pos")


@query("join_reconcile", """SELECT l.p_partkey AS part, coalesce(o.uri, 'urn:local:' || l.p_name) AS uri FROM part l LEFT JOIN
 (SELECT DISTINCT 'http://' || p_name AS uri, p_name FROM part WHERE p_name LIKE '%r%') o ON o.p_name = l.p_name""")
def _(t):
    part = t("part")
    local = part.select(F.concat(F.lit("urn:local:"), "p_name").alias("uri"), "p_name")
    official = part.filter(F.col("p_name").contains("r")).select(F.concat(F.lit("http://"), "p_name").alias("uri"), "p_name")
    skills = local.unionByName(official).distinct().withColumnRenamed("p_name", "label_en")
    mapping = T.reconcile(skills, F.col("uri").startswith("urn:local:"))
    uses = part.select(F.col("p_partkey").alias("part"), F.concat(F.lit("urn:local:"), "p_name").alias("uri"))
    return T.remap_column(uses, mapping, "uri", "part")
