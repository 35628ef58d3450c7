"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op9_url_filter"] = """
WITH p AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM p),
r(h, t, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT q.*, h || t AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || t) DESC, length(h) DESC) AS k
  FROM q LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""

SQL["op10_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source,
    CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS size,
    length(translate(coalesce(text, ''), '0123456789#$%&*+/<=>@[\]^_`{|}~!', '')) AS plain,
    greatest(length(coalesce(text, '')), 1) AS n,
    (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / (greatest(1, CAST(floor(10 * CAST(plain AS DOUBLE) * plain / (CAST(n AS DOUBLE) * n)) AS INT)) / 10.0) AS key FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM k GROUP BY source),
-- the level at which the capped shares use up the budget, among the levels where a source meets its cap
c AS (
  SELECT 2.0 * a.source_size / a.w AS cap_level,
    (SELECT sum(least(2.0 * b.source_size, b.w * 2.0 * a.source_size / a.w)) FROM s b) AS used,
    (SELECT 1.5 * sum(source_size) FROM s) AS budget
  FROM s a),
f AS (SELECT coalesce(max(cap_level), 0) AS lo FROM c WHERE used <= budget),
l AS (
  SELECT (max(budget) - (SELECT coalesce(sum(2.0 * source_size), 0) FROM s WHERE 2.0 * source_size / w <= (SELECT lo FROM f)))
    / (SELECT sum(w) FROM s WHERE 2.0 * source_size / w > (SELECT lo FROM f)) AS level
  FROM c),
t AS (SELECT source, source_size, least(2.0 * source_size, w * level) AS target FROM s, l),
g AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, k.source,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken, source
FROM g
"""

# every pair of lines that shares a word is counted; sets are numbered so that copies meet once
SQL["op4_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS line,
    list_sort(list_filter(list_distinct(string_split(parts[i], ' ')), lambda x: x <> '')) AS ws
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS g(i)),
c AS (
  SELECT ws, len(ws) AS n, min((doc_id, line)) AS first, row_number() OVER () AS c FROM l WHERE len(ws) > 0 GROUP BY ws),
w AS (SELECT c, n, first, unnest(ws) AS w FROM c),
m AS (
  SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM w a JOIN w b ON a.w = b.w AND b.first < a.first AND b.n >= 0.8 * a.n AND a.n >= 0.8 * b.n GROUP BY ALL),
g AS (SELECT DISTINCT a AS c FROM m WHERE k / (na + nb - k) >= 0.8),
r AS (
  SELECT l.doc_id, l.line FROM l JOIN c USING (ws) LEFT JOIN g USING (c)
  WHERE g.c IS NOT NULL OR (l.doc_id, l.line) <> c.first),
t AS (SELECT doc_id, list_sort(list_distinct(list(line))) AS removed FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INT) AS n_lines,
  CAST(len(coalesce(removed, [])) AS INT) AS n_removed, coalesce(removed, []) AS removed
FROM documents LEFT JOIN t USING (doc_id)
"""


def _license_sql() -> str:
    """The scan over the same table of sentences and rules, with DuckDB's lists and patterns."""
    from .licenses import RULES, SENTENCES, rule_pattern

    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    whens = ", ".join(f"CASE WHEN regexp_matches(line, '{rule_pattern(ids)}') THEN '{name}' END" for name, ids in RULES)
    return rf"""
WITH k(sentence, sid) AS (VALUES {known}),
a AS (
  SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS place
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.!?;:]+[ \t]+', chr(10), 'g'), '[.!?;:]+(\r?\n)', chr(10), 'g'), chr(10)) AS s FROM documents)),
b AS (
  SELECT doc_id, place, trim(regexp_replace(regexp_replace(regexp_replace(sentence, '[^a-z0-9.]+', ' ', 'g'),
    '\.+( |$)|(^| )\.+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS sentence FROM a),
c AS (
  SELECT doc_id, list(sid ORDER BY place) AS ids FROM b JOIN k USING (sentence) GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(ids, []) AS sentence_ids,
    coalesce(array_to_string(list_transform(ids, lambda i: ';' || i || ';'), ''), '') AS line
  FROM documents LEFT JOIN c USING (doc_id)),
e AS (SELECT doc_id, sentence_ids, list_filter([{whens}], lambda x: x IS NOT NULL) AS licenses FROM d)
SELECT doc_id, sentence_ids, licenses, licenses[1] AS license FROM e
"""


SQL["op3_license_scan"] = _license_sql()

SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS failed FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
k(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM k a JOIN k b ON b.bit <> a.bit JOIN k c ON c.bit NOT IN (a.bit, b.bit) JOIN k d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN k e ON e.bit = 31 - a.bit - b.bit - c.bit - d.bit),
s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step - 1]) AS INT) AS before
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (failed & (coalesce(before, 0) | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (failed & coalesce(before, 0) = 0 AND failed & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (failed & coalesce(before, 0) > 0 AND failed & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (failed & coalesce(before, 0) = 0 AND failed & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (failed & coalesce(before, 0) = 0 AND failed & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


def _repair_sql() -> str:
    """The lattice row by row: a label is the cost in nine digits and the audit, so the least text is the answer."""

    def add(label: str, cost: str, edits: str) -> str:
        return f"lpad(CAST(CAST(left({label}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({label}, 10) || '{edits}'"

    turn = "least(v.l0, v.l1, v.l3)"
    return rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
r AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda h, b: xor(h >> 8, crcs[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, t),
x AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM r, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS u(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM x),
f AS (
  SELECT *, CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS code,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM o),
v AS (
  SELECT DISTINCT c, 0 AS i, '000000000' AS l0, CAST(NULL AS VARCHAR) AS l1, '000000005I' AS l2, '000000010II' AS l3 FROM r
  UNION ALL
  SELECT c, i, n0, n1,
    least(n2, {add("n0", "5", "I")}, {add("n1", "5", "I")}, {add("n3", "5", "I")}),
    least(n3, {add("n2", "5", "I")}, {add("n0", "10", "II")}, {add("n1", "10", "II")})
  FROM (
    SELECT v.c, f.i, {add("v.l0", "2", "D")} AS n0,
      least({add("v.l1", "2", "D")}, CASE WHEN ok AND code = 1 THEN {add("v.l0", "m", "K")} END) AS n1,
      least({add("v.l2", "2", "D")}, CASE WHEN ok AND code = 2 THEN {add(turn, "m", "K")} END, CASE WHEN ok THEN {add(turn, "m + 1", "R")} END) AS n2,
      least({add("v.l3", "2", "D")}, CASE WHEN ok AND code = 3 THEN {add("v.l2", "m", "K")} END, CASE WHEN ok THEN {add("v.l2", "m + 1", "R")} END) AS n3
    FROM v JOIN (SELECT c, i, code, fault NOT IN (1, 2) AS ok, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS m FROM f) f ON f.c = v.c AND f.i = v.i + 1)),
e AS (SELECT c, max_by(least(l0, l3), i) AS label FROM v GROUP BY c),
a AS (SELECT c, CAST(left(label, 9) AS BIGINT) AS cost, substr(label, 10) AS audit FROM e),
b AS (
  SELECT c, p, substr(audit, p, 1) AS edit, p - len(replace(left(audit, p), 'I', '')) AS added, len(replace(left(audit, p), 'D', '')) AS given
  FROM a, unnest(generate_series(1, len(audit))) AS g(p)),
g AS (
  SELECT b.*, f.role, f.text, coalesce(max(CAST(edit = 'K' AND code = 1 AS INT)) OVER (PARTITION BY b.c), 0) AS s
  FROM b LEFT JOIN f ON f.c = b.c AND edit <> 'I' AND f.i = p - added),
h AS (
  SELECT c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (given - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
  FROM g WHERE edit <> 'D' GROUP BY c),
n AS (
  SELECT c, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM r) JOIN a USING (c) LEFT JOIN n USING (c) LEFT JOIN h USING (c)
"""


SQL["op13_conversation_repair"] = _repair_sql()
