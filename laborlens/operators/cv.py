"""Reading CV texts: blocks, sections, level, education, languages, skills with recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import let
from ..functions.text import BLANK, has, java, js_trim, normalize_label, redact_text
from .classify import first_class, mentioned_languages
from .taxonomy import best_concept, find_concepts

# --- fixed values -----------------------------------------------------------------------
YEAR_RANGE = (
    r"((?:19|20)\d{2})(?:[-/.]\d{1,2})?\s*(?:-|–|—|to|tot|until)\s*"
    r"((?:19|20)\d{2}(?:[-/.]\d{1,2})?|present|now|current|heden|nu|huidig)"
)
CURRENT = r"present|now|current|heden|nu|huidig"
BODY_STOP = r"^(education|opleiding|skills|vaardigheden|languages|talen)\b"
TITLE_SPLIT = r"\s+(?:at|bij|@)\s+|\s+[|–—]\s+|,\s+"
TOP_TITLES = (
    ("executive", r"\b(head|director|chief|cto|vp)\b"),
    ("lead", r"\b(lead|manager|principal|teamleider|leidinggevende)\b"),
)
DEGREES = (
    (8, r"\b(phd|ph\.d|doctorate|promotie)\b"),
    (7, r"\b(msc|m\.sc|master|ma\b|wo\b|university of|universiteit)"),
    (6, r"\b(bsc|b\.sc|bachelor|hbo|university of applied sciences|hogeschool)"),
    (4, r"\bmbo\b"),
)
LANGUAGE_HEADING = r"^(languages|talen|language skills)\b"
SUMMARY_HEADING = r"^(profile|profiel|summary|samenvatting|about me|over mij)\b"
NEXT_HEADING = r"^[A-Z][A-Za-z ]{2,30}:?$"
# --- end of fixed values ----------------------------------------------------------------


def ws(pattern: str) -> str:
    return pattern.replace(r"\s", BLANK)


def cv_blocks(text: Column, year: int, body_lines: int | None = None) -> Column:
    """Experience blocks of one text: a line with a year range opens a block.

    array<struct<k, title, org, start, end, is_current, body, from, to>>; offsets are 0-based
    characters. ``body_lines`` keeps so many lines of a body, by default all. Everything happens
    inside the row, so no shuffle is needed.
    """
    span = java(ws(YEAR_RANGE), True)

    def block(lines: Column, starts: Column, s: Column, k: Column) -> Column:
        line = F.get(lines, s)
        stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
        rest = F.regexp_replace(line, r"(?s)^(.*?)(?:" + span + ")", "$1")
        rest = F.regexp_replace(rest, ws(r"[()|,–—-]+\s*$"), "")
        head = js_trim(F.regexp_replace(rest, ws(r"^[-•*\s]+").replace(f"[-•*{BLANK}]", f"(?:[-•*]|{BLANK})"), ""))
        body = F.filter(
            F.transform(F.slice(lines, s + 2, stop - s - 1), js_trim), lambda x: (x != "") & ~has(x, BODY_STOP)
        )

        def offset(i: Column) -> Column:
            return F.length(F.array_join(F.slice(lines, F.lit(1), i), "\n")) + F.when(i > 0, 1).otherwise(0)

        def made(parts: Column, years: Column) -> Column:
            until = years["until"]
            return let(has(until, CURRENT), lambda current: F.struct(
                k.alias("k"), js_trim(F.get(parts, F.lit(0))).alias("title"),
                F.nullif(js_trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit("")).alias("org"),
                years["since"].cast("int").alias("start"),
                F.when(current, year).otherwise(F.left(until, F.lit(4)).try_cast("int")).alias("end"),
                current.alias("is_current"), (body if body_lines is None else F.slice(body, 1, body_lines)).alias("body"),
                offset(s).alias("from"), offset(stop).alias("to"),
            ))

        years = F.struct(F.regexp_extract(line, span, 1).alias("since"), F.regexp_extract(line, span, 2).alias("until"))
        return let(F.split(head, "(?i)" + ws(TITLE_SPLIT), -1), lambda parts: let(years, lambda y: made(parts, y)))

    def blocks(lines: Column) -> Column:
        all_places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(span))
        return let(all_places, lambda starts: F.transform(starts, lambda s, k: block(lines, starts, s, k)))

    return let(F.split(text, "\n", -1), blocks)


def block_rows(cvs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per block. A plain explode adds a filter on the blocks, which is pushed to the scan and makes them twice."""
    rows = cvs.select(doc_id, F.explode_outer("blocks").alias("b"))
    return rows.filter(F.col("b").isNotNull()).select(doc_id, "b.*")


def section(text: Column, heading: str) -> Column:
    """Lines under the first matching heading up to the next heading-like line; "" without one."""

    def cut(lines: Column) -> Column:
        hit = F.array_position(F.transform(lines, lambda x: has(js_trim(x), heading)), True)
        none = F.array().cast("array<string>")
        return let(let(hit, lambda h: F.when(h > 0, F.slice(lines, (h + 1).cast("int"), F.size(lines))).otherwise(none)), until_heading)

    def until_heading(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda x: js_trim(x).rlike(NEXT_HEADING)), True)
        return let(stop, lambda s: F.array_join(F.when(s > 0, F.slice(rest, F.lit(1), (s - 1).cast("int"))).otherwise(rest), "\n"))

    return let(F.split(text, "\n", -1), cut)


def summary(text: Column) -> Column:
    lines = F.split(section(text, SUMMARY_HEADING), "\n", -1)
    return js_trim(F.array_join(F.slice(lines, 1, 3), " "))


def education_level(text: Column) -> Column:
    return first_class(text, DEGREES).cast("int")


def cv_seniority(blocks: Column) -> Column:
    """From the title of the current (else first) block, otherwise from total years."""
    title = F.coalesce(F.get(F.filter(blocks, lambda b: b["is_current"]), F.lit(0))["title"], F.get(blocks, F.lit(0))["title"])
    years = F.aggregate(F.transform(blocks, lambda b: F.greatest(F.lit(0), b["end"] - b["start"])), F.lit(0), lambda a, x: a + x)
    by_years = F.when(F.size(blocks) == 0, F.lit(None).cast("string")).when(years >= 6, "senior").when(years >= 2, "medior").otherwise("junior")
    return F.coalesce(first_class(title, TOP_TITLES), by_years)


def skill_recency(cvs: DataFrame, entries: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, uri, label, last_used_year, evidence): end of the block that names the skill.

    Outside any block the newest end counts. ``cvs`` has the columns text and blocks.
    """
    found = find_concepts(cvs, entries, doc_id, "text").join(cvs.select(doc_id, "blocks").hint("merge"), doc_id)
    inside = F.filter("blocks", lambda b: (F.col("index") >= b["from"]) & (F.col("index") < b["to"]))
    home = F.get(inside, F.lit(0))
    newest = F.array_max(F.transform("blocks", lambda b: b["end"]))
    return found.select(
        doc_id, "uri", "label", "index", F.coalesce(home["end"], newest).alias("last_used_year"),
        F.coalesce(home["title"], F.col("label")).alias("evidence"),
    )


def cv_languages(cvs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Languages with a level from the language section, else from the whole text."""
    part = section(F.col("text"), LANGUAGE_HEADING)
    rows = cvs.select(doc_id, F.when(part != "", part).otherwise(F.col("text")).alias("part"))
    return mentioned_languages(rows, doc_id, "part", None, False).drop("required")


def ground_cv(cvs: DataFrame, entries: DataFrame, occupations: DataFrame, doc_id: str = "doc_id"):
    """(skills, experiences, languages) of parsed CVs with taxonomy ids.

    Skills keep their first mention per concept; experiences get the occupation named in the
    title; unknown languages are dropped.
    """
    skills = skill_recency(cvs, entries, doc_id)
    rows = block_rows(cvs, doc_id)
    titles = rows.select("title").distinct().withColumn("t", F.col("title"))
    jobs = best_concept(find_concepts(titles, occupations.drop("isco_code"), "t", "title"), "t").select(
        F.col("t").alias("title"), F.col("uri").alias("occupation_uri")
    )
    codes = occupations.select(F.col("uri").alias("occupation_uri"), "isco_code").distinct()
    exp = rows.join(jobs, "title", "left").join(codes, "occupation_uri", "left")
    return skills, exp, cv_languages(cvs, doc_id)


def label_key(uri: Column, label: Column) -> Column:
    return F.coalesce(uri, normalize_label(label))


# --- texts of a candidate that are embedded ------------------------------------------------


def candidate_texts(profiles: DataFrame, experiences: DataFrame, skills: DataFrame) -> DataFrame:
    """(user_id, pos, text): the redacted profile text of every candidate, whose ``pos`` is null, and that of each experience.

    ``profiles`` (user_id, headline, summary), ``experiences`` (user_id, pos, title, description) in the order of ``pos``,
    ``skills`` (user_id, label). A profile is its headline, summary, redacted experiences and labels, those that are there;
    experiences of users without a profile are left out.
    """
    lived = experiences.select("user_id", "pos", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("description", F.lit(""))).alias("text"))
    lived = redact_text(lived, "text")
    told = lived.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_lived"))
    named = skills.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("_labels"))
    f = profiles.select("user_id", "headline", "summary").join(told, "user_id", "left").join(named, "user_id", "left")
    each = F.concat(F.array("headline", "summary"), F.coalesce(F.col("_lived.text"), F.array().cast("array<string>")), F.array("_labels"))
    whole = F.array_join(F.filter(each, lambda x: x.isNotNull() & (x != "")), "\n")
    whole = redact_text(f.select("user_id", F.lit(None).cast(lived.schema["pos"].dataType).alias("pos"), whole.alias("text")), "text")
    return whole.unionByName(lived.join(profiles.select("user_id"), "user_id", "left_semi"))
