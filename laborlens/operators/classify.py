"""Heuristic classification of posting texts, as columns and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import let
from ..functions.text import BLANK, has, java, normalize_label
from .taxonomy import best_concept, find_concepts

# --- fixed values -----------------------------------------------------------------------
LANGUAGE_NAMES = {
    "nl": "dutch|nederlands|flemish",
    "en": "english|engels",
    "de": "german|duits|deutsch",
    "fr": "french|frans|français",
    "es": "spanish|spaans|español",
    "it": "italian|italiaans",
    "pt": "portuguese|portugees",
    "pl": "polish|pools",
    "tr": "turkish|turks",
    "ar": "arabic|arabisch",
    "hi": "hindi",
    "zh": "chinese|mandarin|chinees",
    "ru": "russian|russisch",
    "uk": "ukrainian|oekraïens",
}
LEVEL_WORDS = (
    ("C2", r"\b(C2|native|mother tongue|moedertaal|bilingual|tweetalig)\b"),
    ("C1", r"\b(C1|fluent|vloeiend|proficient|advanced|uitstekend)\b"),
    ("B2", r"\b(B2|good|goed|professional working|upper[- ]intermediate)\b"),
    ("B1", r"\b(B1|intermediate|redelijk|conversational)\b"),
    ("A2", r"\b(A2|basic|basis|elementary|beginner)\b"),
)
OPTIONAL_WORDS = r"plus|pré|\bpre\b|nice|bonus|advantage|voordeel|preferred"
NICE_MARKER = (
    r"nice to have|nice-to-have|\bpré\b|\bpre\b:|bonus points|preferred|pluspunten|een plus|is een pre"
    r"|would be a plus|bonus:"
)
REMOTE_PHRASES = (
    ("remote", r"fully remote|100% remote|remote[- ]first|volledig (?:vanuit huis|thuis|remote)|work from anywhere"),
    (
        "hybrid",
        r"hybrid|hybride|\d days? (?:a week )?(?:in|at) the office|dagen (?:per week )?op kantoor|deels thuis|thuiswerken",
    ),
    ("onsite", r"on[- ]site|op locatie|on location|in de winkel|in het ziekenhuis|op de werkvloer"),
)
EMPLOYMENT_PHRASES = (
    ("full_time", r"full[- ]?time|fulltime|voltijd"),
    ("part_time", r"part[- ]?time|parttime|deeltijd"),
    ("freelance", r"freelance|\bzzp\b|interim"),
    ("internship", r"internship|\bstage\b|stagiair"),
    ("temporary", r"temporary|tijdelijk|fixed[- ]term"),
)
# what a text must hold, in lower case, for the phrases above; without i, k and s, which match further letters
EMPLOYMENT_PARTS = {
    "full_time": ("full", "volt"), "part_time": ("part", "deelt"), "freelance": ("freelance", "zzp", "nter"),
    "internship": ("ntern", "tag"), "temporary": ("temporar", "jdel", "xed"),
}
HOURS_RANGE = r"(\d{2})\s*(?:-|–|tot|to)\s*(\d{2})\s*(?:uur|hours|hrs|u\b)"
HOURS_SINGLE = r"(\d{2})\s*(?:uur|hours|hrs)(?:\s*(?:per|p\/)\s*(?:week|w))?"
EDUCATION_REQUIRED = (
    (
        7,
        r"(?:\bwo\b|master'?s?|msc|universitair)[- ]?(?:diploma|degree|opleiding)?\s*(?:is\s*)?"
        r"(?:vereist|verplicht|required|mandatory)",
    ),
    (6, r"(?:\bhbo\b|bachelor'?s?|bsc)[- ]?(?:diploma|degree)\s*(?:is\s*)?(?:vereist|verplicht|required|mandatory)"),
    (4, r"\bmbo\b[- ]?(?:\d\s*)?(?:diploma)\s*(?:is\s*)?(?:vereist|verplicht|required)"),
)
TITLE_LEVELS = (
    ("intern", r"\b(intern|stagiair)\b"),
    ("junior", r"\b(junior|starter|graduate|trainee)\b"),
    ("executive", r"\b(head of|director|chief|cto|cfo|vp)\b"),
    ("lead", r"\b(lead|principal|manager|teamleider|staff)\b"),
    ("senior", r"\b(senior|sr\.?)\b"),
    ("medior", r"\b(medior|mid[- ]level)\b"),
)
VALUE_WORDS = (
    ("achievement", r"impact|challeng|uitdag|groei|growth|ambiti|ownership", 0.85),
    ("independence", r"autonom|zelfstandig|ownership|vrijheid|freedom|self[- ]directed", 0.85),
    ("recognition", r"career|carrière|doorgroei|recognition|waardering|leadership|promotion", 0.75),
    ("relationships", r"team|collega|colleague|samenwerk|collaborat|community", 0.8),
    ("support", r"training|coaching|mentor|begeleiding|opleidingsbudget|learning budget|onboarding", 0.85),
    (
        "working_conditions",
        r"flexib|thuiswerk|work[- ]life|balance|pensioen|pension|vakantiedagen|holiday|secondary benefits|arbeidsvoorwaarden",
        0.85,
    ),
)
# --- end of fixed values ----------------------------------------------------------------


def first_class(text: Column, classes: tuple, ignore_case: bool = True) -> Column:
    """Name of the first class whose words occur."""
    out = F.lit(None)
    for name, words in reversed(classes):
        out = F.when(has(text, words, ignore_case), F.lit(name)).otherwise(out)
    return out


def remote_policy(text: Column) -> Column:
    return first_class(text, REMOTE_PHRASES)


def employment(text: Column) -> Column:
    """Names of the employment types whose phrases occur; plain parts of them spare most texts the pattern."""

    def found(low: Column) -> Column:
        def may(name: str) -> Column:
            return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in EMPLOYMENT_PARTS[name]])

        return F.array_compact(F.array(*[F.when(may(n) & has(text, w), F.lit(n)) for n, w in EMPLOYMENT_PHRASES]))

    return let(F.lower(text), found)


def hours(text: Column) -> Column:
    """struct<min, max>: a range first, else one number; implausible hours are dropped."""
    two, one = (java(p.replace(r"\s", BLANK), True) for p in (HOURS_RANGE, HOURS_SINGLE))
    lo, hi, single = (F.regexp_extract(text, p, g).try_cast("double") for p, g in ((two, 1), (two, 2), (one, 1)))
    a, b = F.coalesce(lo, single), F.when(lo.isNotNull(), hi).otherwise(single)
    ok = a.between(4, 60)
    return F.struct(F.when(ok, a).alias("min"), F.when(ok, b).alias("max"))


def education_required(text: Column) -> Column:
    return first_class(text, tuple((n, w.replace(r"\s", BLANK)) for n, w in EDUCATION_REQUIRED)).cast("int")


def title_seniority(title: Column) -> Column:
    return first_class(title, TITLE_LEVELS)


def work_values(text: Column) -> Column:
    return F.struct(*[F.when(has(text, w), hit).otherwise(0.5).alias(n) for n, w, hit in VALUE_WORDS])


def language_level(line: Column) -> Column:
    known = first_class(line, LEVEL_WORDS)
    return F.coalesce(known, F.when(has(line, r"\bA1\b", False), "A1"))


def mentioned_languages(rows: DataFrame, doc_id: str, text: str, fallback: str | None, by_sentence: bool) -> DataFrame:
    """(doc_id, language, level, required): the first mention with a level of every language.

    Parts without any language name are dropped inside the row, before the explode.
    """
    anyone = java(r"\b(?:" + "|".join(LANGUAGE_NAMES.values()) + r")\b", True)
    outer = F.split(F.col(text), r"[.\n]") if by_sentence else F.array(F.col(text))
    numbered = F.transform(outer, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    kept = F.filter(numbered, lambda x: x["s"].rlike(anyone))
    sentences = rows.select(doc_id, F.explode(kept).alias("x"))
    lines = F.transform(F.split("x.s", r"\n|;|,(?![^(]*\))"), lambda s, i: F.struct(i.alias("j"), s.alias("line")))
    parts = sentences.select(doc_id, "x.i", F.col("x.s").alias("sentence"), F.explode(lines).alias("y")).select(
        doc_id, "i", "sentence", "y.j", "y.line"
    )
    codes = F.array_compact(
        F.array(*[F.when(has(F.col("line"), rf"\b(?:{names})\b"), F.lit(c)) for c, names in LANGUAGE_NAMES.items()])
    )
    level = F.coalesce(language_level(F.col("line")), F.lit(fallback))
    hits = parts.withColumn("level", level).filter(F.col("level").isNotNull()).withColumn("language", F.explode(codes))
    first = hits.groupBy(doc_id, "language").agg(F.min_by(F.struct("level", "sentence"), F.struct("i", "j")).alias("m"))
    return first.select(
        doc_id, "language", F.col("m.level").alias("level"), (~has(F.col("m.sentence"), OPTIONAL_WORDS)).alias("required")
    )


def nice_start(text: Column) -> Column:
    """0-based start of the first nice-to-have marker, -1 without one."""
    return F.regexp_instr(F.lower(text), F.lit(java(NICE_MARKER))) - 1


def posting_skills(docs: DataFrame, entries: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Concepts of a posting with importance: nice after a nice-to-have marker, must otherwise."""
    marks = docs.select(doc_id, nice_start(F.col(text)).alias("_nice"))
    found = find_concepts(docs, entries, doc_id, text).join(marks, doc_id)
    nice = (F.col("_nice") >= 0) & (F.col("index") > F.col("_nice"))
    return found.withColumn("importance", F.when(nice, "nice").otherwise("must")).drop("_nice")


def confidence(skill_count: Column) -> Column:
    return F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.1) * F.least(skill_count, F.lit(4)).cast("double"))


def grounded_confidence(raw: Column, has_occupation: Column, skill_count: Column) -> Column:
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    return clamped * F.when(has_occupation, 1.0).otherwise(0.7) * F.when(skill_count == 0, 0.6).otherwise(1.0)


def ground_labels(raw: DataFrame, entries: DataFrame, doc_id: str) -> DataFrame:
    """Free labels (doc_id, pos, label, importance) to concepts.

    An equal label first, else the only concept named inside the label. Repeated concepts
    merge and keep ``must``; labels without a concept are returned with a null uri.
    """
    texts = raw.select("label").distinct()
    exact = texts.join(entries.select("norm", "uri"), normalize_label(F.col("label")) == F.col("norm")).groupBy("label").agg(
        F.min("uri").alias("exact")
    )
    inside = _inside(texts, entries)
    rows = raw.join(exact, "label", "left").join(inside, "label", "left")
    rows = rows.withColumn("uri", F.coalesce("exact", "inside"))
    mapped = rows.filter(F.col("uri").isNotNull()).groupBy(doc_id, "uri").agg(
        F.min("pos").alias("pos"), F.max(F.col("importance") == "must").alias("_must")
    )
    mapped = mapped.select(doc_id, "uri", "pos", F.when(F.col("_must"), "must").otherwise("nice").alias("importance"), F.lit(None).cast("string").alias("unmapped"))
    lost = rows.filter(F.col("uri").isNull()).select(doc_id, "uri", "pos", "importance", F.col("label").alias("unmapped"))
    return mapped.unionByName(lost)


def unmapped_labels(raw: DataFrame, entries: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, cls_unmapped): the free labels of a posting that no concept answers to, in order."""
    lost = ground_labels(raw, entries, doc_id).filter(F.col("unmapped").isNotNull())
    return lost.groupBy(doc_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unmapped"))), lambda x: x["unmapped"]).alias("cls_unmapped"))


def _inside(texts: DataFrame, entries: DataFrame) -> DataFrame:
    keyed = texts.select(F.col("label").alias("text_id"), F.col("label").alias("text"))
    found = find_concepts(keyed, entries, "text_id", "text")
    single = found.groupBy("text_id").agg(F.count("*").alias("n"), F.min("uri").alias("inside")).filter("n = 1")
    return single.select(F.col("text_id").alias("label"), "inside")


def classify(docs: DataFrame, skills: DataFrame, occupations: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per posting (doc_id, title, description) with every classified field.

    ``skills`` and ``occupations`` are label entries; ``occupations`` also carries ``isco_code``.
    """
    base = docs.select(doc_id, "title", F.concat_ws("\n", "title", "description").alias("_text"))
    t, title = F.col("_text"), F.col("title")
    flat = base.select(
        doc_id, remote_policy(t).alias("cls_remote"), employment(t).alias("cls_employment"), hours(t).alias("cls_hours"),
        education_required(t).alias("cls_min_eqf"), title_seniority(title).alias("cls_seniority"), work_values(t).alias("cls_values"),
    )
    named = posting_skills(base, skills, doc_id, "_text").groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("index", "uri", "label", "importance"))).alias("cls_skills")
    )
    langs = mentioned_languages(base, doc_id, "_text", "B2", True).groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("language", "level", "required"))).alias("cls_languages")
    )
    codes = occupations.select("uri", "isco_code").distinct()
    job = best_concept(find_concepts(base, occupations, doc_id, "title"), doc_id).join(codes, "uri", "left").select(
        doc_id, F.col("uri").alias("cls_occupation"), F.col("isco_code").alias("cls_isco")
    )
    out = flat.join(named, doc_id, "left").join(langs, doc_id, "left").join(job, doc_id, "left")
    n = F.coalesce(F.size("cls_skills"), F.lit(0))
    return out.withColumn("cls_confidence", grounded_confidence(confidence(n), F.col("cls_occupation").isNotNull(), n))
