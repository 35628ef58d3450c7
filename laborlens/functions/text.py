"""Text columns: normalisation, HTML to text, URLs, keyword classes, redaction."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# JavaScript-style classes written out for Java: \s includes the Unicode blanks, \b is ASCII.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BLANK_SET = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Spell an ASCII-word-boundary pattern so that the JVM reads it the same way."""
    flags = ("iu" if ignore_case else "") + ("m" if multiline else "")
    return (f"(?{flags})" if flags else "") + pattern.replace(r"\b", EDGE)


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(java(pattern, ignore_case))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


# --- fixed values -----------------------------------------------------------------------
TITLE_HOURS = r"\b\d{1,2}\s*(?:[-–]|tot|to)\s*\d{1,2}\s*(?:uur|hours|u)\b"
TITLE_NOISE = (
    r"\((?:m\/v\/x|m\/v|v\/m|m\/f\/d|m\/w\/d|f\/m\/x|m\/f|all genders|h\/f)\)"
    r"|\b(?:m\/v\/x|m\/f\/d|m\/w\/d)\b"
    r"|\b(?:vacature|vacancy|job|gezocht|wanted|urgent|nieuw|new)\b|[!*|]"
)
COMPANY_SUFFIX = (
    r"\b(b\.?v\.?|n\.?v\.?|v\.?o\.?f\.?|gmbh|ltd|llc|inc|holding|group|groep|nederland|netherlands)\b\.?"
)
CAREER_HOST_PREFIX = r"^(jobs|careers|werkenbij|karriere|apply)\."
TRACKING_PARAM = r"^(utm_[a-z]+|gclid|fbclid|ref|source|src|campaign|trk|mc_[a-z]+|_ga)$"
CREDENTIAL_PARAM = r"([?&](?:app_key|app_id|api_key|key|token|secret)=)[^&]+"
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "euro": "€",
    "rsquo": "’",
    "lsquo": "‘",
    "ndash": "–",
    "mdash": "—",
    "hellip": "…",
}
REMOTE_WORDS = (
    ("hybrid", r"hybrid|hybride"),
    ("remote", r"remote|thuiswerk|work from home|wfh|anywhere"),
    ("onsite", r"on[- ]?site|office|kantoor|op locatie"),
)
EMPLOYMENT_WORDS = (
    ("full_time", r"full[\s_-]?time|fulltime|voltijd"),
    ("part_time", r"part[\s_-]?time|parttime|deeltijd"),
    ("freelance", r"freelance|zzp|contractor|interim"),
    ("internship", r"intern(ship)?|stage|trainee"),
    ("temporary", r"temporary|temp\b|tijdelijk|fixed[- ]term"),
)
CONTRACT_WORD = r"\bcontract\b"
# --- end of fixed values ----------------------------------------------------------------


@pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x))


def nfkd(text: Column) -> Column:
    """Compatibility decomposition; Spark has no built-in for it, so one Arrow batch call."""
    return _nfkd(text)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def normalize_plain(text: Column) -> Column:
    """Lower-cased letters and digits, marks removed, single blanks."""
    base = F.lower(F.regexp_replace(nfkd(text), r"[\u0300-\u036F]", ""))
    return _squeeze(F.regexp_replace(base, rf"[^\p{{L}}\p{{N}}{BLANK_SET}]", " "))


def normalize_label(text: Column) -> Column:
    """Like :func:`normalize_plain`, but ``+ # .`` stay and dashes part words."""
    base = F.lower(F.regexp_replace(nfkd(text), r"[\u0300-\u036F]", ""))
    kept = F.regexp_replace(base, rf"[^\p{{L}}\p{{N}}+#.{BLANK_SET}-]", " ")
    return _squeeze(F.translate(kept, "-_/", "   "))


def normalize_title(title: Column) -> Column:
    quiet = F.regexp_replace(title, java(TITLE_HOURS, True), " ")
    plain = normalize_plain(F.regexp_replace(quiet, java(TITLE_NOISE, True), " "))
    plain = F.regexp_replace(plain, java(r"\bsr\b"), "senior")
    return F.regexp_replace(plain, java(r"\bjr\b"), "junior")


def normalize_company(name: Column) -> Column:
    return normalize_plain(F.regexp_replace(name, java(COMPANY_SUFFIX, True), " "))


def dedup_key(title: Column, company: Column, city: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws(
        "|",
        normalize_title(title),
        normalize_company(F.coalesce(company, blank)),
        normalize_plain(F.coalesce(city, blank)),
    )


def label_search_text(en: Column, nl: Column, alts: Column) -> Column:
    blank = F.lit("")
    return F.lower(
        F.concat(
            en, F.lit(" "), F.coalesce(nl, blank), F.lit(" "),
            F.coalesce(F.array_join(alts, " "), blank),
        )
    )


def short_label(label: Column) -> Column:
    return js_trim(F.regexp_replace(label, rf"{BLANK}*\([^)]*\){BLANK}*", " "))


def tidy_blanks(text: Column) -> Column:
    """NBSP to blank, runs of blanks to one, three or more line ends to two."""
    t = F.regexp_replace(F.translate(text, "\u00a0", " "), r"[ \t]+", " ")
    return js_trim(F.regexp_replace(t, rf"\n{BLANK}*\n{BLANK}*\n+", "\n\n"))


# --- URLs -------------------------------------------------------------------------------

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_domain(value: Column) -> Column:
    full = F.when(F.contains(value, F.lit("://")), value).otherwise(
        F.concat(F.lit("https://"), value)
    )
    host = F.lower(F.regexp_extract(full, _URL, 2))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), CAREER_HOST_PREFIX, "")
    return F.when((value != "") & full.rlike(_URL) & ~host.rlike(BLANK), host)


def url_canonical(value: Column) -> Column:
    """No fragment, no ``www.``, no tracking parameters, sorted parameters, no end slash."""

    def part(i: int) -> Column:
        return F.regexp_extract(value, _URL, i)

    scheme, host = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    default_port = ((scheme == "http") & (part(3) == ":80")) | (
        (scheme == "https") & (part(3) == ":443")
    )
    port = F.when(default_port | (part(3) == ":"), "").otherwise(part(3))
    path = F.regexp_replace(part(4), r"/+$", "")
    pairs = F.filter(F.split(F.substr(part(5), F.lit(2)), "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.substring_index(p, "=", 1).alias("k"),
            i.alias("i"),
            F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p"),
        ),
    )
    kept = F.array_sort(F.filter(named, lambda s: ~s["k"].rlike("(?i)" + TRACKING_PARAM)))
    query = F.array_join(F.transform(kept, lambda s: s["p"]), "&")
    query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    whole = F.lower(F.concat(scheme, F.lit("://"), host, port, path, query))
    return F.when(value.rlike(_URL), whole)


def url_mask(url: Column) -> Column:
    return F.regexp_replace(url, "(?i)" + CREDENTIAL_PARAM, "$1***")


# --- HTML -------------------------------------------------------------------------------

_ENTITY = r"(?i)&(#x?[0-9a-f]+|[a-z]+);"


def decode_entities(text: Column) -> Column:
    """One pass over the entities: split around them, map each, join again (all JVM-side)."""
    names = F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv])

    def one(e: Column) -> Column:
        low = F.lower(e)
        digits = F.regexp_replace(low, r"^#x?", "")
        code = F.when(
            low.startswith("#x"), F.conv(digits, 16, 10).try_cast("long")
        ).when(low.rlike(r"^#[0-9]+$"), digits.try_cast("long"))
        valid = low.startswith("#") & code.isNotNull() & (F.length(digits) < 10) & (code <= 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")
        raw = F.concat(F.lit("&"), e, F.lit(";"))
        return F.when(valid, char).otherwise(F.coalesce(F.try_element_at(names, low), raw))

    found = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1)), one)
    between = F.split(text, _ENTITY)
    joined = F.array_join(
        F.zip_with(between, found, lambda b, e: F.concat(b, F.coalesce(e, F.lit("")))), ""
    )
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def html_to_text(html: Column) -> Column:
    html = F.coalesce(html, F.lit(""))
    doubly = html.rlike(rf"(?i)&lt;{BLANK}*/?{BLANK}*[a-z]")
    t = F.when(doubly, decode_entities(html)).otherwise(html)
    steps = (
        (r"(?is)<(script|style).*?</\1>", ""),
        (r"(?i)<li[^>]*>", "\n• "),
        (rf"(?i)<br{BLANK}*/?>", "\n"),
        (r"(?i)</(p|div|h[1-6]|ul|ol|section|tr)>", "\n"),
        (r"<[^>]+>", ""),
    )
    t = decode_entities(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, t))
    t = F.regexp_replace(t, r"[ \t\u00A0]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return js_trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


# --- keyword classes --------------------------------------------------------------------


def remote_class(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(REMOTE_WORDS):
        out = F.when(has(text, words), name).otherwise(out)
    return out


def employment_types(text: Column) -> Column:
    freelance = has(text, dict(EMPLOYMENT_WORDS)["freelance"])
    picks = [F.when(has(text, words), F.lit(name)) for name, words in EMPLOYMENT_WORDS]
    picks.append(F.when(has(text, CONTRACT_WORD) & ~freelance, F.lit("contract")))
    return F.coalesce(F.array_compact(F.array(*picks)), F.array().cast("array<string>"))


# --- dates ------------------------------------------------------------------------------


def parse_date(value: Column) -> Column:
    """Timestamp of an ISO-like text, null when it is not one."""
    return F.coalesce(
        F.try_to_timestamp(value),
        F.try_to_timestamp(value, F.lit("yyyy/MM/dd")),
        F.try_to_timestamp(value, F.lit("dd MMM yyyy")),
    )


def month_to_date(value: Column) -> Column:
    year = F.regexp_extract(value, r"^(\d{4})(?:-(\d{1,2}))?", 1)
    month = F.regexp_extract(value, r"^(\d{4})(?:-(\d{1,2}))?", 2)
    month = F.when(month == "", "1").otherwise(month)
    return F.when(
        year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01"))
    )


# --- redaction --------------------------------------------------------------------------

# --- fixed values -----------------------------------------------------------------------
PLACEHOLDER = {
    "name": "[NAME]",
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "url": "[PROFILE_URL]",
    "address": "[ADDRESS]",
    "postcode": "[POSTCODE]",
    "birthdate": "[REMOVED]",
    "personal_line": "[REMOVED]",
    "id_number": "[ID]",
}
PERSONAL_LINE_LABELS = (
    r"date of birth|birth ?date|born|d\.?o\.?b\.?|geboortedatum|geboren|geboorteplaats|place of birth|age|leeftijd"
    r"|nationality|nationaliteit|citizenship|staatsburgerschap|gender|sex|geslacht|marital status|burgerlijke staat"
    r"|civil status|religion|religie|geloof|photo|foto|driver'?s licen[cs]e number|bsn|social security"
    r"|burgerservicenummer|passport|paspoort"
)
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?<![\w/])(?:\+|0)(?:\d[\s().-]?){8,13}\d(?![\w/])"
PROFILE_URL = (
    r"\b(?:https?:\/\/)?(?:www\.)?(?:linkedin\.com|github\.com|facebook\.com|instagram\.com|x\.com|twitter\.com)\/[^\s)]+"
)
NL_POSTCODE = r"\b[1-9]\d{3}\s?(?!SA|SD|SS)[A-Z]{2}\b"
STREET = (
    r"\b[\p{L}][\p{L}'.-]+(?:\s[\p{L}'.-]+){0,3}\s?(?:straat|laan|weg|plein|gracht|kade|singel|dijk|pad|hof|dreef"
    r"|street|st\.|road|rd\.|avenue|ave\.|lane|boulevard)\s*\d{1,5}\s?[a-zA-Z]?\b"
)
BIRTH_PHRASE = r"\b(?:born|geboren)\s+(?:on\s+|op\s+)?\d{1,2}[-/. ]\w+[-/. ]\d{2,4}"
NINE_DIGITS = r"\b\d{9}\b"
NAME_PARTICLES = "van|de|der|den|ten|ter|von|da|di|el|al|bin|le|la"
SECTION_WORDS = (
    r"^(curriculum vitae|cv|resume|résumé|profile|profiel|summary|samenvatting|experience|werkervaring|education"
    r"|opleiding|skills|vaardigheden|languages|talen|contact|personal details|persoonlijke gegevens)$"
)
# --- end of fixed values ----------------------------------------------------------------

_REDACTIONS = (
    (
        "personal_line",
        java(rf"^{BLANK}*(?:[-•*]{BLANK}*)?(?:{PERSONAL_LINE_LABELS})\b.*$", True, True),
        None,
    ),
    ("birthdate", java(BIRTH_PHRASE.replace(r"\s", BLANK), True), r"(?i)born|geboren"),
    ("email", java(EMAIL), "@"),
    ("url", java(PROFILE_URL, True), r"(?i)\.com/"),
    (
        "address",
        java(STREET, True),
        r"(?iu)(?:straat|laan|weg|plein|gracht|kade|singel|dijk|pad|hof|dreef|street|st\.|road|rd\.|avenue|ave\."
        r"|lane|boulevard)\s*\d",
    ),
    ("postcode", java(NL_POSTCODE), r"\d{4}"),
    ("phone", java(PHONE), r"[+0]\d"),
    ("id_number", java(NINE_DIGITS), r"\d{9}"),
)


def redact_steps(df, text: str, names: str | None = None):
    """Add ``redacted`` and one ``n_<kind>`` count per kind; rules run in a fixed order.

    A cheap necessary pattern guards each costly rule, so most rows skip it.
    """
    work = df.withColumn("redacted", F.regexp_replace(F.col(text), r"\r\n?", "\n"))
    t = F.col("redacted")
    for kind, pattern, guard in _REDACTIONS:
        hit = F.lit(True) if guard is None else t.rlike(guard)
        work = work.withColumn(
            f"n_{kind}", F.when(hit, F.regexp_count(t, F.lit(pattern))).otherwise(0)
        ).withColumn(
            "redacted",
            F.when(F.col(f"n_{kind}") > 0, F.regexp_replace(t, pattern, PLACEHOLDER[kind])).otherwise(t),
        )
    work = work.withColumn("n_name", F.lit(0))
    if names is not None:
        parts = F.flatten(
            F.transform(
                F.coalesce(F.col(names), F.array().cast("array<string>")),
                lambda n: F.concat(
                    F.array(n),
                    F.filter(F.split(n, rf"{BLANK}+"), lambda p: F.length(p) > 2),
                ),
            )
        )

        def pattern_of(p: Column) -> Column:
            quoted = F.regexp_replace(p, r"([.*+?^${}()|\[\]\\])", r"\\$1")
            return F.concat(F.lit("(?iu)" + EDGE), quoted, F.lit(EDGE))

        start = F.struct(t.alias("t"), F.lit(0).alias("n"))
        folded = F.aggregate(
            parts,
            start,
            lambda acc, p: F.struct(
                F.regexp_replace(acc["t"], pattern_of(p), F.lit(PLACEHOLDER["name"])).alias("t"),
                (acc["n"] + F.regexp_count(acc["t"], pattern_of(p))).alias("n"),
            ),
        )
        work = (
            work.withColumn("_f", folded)
            .withColumn("redacted", F.col("_f.t"))
            .withColumn("n_name", F.col("_f.n"))
            .drop("_f")
        )
    # The first of the leading three lines that is not a heading may be a person's name.
    lines = F.split(t, "\n", -1)
    head = F.transform(F.slice(lines, 1, 3), js_trim)
    usable = F.transform(head, lambda x: (x != "") & ~x.rlike("(?iu)" + SECTION_WORDS))
    pos = F.array_position(usable, True)
    line = F.get(head, (pos - 1).cast("int"))
    word = rf"(?:(?iu:{NAME_PARTICLES})|\p{{Lu}}[\p{{L}}'’-]*\.?)"
    namelike = (
        (pos > 0)
        & (F.length(line) <= 60)
        & ~line.rlike(r"[\d@:]")
        & line.rlike(rf"^{word}(?:{BLANK}+{word}){{1,4}}$")
    )
    work = work.withColumn("_pos", F.when(namelike, pos).otherwise(0))
    work = work.withColumn(
        "redacted",
        F.when(
            F.col("_pos") > 0,
            F.array_join(
                F.transform(
                    lines,
                    lambda x, i: F.when(i + 1 == F.col("_pos"), PLACEHOLDER["name"]).otherwise(x),
                ),
                "\n",
            ),
        ).otherwise(t),
    ).withColumn("n_name", F.col("n_name") + (F.col("_pos") > 0).cast("int"))
    return work.withColumn(
        "redacted", js_trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    ).drop("_pos")


REDACTION_KINDS = tuple(PLACEHOLDER)


def redact_text(df, text: str, names: str | None = None):
    """Replace ``text`` by its redacted form and drop the counts."""
    work = redact_steps(df, text, names)
    return work.withColumn(text, F.col("redacted")).drop(
        "redacted", *[f"n_{k}" for k in REDACTION_KINDS]
    )
