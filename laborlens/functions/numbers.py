"""Number columns: rounding, salary, geography, vectors, ordinal scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .text import BLANK

# --- fixed values -----------------------------------------------------------------------
CEFR = ("A1", "A2", "B1", "B2", "C1", "C2")
SENIORITY = ("intern", "junior", "medior", "senior", "lead", "executive")
RIASEC = ("R", "I", "A", "S", "E", "C")
WORK_VALUES = (
    "achievement", "independence", "recognition", "relationships", "support", "working_conditions",
)
REMOTE_POLICIES = ("onsite", "hybrid", "remote")
EMPLOYMENT = ("full_time", "part_time", "contract", "temporary", "internship", "freelance")
COMPANY_SIZES = ("micro", "small", "medium", "large", "enterprise")
COMPANY_TYPES = ("startup", "scaleup", "sme", "corporate", "public", "nonprofit", "agency")
TRAVEL_MODES = ("public_transport", "car", "bike")
HOLIDAY_FACTOR = 1.08
EARTH_RADIUS_KM = 6371.0
# mode: detour factor, km/h, overhead minutes
TRAVEL = {"public_transport": (1.2, 75.0, 20.0), "car": (1.3, 70.0, 8.0), "bike": (1.25, 16.0, 3.0)}
SENIORITY_FIT = (1.0, 0.8, 0.5, 0.2)
# agreement weights by position of a letter in the person's and the job's code; 28 at most
IACHAN = ((22, 10, 4), (10, 5, 2), (4, 2, 1))
SALARY_NUMBER = r"€?\s?(\d{1,3}(?:[.,\s]\d{3})+|\d+(?:[.,]\d{1,2})?)\s?(k)?"
SALARY_UNIT_WORDS = (
    ("hour", r"per uur|\/ ?uur|per hour|\/ ?h(ou)?r|hourly|uurloon"),
    ("day", r"per dag|per day|daily|dagtarief"),
    ("week", r"per week|weekly"),
    ("month", r"per maand|p\/m|p\.m\.|per month|monthly|maandelijks|\/ ?mnd|\/ ?month"),
    ("year", r"per jaar|per year|annual|yearly|jaarsalaris|p\/j|\/ ?jaar|\/ ?year|pa(?![A-Za-z0-9_])"),
)
# --- end of fixed values ----------------------------------------------------------------


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (Spark repeats an expression per mention,
    and inside a lambda even per element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_up(x: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: halves go up, also for values just below one."""
    m = F.lit(float(10**digits))
    return F.floor(x * m + F.lit(0.5)).cast("double") / m


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def ordinal(value: Column, scale: tuple[str, ...]) -> Column:
    """0-based place on an ordered scale, null when not on it."""
    place = F.array_position(F.array(*[F.lit(s) for s in scale]), value)
    return F.when(place > 0, (place - 1).cast("int"))


def cefr_meets(actual: Column, required: Column, tolerance: int = 0) -> Column:
    return F.coalesce(ordinal(actual, CEFR) >= ordinal(required, CEFR) - tolerance, F.lit(False))


def seniority_fit(a: Column, b: Column) -> Column:
    gap = F.abs(ordinal(a, SENIORITY) - ordinal(b, SENIORITY))
    fit = F.lit(SENIORITY_FIT[3])
    for d in (2, 1, 0):
        fit = F.when(gap == d, SENIORITY_FIT[d]).otherwise(fit)
    return F.when(gap.isNotNull(), fit)


def isco_similarity(a: Column, b: Column) -> Column:
    out = F.lit(0.0)
    for n in (1, 2, 3, 4):
        same = (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))
        out = F.when(same, n / 4).otherwise(out)
    return out


def holland_code(dims: list[Column]) -> Column:
    """Top three letters of six scores, ties in scale order."""
    scored = F.array(
        *[
            F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k"))
            for i, (k, v) in enumerate(zip(RIASEC, dims))
        ]
    )
    return F.transform(F.slice(F.array_sort(scored), 1, 3), lambda s: s["k"])


def riasec_congruence(person: Column, job: Column) -> Column:
    """Agreement of two three-letter codes, 0..1."""

    def agree(p: Column, j: Column) -> Column:
        total = F.lit(0)
        for i, row in enumerate(IACHAN):
            weights = F.array(*[F.lit(w) for w in row])
            place = F.array_position(j, F.get(p, F.lit(i)))
            total = total + F.coalesce(F.get(weights, (place - 1).cast("int")), F.lit(0))
        return total.cast("double") / F.lit(28.0)

    return let(person, lambda p: let(job, lambda j: agree(p, j)))


def value_weight(ranking: Column, value: str) -> Column:
    """Rank weight 6/21 .. 1/21 of one value; the last mention counts, unranked is 0."""
    n = len(WORK_VALUES)
    head = F.slice(ranking, 1, n)
    from_end = F.array_position(F.reverse(head), value)
    place = F.size(head) - from_end  # 0-based place of the last mention
    return F.when(from_end > 0, (F.lit(n) - place).cast("double") / F.lit(n * (n + 1) / 2)).otherwise(0.0)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    rad = math.pi / 180

    def square(c: Column) -> Column:
        return c * c

    h = square(F.sin((lat2 - lat1) * rad / 2)) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * square(
        F.sin((lng2 - lng1) * rad / 2)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def travel_minutes(km: Column, mode: Column) -> Column:
    """Door-to-door estimate: straight line x detour at a speed plus overhead."""
    mode = F.coalesce(mode, F.lit("public_transport"))
    out = F.lit(None).cast("double")
    for name, (detour, kmh, overhead) in TRAVEL.items():
        out = F.when(mode == name, km * detour / kmh * 60.0 + overhead).otherwise(out)
    return F.when(km < 0.5, 5.0).otherwise(half_up(out, 0))


# --- salary -----------------------------------------------------------------------------


def salary_unit_guess(amount: Column) -> Column:
    return (
        F.when(amount < 200, "hour")
        .when(amount < 1500, "week")
        .when(amount < 15000, "month")
        .when(amount.isNotNull(), "year")
    )


def salary_monthly(amount: Column, unit: Column, hours: Column) -> Column:
    hours = F.coalesce(hours, F.lit(40.0))
    return (
        F.when(unit == "hour", amount * hours * 52.0 / 12.0)
        .when(unit == "day", amount * 5.0 * 52.0 / 12.0)
        .when(unit == "week", amount * 52.0 / 12.0)
        .when(unit == "month", amount)
        .when(unit == "year", amount / F.lit(12 * HOLIDAY_FACTOR))
    )


def salary_from_text(text: Column) -> Column:
    """struct<min, max, unit> of a Dutch or English salary phrase."""
    pattern = F.lit(SALARY_NUMBER.replace(r"\s", BLANK))

    def value(raw: Column, k: Column) -> Column:
        solid = F.regexp_replace(raw, BLANK, "")
        grouped = solid.rlike(r"^\d{1,3}([.,]\d{3})+$")
        digits = F.when(grouped, F.translate(solid, ".,", "")).otherwise(F.regexp_replace(solid, ",", "."))
        return digits.cast("double") * F.when(k == "k", 1000.0).otherwise(1.0)

    def parse(t: Column) -> Column:
        raws, kilos = (F.regexp_extract_all(t, pattern, F.lit(g)) for g in (1, 2))
        unit = F.lit(None).cast("string")
        for name, words in reversed(SALARY_UNIT_WORDS):
            unit = F.when(t.rlike(words), name).otherwise(unit)
        return let(
            F.filter(F.zip_with(raws, kilos, value), lambda n: n >= 5),
            lambda n: F.struct(
                F.get(n, F.lit(0)).alias("min"), F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0))).alias("max"), unit.alias("unit")
            ),
        )

    return let(F.regexp_replace(F.lower(text), rf"{BLANK}+", " "), parse)


def salary_normalize(
    lo: Column, hi: Column, unit: Column, currency: Column, text: Column, hours: Column
) -> Column:
    """struct<min_month, max_month> in gross EUR a month; both null when not plausible."""
    silent = lo.isNull() & hi.isNull()

    def month(x: Column, u: Column) -> Column:
        return F.when(x > 0, half_up(salary_monthly(x, u, hours), 0))

    def raw(parsed: Column) -> Column:
        low = F.when(silent, parsed["min"]).otherwise(lo)
        high = F.when(silent, parsed["max"]).otherwise(hi)
        return F.struct(
            low.alias("lo"), high.alias("hi"),
            F.coalesce(unit, parsed["unit"], salary_unit_guess(F.coalesce(high, low))).alias("u"),
        )

    def monthly(r: Column) -> Column:
        return F.struct(month(r["lo"], r["u"]).alias("a"), month(r["hi"], r["u"]).alias("b"))

    def plausible(x: Column) -> Column:
        return x.isNull() | x.between(800, 40000)

    euro = currency.isNull() | (currency == "") | (F.upper(currency) == "EUR")

    def checked(m: Column) -> Column:
        a, b = m["a"], m["b"]
        swap = (a > 0) & (b > 0) & (a > b)
        ok = euro & plausible(a) & plausible(b)
        return F.struct(
            F.when(ok, F.when(swap, b).otherwise(a)).alias("min_month"), F.when(ok, F.when(swap, a).otherwise(b)).alias("max_month")
        )

    parsed = salary_from_text(F.when(silent, text))
    return let(parsed, lambda p: let(raw(p), lambda r: let(monthly(r), checked)))


# --- vectors ----------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def cosine(a: Column, b: Column) -> Column:
    na, nb = dot(a, a), dot(b, b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / F.sqrt(na * nb)).otherwise(0.0)


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    norm = F.when(norm > 0, norm).otherwise(1.0)
    return F.transform(v, lambda x: x.cast("double") / norm)


def vector_literal(v: Column) -> Column:
    """Text form with six decimals; values that are not finite become 0."""

    def one(x: Column) -> Column:
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, "0").otherwise(F.format_string("%.6f", x.cast("double")))

    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.from_json(F.when(text.startswith("["), text), "array<double>")
