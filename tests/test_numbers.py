import math

import pytest
from pyspark.sql import functions as F

from laborlens.functions import numbers as N


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize(
    "text, want",
    [
        ("€ 3.500 - € 4.500 bruto per maand", (3500, 4500, "month")),
        ("€45k–€55k per year", (45000, 55000, "year")),
        ("€ 22,50 per uur", (22.5, 22.5, "hour")),
        ("Marktconform salaris", (None, None, None)),
    ],
)
def test_salary_text(one, text, want):
    assert tuple(one(N.salary_from_text(F.col("x")), "x string", text)) == want


@pytest.mark.parametrize(
    "lo, hi, unit, currency, text, want",
    [
        (70000.0, 90000.0, "year", "EUR", None, (5401, 6944)),
        (4000.0, 3000.0, None, None, None, (3000, 4000)),
        (50000.0, 60000.0, "year", "USD", None, (None, None)),
        (1.0, 2.0, "month", None, None, (None, None)),
        (None, None, None, None, "€ 45.000 – € 55.000 per jaar", (3472, 4244)),
    ],
)
def test_salary_normalize(one, lo, hi, unit, currency, text, want):
    ddl = "lo double, hi double, unit string, currency string, text string, hours double"
    made = N.salary_normalize(*[F.col(c) for c in ("lo", "hi", "unit", "currency", "text", "hours")])
    assert tuple(one(made, ddl, lo, hi, unit, currency, text, None)) == want


def test_units(one):
    def month(amount, unit, hours=None):
        return one(N.half_up(N.salary_monthly(*[F.col(c) for c in "auh"]), 0), "a double, u string, h double", amount, unit, hours)

    assert month(64800.0, "year") == 5000
    assert (month(20.0, "hour", 40.0), month(20.0, "hour", 32.0)) == (3467, 2773)


def test_half_up_is_not_bankers(one):
    assert one(N.half_up(F.col("x"), 2), "x double", 1.005) == 1.0
    assert one(N.half_up(F.col("x"), 0), "x double", 2.5) == 3.0


def test_isco(one):
    def sim(b):
        return one(N.isco_similarity(F.lit("2521"), F.col("x")), "x string", b)

    assert [sim(b) for b in ("2521", "2522", "2511", "2221", "7411")] == [1, 0.75, 0.5, 0.25, 0]


def test_riasec(one):
    def m(a, b):
        return one(N.riasec_congruence(F.split(F.lit(a), ""), F.split(F.col("x"), "")), "x string", b)

    assert m("ICR", "ICR") == 1 and m("ICR", "SEA") == 0
    assert math.isclose(m("ICR", "ICE"), 27 / 28) and math.isclose(m("ICR", "CIR"), 21 / 28)


def test_holland_ties(one):
    dims = [F.lit(v) for v in (0.5, 0.9, 0.5, 0.5, 0.1, 0.1)]
    assert one(N.holland_code(dims), "x int", 1) == ["I", "R", "A"]


def test_value_weights(one):
    r = F.array(*[F.lit(v) for v in N.WORK_VALUES])
    got = [one(N.value_weight(r, v), "x int", 1) for v in N.WORK_VALUES]
    assert all(math.isclose(a, (6 - i) / 21) for i, a in enumerate(got)) and math.isclose(sum(got), 1)


def test_geo(one):
    ams, rot = (52.3676, 4.9041), (51.9244, 4.4777)
    km = one(N.haversine_km(*lit(*ams, *rot)), "x int", 1)
    assert 55 < km < 60
    minutes = one(N.travel_minutes(F.lit(km), F.lit(None).cast("string")), "x int", 1)
    assert 60 <= minutes <= 90
    assert one(N.travel_minutes(F.lit(0.0), F.lit("car")), "x int", 1) == 5


def test_vectors(one):
    v = F.array(*lit(3.0, 4.0))
    assert one(N.unit_vector(v), "x int", 1) == [0.6, 0.8]
    assert one(N.cosine(v, F.array(*lit(0.0, 0.0))), "x int", 1) == 0
    assert one(N.vector_literal(F.array(*lit(0.1, float("nan")))), "x int", 1) == "[0.100000,0]"
    assert one(N.parse_vector(F.col("x")), "x string", "[0.5,1]") == [0.5, 1.0]
