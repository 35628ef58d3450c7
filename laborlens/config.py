"""Matching model versions: weights, rules and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .functions.numbers import let

COMPONENTS = ("skills", "experience", "occupation", "interests", "values", "practical")
RULES = ("language", "location", "salary", "contract", "education")


@dataclass(frozen=True)
class ModelConfig:
    """Values of one model version. The defaults are the published first version."""

    weights: dict = field(
        default_factory=lambda: dict(zip(COMPONENTS, (35.0, 20.0, 15.0, 10.0, 10.0, 10.0)))
    )
    enabled: tuple = RULES
    language_tolerance: int = 0
    grace_minutes: float = 10.0
    hybrid_travel_factor: float = 1.25
    salary_tolerance_pct: float = 5.0
    strong: float = 75.0
    good: float = 60.0
    possible: float = 45.0
    must_weight: float = 2.0
    nice_weight: float = 1.0
    related_credit: float = 0.5
    recency: tuple = ((2, 1.0), (5, 0.8), (None, 0.6))
    unknown_recency: float = 0.85
    similarity_floor: float = 0.72
    similarity_ceil: float = 0.9
    limited_data_threshold: float = 0.35

    def skill_evidence_is_exact(self) -> bool:
        """True when no pair without a shared or related skill can reach ``possible``.

        Such a pair scores 0 on skills, so its total is at most 100 minus the skills weight:
        redistributing the weights of missing components only lowers that bound, because the
        skills component of a posting that lists skills is never missing. Totals are rounded to
        one decimal, hence the small margin.
        """
        return 100.0 - self.weights["skills"] < self.possible - 0.05


DEFAULT = ModelConfig()

# A skill-led version: of postings that list skills it keeps pairs only that share one.
SKILL_LED = ModelConfig(weights=dict(zip(COMPONENTS, (60.0, 10.0, 10.0, 5.0, 5.0, 10.0))))

CONFIG_SCHEMA = (
    "weights struct<skills double, experience double, occupation double, interests double,"
    " values double, practical double>,"
    " knockouts struct<language struct<enabled boolean, toleranceLevels int>,"
    " location struct<enabled boolean, graceMinutes double, hybridTravelFactor double>,"
    " salary struct<enabled boolean, tolerancePct double>,"
    " contract struct<enabled boolean>, education struct<enabled boolean>>,"
    " thresholds struct<strong double, good double, possible double>,"
    " skills struct<mustWeight double, niceWeight double, relatedCredit double,"
    " recency array<struct<maxYears double, factor double>>, unknownRecencyFactor double>,"
    " experience struct<similarityFloor double, similarityCeil double>,"
    " limitedDataThreshold double"
)


def validate_versions(versions: DataFrame, config: str = "config") -> DataFrame:
    """Check a whole table of JSON model versions; adds ``errors`` and ``is_valid``.

    A version is parsed once, whatever the number of checks that read it.
    """
    errors = let(F.from_json(F.col(config), CONFIG_SCHEMA), _errors)
    return versions.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def _errors(c: Column) -> Column:
    """Names of the rules that a parsed version breaks."""
    w = [c[f"weights"][k] for k in COMPONENTS]

    def rule(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    total = sum(w[1:], w[0])
    t, k, s, e = c["thresholds"], c["knockouts"], c["skills"], c["experience"]
    all_enabled = F.lit(True)
    for r in RULES:
        all_enabled = all_enabled & k[r]["enabled"].isNotNull()
    checks = [rule(f"weights.{n}", x.between(0, 100)) for n, x in zip(COMPONENTS, w)]
    checks += [
        rule("weights", F.abs(total - 100.0) < 0.001),
        rule("knockouts.enabled", all_enabled),
        rule("knockouts.language", k["language"]["toleranceLevels"].between(0, 2)),
        rule(
            "knockouts.location",
            k["location"]["graceMinutes"].between(0, 60)
            & k["location"]["hybridTravelFactor"].between(1, 3),
        ),
        rule("knockouts.salary", k["salary"]["tolerancePct"].between(0, 30)),
        rule(
            "thresholds",
            t["strong"].between(0, 100)
            & t["possible"].between(0, 100)
            & (t["strong"] > t["good"])
            & (t["good"] > t["possible"]),
        ),
        rule(
            "skills",
            (s["mustWeight"] > 0)
            & (s["niceWeight"] > 0)
            & s["relatedCredit"].between(0, 1)
            & s["unknownRecencyFactor"].between(0, 1)
            & (F.size(s["recency"]) >= 1)
            & F.forall(s["recency"], lambda b: b["factor"].between(0, 1)),
        ),
        rule(
            "experience",
            e["similarityFloor"].between(-1, 1)
            & e["similarityCeil"].between(-1, 1)
            & (e["similarityCeil"] > e["similarityFloor"]),
        ),
        rule("limitedDataThreshold", c["limitedDataThreshold"].between(0, 1)),
    ]
    return F.array_compact(F.array(*checks))
