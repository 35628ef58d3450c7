"""Validated candidates and postings from stored rows with JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N

PREFERENCES = (
    "desiredOccupations array<struct<uri:string,iscoCode:string,label:string>>, location struct<lat:double,lng:double,city:string>,"
    " maxTravelMinutes double, travelMode string, remote string, minSalaryMonth double, hoursMin double, hoursMax double,"
    " employmentTypes array<string>, companySizes array<string>, companyTypes array<string>"
)
# Everything the matching step may see of a candidate; other columns never pass.
ALLOWED = (
    "user_id", "skills", "languages", "preferences", "seniority", "education_level", "experience_codes", "riasec", "work_values",
)
PROTECTED = (
    "name", "firstName", "lastName", "fullName", "age", "birthDate", "dateOfBirth", "gender", "sex", "photo", "photoUrl",
    "avatar", "nationality", "citizenship", "ethnicity", "religion", "address", "email", "phone", "maritalStatus",
)


def allow(df: DataFrame) -> DataFrame:
    """Keep allow-listed columns only."""
    return df.select(*[c for c in ALLOWED if c in df.columns])


def allow_json(text: Column, schema: str) -> Column:
    """Nested allow-list: parse by schema, so unknown fields vanish at every level."""
    return F.from_json(text, schema)


def within(values: Column, allowed: tuple[str, ...]) -> Column:
    known = F.array(*[F.lit(a) for a in allowed])
    return F.coalesce(F.forall(values, lambda x: F.array_contains(known, x)), F.lit(True))


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    return value.isNull() | value.isin(*allowed)


def is_json(text: Column, path: str, *kinds: str) -> Column:
    """True when the field is absent, null, or has one of the given JSON kinds."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return kind.isNull() | F.regexp_replace(kind, r"\(.*", "").isin("VOID", *kinds)


def preferences(text: Column) -> Column:
    """Parsed preferences, or null as a whole when any field breaks its rule."""
    p = F.from_json(text, PREFERENCES)
    number = ("BIGINT", "DECIMAL", "DOUBLE")
    minutes = p["maxTravelMinutes"]
    kinds = F.lit(True)
    for f in ("maxTravelMinutes", "minSalaryMonth", "hoursMin", "hoursMax"):
        kinds = kinds & is_json(text, f"$.{f}", *number)
    ok = (
        F.try_parse_json(text).isNotNull() & kinds
        & (minutes.isNull() | (minutes.between(5, 240) & (minutes == F.floor(minutes))))
        & one_of(p["travelMode"], N.TRAVEL_MODES) & one_of(p["remote"], (*N.REMOTE_POLICIES, "any"))
        & (p["minSalaryMonth"].isNull() | p["minSalaryMonth"].between(0, 50000))
        & (p["hoursMin"].isNull() | p["hoursMin"].between(0, 60)) & (p["hoursMax"].isNull() | p["hoursMax"].between(0, 60))
        & within(p["employmentTypes"], N.EMPLOYMENT) & within(p["companySizes"], N.COMPANY_SIZES)
        & within(p["companyTypes"], N.COMPANY_TYPES)
        & (p["location"].isNull() | (p["location"]["lat"].isNotNull() & p["location"]["lng"].isNotNull()))
        & F.coalesce(F.forall(p["desiredOccupations"], lambda o: o["uri"].isNotNull() & o["iscoCode"].isNotNull()), F.lit(True))
    )
    return F.when(ok, p)


def elements(text: Column) -> Column:
    """Elements of a JSON array as variants; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<variant>"), F.array().cast("array<variant>"))


def string_at(v: Column, path: str) -> Column:
    """A string field, null when it is missing or not a JSON string."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def posting_skills(text: Column) -> Column:
    """Valid skills of a JSON array; bad elements are dropped one by one."""
    made = F.transform(
        elements(text),
        lambda v: F.struct(string_at(v, "$.uri").alias("uri"), string_at(v, "$.label").alias("label"), string_at(v, "$.importance").alias("importance")),
    )
    return F.filter(made, lambda s: s["uri"].isNotNull() & s["importance"].isin("must", "nice"))


def language_demands(text: Column) -> Column:
    made = F.transform(
        elements(text),
        lambda v: F.struct(
            string_at(v, "$.language").alias("language"), string_at(v, "$.level").alias("level"),
            F.try_variant_get(v, "$.required", "boolean").alias("required"),
        ),
    )
    return F.filter(made, lambda s: s["language"].isNotNull() & s["level"].isin(*N.CEFR) & s["required"].isNotNull())


def all_numbers(text: Column, names: tuple[str, ...]) -> Column:
    """struct of doubles, null unless every name is present."""
    s = F.from_json(text, ", ".join(f"{n} double" for n in names))
    whole = F.lit(True)
    for n in names:
        whole = whole & s[n].isNotNull()
    return F.when(whole, s)


def riasec(text: Column) -> Column:
    return all_numbers(text, N.RIASEC)


def value_profile(text: Column) -> Column:
    return all_numbers(text, N.WORK_VALUES)


def value_ranking(text: Column) -> Column:
    """Six known values; repeats are allowed when reading."""
    r = F.from_json(text, "array<string>")
    return F.when((F.size(r) == len(N.WORK_VALUES)) & within(r, N.WORK_VALUES), r)


def candidate_rows(profiles: DataFrame, skills: DataFrame, experiences: DataFrame, languages: DataFrame) -> DataFrame:
    """One validated, allow-listed candidate per profile row."""
    s = skills.filter(F.col("uri").isNotNull()).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "uri", "label", "last_used_year"))).alias("skills")
    )
    e = experiences.filter(F.col("isco_code") != "").groupBy("user_id").agg(F.array_sort(F.collect_set("isco_code")).alias("experience_codes"))
    lang = languages.filter(F.col("level").isin(*N.CEFR)).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("language", "level"))).alias("languages")
    )
    f = profiles.join(s, "user_id", "left").join(e, "user_id", "left").join(lang, "user_id", "left")
    f = f.withColumns(
        {
            "preferences": preferences(F.coalesce("preferences", F.lit("{}"))),
            "riasec": riasec(F.col("riasec")),
            "work_values": value_ranking(F.col("work_values")),
        }
    )
    return allow(f)


def posting_rows(jobs: DataFrame, companies: DataFrame, occupations: DataFrame) -> DataFrame:
    """One posting per row; interests from the occupation, values from the row else the occupation."""
    c = companies.select("company_id", F.struct("name", "size", "type").alias("company"))
    o = occupations.select("occupation_uri", riasec(F.col("riasec")).alias("riasec"), value_profile(F.col("work_values")).alias("_ov"))
    edu = F.from_json("education_requirement", "min_eqf int")["min_eqf"]
    f = jobs.join(c, "company_id", "left").join(o, "occupation_uri", "left")
    return f.select(
        "job_id", "title", posting_skills(F.col("skills_json")).alias("skills"),
        language_demands(F.col("languages_json")).alias("languages"), "company", "riasec",
        F.coalesce(value_profile(F.col("work_values")), "_ov").alias("work_values"),
        F.when(edu.between(1, 8), edu).alias("min_eqf"),
    )
