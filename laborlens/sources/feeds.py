"""Posting feeds: readers of landed files and mappings to the canonical columns.

Every source is a ``read_*`` that yields one raw record per row and a ``map_*`` that turns raw
records into canonical postings, so a mapping works the same on files, tables and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X

SALARY = "struct<min:double,max:double,currency:string,unit:string,text:string,is_estimate:boolean>"
CANONICAL = {
    "external_id": "string", "title": "string", "description": "string", "company_name": "string",
    "company_domain": "string", "apply_url": "string", "source_url": "string", "city": "string", "region": "string",
    "postal_code": "string", "country": "string", "lat": "double", "lng": "double", "remote_policy": "string",
    "employment_types": "array<string>", "hours_min": "double", "hours_max": "double", "salary": SALARY,
    "date_posted": "date", "valid_through": "timestamp", "language": "string",
}

ADZUNA = (
    "id string, title string, description string, created string, redirect_url string, company struct<display_name:string>,"
    " location struct<display_name:string,area:array<string>>, latitude double, longitude double, salary_min double,"
    " salary_max double, salary_is_predicted string, contract_time string, contract_type string"
)
GREENHOUSE = (
    "id string, title string, updated_at string, first_published string, absolute_url string, company_name string,"
    " location struct<name:string>, offices array<struct<name:string>>, metadata array<struct<name:string,value:string>>, content string"
)
LEVER = (
    "id string, text string, createdAt bigint, hostedUrl string, applyUrl string, country string, workplaceType string,"
    " categories struct<location:string,commitment:string>, description string, descriptionPlain string,"
    " additionalPlain string, lists array<struct<text:string,content:string>>,"
    " salaryRange struct<min:double,max:double,currency:string,interval:string>"
)
RECRUITEE = (
    "id string, title string, description string, requirements string, city string, postal_code string, country_code string,"
    " remote boolean, hybrid boolean, on_site boolean, employment_type_code string, min_hours double, max_hours double,"
    " published_at string, created_at string, updated_at string, careers_url string, careers_apply_url string,"
    " salary struct<min:string,max:string,period:string,currency:string>, company_name string, status string"
)
PERSONIO = (
    "id string, subcompany string, office string, name string, employmentType string, schedule string, createdAt string,"
    " jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"
)
# --- fixed values -----------------------------------------------------------------------
LEVER_INTERVALS = {
    "per-year-salary": "year",
    "per-month-salary": "month",
    "per-week-salary": "week",
    "per-day-wage": "day",
    "per-hour-wage": "hour",
}
UNITS = ("hour", "day", "week", "month", "year")
# --- end of fixed values ----------------------------------------------------------------


def changed_at(source: str) -> tuple[Column, bool]:
    """When a raw record of a source was changed, and whether records without that date pass a filter on it."""
    if source == "lever":
        return F.timestamp_millis("createdAt"), False
    if source == "greenhouse":
        return F.try_to_timestamp("updated_at"), False
    if source == "recruitee":
        return F.try_to_timestamp(F.nullif(F.coalesce("updated_at", "published_at", "created_at"), F.lit(""))), True
    if source == "personio":
        return F.try_to_timestamp(F.nullif("createdAt", F.lit(""))), True
    if source == "adzuna":
        return F.try_to_timestamp("created"), False
    raise ValueError(f"no date of change is known for {source}")


def changed_since(raw: DataFrame, source: str, since: Column | None, now: Column | None = None) -> DataFrame:
    """Records changed at ``since`` or later; all of them without it.

    Aggregated pages are asked for by whole days of age, at least one and 30 without ``since``, counted from
    ``now``. Where a source keeps records without a date, one that is no date is dropped.
    """
    at, keep_undated = changed_at(source)
    if source == "adzuna":
        if now is None:
            return raw
        days = F.lit(30) if since is None else F.greatest(F.lit(1), F.ceil((F.unix_micros(now) - F.unix_micros(since)) / F.lit(86_400_000_000)))
        return raw.filter(at >= now - F.make_dt_interval(days=days.cast("int")))
    if since is None:
        return raw
    if not keep_undated:
        return raw.filter(at >= since)
    given = F.coalesce("updated_at", "published_at", "created_at") if source == "recruitee" else F.col("createdAt")
    return raw.filter(F.coalesce(given, F.lit("")).eqNullSafe("") | (at >= since))


def _pages(spark: SparkSession, path: str, field: str, schema: str, lines: bool) -> DataFrame:
    """Records of the array ``field`` of landed JSON pages: one page a file, or one a line."""
    pages = spark.read.schema(f"{field} array<struct<{_fields(schema)}>>").json(path, multiLine=not lines)
    return pages.select(F.explode(field).alias("r")).select("r.*")


def read_adzuna(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _pages(spark, path, "results", ADZUNA, lines)


def read_greenhouse(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _pages(spark, path, "jobs", GREENHOUSE, lines)


def read_lever(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of landed arrays of postings; a line may also hold one array."""
    if lines:
        page = F.from_json("value", f"array<struct<{_fields(LEVER)}>>")
        return spark.read.text(path).select(F.explode(page).alias("r")).select("r.*")
    return spark.read.schema(LEVER).json(path, multiLine=True)


def read_recruitee(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return _pages(spark, path, "offers", RECRUITEE, lines)


def read_personio(spark: SparkSession, path: str) -> DataFrame:
    """Positions of landed XML feeds; a file is cut at its positions, so a large one is read by many tasks."""
    return spark.read.format("xml").option("rowTag", "position").schema(PERSONIO).load(path)


def read_feed_items(spark: SparkSession, path: str, fmt: str, items: str, schema: str, lines: bool = False) -> DataFrame:
    """Items of a generic feed: an array field of JSON documents or a repeated XML element."""
    if fmt == "xml":
        return spark.read.format("xml").option("rowTag", items).option("attributePrefix", "attr_").schema(schema).load(path)
    return _pages(spark, path, items, schema, lines)


def _fields(ddl: str) -> str:
    """``a string, b struct<..>`` to the ``a:string,b:struct<..>`` of a nested type."""
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            word = ""
        else:
            word += ch
    return ",".join(out)


def canonical(raw: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """Select the canonical columns in order; those a source lacks are null."""
    made = [
        (columns[n] if n in columns else F.lit(None)).cast(kind).alias(n) for n, kind in CANONICAL.items()
    ]
    return raw.select(*(keep or []), *made)


def salary_struct(present: Column, lo: Column, hi: Column, currency: Column, unit: Column, text: Column | None = None,
                  estimate: Column | None = None) -> Column:
    none = F.lit(None)
    return F.when(
        present,
        F.struct(
            lo.alias("min"), hi.alias("max"), currency.alias("currency"), unit.alias("unit"),
            (none.cast("string") if text is None else text).alias("text"),
            (F.lit(False) if estimate is None else estimate).alias("is_estimate"),
        ),
    )


def lookup(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def truthy(x: Column) -> Column:
    return F.coalesce(x.cast("double") != 0, F.lit(False))


def map_adzuna(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    area = F.col("location.area")
    place = F.substring_index("location.display_name", ",", 1)
    lo, hi = F.col("salary_min"), F.col("salary_max")
    return canonical(
        raw, keep,
        external_id=F.col("id"), title=X.html_to_text(F.col("title")), description=X.html_to_text(F.col("description")),
        company_name=F.col("company.display_name"), apply_url=F.col("redirect_url"), source_url=F.col("redirect_url"),
        city=F.when(F.size(area) >= 3, F.element_at(area, -1)).otherwise(place), region=F.get(area, F.lit(1)),
        country=F.lit("NL"), lat=F.col("latitude"), lng=F.col("longitude"),
        employment_types=X.employment_types(F.concat_ws(" ", "contract_time", "contract_type")),
        salary=salary_struct(truthy(lo) | truthy(hi), lo, hi, F.lit("EUR"), F.lit("year"),
                             estimate=F.coalesce(F.col("salary_is_predicted") == "1", F.lit(False))),
        date_posted=X.parse_date(F.col("created")),
    )


def map_greenhouse(raw: DataFrame, company: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Metadata names are matched without case; the last of equal names counts."""
    meta = F.coalesce("metadata", F.array().cast("array<struct<name:string,value:string>>"))

    def fact(*names: str) -> Column:
        def last(name: str) -> Column:
            return F.try_element_at(F.filter(meta, lambda m: F.lower(m["name"]) == name), F.lit(-1))["value"]

        return F.coalesce(*[last(n) for n in names], F.lit(""))

    place = F.coalesce("location.name", F.get("offices", F.lit(0))["name"])
    return canonical(
        raw, keep,
        external_id=F.col("id"), title=X.js_trim(F.col("title")), description=X.html_to_text(F.col("content")),
        company_name=F.coalesce("company_name", F.lit(company)), apply_url=F.col("absolute_url"), source_url=F.col("absolute_url"),
        city=F.nullif(X.js_trim(F.get(F.split(place, r"[,/–-]"), F.lit(0))), F.lit("")),
        remote_policy=X.remote_class(F.concat_ws(" ", F.coalesce(place, F.lit("")), fact("workplace type", "remote"))),
        employment_types=X.employment_types(fact("employment type", "employment_type")),
        date_posted=X.parse_date(F.coalesce("first_published", "updated_at")),
    )


def map_lever(raw: DataFrame, company: str | None = None, keep: list[str] | None = None) -> DataFrame:
    lists = F.array_join(
        F.transform(
            F.coalesce("lists", F.array().cast("array<struct<text:string,content:string>>")),
            lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n"), X.html_to_text(x["content"])),
        ),
        "\n\n",
    )
    body = F.filter(
        F.array(F.coalesce("descriptionPlain", X.html_to_text(F.col("description"))), lists, F.col("additionalPlain")),
        lambda p: p.isNotNull() & (p != ""),
    )
    s = F.col("salaryRange")
    return canonical(
        raw, keep,
        external_id=F.col("id"), title=X.js_trim(F.col("text")), description=X.js_trim(F.array_join(body, "\n\n")),
        company_name=F.lit(company), apply_url=F.coalesce("applyUrl", "hostedUrl"), source_url=F.col("hostedUrl"),
        city=X.js_trim(F.substring_index("categories.location", ",", 1)), country=F.col("country"),
        remote_policy=F.nullif("workplaceType", F.lit("unspecified")),
        employment_types=X.employment_types(F.coalesce("categories.commitment", F.lit(""))),
        salary=salary_struct(truthy(s["min"]) | truthy(s["max"]), s["min"], s["max"], s["currency"], lookup(s["interval"], LEVER_INTERVALS)),
        date_posted=F.timestamp_millis("createdAt"),
    )


def map_recruitee(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Published offers only."""
    live = raw.filter(F.col("status").isNull() | F.col("status").isin("", "published"))
    body = F.filter(F.array(X.html_to_text(F.col("description")), X.html_to_text(F.col("requirements"))), lambda p: p != "")
    s = F.col("salary")
    lo, hi = s["min"].try_cast("double"), s["max"].try_cast("double")
    given = (F.coalesce(s["min"], F.lit("")) != "") | (F.coalesce(s["max"], F.lit("")) != "")
    return canonical(
        live, keep,
        external_id=F.col("id"), title=X.js_trim(F.col("title")), description=F.array_join(body, "\n\n"),
        company_name=F.col("company_name"), apply_url=F.coalesce("careers_apply_url", "careers_url"), source_url=F.col("careers_url"),
        city=F.col("city"), postal_code=F.col("postal_code"), country=F.upper("country_code"),
        remote_policy=F.when(F.col("hybrid"), "hybrid").when(F.col("remote"), "remote").when(F.col("on_site"), "onsite"),
        employment_types=X.employment_types(F.regexp_replace(F.coalesce("employment_type_code", F.lit("")), "_", " ")),
        hours_min=F.col("min_hours"), hours_max=F.col("max_hours"),
        salary=salary_struct(given, lo, hi, s["currency"], F.when(s["period"].isin(*UNITS), s["period"])),
        date_posted=X.parse_date(F.coalesce("published_at", "created_at")),
    )


def map_personio(raw: DataFrame, company: str, domain: str = "de", language: str = "en", keep: list[str] | None = None) -> DataFrame:
    parts = F.transform(
        F.coalesce("jobDescriptions.jobDescription", F.array().cast("array<struct<name:string,value:string>>")),
        lambda d: X.js_trim(F.concat(F.coalesce(d["name"], F.lit("")), F.lit("\n"), X.html_to_text(d["value"]))),
    )
    url = F.concat(F.lit(f"https://{company}.jobs.personio.{domain}/job/"), "id")
    kind = F.when(F.col("employmentType") == "intern", "internship").otherwise(F.coalesce("employmentType", F.lit("")))
    return canonical(
        raw, keep,
        external_id=F.col("id"), title=X.js_trim(F.col("name")), description=F.array_join(parts, "\n\n"),
        company_name=F.coalesce(F.nullif("subcompany", F.lit("")), F.lit(company)), apply_url=url, source_url=url,
        city=F.col("office"), employment_types=X.employment_types(F.concat_ws(" ", F.coalesce("schedule", F.lit("")), kind)),
        date_posted=X.parse_date(F.col("createdAt")), language=F.lit(language[:2]),
    )
