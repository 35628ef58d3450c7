"""Declared field mappings for generic feeds, compiled to columns.

A mapping is ``{field: {path | template, transform, default}}``. Items are variants, so paths need
no schema; one select maps a whole table and every row keeps its own list of errors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numbers as N, text as X
from .feeds import UNITS, canonical, salary_struct

REQUIRED = ("externalId", "title", "description")


def at(item: Column, path: str) -> Column:
    path = path if path.startswith("$") else f"$.{path}"
    return F.try_variant_get(item, path, "string")


def array_at(item: Column, path: str) -> Column:
    path = path if path.startswith("$") else f"$.{path}"
    return F.try_variant_get(item, path, "array<string>")


def template_value(item: Column, template: str) -> Column:
    """``{{path}}`` holes filled with values, missing ones with nothing; a blank result is null."""
    pieces = re.split(r"\{\{\s*([^}]+?)\s*\}\}", template)
    cols = [F.lit(p) if i % 2 == 0 else F.coalesce(at(item, p), F.lit("")) for i, p in enumerate(pieces)]
    whole = F.concat(*cols)
    return F.when(X.js_trim(whole) != "", whole)


def number_of(text: Column) -> Column:
    """Digits with the first comma as decimal point; a text without any digits is 0."""
    kept = F.regexp_replace(text, r"[^\d.,-]", "")
    dotted = F.regexp_replace(kept, r"^([^,]*),", "$1.")
    return F.when(kept == "", 0.0).otherwise(dotted.try_cast("double"))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[,;|]"), X.js_trim), lambda x: x != "")


def bare_domain(text: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(text, r"^https?://", ""), r"^www\.", "")
    return F.lower(F.substring_index(host, "/", 1))


TRANSFORMS = {
    "none": lambda s: s,
    "trim": X.js_trim,
    "html_to_text": X.html_to_text,
    "lowercase": lambda s: X.js_trim(F.lower(s)),
    "number": number_of,
    "date": X.parse_date,
    "split_comma": split_list,
    "salary_text": lambda s: s,
    "remote_text": X.remote_class,
    "employment_text": X.employment_types,
    "domain": bare_domain,
}


def rule_value(item: Column, rule: dict) -> Column:
    """Value of one rule: path or template, transform, then the default for null or empty."""
    if rule.get("template"):
        raw = template_value(item, rule["template"])
    elif rule.get("path"):
        many = F.array_join(array_at(item, rule["path"]), ", ")
        raw = F.coalesce(many, at(item, rule["path"]))
    else:
        raw = F.lit(None).cast("string")
    out = F.when(raw.isNotNull(), TRANSFORMS[rule.get("transform", "none")](raw))
    if "default" in rule:
        blank = out.isNull()
        if rule.get("transform") not in ("split_comma", "employment_text", "date", "number"):
            blank = blank | (out == "")
        out = F.when(blank, F.lit(rule["default"])).otherwise(out)
    return out


def map_items(items: DataFrame, item: str, fields: dict[str, dict]) -> DataFrame:
    """Canonical row and ``errors`` per item; required fields that are empty give an error."""
    v = {f: rule_value(F.col(item), r) for f, r in fields.items()}

    def text(name: str) -> Column:
        c = v.get(name)
        return F.lit(None).cast("string") if c is None else F.nullif(c.cast("string"), F.lit(""))

    def num(name: str) -> Column:
        return text(name).try_cast("double")

    errors = F.array_compact(
        F.array(*[F.when(text(f).isNull(), F.lit(f"{f}: required field is empty")) for f in REQUIRED])
    )
    listed = fields.get("employmentTypes", {}).get("transform") in ("split_comma", "employment_text")
    types = v["employmentTypes"] if listed else X.employment_types(F.coalesce(text("employmentTypes"), F.lit("")))
    if fields.get("employmentTypes", {}).get("transform") == "split_comma":
        known = F.array(*[F.lit(e) for e in N.EMPLOYMENT])
        types = F.flatten(
            F.transform(types, lambda x: F.when(F.array_contains(known, x), F.array(x)).otherwise(X.employment_types(x)))
        )
    phrase = text("salaryText")
    parsed = N.salary_from_text(phrase)
    work = items.withColumn("_parsed", F.when(phrase.isNotNull(), parsed)).withColumn("errors", errors)
    lo, hi = (F.coalesce(num(n), F.col(f"_parsed.{k}")) for n, k in (("salaryMin", "min"), ("salaryMax", "max")))
    unit = F.lower(text("salaryUnit"))
    unit = F.when(unit.isin(*UNITS), unit).otherwise(F.col("_parsed.unit"))
    remote = text("remotePolicy")
    remote = F.when(remote.isin(*N.REMOTE_POLICIES), remote).otherwise(X.remote_class(remote))
    return canonical(
        work, [*items.columns, "errors"],
        external_id=text("externalId"), title=X.js_trim(text("title")), description=X.html_to_text(text("description")),
        company_name=text("companyName"), company_domain=text("companyDomain"), apply_url=text("applyUrl"),
        source_url=text("applyUrl"), city=text("city"), region=text("region"), postal_code=text("postalCode"),
        country=F.left(F.upper(text("country")), F.lit(2)), remote_policy=remote,
        employment_types=F.array_distinct(F.coalesce(types, F.array().cast("array<string>"))),
        hours_min=num("hoursMin"), hours_max=num("hoursMax"),
        salary=salary_struct(lo.isNotNull() | hi.isNotNull(), lo, hi, F.coalesce(text("salaryCurrency"), F.lit("EUR")), unit, phrase),
        date_posted=X.parse_date(text("datePosted")), valid_through=X.parse_date(text("validThrough")),
        language=F.lower(F.left(text("language"), F.lit(2))),
    )


def accepted(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.size("errors") == 0).drop("errors")


def rejected(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.size("errors") > 0).select("external_id", "errors")
