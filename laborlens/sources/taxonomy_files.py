"""Taxonomy files: one nested JSON document, or the CSV export with relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SKILL = "uri:string,preferredLabelEn:string,preferredLabelNl:string,altLabels:array<string>,skillType:string,broaderUris:array<string>"
OCCUPATION = "uri:string,code:string,iscoCode:string,preferredLabelEn:string,preferredLabelNl:string,altLabels:array<string>"
TYPES = ("skill/competence", "knowledge", "language", "transversal")


def none_list() -> Column:
    return F.array().cast("array<string>")


def read_taxonomy_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    doc = spark.read.schema(f"skills array<struct<{SKILL}>>, occupations array<struct<{OCCUPATION}>>").json(path, multiLine=True)
    return taxonomy_tables(doc)


def taxonomy_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skills, occupations) of nested documents, defaults filled in."""
    s = doc.select(F.explode("skills").alias("s")).select("s.*")
    skills = s.select(
        "uri", F.col("preferredLabelEn").alias("label_en"), F.col("preferredLabelNl").alias("label_nl"),
        F.coalesce("altLabels", none_list()).alias("alt_labels"), F.coalesce("skillType", F.lit(TYPES[0])).alias("skill_type"),
        F.coalesce("broaderUris", none_list()).alias("broader_uris"),
    )
    o = doc.select(F.explode("occupations").alias("o")).select("o.*").filter(F.col("iscoCode").rlike(r"^\d{4}$"))
    occupations = o.select(
        "uri", "code", F.col("iscoCode").alias("isco_code"), F.col("preferredLabelEn").alias("label_en"),
        F.col("preferredLabelNl").alias("label_nl"), F.coalesce("altLabels", none_list()).alias("alt_labels"),
    )
    return skills, occupations


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def split_labels(text: Column) -> Column:
    """Alternative labels separated by line ends or bars."""
    parts = F.filter(F.transform(F.split(text, r"\n|\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, none_list())


def skills_from_rows(english: DataFrame, dutch: DataFrame, broader: DataFrame) -> DataFrame:
    nl = dutch.groupBy("conceptUri").agg(F.max("preferredLabel").alias("label_nl"))
    up = broader.filter((F.col("conceptUri") != "") & (F.col("broaderUri") != "")).groupBy("conceptUri").agg(
        F.array_sort(F.collect_list("broaderUri")).alias("broader_uris")
    )
    f = english.join(nl, "conceptUri", "left").join(up, "conceptUri", "left")
    return f.select(
        F.col("conceptUri").alias("uri"), F.col("preferredLabel").alias("label_en"), "label_nl",
        split_labels(F.col("altLabels")).alias("alt_labels"),
        F.when(F.col("skillType") == "knowledge", "knowledge").otherwise(TYPES[0]).alias("skill_type"),
        F.coalesce("broader_uris", none_list()).alias("broader_uris"),
    )


def occupations_from_rows(english: DataFrame, dutch: DataFrame) -> DataFrame:
    nl = dutch.groupBy("conceptUri").agg(F.max("preferredLabel").alias("label_nl"))
    f = english.filter(F.col("iscoGroup").rlike(r"^\d{4}$")).join(nl, "conceptUri", "left")
    return f.select(
        F.col("conceptUri").alias("uri"), F.nullif("code", F.lit("")).alias("code"), F.col("iscoGroup").alias("isco_code"),
        F.col("preferredLabel").alias("label_en"), "label_nl", split_labels(F.col("altLabels")).alias("alt_labels"),
    )


def read_taxonomy_csv(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    def part(name: str) -> DataFrame:
        return read_csv(spark, f"{folder}/{name}.csv")

    skills = skills_from_rows(part("skills_en"), part("skills_nl"), part("broaderRelationsSkillPillar"))
    return skills, occupations_from_rows(part("occupations_en"), part("occupations_nl"))
