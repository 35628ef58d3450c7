"""Everything that is stored about a person: one declared catalogue drives export, erasure and proof."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

EXPORT_CHUNK = 1000


class SubjectTable(NamedTuple):
    """A table with rows of persons.

    ``fields`` are what an export shows (empty: not exported), ``single`` says that a person has one row at most.
    ``on_erase`` is what erasure does: ``delete`` the rows, ``forget`` the person and keep the row, ``keep`` all.
    """

    name: str
    fields: tuple[str, ...] = ()
    single: bool = False
    key: str = "user_id"
    on_erase: str = "delete"


# --- fixed values: sections of an export and their fields, and what erasure does to each table
CATALOGUE = (
    SubjectTable("profile", ("email", "locale", "role", "created_at", "last_active_at"), single=True),
    SubjectTable("candidateProfile", (
        "headline", "summary", "seniority", "education_level", "preferences", "riasec", "riasec_answers", "work_values",
        "onboarding_completed_at", "parsed_cv", "created_at", "updated_at"), single=True),
    SubjectTable("skills", ("esco_uri", "label", "last_used_year", "evidence", "source", "confirmed", "created_at")),
    SubjectTable("experiences", (
        "title", "organisation", "esco_occupation_uri", "isco_code", "start_date", "end_date", "is_current", "description")),
    SubjectTable("languages", ("language", "level")),
    SubjectTable("cvFiles", ("version", "file_name", "mime_type", "size_bytes", "parse_status", "created_at")),
    SubjectTable("matches", (
        "job_id", "total_score", "label", "component_scores", "explanation", "knockouts", "knocked_out", "model_version_id",
        "input_hash", "created_at", "updated_at")),
    SubjectTable("matchFeedback", ("job_id", "type", "reason", "comment", "created_at")),
    SubjectTable("applications", ("job_id", "status", "notes", "saved_at", "applied_at", "interview_at", "offer_at", "rejected_at")),
    SubjectTable("alertSettings", ("enabled", "frequency", "min_score", "updated_at"), single=True),
    SubjectTable("consents", ("type", "granted", "policy_version", "created_at")),
    SubjectTable("deletionRequests", ("status", "requested_at", "processed_at"), on_erase="forget"),
    SubjectTable("alertDeliveries"),
    SubjectTable("employerAccounts"),
    SubjectTable("jobs", key="created_by", on_erase="forget"),
    SubjectTable("auditLog", key="actor_id", on_erase="keep"),
)
# --- end of fixed values


def known(tables: dict[str, DataFrame]) -> list[SubjectTable]:
    """Catalogue entries of the given tables; a table that the catalogue lacks is an error, not left out."""
    strange = set(tables) - {c.name for c in CATALOGUE}
    if strange:
        raise ValueError(f"not in the catalogue: {', '.join(sorted(strange))}")
    return [c for c in CATALOGUE if c.name in tables]


def exported_rows(entry: SubjectTable, table: DataFrame) -> DataFrame:
    """(user_id, row, spread): a struct of the exported fields, and a digest of the whole stored row.

    A field that the table lacks is null.
    """
    shown = [F.col(f) if f in table.columns else F.lit(None).cast("string").alias(f) for f in entry.fields]
    return table.select(F.col(entry.key).alias("user_id"), F.struct(*shown).alias("row"), F.xxhash64(*table.columns).alias("spread"))


def export_chunks(users: DataFrame, tables: dict[str, DataFrame], chunk: int = EXPORT_CHUNK) -> DataFrame:
    """(user_id, section, chunk, n, document): all rows of the users as JSON arrays; an object where a section has one row.

    A section of a user is cut into chunks of about ``chunk`` rows by the digests of its rows, so a user with very
    many rows is written by many tasks. Rows are counted before they are cut: sizes have one row per user. Rows that
    show the same are all kept. Of several rows in a section of one row the least is shown. Users are matched once
    however often they are listed.
    """
    ids, out = users.select("user_id").distinct(), None
    for entry in known(tables):
        if not entry.fields:
            continue
        mine = exported_rows(entry, tables[entry.name]).join(ids, "user_id", "left_semi")
        if entry.single:
            docs = mine.groupBy("user_id").agg(F.min("row").alias("_r")).select("user_id", F.lit(0).alias("chunk"), F.lit(1).cast("long").alias("n"), "_r")
        else:
            sizes = mine.groupBy("user_id").agg(F.ceil(F.count("*") / F.lit(float(chunk))).cast("int").alias("_chunks"))
            cut = mine.join(sizes, "user_id").withColumn("chunk", F.pmod(F.col("spread"), F.col("_chunks")).cast("int"))
            docs = cut.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("row")).alias("_r"))
        text = F.to_json("_r", {"ignoreNullFields": "false"}).alias("document")
        docs = docs.select("user_id", F.lit(entry.name).alias("section"), "chunk", "n", text)
        out = docs if out is None else out.unionByName(docs)
    return out


def export_documents(users: DataFrame, tables: dict[str, DataFrame], chunk: int = EXPORT_CHUNK) -> DataFrame:
    """(user_id, part, document): one nested JSON document per user with a field per section.

    Sections of one row are objects or null, the others arrays. A user whose sections are all within one chunk, as
    is usual, has the one part 0; further chunks of long sections follow as further parts with the same fields.
    Users without any row have a part 0 of empty sections.
    """
    chunks = export_chunks(users, tables, chunk).select("user_id", F.col("chunk").alias("part"), "section", "document")
    none = F.lit(None).cast("string")
    first = users.select("user_id").distinct().select("user_id", F.lit(0).alias("part"), none.alias("section"), none.alias("document"))
    sections = [c for c in known(tables) if c.fields]
    texts = [F.max(F.when(F.col("section") == c.name, F.col("document"))).alias(c.name) for c in sections]
    parts = chunks.unionByName(first).groupBy("user_id", "part").agg(*texts)
    fields = [F.concat(F.lit(f'"{c.name}":'), F.coalesce(F.col(c.name), F.lit("null" if c.single else "[]"))) for c in sections]
    return parts.select("user_id", "part", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("document"))


def erase(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Every table after the erasure of the users, as the catalogue says for it.

    Rows without a person stay. The ids of the users are matched once however often they are listed.
    """
    entries, out = known(tables), {}
    ids = users.select(F.col("user_id").alias("_gone")).filter(F.col("_gone").isNotNull()).distinct()
    for entry in entries:
        df = tables[entry.name]
        on = F.col(entry.key) == F.col("_gone")
        if entry.on_erase == "delete":
            df = df.join(ids, on, "left_anti")
        elif entry.on_erase == "forget":
            marked = df.join(ids, on, "left")
            df = marked.withColumn(entry.key, F.when(F.col("_gone").isNull(), F.col(entry.key))).select(*df.columns)
        out[entry.name] = df
    return out


def email_hash(email: Column, user_id: Column) -> Column:
    return F.sha2(F.lower(F.coalesce(email, user_id.cast("string"))), 256)


def erasure_proof(users: DataFrame) -> DataFrame:
    """The completed request that stays as proof: a hashed address and no id."""
    return users.select(email_hash(F.col("email"), F.col("user_id")).alias("email_hash"), F.lit("completed").alias("status"))


def erasure_audit(users: DataFrame, source: str, files: DataFrame | None = None) -> DataFrame:
    """One audit row per erased user; a user who asked for it is not named as actor."""
    who = users.select("user_id", email_hash(F.col("email"), F.col("user_id")).alias("_hash"))
    n = F.lit(0).cast("long")
    if files is not None:
        who = who.join(files.groupBy("user_id").agg(F.count("*").alias("_n")), "user_id", "left")
        n = F.coalesce("_n", n)
    role = {"admin": "admin", "retention": "system"}.get(source, "user")
    return who.select(
        F.lit(role).alias("actor_role"), F.lit("account.delete").alias("action"), F.lit("user").alias("entity_type"),
        F.left("_hash", F.lit(16)).alias("entity_id"), F.struct(F.lit(source).alias("source"), n.alias("cv_files")).alias("metadata"),
    )
