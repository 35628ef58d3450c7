"""Landed feed files, the incremental filter, audit rows, and enrichment as one path."""

import json

import pytest
from pyspark.sql import functions as F

from laborlens.operators import classify as C, ingest as I
from laborlens.sources import feeds as S, sinks as K


def test_pages_as_files_and_as_lines(spark, tmp_path):
    pages = [{"jobs": [{"id": 1, "title": "a"}, {"id": 2, "title": "b\nc"}]}, {"jobs": []}, {"jobs": [{"id": 3}]}]
    for name, texts in {"files": [json.dumps(p, indent=1) for p in pages], "lines": ["\n".join(map(json.dumps, pages))]}.items():
        (tmp_path / name).mkdir()
        for k, text in enumerate(texts):
            (tmp_path / name / f"{k}.json").write_text(text)
        rows = S.read_greenhouse(spark, str(tmp_path / name), lines=name == "lines").collect()
        assert sorted((r["id"], r["title"]) for r in rows) == [("1", "a"), ("2", "b\nc"), ("3", None)]
    (tmp_path / "lever").mkdir()
    (tmp_path / "lever" / "1.json").write_text('[{"id":"x"},{"id":"y"}]\n[]\n[{"id":"z"}]')
    assert sorted(r["id"] for r in S.read_lever(spark, str(tmp_path / "lever"), lines=True).collect()) == ["x", "y", "z"]


def test_a_feed_of_positions(spark, tmp_path):
    one = "<position><id>{0}</id><name>Job {0}</name><createdAt>2026-01-0{0}</createdAt></position>"
    (tmp_path / "feed.xml").write_text("<workzag-jobs>" + "".join(one.format(k) for k in (1, 2, 3)) + "</workzag-jobs>")
    raw = S.read_personio(spark, str(tmp_path))
    assert sorted(r["id"] for r in S.changed_since(raw, "personio", F.lit("2026-01-02").cast("timestamp")).collect()) == ["2", "3"]


@pytest.mark.parametrize("source, columns, undated", [
    ("greenhouse", "updated_at", False), ("recruitee", "updated_at,published_at,created_at", True), ("personio", "createdAt", True), ("adzuna", "created", False)])
def test_since(spark, source, columns, undated):
    names = columns.split(",")
    rows = [("new", "2026-05-03T10:00:00Z"), ("same", "2026-05-02T00:00:00Z"), ("old", "2026-05-01T23:59:59Z"), ("none", None), ("empty", ""), ("odd", "soon")]
    df = spark.createDataFrame(rows, "id string, d string").select("id", *[(F.col("d") if n == names[-1] else F.lit(None).cast("string")).alias(n) for n in names])
    since, now = F.lit("2026-05-02").cast("timestamp"), F.lit("2026-05-04").cast("timestamp")
    got = {r["id"] for r in S.changed_since(df, source, since, now).collect()}
    assert got == {"new", "same"} | ({"none", "empty"} if undated else set())
    everything = {r["id"] for r in S.changed_since(df, source, None, now).collect()}
    assert everything == ({"new", "same", "old"} if source == "adzuna" else {r[0] for r in rows})  # thirty days of pages


def test_since_of_milliseconds(spark):
    df = spark.createDataFrame([("new", 1_777_680_000_000), ("old", 1_777_679_999_999), ("none", None)], "id string, createdAt long")
    assert [r["id"] for r in S.changed_since(df, "lever", F.timestamp_millis(F.lit(1_777_680_000_000))).collect()] == ["new"]


def test_audit_is_parted_by_action(spark, tmp_path):
    path = str(tmp_path / "audit")
    pairs = spark.createDataFrame([(1, 2, 50.0, "good", False)], "user_id long, job_id long, total_score double, label string, knocked_out boolean")
    K.write_audit(K.match_audit(pairs, F.lit(3)), path)
    K.write_audit(K.decision_audit(spark.createDataFrame([(2, "rejected", None)], "job_id long, new_status string, note string")), path)
    rows = {r["action"]: r for r in spark.read.parquet(path).collect()}
    assert set(rows) == {"match.compute", "job.rejected"} and rows["match.compute"]["entity_id"] == "1:2"
    assert json.loads(rows["match.compute"]["metadata"]) == {"score": 50.0, "label": "good", "knocked_out": False}
    assert sorted(p.name for p in (tmp_path / "audit").iterdir() if p.is_dir()) == ["action=job.rejected", "action=match.compute"]


def test_enrichment_is_one_path(spark):
    rows = spark.createDataFrame(
        [(1, "Python developer", "We use python", "Acme", "https://www.acme.com/jobs/1", None), (2, "Python developer", "python", "ACME Europe", "https://acme.com/2", "fy"),
         (3, "Cook", "", None, None, None)],
        "doc_id long, title string, description string, company_name string, apply_url string, language string",
    ).selectExpr("*", "'Breda' AS city", "CAST(NULL AS STRING) AS remote_policy", "CAST(array() AS ARRAY<STRING>) AS employment_types", "CAST(NULL AS DOUBLE) AS hours_min",
                 "CAST(NULL AS DOUBLE) AS hours_max", "CAST(NULL AS DOUBLE) AS lat", "CAST(NULL AS DOUBLE) AS lng", "CAST(NULL AS STRING) AS region", "CAST(NULL AS STRING) AS country",
                 "named_struct('min', CAST(NULL AS DOUBLE), 'max', CAST(NULL AS DOUBLE), 'unit', CAST(NULL AS STRING), 'currency', 'EUR', 'text', CAST(NULL AS STRING)) AS salary")
    skills = spark.createDataFrame([("py", "python", "python", 0)], "uri string, label string, norm string, entry int")
    jobs = spark.createDataFrame([("dev", "developer", "developer", 0, "2512")], "uri string, label string, norm string, entry int, isco_code string")
    free = spark.createDataFrame([(1, k, f"zq{k}", "must") for k in range(4)] + [(1, 9, "Python", "must"), (2, 0, "zq", "nice")], "doc_id long, pos int, label string, importance string")
    cls = C.classify(rows, skills, jobs).join(C.unmapped_labels(free, skills, "doc_id"), "doc_id", "left")
    cities = spark.createDataFrame([("breda", 51.5, 4.7, "NB")], "norm string, lat double, lng double, province string")
    companies = spark.createDataFrame([(5, "Acme Holding", "acme.com")], "company_id long, name string, domain string")
    profiles = spark.createDataFrame([("en", "the", 300)], "lang string, gram string, weight int")
    out = {r["doc_id"]: r for r in I.enrich(rows, cls, cities, companies=companies, profiles=profiles, today=F.lit("2026-09-01").cast("date")).collect()}
    assert [out[k]["company_key"] for k in (1, 2, 3)] == ["5", "5", None]
    assert out[1]["dedup_key"] == out[2]["dedup_key"] and "acme" in out[1]["dedup_key"]  # one company under two names
    assert out[1]["review_reasons"] == ["unmapped_skills"] and out[1]["status"] == "published" and out[1]["needs_review"]
    assert out[2]["review_reasons"] == [] and set(out[3]["review_reasons"]) >= {"no_skills", "no_occupation"} and out[3]["status"] == "pending_review"
    assert out[2]["language"] == "fy" and out[1]["language"] is None  # too short to say
    assert str(out[1]["date_posted"]) == "2026-09-01" and len(out[1]["embedding"]) == 768 and out[1]["lat"] == 51.5


def test_classified_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    none = "CAST(NULL AS {0}) AS {1}"
    rows = spark.range(40).selectExpr(
        "id AS doc_id", "'Cook' AS title", "concat('a text that is long enough to say which language it is ', id) AS description",
        "CASE WHEN id % 2 = 0 THEN 'Acme' WHEN id % 3 = 0 THEN 'Other' END AS company_name", "CASE WHEN id % 4 = 0 THEN 'https://acme.example/1' END AS apply_url",
        "'Breda' AS city", *[none.format("STRING", c) for c in ("remote_policy", "region", "country", "language")],
        *[none.format("DOUBLE", c) for c in ("hours_min", "hours_max", "lat", "lng")], "CAST(array() AS ARRAY<STRING>) AS employment_types",
        "named_struct('min', CAST(NULL AS DOUBLE), 'max', CAST(NULL AS DOUBLE), 'unit', CAST(NULL AS STRING), 'currency', 'EUR', 'text', CAST(NULL AS STRING)) AS salary")
    cls = rows.select("doc_id").mapInPandas(counted, "doc_id long").select(
        "doc_id", F.lit(0.9).alias("cls_confidence"), F.lit("2512").alias("cls_isco"), F.array(F.lit("py")).alias("cls_skills"),
        F.lit("senior").alias("cls_seniority"), F.lit("remote").alias("cls_remote"), F.array(F.lit("full_time")).alias("cls_employment"),
        F.struct(F.lit(8.0).alias("min"), F.lit(16.0).alias("max")).alias("cls_hours"))
    cities = spark.createDataFrame([("breda", 51.5, 4.7, "NB")], "norm string, lat double, lng double, province string")
    companies = spark.createDataFrame([(5, "Known", None)], "company_id long, name string, domain string")
    profiles = spark.createDataFrame([("en", "the", 300), ("en", "lon", 200)], "lang string, gram string, weight int")
    out = I.enrich(rows, cls, cities, companies=companies, profiles=profiles, today=F.lit("2026-09-01").cast("date"))
    got = out.select("doc_id", "company_key", "language", "status", "dedup_key").collect()
    assert made.value == 40 and len(got) == 40
    assert {r["language"] for r in got} == {"en"} and {r["status"] for r in got} == {"published"}
    assert {(r["doc_id"] % 2, r["company_key"]) for r in got if r["doc_id"] % 2 == 0} == {(0, "new:acme.example")}
    assert {r["company_key"] for r in got if r["doc_id"] % 6 == 3} == {"new:other"}
