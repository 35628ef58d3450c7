"""Export, erasure and CV merge over all tables of a person."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from laborlens.operators import lifecycle as L, subjects as S


def tables(spark):
    return {
        "profile": spark.createDataFrame([(1, "A@x.nl", "nl"), (2, None, "en"), (3, "c@x.nl", "en"), (3, "b@x.nl", "en")], "user_id long, email string, locale string"),
        "consents": spark.createDataFrame([(1, k, "terms", k % 2 == 0) for k in range(2500)] + [(2, 0, "terms", True), (None, 1, "terms", True)],
                                          "user_id long, id long, type string, granted boolean"),
        "cvFiles": spark.createDataFrame([(1, 7, 'a "b".pdf'), (1, 8, None)], "user_id long, version int, file_name string"),
        "deletionRequests": spark.createDataFrame([(1, "pending"), (2, "pending")], "user_id long, status string"),
        "auditLog": spark.createDataFrame([(1, "x")], "actor_id long, action string"),
    }


def test_a_document_holds_every_row_once(spark):
    users = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "user_id long")
    rows = S.export_documents(users, tables(spark), chunk=100).collect()
    docs = {}
    for r in rows:
        docs.setdefault(r["user_id"], {})[r["part"]] = json.loads(r["document"])
    assert set(docs) == {1, 2, 3, 9} and all(0 in d for d in docs.values())
    assert set(docs[1][0]) == {"profile", "consents", "cvFiles", "deletionRequests"}  # the audit log is not exported
    sizes = [len(d["consents"]) for d in docs[1].values()]
    assert sum(sizes) == 2500 and max(sizes) < 300  # equal rows are all there, and spread over the parts
    assert Counter(c["granted"] for d in docs[1].values() for c in d["consents"]) == {True: 1250, False: 1250}
    assert docs[1][0]["profile"] == {"email": "A@x.nl", "locale": "nl", "role": None, "created_at": None, "last_active_at": None}
    assert sorted((f["version"], f["file_name"]) for d in docs[1].values() for f in d["cvFiles"]) == [(7, 'a "b".pdf'), (8, None)]
    assert docs[3][0]["profile"]["email"] == "b@x.nl"  # the least of repeated rows
    assert docs[9] == {0: {"profile": None, "consents": [], "cvFiles": [], "deletionRequests": []}}


def test_erasure_follows_the_catalogue(spark):
    users = spark.createDataFrame([(1, "A@x.nl"), (2, None)], "user_id long, email string")
    left = S.erase(tables(spark), users)
    assert {r["user_id"] for r in left["profile"].collect()} == {3}
    assert [r["user_id"] for r in left["consents"].collect()] == [None] and left["cvFiles"].count() == 0
    assert [(r["user_id"], r["status"]) for r in left["deletionRequests"].collect()] == [(None, "pending")] * 2
    assert left["auditLog"].count() == 1
    assert {n: df.columns for n, df in left.items()} == {n: df.columns for n, df in tables(spark).items()}
    proof = {r["email_hash"] for r in S.erasure_proof(users).collect()}
    assert proof == {r[0] for r in spark.createDataFrame([("a@x.nl",), ("2",)], "x string").select(F.sha2("x", 256)).collect()}
    audit = S.erasure_audit(users, "retention", tables(spark)["cvFiles"]).collect()
    assert {(r["actor_role"], r["metadata"]["cv_files"]) for r in audit} == {("system", 2), ("system", 0)}
    assert {r["entity_id"] for r in audit} == {p[:16] for p in proof}


def test_a_table_outside_the_catalogue_is_an_error(spark):
    with pytest.raises(ValueError, match="secrets"):
        S.erase({"secrets": spark.range(1)}, spark.range(1))


def test_merge_of_a_parsed_cv(spark):
    skill = "user_id long, uri string, label string, last_used_year int, source string, confirmed boolean"
    work = "user_id long, sort_order int, title string, end_date string, is_current boolean"
    stored = {
        "skills": spark.createDataFrame([
            (1, "a", "A", 2001, "cv", False), (1, "b", "B", 2002, "cv", True), (1, None, "Own", 2003, "manual", False),
            (2, "a", "A", 2004, "cv", False)], skill),
        "experiences": spark.createDataFrame([(1, 0, "old", None, True), (2, 0, "stays", None, True)], work),
        "languages": spark.createDataFrame([(2, "nl", "B1")], "user_id long, language string, level string"),
        "profiles": spark.createDataFrame([(1, "s", "junior", 3), (2, "t", "lead", 7)], "user_id long, summary string, seniority string, education_level int"),
    }
    parsed = {
        "skills": spark.createDataFrame([(1, "b", "B", 2020), (1, "c", "c" * 300, 2021), (1, None, "OWN", 2022), (2, "z", "Z", 2023)],
                                        "user_id long, uri string, label string, last_used_year int"),
        "experiences": spark.createDataFrame([(1, k, f"job {k}", "2020-01-01", k == 0) for k in range(20)], "user_id long, pos int, title string, end_date string, is_current boolean"),
        "languages": spark.createDataFrame([(1, "en", "C1"), (2, "en", "C1")], "user_id long, language string, level string"),
        "profiles": spark.createDataFrame([(1, "", "senior", None)], "user_id long, summary string, seniority string, education_level int"),
    }
    out = L.merge_cv(stored, parsed)
    skills = {(r["user_id"], r["uri"], r["label"], r["last_used_year"], r["source"]) for r in out["skills"].collect()}
    assert skills == {(1, "b", "B", 2002, "cv"), (1, None, "Own", 2003, "manual"), (1, "c", "c" * 200, 2021, "cv"), (2, "a", "A", 2004, "cv")}
    jobs = sorted((r["user_id"], r["sort_order"], r["title"], r["end_date"]) for r in out["experiences"].filter("user_id = 1 and sort_order > 0").collect())
    assert jobs == [(1, k, f"job {k}", "2020-01-01") for k in range(1, 15)]
    assert [r["end_date"] for r in out["experiences"].filter("user_id = 1 and sort_order = 0").collect()] == [None]
    assert [r["title"] for r in out["experiences"].filter("user_id = 2").collect()] == ["stays"]
    assert sorted((r["user_id"], r["language"]) for r in out["languages"].collect()) == [(1, "en"), (2, "nl")]
    assert sorted(tuple(r) for r in out["profiles"].collect()) == [(1, None, "senior", None), (2, "t", "lead", 7)]
    assert all(out[n].columns == stored[n].columns for n in stored)


def test_users_without_rows_need_no_join(spark):
    users = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "user_id long")
    rows = spark.createDataFrame([(1, f"c{k}") for k in range(40)] + [(2, "only"), (5, "not asked for")], "user_id long, type string")
    out = S.export_documents(users, {"consents": rows}, chunk=10)
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()  # whole documents are not shuffled again
    docs = {}
    for r in out.collect():
        assert (r["user_id"], r["part"]) not in docs
        docs[r["user_id"], r["part"]] = [c["type"] for c in json.loads(r["document"])["consents"]]
    assert sorted(x for (u, _), v in docs.items() if u == 1 for x in v) == sorted(f"c{k}" for k in range(40))
    assert docs[2, 0] == ["only"] and docs[9, 0] == [] and docs[None, 0] == [] and {u for u, _ in docs} == {1, 2, 9, None}
    assert len([1 for u, _ in docs if u in (2, 9, None)]) == 3 and (1, 0) in docs
