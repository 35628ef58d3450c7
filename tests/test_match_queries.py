"""Registered matching queries over a few rows of their tables."""

import pytest

from laborlens.plans import all_queries

LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """24 candidates, 12 postings, 40 skills and 200 order lines; the 13th posting of a line does not exist."""
    at = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "customer": spark.range(24).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "CAST(id % 5 AS INT) AS c_nationkey"),
        "supplier": spark.range(12).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "CAST(id % 7 AS INT) AS s_nationkey"),
        "part": spark.range(40).selectExpr("id AS p_partkey", "'iron' AS p_name", "'t' AS p_type", "'b' AS p_brand"),
        "orders": spark.range(100).selectExpr("id AS o_orderkey", "id * 7 % 24 AS o_custkey"),
        "lineitem": spark.range(200).selectExpr(
            "id % 100 AS l_orderkey", "id * 11 % 40 AS l_partkey", "id * 5 % 13 AS l_suppkey", "CAST(id % 9 + 1 AS DOUBLE) AS l_quantity",
            "make_timestamp(1992 + CAST(id % 10 AS INT), 1, 1, 0, 0, 0) AS l_shipdate"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{at}/{name}.parquet")
    return at


def test_gaps_name_the_languages_that_are_not_met(spark, folder):
    """Every required language that the candidate does not reach at its level, with what the candidate has, in the posting's order."""
    from laborlens.plans.registry import Tables

    t = Tables(spark, folder)
    spoken = {(r["user_id"], r["language"]): r["level"] for r in t("v_candidate_languages").collect()}
    asked = sorted(t("v_job_languages").filter("required").collect(), key=lambda r: r["pos"])
    want = {}
    for p in t("v_pairs").join(t("v_jobs").select("job_id"), "job_id").collect():
        miss = []
        for r in asked:
            has = spoken.get((p["user_id"], r["language"]))
            if r["job_id"] == p["job_id"] and (has is None or LEVELS.index(has) < LEVELS.index(r["level"])):
                miss.append(f"{r['language']} {r['level']} {has or '–'}")
        want[p["user_id"], p["job_id"]] = ",".join(miss)
    got = {(r["user_id"], r["job_id"]): r["language_gaps"] for r in all_queries()[0]["match_gaps"](spark, folder).collect()}
    assert any("–" in w for w in want.values()) and any("," in w for w in want.values())
    assert set(got) <= set(want) and all(got.get(k, "") == w for k, w in want.items())


def test_gaps_are_decoded_once(spark, folder):
    """The filter reads the text of the gaps; it does not make it a second time."""
    plan = all_queries()[0]["match_gaps"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and not any("getbit" in line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter"))
