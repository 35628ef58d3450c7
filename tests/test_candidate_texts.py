"""Texts and vectors of candidates against a plain reading of what they are made of."""

from pyspark.sql import functions as F

from laborlens.functions.embed import embed
from laborlens.operators import cv as V


def test_profile_has_all_its_parts_and_each_experience_its_own_text(spark):
    people = spark.createDataFrame([(1, "data person", "likes mail a@b.nl"), (2, None, None), (3, "", "about")], "user_id long, headline string, summary string")
    lived = spark.createDataFrame(
        [(1, 20, "Cook", None), (1, 10, "Tester", "call 06-12345678"), (3, 5, None, "x"), (9, 1, "Nurse", "y")],
        "user_id long, pos long, title string, description string")
    skills = spark.createDataFrame([(1, "sql"), (1, "python"), (2, "care")], "user_id long, label string")
    got = {(r["user_id"], r["pos"]): r["text"] for r in V.candidate_texts(people, lived, skills).collect()}
    assert set(got) == {(1, None), (1, 10), (1, 20), (2, None), (3, None), (3, 5)}
    assert got[1, 20] == "Cook." and got[3, 5] == ". x" and "12345678" not in got[1, 10] and got[1, 10].startswith("Tester. call ")
    lines = got[1, None].split("\n")
    assert lines[0] == "data person" and lines[1].startswith("likes mail ") and "a@b.nl" not in lines[1]
    assert lines[2:] == [got[1, 10], "Cook.", "python, sql"]
    assert got[2, None] == "care" and got[3, None] == "about\n. x"


def test_query_embeds_profiles_and_experiences(spark, tmp_path):
    from laborlens.plans import all_queries

    spark.range(1, 5).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "0 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, 9).selectExpr("id AS o_orderkey", "id % 4 + 1 AS o_custkey", "'fast' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 9).selectExpr("id AS l_orderkey", "id % 3 + 1 AS l_partkey", "timestamp'2001-01-01' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, 4).selectExpr("id AS p_partkey", "'iron' AS p_name", "'t' AS p_type", "'b' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    rows = all_queries()[0]["embed_candidates"](spark, str(tmp_path)).collect()
    got = {(r["user_id"], r["pos"]): r["embedding"] for r in rows}
    assert set(got) == {(u, None) for u in range(1, 5)} | {(k % 4 + 1, k) for k in range(1, 9)} and len(rows) == 12
    want = spark.range(1).select(embed(F.lit("Nurse. fast")).alias("v")).first()["v"]
    assert got[2, 1] == want and got[2, None] != want
