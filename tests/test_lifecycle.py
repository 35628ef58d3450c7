"""The state fold against an ordered replay, overrides, and change capture."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from laborlens.config import DEFAULT
from laborlens.operators import lifecycle as L, matching as M, pruning as P

import test_matching as tm


def replay(events):
    state = {}
    for user, job, kind, at, _ in sorted(events, key=lambda e: (e[3], e[4])):
        key, row = (user, job), state.get((user, job))
        if kind == "saved" and row is None:
            state[key] = ("saved", at, None)
        elif kind == "unsaved" and row and row[0] == "saved":
            del state[key]
        elif kind == "applied" and row is None:
            state[key] = ("applied", at, at)
        elif kind == "applied" and row[0] == "saved":
            state[key] = ("applied", row[1], at)
    return state


def test_state_fold_equals_a_replay(spark):
    rnd = random.Random(8)
    start = datetime(2026, 1, 1)
    events = []
    for k in range(3000):
        key = (1, 1) if k % 3 == 0 else (rnd.randrange(12), rnd.randrange(12))  # a third of all events are of one pair
        kind = rnd.choice(["saved", "unsaved", "dismissed"] if key == (1, 1) and k < 2900 else ["saved", "unsaved", "saved", "applied", "dismissed"])
        events.append((*key, kind, start + timedelta(minutes=rnd.randrange(4000)), k))
    df = spark.createDataFrame(events, "user_id long, job_id long, type string, created_at timestamp, event_id long")
    want = replay(events)
    for span in ("minute", "day"):
        got = {(r["user_id"], r["job_id"]): (r["status"], r["saved_at"], r["applied_at"]) for r in L.application_state(df, span).collect()}
        assert got == want


def test_last_override_counts(spark):
    jobs = spark.createDataFrame(
        [(1, "10", "junior", 0.2, True, "pending_review", 5, ["x"]), (2, "20", "senior", 0.4, True, "published", 6, ["y"])],
        "job_id long, isco_code string, seniority string, confidence double, needs_review boolean, status string, occupation_uri int, review_reasons array<string>",
    )
    overrides = spark.createDataFrame([(1, 7, "lead", True, 2), (1, 8, "medior", False, 1)], "job_id long, occupation_uri int, new_seniority string, publish boolean, event_id long")
    occupations = spark.createDataFrame([(7, "77")], "occupation_uri int, isco string")
    rows = {r["job_id"]: r for r in L.reclassify(jobs, overrides, occupations).collect()}
    assert len(rows) == 2 and L.reclassify(jobs, overrides, occupations).count() == 2
    assert (rows[1]["isco_code"], rows[1]["seniority"], rows[1]["occupation_uri"], rows[1]["review_reasons"], rows[1]["status"]) == ("77", "lead", 7, [], "published")
    assert rows[2]["review_reasons"] == ["y"] and rows[2]["needs_review"]


def test_a_change_set_gives_what_a_full_run_gives(spark):
    parents, have, need = tm.fixture(seed=4, users=16, jobs=12)
    c, p = tm.sides(spark, parents, have, need, DEFAULT)
    result = ["user_id", "job_id", "total_score", "label"]
    stored = M.recompute(c, p, DEFAULT).select(*result)
    less = {j: (skills[1:] if j in (3, 5) else skills) for j, skills in need.items()}
    _, p2 = tm.sides(spark, parents, have, less, DEFAULT)
    before = p.select("job_id", F.xxhash64(F.to_json("j_skills")).cast("string").alias("digest"))
    now = p2.select("job_id", F.xxhash64(F.to_json("j_skills")).cast("string").alias("digest"))
    jobs = M.changed_keys(before, now, "job_id")
    assert sorted(r["job_id"] for r in jobs.collect()) == [3, 5]
    kept = M.recompute_changed(c, p2, None, jobs, DEFAULT)
    assert {r["job_id"] for r in kept.collect()} <= {3, 5}
    got = sorted(map(tuple, M.apply_changes(stored, kept, None, jobs).collect()))
    assert got == sorted(map(tuple, M.recompute(c, p2, DEFAULT).select(*result).collect()))


def test_bounds_leave_no_kept_pair_out(spark):
    """Few pairs are scored, and small cells of the grid give the same pairs."""
    parents, have, need = tm.fixture(seed=21, users=24, jobs=18)
    c, p = tm.sides(spark, parents, have, need, DEFAULT)
    left = {(r["user_id"], r["job_id"]) for r in P.promising_pairs(c, p, DEFAULT).collect()}
    totals = {(u, j): tm.brute_total(u, j, parents, have, need, DEFAULT) for u in have for j in need}
    assert {k for k, v in totals.items() if v >= DEFAULT.possible} <= left and len(left) < len(totals)
    a, b = spark.range(57).withColumnRenamed("id", "user_id"), spark.range(23).withColumnRenamed("id", "job_id")
    assert P.grid_join(a, b, rows=5).distinct().count() == 57 * 23 == P.grid_join(a, b, rows=5).count()
