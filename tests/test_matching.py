"""The engine against a plain-Python brute force over every pair of a small fixture."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from laborlens.config import DEFAULT, SKILL_LED, ModelConfig
from laborlens.operators import matching as M

YEAR = 2026
PROFILE = (
    "user_id long, seniority string, education_level int, lat double, lng double, max_travel double, travel_mode string,"
    " remote_pref string, min_salary double, hours_min double, hours_max double, employment array<string>, sizes array<string>,"
    " types array<string>, codes array<string>, riasec struct<R:double,I:double,A:double,S:double,E:double,C:double>, work_values array<string>"
)
JOB = (
    "job_id long, company_id long, lat double, lng double, remote_policy string, salary_min double, salary_max double, hours_min double,"
    " hours_max double, employment array<string>, isco_code string, seniority string, min_eqf int,"
    " riasec struct<R:double,I:double,A:double,S:double,E:double,C:double>, work_values struct<achievement:double,independence:double,"
    "recognition:double,relationships:double,support:double,working_conditions:double>"
)


def fixture(seed=7, users=12, jobs=9, skills=14):
    r = random.Random(seed)
    parents = {s: {100 + s // 4} | ({s - 5} if s % 9 == 5 else set()) for s in range(skills)}
    have = {u: {s: r.choice([None, 2015, 2022, 2025]) for s in r.sample(range(skills), r.randint(0, 4))} for u in range(users)}
    need = {j: [(s, r.choice(["must", "nice"])) for s in r.sample(range(skills), r.randint(1, 4))] for j in range(jobs)}
    return parents, have, need


def sides(spark, parents, have, need, cfg):
    users, jobs = list(have), list(need)
    profiles = spark.createDataFrame(
        [(u, "medior" if u % 2 else None, None, None, None, None, None, None, 3000.0 if u % 3 else None, None, None, None, None, None,
          [f"25{u % 3}1"], None, None) for u in users], PROFILE)
    postings = spark.createDataFrame(
        [(j, None, None, None, None, 3500.0 - 400 * (j % 3), None, None, None, None, f"2{j % 2 + 4}11", "senior", None, None, None) for j in jobs], JOB)
    sk = spark.createDataFrame([(u, s, s, y) for u, m in have.items() for s, y in m.items()], "user_id long, uri long, pos long, last_used_year int")
    js = spark.createDataFrame([(j, i, s, str(s), imp) for j, l in need.items() for i, (s, imp) in enumerate(l)],
                               "job_id long, pos int, uri long, label string, importance string")
    br = spark.createDataFrame([(s, p) for s, ps in parents.items() for p in ps], "uri long, broader_uri long")
    lang = spark.createDataFrame([], "user_id long, language string, level string")
    asked = spark.createDataFrame([], "job_id long, pos int, language string, level string, required boolean")
    firms = spark.createDataFrame([], "company_id long, size string, type string")
    return M.candidate_side(profiles, sk, lang, br, cfg, YEAR), M.posting_side(postings, js, asked, firms, br)


def brute_total(u, j, parents, have, need, cfg):
    def factor(y):
        if y is None:
            return cfg.unknown_recency
        years = max(0, YEAR - y)
        return next(f for limit, f in cfg.recency if limit is None or years <= limit)

    def related(a, b):
        return a in parents[b] or b in parents[a] or parents[a] & parents[b]

    earned = total = 0.0
    for s, imp in need[j]:
        w = cfg.must_weight if imp == "must" else cfg.nice_weight
        total += w
        if s in have[u]:
            earned += w * factor(have[u][s])
        else:
            near = [x for x in sorted(have[u]) if related(x, s)]
            earned += w * cfg.related_credit * factor(have[u][near[0]]) if near else 0.0
    scores = {"skills": earned / total} if total else {}
    a, b = f"25{u % 3}1", f"2{j % 2 + 4}11"
    family = next((n / 4 for n in (4, 3, 2, 1) if a[:n] == b[:n]), 0.0)
    scores["occupation"] = family * 0.75 + 0.25 * 0.8 if u % 2 else family
    if u % 3:
        lo = 3500.0 - 400 * (j % 3)
        s = 1.0 if lo >= 3000 else min(1.0, max(0.0, lo / 3000 - 0.5))
        scores["practical"] = int(s * 100 + 0.5) / 100
    avail = sum(cfg.weights[k] for k in scores)
    return int(sum(cfg.weights[k] / avail * v * 100 for k, v in scores.items()) * 10 + 0.5) / 10


@pytest.mark.parametrize("cfg", [DEFAULT, SKILL_LED], ids=["default", "skill_led"])
def test_scores_equal_brute_force(spark, cfg):
    parents, have, need = fixture()
    c, p = sides(spark, parents, have, need, cfg)
    pairs = spark.createDataFrame(list(itertools.product(have, need)), "user_id long, job_id long")
    got = {(r["user_id"], r["job_id"]): r["total_score"] for r in M.score_pairs(M.join_pairs(pairs, c, p), cfg).collect()}
    want = {k: brute_total(*k, parents, have, need, cfg) for k in itertools.product(have, need)}
    assert got == pytest.approx(want, abs=0.051) and sum(abs(got[k] - want[k]) > 1e-9 for k in want) <= 1


@pytest.mark.parametrize("cfg", [DEFAULT, SKILL_LED], ids=["default", "skill_led"])
def test_recompute_keeps_every_match(spark, cfg):
    """Also with postings that list no skills; no valid model is refused."""
    parents, have, need = fixture(seed=11, users=20, jobs=15)
    need = {j: ([] if j % 4 == 0 else skills) for j, skills in need.items()}
    c, p = sides(spark, parents, have, need, cfg)
    got = {(r["user_id"], r["job_id"]): r["total_score"] for r in M.recompute(c, p, cfg).collect()}
    totals = {k: brute_total(*k, parents, have, need, cfg) for k in itertools.product(have, need)}
    want = {k for k, v in totals.items() if v >= cfg.possible}
    assert set(got) == want and any(k[1] % 4 == 0 for k in want) and any(k[1] % 4 for k in want)


def test_candidate_pairs_are_few_when_skills_dominate(spark):
    parents, have, need = fixture(seed=11, users=20, jobs=15)
    c, p = sides(spark, parents, have, need, SKILL_LED)
    assert M.candidate_pairs(c, p, SKILL_LED).count() < M.candidate_pairs(c, p, DEFAULT).count() == 300


def test_similarity_is_the_best_cosine(spark):
    parents, have, need = fixture(users=3, jobs=2)
    c, p = sides(spark, parents, have, need, DEFAULT)
    lived = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 1.0]), (1, [0.0, 0.0]), (2, None)], "user_id long, vector array<double>")
    asked = spark.createDataFrame([(0, [0.0, 2.0])], "job_id long, vector array<double>")
    c = c.join(lived.groupBy("user_id").agg(F.collect_list("vector").alias("c_vectors")), "user_id", "left")
    p = p.join(asked.withColumnRenamed("vector", "j_vector"), "job_id", "left")
    got = {(r["user_id"], r["job_id"]): r["similarity"] for r in M.join_pairs(M.every_pair(c, p), c, p).collect()}
    assert got[0, 0] == 0.7071 and got[1, 0] == 0.0 and got[2, 0] is None and got[0, 1] is None


def test_gaps_list_related_and_missing_skills(spark):
    parents, have, need = fixture()
    c, p = sides(spark, parents, have, need, DEFAULT)
    f = M.join_pairs(M.every_pair(c, p), c, p).withColumn("skill_credits", M.skill_credits()).withColumn("gaps", M.skill_gaps())
    for r in f.collect():
        mine, asked = have[r["user_id"]], need[r["job_id"]]
        order = sorted(range(len(asked)), key=lambda i: (asked[i][1] != "must", i))
        assert [g["uri"] for g in r["gaps"]] == [asked[i][0] for i in order if asked[i][0] not in mine]


def test_input_hash_follows_every_input(spark):
    from dataclasses import replace

    from laborlens.sources.sinks import match_audit

    people = spark.createDataFrame([(1, "medior"), (2, None)], "user_id long, seniority string")
    jobs = spark.createDataFrame([(7, "x")], "job_id long, title string")
    skills = [(1, 10, 2020), (1, 11, None), (2, 10, 2020)]

    def hashes(skills=skills, cfg=DEFAULT, similarity=0.8, year=2026):
        sk = spark.createDataFrame(skills, "user_id long, uri long, last_used_year int")
        c = M.input_digest(people, "user_id", {"skills": sk})
        p = spark.createDataFrame([(1, 7, similarity), (2, 7, similarity)], "user_id long, job_id long, similarity double")
        return {r["user_id"]: r["input_hash"] for r in M.with_input_hash(p, c, M.input_digest(jobs, "job_id", {}), cfg, 1, year).collect()}

    first = hashes()
    assert hashes(skills[::-1]) == first
    changed = hashes([(1, 10, 2021), *skills[1:]])
    assert changed[1] != first[1] and changed[2] == first[2]
    for other in (hashes(cfg=replace(DEFAULT, good=61.0)), hashes(similarity=0.81), hashes(similarity=None), hashes(year=2027)):
        assert other[1] != first[1] and other[2] != first[2]
    rows = spark.createDataFrame([(1, 7, 50.0, "possible", False, "h")], "user_id long, job_id long, total_score double, label string, knocked_out boolean, input_hash string")
    assert match_audit(rows, F.lit(1)).first()["metadata"]["input_hash"] == "h"


def test_hot_keys_are_salted_without_loss(spark):
    from laborlens.operators.skew import salted_join

    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    salted = salted_join(left, right, "k", "id", floor=100)
    assert sorted(salted.collect()) == sorted(left.join(right, "k").select("k", "id", "v").collect())


def test_rank_equals_window(spark):
    rows = [(u, j, float((u * 37 + j * 13) % 1001) / 10, j % 3 == 0) for u in range(3) for j in range(400)]
    df = spark.createDataFrame(rows, "user_id long, job_id long, total_score double, knocked_out boolean")
    got = {(r["user_id"], r["job_id"]): r["rank"] for r in M.rank_matches(df).collect()}
    for u in range(3):
        order = sorted((x for x in rows if x[0] == u), key=lambda x: (x[3], -x[2], x[1]))
        assert [got[(u, x[1])] for x in order] == list(range(1, 401))


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (75.0, 74.9, 60.0, 59.9, 45.0, 44.9)], "x double")
    got = [r[0] for r in df.select(M.match_label(F.col("x"))).collect()]
    assert got == ["strong", "good", "good", "possible", "possible", "weak"]


def test_exact_only_when_skills_dominate():
    assert SKILL_LED.skill_evidence_is_exact() and not DEFAULT.skill_evidence_is_exact()
    assert not ModelConfig(weights={**SKILL_LED.weights, "skills": 55.0, "practical": 15.0}).skill_evidence_is_exact()


def test_protected_attributes_never_enter():
    from laborlens.operators.assemble import ALLOWED, PREFERENCES, PROTECTED

    import re

    names = set(ALLOWED) | set(re.findall(r"(\w+)[ :](?:string|double|array|struct)", PREFERENCES)) | set(re.findall(r"(\w+) \w+", PROFILE))
    assert not {n.lower() for n in names} & {n.lower() for n in PROTECTED}


def exchanged(df):
    """Columns of every shuffle of a plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = [b.strip().splitlines() for b in text.split("\n\n") if ") Exchange" in b.strip().split("\n")[0]]
    return [{c.split("#")[0].strip(" []") for c in b[1].split(": ", 1)[1].split(",")} for b in blocks]


def test_posting_lists_do_not_travel_with_pairs(spark):
    """A pair is shuffled with its candidate's own skills at most, and with no skill list of the posting."""
    parents, have, need = fixture()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c, p = sides(spark, parents, have, need, DEFAULT)
        pairs = spark.createDataFrame(list(itertools.product(have, need)), "user_id long, job_id long")
        f = M.match_rows(M.score_pairs(M.join_pairs(pairs, c, p)))
        shuffles = [s for s in exchanged(f) if "user_id" in s and "job_id" in s]
        assert shuffles and not any(n.startswith(("j_", "_j")) or n == "key" for s in shuffles for n in s)
        assert f.count() == len(have) * len(need)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pairs_that_share_skills_are_made_once_in_their_cell(spark, monkeypatch):
    """Blocks, slices and runs of any size give the pairs and the credit of a plain join; no row per shared key is shuffled."""
    from laborlens.operators import pruning as P

    parents, have, need = fixture(seed=5, users=25, jobs=14)
    have[3] = {}
    c, p = sides(spark, parents, have, need, DEFAULT)
    credit = {}
    scored = M.join_pairs(M.every_pair(c, p), c, p).withColumn("skill_credits", M.skill_credits())
    for r in scored.select("user_id", "job_id", M.skills_earned().alias("earned"), F.size("skill_credits").alias("n")).collect():
        if r["n"]:
            credit[r["user_id"], r["job_id"]] = r["earned"]
    for keys, rows, run in ((1 << 23, 1 << 17, 1 << 21), (20, 4, 7)):
        monkeypatch.setattr(P, "BLOCK_KEYS", keys)
        monkeypatch.setattr(P, "SLICE_ROWS", rows)
        monkeypatch.setattr(P, "SHARED_RUN", run)
        pairs = M.evidence_pairs(c, p)
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == set(credit)
        assert {(r["user_id"], r["job_id"]): r["earned"] for r in P.skill_evidence(c, p, DEFAULT).collect()} == pytest.approx(credit)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and plan.index("MapInArrow") < plan.index("RepartitionByExpression") and not plan.startswith("Aggregate")


def test_a_cosine_that_lowers_the_total_drops_the_pair_before_it_is_scored(spark):
    from laborlens.operators import pruning as P

    parents, have, need = fixture(seed=11, users=20, jobs=15)
    c, p = sides(spark, parents, have, need, DEFAULT)
    c = c.withColumn("c_vectors", F.array(F.array(F.lit(1.0), (F.col("user_id") % 3).cast("double"))))
    p = p.withColumn("j_vector", F.array(F.lit(0.0), F.lit(1.0)))
    every = M.keep_matches(M.total_scores(M.join_pairs(M.every_pair(c, p), c, p, listed=False))).select("user_id", "job_id")
    want = {tuple(r) for r in every.collect()}
    left = {tuple(r) for r in P.promising_pairs(c, p, DEFAULT).collect()}
    assert want and want <= left and len(left) <= 1.2 * len(want)


def test_pairs_meet_their_postings_first(spark):
    pairs = spark.createDataFrame([(u, j, None if u == 3 else 0.8) for u in range(4) for j in (7, 8, 9)], "user_id long, job_id long, similarity double")
    people = spark.createDataFrame([(u, f"c{u}") for u in range(3)], "user_id long, digest string")
    jobs = spark.createDataFrame([(7, "j7"), (8, "j8")], "job_id long, digest string")
    out = M.with_input_hash(pairs, people, jobs, M.DEFAULT, 1, 2026)
    keys = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [" in line]
    assert len(keys) >= 2 and "user_id" in keys[0] and "SortMergeJoin [job_id" in keys[1]  # the digest that repeats travels, side by side
    model = M.model_digest(M.DEFAULT)
    for r in out.collect():
        u, j = r["user_id"], r["job_id"]
        text = "|".join([f"c{u}" if u < 3 else "", f"j{j}" if j < 9 else "", "" if u == 3 else "8000", model, "2026"])
        assert r["input_hash"] == hashlib.sha256(text.encode()).hexdigest()
    assert out.count() == 12


def test_a_candidate_meets_its_postings_of_a_block_at_once(spark, monkeypatch):
    """Rows and hits are those of a plain join, however many blocks there are; a candidate's skills do not travel with its pairs."""
    from laborlens.operators import cells

    parents, have, need = fixture(seed=3, users=14, jobs=11)
    have[2], need[4] = {}, []
    parents = {s: {p * -(2**40) for p in ps} for s, ps in parents.items()}
    c, p = sides(spark, parents, have, need, DEFAULT)
    c, p = c.union(c.filter("user_id = 5")), p.union(p.filter("job_id in (3, 4)"))  # rows that come twice
    rows = [(u, j, 0.5 if j % 2 else None, "x") for u, j in itertools.product([*have, 99], [*need, 77])] + [(1, None, None, "y"), (None, 1, None, "y"), (1, 1, 0.7, "z")]
    pairs = spark.createDataFrame(rows, "user_id long, job_id long, similarity double, extra string")

    def told(f):
        f = M.with_components(f).withColumn("j_hits", F.coalesce("j_hits", F.array().cast(M.HITS)))
        return sorted(repr(sorted(r.asDict(recursive=True).items())) for r in f.drop(*M.LISTS).collect())

    want = {listed: told(M.join_pairs(pairs, c, p, listed=listed, cells=False)) for listed in (False, True)}
    assert len(want[False]) == 15 * (9 + 2 * 4) + 1
    for keys in (1 << 23, 12):
        monkeypatch.setattr(cells, "BLOCK_KEYS", keys)
        for listed in (False, True):
            f = M.join_pairs(pairs, c, p, listed=listed, named=True)
            assert told(f) == want[listed]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with_pairs = [s for s in exchanged(M.join_pairs(pairs, c, p, listed=False)) if "job_id" in s and "user_id" in s]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert with_pairs and all(s <= {"user_id", "job_id", "similarity", "travel_minutes", "extra"} for s in with_pairs)


def test_packed_keys_come_back_in_order():
    import pyarrow as pa

    from laborlens.operators import cells

    rows = [[2**62 + 5, -(2**62), 7, 7], None, [], [-1]]
    numbers, marks = [[4, 3, 2, 1], None, [], [9]], [[0, 1, 2, 3], None, [], [5]]
    packed = cells.packed_keys.func(pa.array(rows, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int16())))
    keys, n, m, sizes = cells.unpacked_keys(packed, 14)
    assert keys.tolist() == [-(2**62), 7, 7, 2**62 + 5, -1] and n.tolist() == [3, 1, 2, 4, 9] and m.tolist() == [1, 3, 2, 0, 5]
    assert sizes.tolist() == [4, 0, 0, 1]


def test_a_language_that_comes_twice_counts_at_its_highest_level(spark):
    parents, have, need = fixture(users=2, jobs=2)
    profiles = spark.createDataFrame([(0, *[None] * 16), (1, *[None] * 16)], PROFILE)
    skills = spark.createDataFrame([], "user_id long, uri long, pos long, last_used_year int")
    broader = spark.createDataFrame([], "uri long, broader_uri long")
    rows = [(0, "nl", "B1"), (0, "nl", "C1"), (0, "nl", "C1"), (0, "en", "A2"), (0, None, "A1"), (1, "de", "x"), (1, "de", None)]
    spoken = spark.createDataFrame(rows, "user_id long, language string, level string")
    got = {r["user_id"]: r["c_languages"] for r in M.candidate_side(profiles, skills, spoken, broader, DEFAULT, YEAR).collect()}
    assert got == {0: {"nl": "C1", "en": "A2"}, 1: None}
