import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.operators import dedup as D


@pytest.mark.parametrize("tile", [2048, 16])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(D, "TILE", tile)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    v = np.concatenate([c + rng.normal(scale=0.45, size=(40, 12)) for c in centres])
    rows = [(i, i % 2, [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "id long, company long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if sim[i, j] > 0.9}
    assert want
    assert {(r["a"], r["b"]) for r in D.similar_pairs(df, "id", "v").collect()} == want
    blocked = {(r["a"], r["b"]) for r in D.similar_pairs(df, "id", "v", block="company").collect()}
    assert blocked == {(i, j) for i, j in want if i % 2 == j % 2}


def test_pairs_above_equal_whole_products():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 64))
    v = np.concatenate([c + rng.normal(scale=0.3, size=(20, 64)) for c in centres] + [np.zeros((1, 64))])
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    sim = u @ u.T
    h = D.heads(v, D.main_directions(u[:100]))
    for threshold in (0.95, 0.9, 0.5, 0.0):
        i, j, s, _ = D.pairs_above(v, v, h, h, threshold)
        assert set(zip(i, j)) == set(zip(*np.nonzero(sim > threshold)))
        assert np.allclose(s, sim[i, j])
    # balls that lie far apart are dropped before any product of two rows
    one = np.eye(64)[:1] + 0.01 * u[:50]
    far = [D.heads(m, np.eye(64)[:, :16]) for m in (one, -one)]
    got = D.pairs_above(one, -one, *far, 0.9)
    assert len(got[0]) == 0 and got[3] == 2 * 17 * 100


def test_work_that_bounds_skip_and_recall_of_hyperplanes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 64))
    v = np.concatenate([c + rng.normal(scale=0.3, size=(15, 64)) for c in centres])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if sim[i, j] > 0.9}
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    work = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    assert {(r["a"], r["b"]) for r in D.similar_pairs(df, "id", "v", work=work).collect()} == want
    assert 0 < work[0].value < work[1].value / 2
    found = [(r["a"], r["b"]) for r in D.hyperplane_pairs(df, "id", "v").collect()]
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.9 * len(want)
    none = df.filter("id < 0")
    assert D.similar_pairs(none, "id", "v").count() == 0 and D.hyperplane_pairs(none, "id", "v").count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(180)]
    edges += [(500, x) for x in range(501, 700)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e}
    got = D.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == want


def test_same_key_edges_form_a_star(spark):
    df = spark.createDataFrame([(5, "a"), (3, "a"), (9, "a"), (4, "b"), (7, None), (8, None)], "id long, k string")
    got = sorted((r["src"], r["dst"]) for r in D.same_key_edges(df, "k", "id").collect())
    assert got == [(5, 3), (9, 3)]


def test_platform_hosts_say_nothing(one):
    from pyspark.sql import functions as F

    make = D.employer_domain(F.lit(None).cast("string"), F.col("x"))
    assert one(make, "x string", "https://boards.greenhouse.io/acme/1") is None
    assert one(make, "x string", "https://jobs.acme.example/1") == "acme.example"


def test_near_copies_of_a_company_join_groups(spark):
    """Layer 4: near copies under other URLs and keys."""
    from laborlens.functions.embed import embed
    from pyspark.sql import functions as F

    text = "We look for a careful engineer who builds data pipelines in the harbour of the city with a small team"
    rows = [
        (1, "https://a.example/1", "Data engineer", "A", "X", text, 7),
        (2, "https://a.example/2", "Engineer of data", "A", "Y", text + " today", 7),
        (3, "https://a.example/3", "Engineer for data", "A", "Z", text, 8),  # another company
        (4, "https://a.example/4", "Cook", "A", "Q", "Prepares meals for guests of our hotel at the lake, mornings and evenings", 7),
        (5, "https://a.example/4", "Cook again", "A", "R", "other words", 7),  # the URL of 4
        (6, "https://a.example/6", "Data engineers", "A", "V", text, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, apply_url string, title string, company_name string, city string, description string, company_id long")
    df = df.withColumn("status", F.lit("published"))
    vectors = df.select("doc_id", embed(F.concat_ws("\n", "title", "description")).alias("embedding"))
    got = {r["id"]: r["component"] for r in D.components(D.duplicate_edges(df, vectors).select("src", "dst")).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 4}
    assert {(r["src"], r["dst"]) for r in D.duplicate_edges(df, vectors).filter("layer = 4").collect()} == {(2, 1)}


def test_a_firm_with_and_without_domain_is_one_company(spark):
    rows = [
        (1, "Acme B.V.", "https://jobs.acme.example/1"), (2, "Acme", None), (3, "acme bv", "https://www.acme.test/2"), (4, "Acme", "https://jobs.acme.example/9"),
        (5, None, "https://www.acme.test/3"), (6, "Other", "https://www.acme.test/4"), (7, None, None), (8, "Known", None), (9, "Shop", "https://boards.greenhouse.io/x"), (10, "Shop", None),
    ]
    posts = spark.createDataFrame(rows, "doc_id long, company_name string, apply_url string")
    known = spark.createDataFrame([(77, "Known Ltd", None)], "company_id long, name string, domain string")
    out, new, _ = D.resolve_companies(posts, known)
    got = {r["doc_id"]: r["company_key"] for r in out.collect()}
    assert got[1] == got[2] == got[3] == got[4] != got[6] and got[5] == got[6] and got[7] is None and got[9] == got[10]
    assert len({r["company_key"] for r in new.collect()}) == new.count()


def test_a_name_is_normalised_once(spark, monkeypatch):
    seen, real = spark.sparkContext.accumulator(0), D.X.normalize_company

    @F.pandas_udf("string")
    def counted(names):
        seen.add(len(names))
        return names

    monkeypatch.setattr(D.X, "normalize_company", lambda c: real(counted(c)))
    posts = spark.range(3000).selectExpr(
        "id AS doc_id", "element_at(array('Acme', 'Acme B.V.', NULL, 'Known'), CAST(id % 4 AS INT) + 1) AS company_name",
        "CASE WHEN id % 2 = 0 THEN 'https://www.acme.example/1' END AS apply_url")
    known = spark.createDataFrame([(77, "Known Ltd", None)], "company_id long, name string, domain string")
    out, new, fills = D.resolve_companies(posts, known)
    got = {(r["company_name"], r["company_key"]): r["n"] for r in out.groupBy("company_name", "company_key").agg(F.count("*").alias("n")).collect()}
    assert got == {("Acme", "new:acme.example"): 750, ("Acme B.V.", "new:acme.example"): 750, (None, "new:acme.example"): 750, ("Known", "77"): 750}
    assert seen.value < 100
    assert [tuple(r) for r in new.collect()] == [("new:acme.example", "Acme", "acme.example")] and fills.count() == 0


def test_a_full_tile_is_compared_in_strips():
    import tracemalloc

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(2048, 64))
    x[:, 0] += 6  # heads leave many pairs open
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    h = D.heads(x, D.main_directions(unit[:512]))
    tracemalloc.start()
    i, j, s, _work = D.pairs_above(x, x, h, h, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = unit @ unit.T
    a, b = np.nonzero(whole > 0.9 + 1e-9)
    assert set(zip(a.tolist(), b.tolist())) <= set(zip(i.tolist(), j.tolist())) and (s > 0.9).all() and np.abs(whole[i, j] - s).max() < 1e-9
    assert peak < 48 << 20
