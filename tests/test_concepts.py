"""Dictionary lookup in the row against the joined form, and language detection against a plain count."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from laborlens.operators import classify as C, language as L, taxonomy as T


def test_both_lookups_agree(spark):
    rnd = random.Random(4)
    words = ["data", "Data", "c", "R", "c++", "C#", "machine", "learning", "é", "Go", "go", "sql", "a b", "ux"]
    labels = {" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))) for _ in range(60)} | {"++", "C", "R", "Go"}
    concepts = spark.createDataFrame([(i, w, None, None) for i, w in enumerate(sorted(labels))], "uri long, label_en string, label_nl string, alt_labels array<string>")
    texts = [" ".join(rnd.choice(words + [",", "-", "x"]) for _ in range(rnd.randint(0, 40))) for _ in range(80)] + ["", None, "Go" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entries = T.label_entries(concepts)
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "uri", "label", F.col("index").cast("int")).collect())
    got = rows(T.find_concepts(docs, entries, "doc_id", "text"))
    assert got == rows(T.joined_concepts(docs, entries, "doc_id", "text")) and len(got) > 100


def test_joined_dictionary_is_not_broadcast(spark, tmp_path):
    """Label and text tables look small as files; sent to all tasks they would pass through the driver."""
    docs = spark.createDataFrame([(1, "data and sql")], "doc_id long, text string")
    concepts = spark.createDataFrame([(1, "sql", None, None)], "uri long, label_en string, label_nl string, alt_labels array<string>")
    for name, df in (("docs", docs), ("concepts", concepts)):
        df.write.parquet(f"{tmp_path}/{name}")
    docs, concepts = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "concepts"))
    found = T.joined_concepts(docs, T.label_entries(concepts), "doc_id", "text")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.select("doc_id", "uri", "label").collect()] == [(1, 1, "sql")]


def test_language_is_the_best_profile(spark):
    rnd = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "é"], "cc": ["ka", "ung", "zu"]}
    texts = [(i, lang, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(rnd.randint(1, 30)))) for i, lang in enumerate(rnd.choices(list(syllables), k=120))]
    texts += [(900, None, None), (901, "aa", ""), (902, "bb", "1234567890 " * 10)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    profiles = L.language_profiles(docs.filter("doc_id < 40"), top=20)

    def grams(text):
        t = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return [t[i : i + 3] for i in range(max(1, len(t) - 2))]

    count = defaultdict(Counter)
    for i, lang, text in texts:
        if i < 40:
            count[lang].update(grams(text))
    want = {lang: {g: 20 - k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:20])} for lang, c in count.items()}
    got = defaultdict(dict)
    for r in profiles.collect():
        got[r["lang"]][r["gram"]] = r["weight"]
    assert got == want
    found = {r["doc_id"]: r["detected"] for r in L.detect_language(docs, profiles, "doc_id", "text").collect()}
    for i, _, text in texts:
        best = None
        if text and len(text.strip()) >= L.MIN_CHARS:
            score = sorted(((sum(w.get(g, 0) for g in grams(text)), lang) for lang, w in want.items()), reverse=True)
            best = score[0][1] if score[0][0] > score[1][0] else None
        assert found[i] == best, text


def test_plain_parts_spare_the_employment_patterns(spark):
    words = ["Full-Time", "FULL TIME", "fulltıme", "VOLTİJD", "voltıjd", "Part time", "deeltijd", "DEELTİJD", "Freelance", "zzp", "zzper", "INTERİM", "ınterım", "internſhip",
             "internship", "ſtage", "STAGE", "backstage", "ſtagıaır", "temporary", "TİJDELİJK", "tijdelijK", "fixed term", "fıxed-term", "full", "", "é nothing", "stage, interim; fulltime"]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)] + [(99, None)], "id int, text string")
    whole = F.array_compact(F.array(*[F.when(C.has(F.col("text"), p), F.lit(n)) for n, p in C.EMPLOYMENT_PHRASES]))
    out = df.select("id", C.employment(F.col("text")).alias("types"), whole.alias("whole"))
    rows = out.collect()
    assert all(r["types"] == r["whole"] for r in rows) and sum(bool(r["types"]) for r in rows) > 15
    plan = out.select("types")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") >= len(C.EMPLOYMENT_PHRASES)
