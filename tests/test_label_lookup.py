"""Label lookup against brute force, with texts of one and two characters."""

from laborlens.operators import serving as S

LABELS = ["Go", "Go programming", "Django", "C#", "C", "R", "AI", "AI ethics", "Train the trainer", "Ruby on Rails", "Python", "a", "Σ algebra", "data 😀"]
TERMS = ["go", "GO ", "c#", "c", "r", "ai", "a", "😀", "σ", "z", "zz", "", " ", "rai", "train", "python", "go programming", "n t"]


def test_lexical_search_scores_texts_of_any_length(spark):
    norms = spark.createDataFrame([(x,) for x in {*LABELS, *TERMS}], "x string")
    norm = {r[0]: r[1] for r in norms.select("x", S.X.normalize_label(norms["x"])).collect()}
    entries = spark.createDataFrame([(f"u{i:02}", norm[x]) for i, x in enumerate(LABELS)], "uri string, norm string")
    want = set()
    for t in TERMS:
        q, scored = norm[t], []
        for i, x in enumerate(LABELS):
            n = norm[x]
            score = 0 if not q else 3 if n == q else 2 if n.startswith(q) else 1 if q in n else 0
            if score:
                scored.append((-score, f"u{i:02}"))
        want |= {(t, u, -s, k + 1) for k, (s, u) in enumerate(sorted(scored)[:10])}
    assert ("go", "u02", 1, 3) in want
    got = S.lexical_search(spark.createDataFrame([(t,) for t in TERMS], "q string"), entries).collect()
    assert len(got) == len(want) and {(r["q"], r["uri"], r["score"], r["rank"]) for r in got} == want


def test_autocomplete_finds_single_characters(spark):
    rows = [(f"u{i:02}", x, x.lower()) for i, x in enumerate(LABELS)]
    labels = spark.createDataFrame(rows, "uri string, label_en string, search_text string")
    terms = [t for t in TERMS if t]
    got = S.autocomplete(spark.createDataFrame([(t,) for t in terms], "q string"), labels, k=25).collect()
    for t in terms:
        inside = {u for u, _, text in rows if t.lower() in text}
        assert inside <= {r["uri"] for r in got if r["q"] == t}, t
