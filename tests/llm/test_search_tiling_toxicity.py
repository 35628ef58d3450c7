"""Search against all scores, tiling against a plain tiling, toxicity on held-out texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from laborlens.llm import tiling, topk, toxicity
from laborlens.llm.common import chunks, lowered, shingles, words


def split(text):
    return [w for w in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", (text or "").lower()) if w]


# --- words ------------------------------------------------------------------------------------


def test_word_hashes_are_those_of_the_words():
    import pyarrow as pa

    rnd = random.Random(1)
    texts = ["", None, "a", "a a", "É é", "ab", "b-c_d", "x" * 3000] + ["".join(rnd.choice("ab É,\n1") for _ in range(rnd.randrange(40))) for _ in range(300)]
    by_word, by_gram = {}, {}
    for limit in (16, 1 << 20):  # however the texts are dealt out
        for row, raw, offsets in chunks(lowered(pa.array(texts, pa.string())), limit):
            found, starts = words(raw, offsets)
            for k in range(len(offsets) - 1):
                mine, want = found[starts[k] : starts[k + 1]], split(texts[row + k])
                assert len(mine) == len(want)
                for h, w in zip(mine, want):
                    assert by_word.setdefault(w, h) == h
                for h, i in zip(shingles(mine, 2), range(len(want))):
                    assert by_gram.setdefault(tuple(want[i : i + 2]), h) == h
    assert len(set(by_word.values())) == len(by_word) and len(set(by_gram.values())) == len(by_gram)


# --- search -----------------------------------------------------------------------------------


def plain_search(docs, queries, top):
    bags = [(i, Counter(split(t))) for i, t in docs if i is not None]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for q, text in queries:
        scored = []
        for i, b in bags:
            s = 0.0
            for w in set(split(text)):
                if b[w]:
                    norm = topk.K1 * (1 - topk.B + topk.B * sum(b.values()) * n / total)
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * (topk.K1 + 1) / (b[w] + norm)
            if s:
                scored.append((-round(s, 9), i))
        if scored:
            out[q] = sorted(scored)[:top]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_all_scores(make_docs, monkeypatch, small):
    if small:  # many shards, blocks and query blocks
        for name, value in (("SHARD_DOCS", 16), ("BLOCK_DOCS", 4), ("QUERY_BLOCK", 7), ("PRIME", 2)):
            monkeypatch.setattr(topk, name, value)
    rnd = random.Random(2)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 5, 30, 200])))) for i in range(300)]
    docs += [(1000, docs[3][1]), (1001, None), (None, "w1 w2"), (1002, "only here")]
    queries = [d for d in docs if d[0] is not None and d[0] % 10 == 0] + [(5001, "nothing known"), (5002, None), (5003, "w1 W1, w2")]
    got = defaultdict(list)
    rows = topk.search(make_docs(docs), make_docs(queries), top=5).orderBy("query_id", "rank").collect()
    for r in rows:
        got[r["query_id"]].append((-r["score"], r["doc_id"]))
    want = plain_search(docs, queries, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [round(s, 6) for s, _ in got[q]] == [round(s, 6) for s, _ in best]
        assert [i for _, i in got[q]] == [i for _, i in best]


def test_index_rows_are_narrow_and_read_one_by_one(spark):
    """A posting takes as few bytes as its numbers need; no reader holds thousands of index rows at a time."""
    counts = [1, 255, 256, 70000]
    for most in counts:
        sizes = np.array([2] * 299 + [most + 1])
        hashes = np.concatenate([*[np.array([7, 9], np.uint64)] * 299, np.array([7] + [9] * most, np.uint64)])
        shard = topk.build_shard(np.arange(300), hashes, np.r_[0, np.cumsum(sizes)])
        postings = int(shard["starts"][-1])
        width = {1: 1, 255: 1, 256: 2, 70000: 4}[most]
        assert postings == 600 and shard["at"].nbytes == 2 * postings and shard["tf"].nbytes == width * postings
        assert topk.widened(shard["tf"].tobytes(), postings).max() == most
        assert topk.widened(shard["at"].tobytes(), postings).tolist() == list(range(300)) * 2
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    with topk.small_batches(spark):
        assert spark.conf.get(name) == "1"
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("frequent", [1, 3, 10**9])
def test_a_floor_drops_no_document(monkeypatch, frequent):
    """Lists held as rows, in part or not at all, and any rounds: the best with a floor are those without one."""
    monkeypatch.setattr(topk, "FREQUENT", frequent)
    monkeypatch.setattr(topk, "STEP_POSTINGS", 500)
    monkeypatch.setattr(topk, "LOOKUP", 1)
    rnd = np.random.default_rng(3)
    texts = [np.minimum(rnd.zipf(1.3, rnd.integers(0, 60)), 200).astype(np.uint64) for _ in range(300)]
    shard = topk.build_shard(np.arange(300), np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])])
    df = dict(zip(shard["terms"].tolist(), np.diff(shard["starts"]).tolist()))
    asked = [np.unique(t) for t in texts[::10] if len(t)]
    terms = np.concatenate(asked)
    idf = np.array([math.log(1 + (300 - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
    queries = topk.Queries(np.arange(len(asked)), np.r_[0, np.cumsum([len(t) for t in asked])], terms, idf, np.zeros(len(asked)))
    row = {k: v.tobytes() for k, v in shard.items()}
    want = {q: (ids.tolist(), scores.tolist()) for q, ids, scores in topk.Shard(row, 30.0, queries).search(queries, 5)}
    assert len(want) == len(asked)
    for place in (-1, 2):  # floors met by the last, or by some of the best only
        queries.least = np.array([want[q][1][min(place, len(want[q][1]) - 1)] for q in range(len(asked))])
        for q, ids, scores in topk.Shard(row, 30.0, queries).search(queries, 5):
            keep = [k for k, score in enumerate(want[q][1]) if score >= queries.least[q]]
            assert ids.tolist() == [want[q][0][k] for k in keep] and scores.tolist() == [want[q][1][k] for k in keep]


def test_search_of_nothing(make_docs):
    assert topk.search(make_docs([]), make_docs(["a"])).count() == 0
    assert topk.search(make_docs(["a"]), make_docs([])).count() == 0


# --- tiling -----------------------------------------------------------------------------------


def plain_tiles(item, doc, least):
    """Greedy string tiling by its definition: again and again the longest match of unmarked words."""
    used_item, used_doc, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and not used_item[a + n] and not used_doc[b + n]:
                    n += 1
                if n >= least and (best is None or (-n, a, b) < best):
                    best = (-n, a, b)
        if best is None:
            return sum(n for _, _, n in out) / len(item) if item else 0.0
        n, a, b = -best[0], best[1], best[2]
        used_item[a : a + n] = [True] * n
        used_doc[b : b + n] = [True] * n
        out.append((a, b, n))


def test_tiling_equals_the_definition(make_docs, spark):
    rnd = random.Random(3)
    vocabulary = ["a", "b", "c", "d"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 14)))) for i in range(12)] + [(50, None), (None, "a b c d a b")]
    docs = []
    for _ in range(25):
        t = items[rnd.randrange(12)][1].split()
        k = rnd.randint(0, len(t))
        docs.append(" ".join([rnd.choice(vocabulary)] * rnd.randint(0, 3) + t[k:] + [rnd.choice(vocabulary)] + t[:k]))
    docs += [None, "", "A, b! C d; a"]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, hits string")
    got = {r["doc_id"]: r for r in tiling.contamination(make_docs(docs), bench, least=3, threshold=0.6).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        shares = {j: plain_tiles(split(t), split(text), min(3, len(split(t)))) for j, t in items if j is not None and t}
        assert got[i]["items"] == sorted(j for j, s in shares.items() if s >= 0.6)
        assert got[i]["coverage"] == pytest.approx(max(shares.values()))
        assert got[i]["contaminated"] == any(s >= 0.6 for s in shares.values())


def test_reordered_passage_and_blocks(make_docs, spark, monkeypatch):
    w = [f"v{i}" for i in range(40)]
    filler = " ".join(f"f{i}" for i in range(3000))
    moved = " ".join(w[20:] + ["between"] + w[:20])
    docs = make_docs([filler + " " + moved + " " + filler, filler, " ".join(w[:15]), moved.upper()])
    bench = spark.createDataFrame([(7, " ".join(w)), (7, " ".join(w)), (8, "other words that stand nowhere else at all"), (9, "too short")], "item_id long, text string")
    want = [True, False, False, True]
    assert [r["contaminated"] for r in tiling.contamination(docs, bench).orderBy("doc_id").collect()] == want
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 40)
    rows = tiling.contamination(docs, bench, keep=("doc_id", "text", "lang")).orderBy("doc_id").collect()
    assert [r["contaminated"] for r in rows] == want and rows[2]["text"] == " ".join(w[:15]) and rows[0]["items"] == [7, 7]


def test_short_items_match_as_a_whole(make_docs, spark):
    bench = spark.createDataFrame([(1, "What is two plus?"), (2, "yes"), (3, "..."), (4, "one two three four five")], "item_id long, text string")
    docs = ["he asked what is two plus exactly", "what is two", "Yes.", "yesterday", "one two three four", "plus what is two"]
    got = {r["doc_id"]: r["items"] for r in tiling.contamination(make_docs(docs), bench).collect()}
    assert got == {0: [1], 1: [], 2: [2], 3: [], 4: [], 5: []}


def test_one_word_over_and_over():
    import numpy as np

    item, doc = np.full(300, 7, np.uint64), np.full(60_000, 7, np.uint64)
    seeds = tiling.Seeds([1], [item], 5)
    grams = tiling.shingles(doc, 5)
    entry, at = seeds.starts(doc, np.arange(len(grams)), grams)
    assert len(entry) < len(doc) + len(item)  # one for each diagonal, not one for each pair of places
    assert seeds.hits(doc, np.arange(len(grams)), grams) == [{"item": 1, "coverage": 1.0, "tiles": 1}]


def test_empty_benchmark_and_table(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in tiling.contamination(make_docs(["a b c d e f"]), none).collect()] == [False]
    assert tiling.contamination(make_docs([]), none).count() == 0


# --- toxicity -----------------------------------------------------------------------------------


def test_transducers():
    g = toxicity.Grammar()
    read = lambda s: [(k, m) for k, _, m in g.read([(x, 1.0 if x == "insult" else 0.0) for x in s.split()])]
    assert read("target word insult") == [("insult", {"targeted"})]
    assert read("insult word target") == [("insult", {"targeted"})]
    assert read("target word word word word insult") == [("insult", set())]
    assert read("negation word insult word insult") == [("insult", {"negated"}), ("insult", set())]
    assert read("report word word word word word insult") == [("insult", {"reported"})]
    assert read("target threat") == [("threat", {"targeted"})]
    assert read("word") == []


def toxic_rows(seed, n=1500):
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "re", "tho", "ün", "ka") for b in ("lo", "mi", "ster", "ing", "é")]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 80))]
        bad = rnd.random() < 0.15
        for _ in range(rnd.randint(1, 4) if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["grumpf", "slorka" + rnd.choice(["lo", "mi"]), "you grumpf"]))
        rows.append((i, ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_texts(make_docs, spark):
    import zlib

    rows, labels = toxic_rows(5)
    flipped = [(i, (1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]  # must not be learned from
    table = spark.createDataFrame([(*x, 0) for x in flipped] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, text int")
    docs = make_docs(rows + [(9000, None), (9001, ""), (9002, "grumpf " * 20000), (9003, "x" * 200000)])
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    wrong = out = 0
    for i, t in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.3)
        if got[i]["held_out"]:
            out += 1
            wrong += got[i]["predicted"] != t
    assert out > 200 and wrong <= 0.02 * out
    assert [got[i]["predicted"] for i in (9000, 9001, 9002, 9003)] == [0, 0, 1, 0]


def test_marks_change_the_score():
    model = toxicity.Model({"grumpf": 5.0}, toxicity.PRIOR.copy(), -4.0)
    s = toxicity.Scorer(model)
    bare, aimed, denied, told = (s.score(t) for t in ("a grumpf here", "you are a grumpf here", "he is not a grumpf here", "he said a grumpf here"))
    assert aimed > bare > told and bare > denied > s.score("a person here")
    assert s.score("agrumpf") == s.score("nothing") < 0.3
    assert s.score("I will kill you") > s.score("I will not kill you")


def test_fit_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(make_docs(["a b c"]), none)
    assert toxicity.score_documents(make_docs(["a b c", None]), model).filter("predicted = 1").count() == 0
    assert toxicity.score_documents(make_docs([]), model).count() == 0


def test_logistic_follows_the_labels():
    x = np.zeros((200, len(toxicity.FEATURES)))
    x[:100, 0] = 5.0
    w, b = toxicity.logistic(x, np.r_[np.ones(100), np.zeros(100)])
    assert 5 * w[0] + b > 1 and b < -1
