"""URL filters against a plain loop over the rules, and the mix against its definition."""

import math
import random
from collections import defaultdict

from laborlens.llm import mixing, urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
        m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        path = tail[:m]
    best = None
    for h, t, v in rules:
        if None in (h, t, v):
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(t):
            key = (len(h + t), h.count("."), h + t, v)
            best = max(best, key) if best else key
    return (host, path, best[2] if best else None, best[3] if best else default)


def check(spark, addresses, rules):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(addresses)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame([(*r, "extra") for r in rules], "host string, path string, verdict string, key string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(pages, table).collect()}
    assert len(got) == len(addresses)
    for i, u in enumerate(addresses):
        assert got[i] == plain(u, rules), u


def test_rules_of_the_query(spark):
    check(spark, [
        "http://www.example.com/en/a?x#y", "https://EXAMPLE.com/en/", "https://a.www.Example.com/en/b", "http://example.com/en", "http://example.com", "http://com/",
        "http://notexample.com/en/", "ftp://x.net/es/1", "http://x.net/es", "http://net/fr/?a=b", None, "", "no address", "x://", "http:///en/", "http://a.net/fr//fr/",
        "http://x.com?page=/en/", "http://x.com#/en/", "http://u://v.com/en/", "http://exämple.net/es/ü", "http://www.example.com/en/a?x#y", "http://" + "a." * 3000 + "com/" + "p" * 50000,
    ], RULES)


def test_random_nested_rules(spark):
    rnd = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "net", "a.net", "", "x"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/é", "/a\uffff"]
    rules = [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(25)] + [(None, "/", "block"), ("com", None, "allow"), ("a.com", "/", None)]
    unique = {}
    for h, t, v in rules:  # of equal rules with both verdicts, block counts
        unique[h, t] = max(v or "", unique.get((h, t), ""))
    rules = [(h, t, v or None) for (h, t), v in unique.items()]
    addresses = ["s://" + rnd.choice(["", "z.", "y.z."]) + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(["", "/", "b", "/b/c", "\uffff", "?q", "#f"]) for _ in range(400)]
    check(spark, addresses, rules)


def test_no_rules_no_pages(spark):
    check(spark, ["http://a.com/"], [])
    check(spark, [], RULES)


# --- mixing -------------------------------------------------------------------------------------


def targets(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, epochs=mixing.EPOCHS):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= epochs * sizes[s]}
        if not full:
            out.update({s: level * w[s] for s in free})
            break
        out.update({s: epochs * sizes[s] for s in full})
        left -= sum(epochs * sizes[s] for s in full)
        free -= full
    return out


def docs_for(make_docs, seed=1, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = rnd.choice([0, 1, 5, 40, 300])
        sep = rnd.choice([" ", "\n", "\t", "\u00a0x ", "\x0b"])
        source = rnd.choice(["a"] * 20 + ["b", "é", "B", None, "\U0001f600", "\uffff"])
        rows.append((i, None if rnd.random() < 0.02 else sep.join(rnd.choice(["w", "$$$", "ünd"]) for _ in range(words)), source))
    return rows, make_docs(rows)


def count_words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_words(make_docs):
    rows, docs = docs_for(make_docs)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size, source_size = {}, defaultdict(int)
    for i, text, source in rows:
        size[i] = count_words(text)
        source_size[source] += size[i]
    want = targets(source_size)
    taken = defaultdict(int)
    for r in got:
        s = r["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == source_size[s]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9)
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        if source_size[s]:  # whole epochs come before anything is taken once more
            whole = int(want[s] // source_size[s])
            assert r["taken"] in (whole * r["size"], (whole + 1) * r["size"])
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(size.values())
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_first_in_key_order_are_taken(make_docs):
    _, docs = docs_for(make_docs, 2)
    by = defaultdict(list)
    for r in mixing.mix_sources(docs, share=0.4).collect():
        by[r["source"]].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r["key"], r["doc_id"], r["size"]))
        before = 0
        for r in rows:
            whole = int(r["target"] // r["source_size"]) if r["source_size"] else 0
            again = before + r["size"] / 2 <= r["target"] - whole * r["source_size"]
            assert r["taken"] == r["size"] * (whole + again)
            before += r["size"]


def test_small_buckets_give_the_same_mix(make_docs, monkeypatch):
    _, docs = docs_for(make_docs, 3)
    one = sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str) == one


def test_repeats_nulls_and_empty(make_docs):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (2, None, "t"), (3, "", "t")]
    got = mixing.mix_sources(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["taken"] <= 2 * r["size"]) for r in got) == [(0, 2, True), (1, 3, True), (1, 3, True), (2, 0, True), (3, 0, True)]
    assert mixing.mix_sources(make_docs([])).count() == 0


def test_better_texts_come_first(make_docs):
    rows = [(i, ("word " * 20) if i % 2 else ("w$%& " * 20)) for i in range(2000)]
    got = mixing.mix_sources(make_docs(rows), share=0.5).collect()
    good = sum(r["taken"] > 0 for r in got if r["doc_id"] % 2)
    assert good > 700  # of about 1000 taken
