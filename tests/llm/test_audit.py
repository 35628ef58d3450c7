"""The audit against applying every order of the filters to every document."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from laborlens.llm import audit

LABELS = "doc_id long, quality int, toxic int, part string, failed string"


def failed(rows):
    """Failed filters of each row, by the definition."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        if i is not None and i > least[t]:
            f.add("E")
        out.append(f)
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    by_part, out = {}, {}
    for (i, _, part), f in zip(rows, failed(rows), strict=True):
        by_part.setdefault(part or "", []).append((i, f))
    for part, docs in by_part.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in d[1] for d in docs) - len(gone), sum(d[1] == {x} for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def texts(rnd, n):
    words = ["alpha", "Beta", "GAMMA", "delta#", "é", " x", "a|b", "z"] + [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        size = rnd.choice([0, 1, 49, 50, 51, 120])
        text = rnd.choice([" ", "\n", "\t ", "\x0b"]).join(rnd.choices(words[: rnd.choice([4, 20, 68])], k=size))
        text = rnd.choice(["", " ", "\n"]) + text + rnd.choice(["", " ", "\r\n"])
        rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice([text, text, "", None, " \n"]), rnd.choice(["a", "b", "", None, "\U0001f600"])))
    return rows + [(1000 + k, "copy " * 60, "a") for k in range(40)] + [(7, "word " * 100_000, "b")]


def run(spark, make_docs, rows, labels):
    table = spark.createDataFrame([(*x, "p", "f") for x in labels], LABELS)
    docs = make_docs(rows)
    for name in ("part", "failed", "good", "docs", "first"):
        docs = docs.withColumn(name, F.lit("x"))
    found = audit.audit_filters(docs, table).collect()
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found}
    assert len(got) == len(found)
    return got


def test_every_order(spark, make_docs):
    rnd = random.Random(3)
    rows = texts(rnd, 300)
    ids = list(range(300)) + [7, 1000, 1001, 5, 5, None, 99999]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in ids]
    assert run(spark, make_docs, rows, labels) == brute(rows, labels)


def test_empty_tables(spark, make_docs):
    assert run(spark, make_docs, [], []) == {}
    rows = [(1, None, None), (2, "", "")]
    assert run(spark, make_docs, rows, []) == brute(rows, [])


def test_few_counters_at_a_time(spark, make_docs, monkeypatch):
    monkeypatch.setattr(audit, "GROUPS", 2)
    rows = [(i, "w " * (i % 70), f"s{i % 9}") for i in range(200)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(200)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert run(spark, make_docs, rows, labels) == brute(rows, labels)


def test_positional_popcount():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 26, 27, 28, 1000, 4099):
        words = rnd.integers(0, 2**32, n, dtype=np.uint32)
        want = [int(((words >> np.uint32(k)) & 1).sum()) for k in range(32)]
        assert audit.positional_popcount(words).tolist() == want
    assert audit.positional_popcount(np.full(999, 0xFFFFFFFF, np.uint32)).tolist() == [999] * 32
