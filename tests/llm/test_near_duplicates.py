"""DartMinHash signatures against the similarity they estimate, groups against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from laborlens.llm import dartminhash as D


def split(text):
    return [w for w in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", (text or "").lower()) if w]


def grams(text, n=5):
    w = split(text)
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def plain(rows, weighted=False, similarity=0.8):
    sets = [grams(t) if weighted else Counter(dict.fromkeys(grams(t), 1)) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both and both >= similarity * sum((sets[a] | sets[b]).values()) - 1e-12:
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def near_rows(seed, n=90):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(300)}" for _ in range(rnd.choice([3, 8, 40, 120]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base)) if rnd.random() < 0.8 else [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 4)):
            if w:
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        if rnd.random() < 0.2:
            w = w + w[:30]  # shingles with counts above one
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("weighted", [False, True])
def test_groups_equal_all_pairs(make_docs, weighted):
    rows = near_rows(11 + weighted)
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(make_docs(rows), weighted=weighted).collect()}
    assert got == plain(rows, weighted)


def test_variants_around_one_text(make_docs):
    """A hot group: many variants, some similar to the middle only, some to nothing."""
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rnd.sample(range(200), rnd.choice([1, 2, 4, 6, 9])):
            w[k] = f"own{i}x{k}" if rnd.random() < 0.7 else ""
        rows.append((i, " ".join(w)))
    rows[80] = (80, " ".join(base))
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(make_docs(rows)).collect()}
    assert got == plain(rows)


def test_chain_of_texts(make_docs):
    """Neighbours are similar, the ends are not: one group all the same."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(60)]
    got = {r["class_id"] for r in D.near_duplicates(make_docs(rows)).collect()}
    assert len(got) == len(set(plain(rows).values())) == 1


def test_odd_rows(make_docs):
    long = " ".join(f"t{i}" for i in range(50000))
    rows = [(9, None), (8, ""), (7, " ,. "), (6, "One two"), (5, "one, TWO"), (4, long), (3, long + " end"), (2, "x"), (None, "x"), (1, "one two"), (1, "one two")]
    got = D.near_duplicates(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in got if r["class_id"] is not None) == [
        (1, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 1), (6, 1), (7, 7), (8, 8), (9, 9),
    ]
    assert {r["class_size"] for r in got if r["class_id"] == 1} == {4}
    assert D.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("size", [3, 60, 900])
def test_agreement_is_the_weighted_similarity(size):
    rng = np.random.default_rng(size)
    elements = rng.integers(1, 2**62, size, dtype=np.uint64)
    cut_at = max(1, int(size * 0.7))
    a, wa = elements, rng.uniform(0.2, 3, size)
    b = np.r_[elements[:cut_at], rng.integers(1, 2**62, size - cut_at, dtype=np.uint64)]
    wb = np.r_[wa[:cut_at] * rng.uniform(0.7, 1.3, cut_at), wa[cut_at:]]
    both = np.minimum(wa[:cut_at], wb[:cut_at]).sum()
    exact = both / (wa.sum() + wb.sum() - both)
    agree = []
    for salt in range(40):
        s = np.uint64(salt * 7919)
        sig = D.signatures(np.r_[np.zeros(size, int), np.ones(size, int)], np.r_[a ^ s, b ^ s], np.r_[wa, wb], 2)
        assert (sig != 0).all()
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - exact) < 0.03


def test_signature_does_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    e = rng.integers(1, 2**62, 50, dtype=np.uint64)
    alone = D.signatures(np.zeros(50, int), e, np.ones(50), 1)
    among = D.signatures(np.r_[np.zeros(5, int), np.ones(50, int)], np.r_[e[:5], e], np.ones(55), 3)
    assert (among[1] == alone[0]).all() and (among[2] == 0).all()
