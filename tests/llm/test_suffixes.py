"""Repeated strings against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from laborlens.llm import suffixes as S


def plain(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(seed, n=40):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(150, 900))) for _ in range(5)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 201, "ab" * 500, "é" * 300]
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            t = rnd.choice(base)
            i = rnd.randrange(len(t))
            t = t[i : i + rnd.randint(1, 700)] if rnd.random() < 0.6 else t
            for _ in range(rnd.randint(0, 2)):
                if t:
                    k = rnd.randrange(len(t))
                    t = t[:k] + rnd.choice("xyz") + t[k + rnd.randint(0, 2) :]
            parts.append(t)
        texts.append("".join(parts))
    return texts


def check(make_docs, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(make_docs(texts)).collect()}
    want = plain(texts)
    for i in range(len(texts)):
        assert got[i] == want[i], i
    assert len(got) == len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_count_of_all_strings(make_docs, seed):
    check(make_docs, random_texts(seed))


def test_crowded_buckets_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(S, "GATHER_RUNS", 1)
    check(make_docs, random_texts(3))


def test_common_passage_in_many_texts(make_docs):
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(330))
    other = lambda n: "".join(rnd.choice("ijklmnop ") for _ in range(n))
    check(make_docs, [other(rnd.randint(0, 300)) + passage + other(rnd.randint(0, 300)) for _ in range(60)])


def test_spans_repeated_rows_and_null_ids(make_docs):
    rnd = random.Random(9)
    a, b = ("".join(rnd.choice("abc") for _ in range(300)) for _ in range(2))
    rows = [(1, a), (1, a), (None, b), (2, "x" + b), (3, None)]
    got = S.remove_repeats(make_docs(rows)).collect()
    assert sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in got) == [
        (0, [(0, 300)]), (1, [(0, 300)]), (1, [(0, 300)]), (2, [(1, 301)]), (3, []),
    ]
    assert S.remove_repeats(make_docs([])).count() == 0


def test_refinement_on_random_bytes():
    rnd = random.Random(5)
    for _ in range(60):
        length = rnd.choice([200, 30, 41])
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 300))) + b"a" * rnd.choice([0, 0, 400]) for _ in range(rnd.randint(1, 5))]
        texts += [texts[0][3:]]
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        bucket = S.refine(np.frombuffer(b"".join(texts), np.uint8), offsets, length)
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for k, t in enumerate(texts):
            mine = bucket[offsets[k] : offsets[k + 1]] >= 0
            want = [i + length <= len(t) and count[t[i : i + length]] > 1 for i in range(len(t))]
            assert list(mine) == want
