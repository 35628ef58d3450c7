"""Heavy work is dealt to all cores and holds a bounded part of a batch."""

import random

import numpy as np
import pandas as pd
import regex

from laborlens.functions import embed as E
from laborlens.operators import taxonomy as T
from laborlens.plans.registry import Tables


def test_vectors_hold_the_words_of_a_run_of_texts(monkeypatch):
    rnd = random.Random(3)
    texts = [None, ""] + [" ".join(rnd.choices(["data", "zorg", "werk", "naïef", "abc"], k=rnd.randrange(1, 40))) for _ in range(60)]
    whole, held, plain = E.embed_texts(pd.Series(texts)), [], E.embed_words
    monkeypatch.setattr(E, "RUN_CHARS", 200)
    monkeypatch.setattr(E, "embed_words", lambda words: held.append(sum(map(len, words))) or plain(words))
    cut = E.embed_texts(pd.Series(texts))
    assert len(cut) == len(texts) and all(np.array_equal(a, b) for a, b in zip(whole, cut))
    assert len(held) > 10 and max(held) < 120


def test_places_of_labels_without_a_pattern_for_each():
    known = pd.DataFrame([("a", "c++", "c++", 0), ("b", "data", "data", 0)], columns=["uri", "label", "norm", "entry"])
    finder, rnd = T.Finder(known), random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choices("dat+ #é1", k=12))
        label = "".join(rnd.choices("dat+", k=rnd.randrange(1, 4)))
        found = regex.search(rf"(?<![\p{{L}}\p{{N}}]){regex.escape(label, literal_spaces=True)}(?![\p{{L}}\p{{N}}+#])", text)
        assert finder.place(text, label) == (found.start() if found else -1)
    assert not hasattr(finder, "patterns")


def test_cv_texts_are_dealt_to_all_cores(spark, tmp_path):
    from laborlens.plans import flow_queries as Q

    spark.range(40).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    t = Tables(spark, str(tmp_path))
    assert Q.cv_texts(t).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "Filter" not in Q.V.block_rows(Q.cvs(t))._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]


def test_equal_vectors_have_equal_cosines_wherever_they_lie():
    from laborlens.operators import dedup as D

    rng = np.random.default_rng(2)
    one = rng.normal(size=67)
    for copies in (5, 40, 333):
        y = np.repeat((one + rng.normal(size=67) * 0.1)[None, :], copies, axis=0)
        x = np.r_[one[None, :], one[None, :] + rng.normal(size=(30, 67)) * 0.1]
        basis = D.main_directions(x / np.linalg.norm(x, axis=1, keepdims=True))
        i, j, s, _ = D.pairs_above(x, y, D.heads(x, basis), D.heads(y, basis), 0.5)
        for row in range(len(x)):
            mine = s[i == row]
            assert len(mine) == copies and len(set(mine)) == 1
            want = sum(a * b for a, b in zip(x[row], y[0])) / np.sqrt(sum(a * a for a in x[row]) * sum(b * b for b in y[0]))
            assert mine[0] == want
