"""Line dedup against all pairs of lines."""

import random

import pytest

from laborlens.llm import lines


def plain(rows, similarity=0.8):
    """Removed line numbers by document."""
    every = []
    for i, text in rows:
        if i is not None:
            for k, body in enumerate((text or "").split("\n")):
                every.append((i, k, frozenset(w for w in body.split(" ") if w)))
    every.sort(key=lambda x: x[:2])
    out = {i: set() for i, _ in rows}
    for n, (i, k, a) in enumerate(every):
        for j, m, b in every[:n]:
            if a and b and (j, m) != (i, k) and len(a & b) >= similarity * len(a | b) - 1e-12:
                out[i].add(k)
                break
    return {i: sorted(v) for i, v in out.items()}


def random_rows(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ä", "É,", "x."]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 25))] for _ in range(12)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(base)) if rnd.random() < 0.7 else [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))]
            for _ in range(rnd.randint(0, 3)):
                if line:
                    line[rnd.randrange(len(line))] = rnd.choice([rnd.choice(vocabulary), f"new{rnd.randrange(10**6)}"])
            body.append(rnd.choice([" ", "  "]).join(line))
        rows.append((i * 7 % n, "\n".join(body)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(make_docs, seed):
    rows = random_rows(seed, 121)
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)


def test_near_copies_of_one_line(make_docs):
    """Each variant has words of its own, and some only match variants that are removed themselves."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(150):
        line = list(base)
        for k in rnd.sample(range(40), rnd.choice([1, 2, 3, 5, 7])):
            line[k] = f"own{i}x{k}" if rnd.random() < 0.5 else rnd.choice(base)
        rows.append((i, " ".join(line)))
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)


def test_other_similarity(make_docs):
    rows = random_rows(5, 61)
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(make_docs(rows), similarity=0.5).collect()}
    assert got == plain(rows, 0.5)


def test_odd_texts(make_docs):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, "\n\n"), (8, "a b"), (9, "a  b\n\nb a"), (10, long), (11, long + " one more"), (12, "   ")]
    docs = make_docs(rows)
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in lines.dedup_lines(docs).collect()}
    assert got == {5: (1, []), 6: (1, []), 7: (3, []), 8: (1, []), 9: (3, [0, 2]), 10: (1, []), 11: (1, [0]), 12: (1, [])}
    kept = {r["doc_id"]: r["text"] for r in lines.without_lines(docs).collect()}
    assert kept[5] is None and kept[9] == "" and kept[8] == "a b" and kept[11] == "" and kept[7] == "\n\n"
    assert lines.without_lines(docs).columns == docs.columns


def test_repeated_rows_null_ids_and_empty(make_docs):
    got = lines.dedup_lines(make_docs([(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b")])).collect()
    assert sorted((r["doc_id"] or 0, r["removed"]) for r in got) == [(0, []), (1, []), (1, []), (2, [0])]
    assert lines.dedup_lines(make_docs([])).count() == 0


def test_leads_are_the_commonest_so_far(spark):
    """A commoner class that comes later must not hide the earlier one that settles a class."""
    sets = [(1, 1, 0), (2, 3, 2**20 - 1), (3, 1, 2**20 - 1), (4, 9, 0)]  # id, copies, parities; 1 and 4 are alike, 2 and 3 are
    classes = spark.createDataFrame(
        [(i, 0, p, 0, 10, copies, 5, 6) for i, copies, p in sets],
        "id bigint, line int, p0 bigint, p1 bigint, n int, copies bigint, k0 int, k1 int",
    )
    got = {(r["aid"], r["bid"]) for r in lines.sampled_pairs(classes, 0.8).collect()}
    assert got == {(3, 2), (4, 1)}


def test_many_pairs_in_two_rounds(make_docs, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS_A_CLASS", 0)
    rows = random_rows(3, 61)
    got = {r["doc_id"]: r["removed"] for r in lines.dedup_lines(make_docs(rows)).collect()}
    assert got == plain(rows)
