"""Base spans against a plain reading of the patterns; learned spans against the same graph in Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from laborlens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


def counts(kind, value):
    n = len(re.sub("[^0-9]", "", value))
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= n <= 19 and luhn(value)
    return kind == "email" or 9 <= n <= 15


def base(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            if counts(kind, m.group()):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def word(w):
    w = re.sub(r"^[^\w]+|[^\w]+\Z", "", w.lower().replace("_", " ").strip())
    return re.sub("[0-9]+", "9", w)


SHAPES = [
    lambda v, n: re.fullmatch(r"[^@\s]+(@|\(at\)|\[at\])[^@\s]+", v),
    lambda v, n: 2 <= n <= 32 and re.fullmatch(r"([0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}", v),
    lambda v, n: 12 <= n <= 19 and re.fullmatch(r"[0-9 ./-]+", v),
    lambda v, n: 7 <= n <= 15 and re.fullmatch(r"[0-9()+ ./-]+", v),
]
SLOT = r"(?<!\S)(?:[0-9()+./-]*[0-9][0-9()+./-]*(?: [0-9()+./-]*[0-9][0-9()+./-]*)*[,;:!?]*(?!\S)|\S*(?:[0-9@]|\(at\)|\[at\])\S*)"


def learned(rows, rounds=pii.ROUNDS):
    """Added spans of each (id, text), by the definition over the whole graph."""
    seen = []
    for key in dict.fromkeys(rows):
        text = key[1] or ""
        found = list(re.finditer(SLOT, text))
        for k, m in enumerate(found):
            left = text[found[k - 1].start() if k else 0 : m.start()][-pii.BEFORE :].split()
            right = text[m.end() : found[k + 1].end() if k + 1 < len(found) else len(text)][: pii.AFTER].split()
            raw = m.group()
            lead = len(re.match(r"[^\w+(\[]*", raw).group())
            value = re.match(r"[^\w+(\[]*(.*?)[^\w)\]]*\Z", raw, re.S).group(1)
            seed = next((j for j, kind in enumerate(pii.KINDS) if any(counts(kind, x.group()) for x in re.finditer(PLAIN[kind], raw))), None)
            low = value.lower()
            shapes = {j for j, f in enumerate(SHAPES) if f(low, len(re.sub("[^0-9]", "", low)))}
            w1, w2 = (word(left[-j]) if len(left) >= j else "" for j in (1, 2))
            r1 = word(right[0]) if right else ""
            patterns = ([f"{w2} {w1} _"] if w1 and w2 else []) + ([f"{w1} _ {r1}"] if w1 and r1 else [])
            if value:
                seen.append((key, m.start() + lead, m.start() + lead + len(value), low, seed, shapes, patterns))
    edges = {(p, v, s, frozenset(sh)) for _, _, _, v, s, sh, ps in seen for p in ps}
    known = {}
    for _ in range(rounds):
        yes, no = defaultdict(float), defaultdict(float)
        for p, v, s, sh in edges:
            for j in range(4):
                if s == j:
                    yes[p, j] += 1
                elif j not in sh:
                    no[p, j] += 1
                elif s is None and v in known and known[v][0] == j:
                    yes[p, j] += known[v][1]
        accepted = {}
        for p in {e[0] for e in edges}:
            score, _, j = max((round(yes[p, j] / (yes[p, j] + no[p, j] + 1), 9), -j, j) for j in range(4))
            if yes[p, j] >= pii.MIN_VALUES and score >= pii.MIN_SCORE:
                accepted[p] = (j, score)
        doubt = defaultdict(float)
        for p, v, s, sh in edges:
            if s is None and p in accepted and accepted[p][0] in sh:
                doubt[v, accepted[p][0]] += math.log(1 - accepted[p][1])
        known = {}
        for (v, j), d in sorted(doubt.items(), key=lambda x: (x[1], x[0][1])):
            if round(1 - math.exp(d), 9) >= pii.MIN_SCORE:
                known.setdefault(v, (j, round(1 - math.exp(d), 9)))
    out = defaultdict(set)
    for key, start, end, v, s, sh, _ in seen:
        if s is None and sh and v in known and not any(a < end and start < e for a, _, e in base(key[1])):
            out[key].add((start, known[v][0], end))
    return {k: sorted(v) for k, v in out.items()}


def run(make_docs, rows):
    docs = make_docs(rows)
    for name in ("base", "slots", "value", "pattern", "kind", "start", "key", "more"):
        docs = docs.withColumn(name, F.lit("x"))
    return [(r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["added"]]) for r in pii.find_personal_data(docs).collect()]


def check(make_docs, rows):
    want = learned(rows)
    got = run(make_docs, rows)
    assert sorted(got, key=repr) == sorted(((i, base(t), want.get((i, t), [])) for i, t in rows), key=repr)
    return want


def test_base_patterns_on_hard_texts(make_docs):
    rnd = random.Random(4)
    fixed = [
        "x@a.b%c@d.e f@g", "a@b.c.d..e@f.gh", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.1 1.2.3", "4111 1111 1111 1111-2", "4111-1111 1111  1111", "+1 (2) 3-4.5 6789 x +49",
        "é 4716123412341238 \U0001f600 a@b.co", "@ + . 1", "+1 (269) 555-3296 4524132264652876", None, "", "a@b.c," * 3, "1 2 3 4 5 6 7 8 9 0 1 2", "..a@b.c.", "a@-.-", "+1234567890123456",
    ]
    parts = ["1", "4111111111111111", "12", "@", ".", "-", " ", "+", "(", ")", "a", "é", "255", "300", "%", "b.co", "x@y.z", "\n", "\U0001f600", "+1 555 123 4567"]
    rows = [(i, t) for i, t in enumerate(fixed + ["".join(rnd.choices(parts, k=rnd.choice([5, 20, 60]))) for _ in range(400)])]
    got = {i: b for i, b, _ in run(make_docs, rows)}
    assert got == {i: base(t) for i, t in rows}


def test_long_texts(make_docs):
    texts = ["1" * 200_000, "a" * 200_000, "1 " * 60_000, "a@b" + ".c" * 60_000, "1." * 60_000, "+1" + "(" * 100_000, "." * 100_000 + "@", "x@y.zz 10.0.0.1, " * 2000]
    got = {i: b for i, b, _ in run(make_docs, list(enumerate(texts)))}
    assert [got[k] for k in (0, 1, 2, 5, 6)] == [[]] * 5
    assert got[3] == [(0, 0, 120_003)]
    assert got[4] == [(8 * k, 1, 8 * k + 7) for k in range(15_000)]
    assert got[7] == sorted([(17 * k, 0, 17 * k + 6) for k in range(2000)] + [(17 * k + 7, 1, 17 * k + 15) for k in range(2000)])


def story(rnd, before, value, after=""):
    words = [rnd.choice("lorem ipsum dolor sit amet elit sed tempor magna nulla".split()) for _ in range(12)]
    k = rnd.randrange(3, 9)
    return " ".join([*words[:k], before, value, after, *words[k:]]).replace("  ", " ")


def planted(rnd):
    texts = [story(rnd, "please call", f"+1 555 {rnd.randrange(100, 999)} {rnd.randrange(1000, 9999)}", "today") for _ in range(30)]
    texts += [story(rnd, "please call", "(0170) 555-1234", "today"), story(rnd, "ring desk", "(0170) 555-1234", "now")]
    texts += [story(rnd, "ring desk", f"(0{k}70) 55{k}-1234", "now") for k in range(5)] + [story(rnd, "please call", f"(0{k}70) 55{k}-1234", "today") for k in range(4)]
    texts += [story(rnd, "mail to", f"u{k}@mail{k}.example.com", "soon") for k in range(12)] + [story(rnd, "mail to", "bob@localhost", "soon"), "mail to jane(at)host soon"]
    texts += [story(rnd, "version number", f"{k}.0") for k in range(9)] + [story(rnd, "order of", "5551234567 8"), story(rnd, "version number", "555 123 4567")]
    texts += [story(rnd, "from host", f"10.0.{k}.1") for k in range(9)] + [story(rnd, "from host", "fe80::1ff:fe23:4567:890a")]
    return [(i, t) for i, t in enumerate(texts)]


def test_contexts_find_unseen_identifiers(make_docs):
    rows = planted(random.Random(9))
    want = check(make_docs, rows)
    found = {t[a:e] for (_, t), spans in want.items() for a, _, e in spans}
    # (0570) and "ring desk" follow from values that "please call" taught in an earlier round
    assert {"(0170) 555-1234", "(0470) 554-1234", "bob@localhost", "jane(at)host", "fe80::1ff:fe23:4567:890a"} <= found
    assert not any("555 123 4567" in t for t in found)


def test_repeats_nulls_and_empty(make_docs):
    rows = [(1, "please call +1 555 123 4567 today")] * 5 + [(1, "other a@b.cd"), (None, "a@b.cd"), (None, None), (2, "please call 555 123 4567 today")]
    want = check(make_docs, rows)
    assert want == {}  # five rows of one id and text are one value, too few for a pattern
    assert run(make_docs, []) == []


def test_digest_and_text(make_docs):
    rows = [(1, "a@b.cd 10.0.0.1"), (2, "")]
    r1, r2 = pii.describe(pii.find_personal_data(make_docs(rows))).orderBy("doc_id").collect()
    assert r1["spans"] == "email:0:6,ip:7:15" and (r1["n_email"], r1["n_ip"], r1["n_card"], r1["n_phone"]) == (1, 1, 0, 0)
    assert r1["base_sha256"] == hashlib.sha256(r1["spans"].encode()).hexdigest()
    assert r2["spans"] == "" and r2["base_sha256"] == hashlib.sha256(b"").hexdigest()
