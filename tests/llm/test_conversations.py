"""Repaired conversations against an exhaustive reading, row by row, with whole audits as labels."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from laborlens.llm import conversations as cv

ROWS = "conv_id long, turn long, role string, text string, kind string, conv string, audit string, digest string"


def layered(codes, faults):
    """Least (cost, audit) by carrying the best audit of every state from row to row."""

    def close(best):
        best = dict(best)
        for _ in range(3):
            for q, (c, s) in list(best.items()):
                after = 3 if q == 2 else 2
                if after not in best or (c + 5, s + "I") < best[after]:
                    best[after] = (c + 5, s + "I")
        return best

    best = close({0: (0, "")})
    for code, fault in zip(codes, faults, strict=True):
        step = {}

        def put(q, label, step=step):
            step[q] = min(label, step.get(q, label))

        for q, (c, s) in best.items():
            after = 3 if q == 2 else 2
            put(q, (c + 2, s + "D"))
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                if code == 1 and q == 0:
                    put(1, (c + more, s + "K"))
                if code == after:
                    put(after, (c + more, s + "K"))
                put(after, (c + more + 1, s + "R"))
        best = close(step)
    return min(label for q, label in best.items() if q in (0, 3))


def test_search_equals_layers():
    rnd = random.Random(5)
    for _ in range(3000):
        n = rnd.choice([0, 1, 2, 3, 5, 8, 25])
        codes = bytes(rnd.choice([0, 1, 2, 3, 2, 3]) for _ in range(n))
        faults = bytes(rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert cv.cheapest_edits(codes, faults) == layered(codes, faults)


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return out


def plain(rows):
    out = {}
    for conv, kept in damage(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults, codes = set(), [], []
        for _, role, text in kept:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") or not (a[1] and b[1]) for a, b in zip(kept, kept[1:], strict=False))
        cost, audit = layered(codes, faults)
        said, k = [], 0
        for x in audit:
            last = "s" if said and codes and said[-1][2] else said[-1][0][:1] if said else ""
            after = "assistant" if last == "u" else "user"
            if x == "I":
                said.append((after, "", False))
                continue
            _, role, text = kept[k]
            k += 1
            if x == "K":
                said.append((role, text, role[:1] == "s"))
            elif x == "R":
                said.append((after, text, False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in said).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, digest)
    return out


def run(spark, rows):
    table = spark.createDataFrame([(*r, "k", "c", "a", "d") for r in rows], ROWS)
    found = cv.repair_conversations(cv.damaged(table)).collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    return got


def test_random_conversations(spark):
    rnd = random.Random(11)
    rows = []
    for conv in [*range(250), None, -3]:
        for turn in range(rnd.choice([1, 2, 4, 8, 15])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Üser", "ua"])
            text = rnd.choice(["Yes.", "no", "Really?  \n", "", None, " \t", "a. b!", "é.", "x ", "same.", f"t{turn}."])
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 3, None]), role, text))
    rows += [(900, 1, "user", "b."), (900, 1, "user", "a."), (900, 1, "assistant", "c."), (900, 1, "user", "a.")]
    rnd.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_a_long_conversation(spark):
    rnd = random.Random(2)
    rows = [(1, t, rnd.choice(["user", "assistant", "assistant"]), rnd.choice([f"t{t}.", f"t{t}", "same."])) for t in range(3000)]
    rows += [(2, 0, "user", "long " * 200_000 + "."), (2, 1, "assistant", "ok.")]
    assert run(spark, rows) == plain(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x")]
    assert run(spark, rows) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}


def test_texts_stay_out_of_the_first_pass(spark):
    rows = cv.with_digest(spark.range(1).select(
        F.col("id").alias("conv"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"), F.lit(False).alias("dropped")))
    assert "text" not in cv.faults(rows).columns
