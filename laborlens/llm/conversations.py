"""Conversation structure repair: bidirectional Dijkstra over the edit lattice of each conversation.

A node of the lattice is a place between rows and the last role given out. Searches from both ends
meet; all crossings of least cost are finished, and the least audit among them is read off the tight
edges, so no node holds a string and memory stays linear in the rows of one conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut

OTHER, SYSTEM, USER, ASSISTANT = range(4)  # what a role's initial stands for
START, GAVE_S, GAVE_U, GAVE_A = range(4)  # the role given out last
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)  # first fault of a row
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5  # costs; keeping is free
FAR = 1 << 62


def _next(gave: int) -> int:
    """The role that follows: users and assistants take turns."""
    return GAVE_A if gave == GAVE_U else GAVE_U


def _onward(node: int, rows: int, codes: bytes, faults: bytes) -> list[tuple[str, int, int]]:
    """(initial of the edit, next node, cost), in the order of the initials."""
    i, gave = node >> 2, node & 3
    after = _next(gave)
    out = []
    if i < rows:
        out.append(("D", node + 4, DELETE))
    out.append(("I", 4 * i + after, INSERT))
    if i < rows and faults[i] not in (BLANK, DUPLICATE):
        more = UNFINISHED if faults[i] == TRUNCATED else 0
        code = codes[i]
        if code == SYSTEM and gave == START:
            out.append(("K", node + 4 + GAVE_S, more))
        elif code in (USER, ASSISTANT) and code == after:
            out.append(("K", 4 * i + 4 + code, more))
        out.append(("R", 4 * i + 4 + after, more + REROLE))
    return out


def _back(node: int, codes: bytes, faults: bytes) -> list[tuple[int, int]]:
    """(node before, cost) of every edit that leads to ``node``."""
    i, gave = node >> 2, node & 3
    before = {GAVE_U: (START, GAVE_S, GAVE_A), GAVE_A: (GAVE_U,)}.get(gave, ())
    out = [(4 * i + q, INSERT) for q in before]
    if i:
        out.append((node - 4, DELETE))
        if faults[i - 1] not in (BLANK, DUPLICATE):
            more = UNFINISHED if faults[i - 1] == TRUNCATED else 0
            code, base = codes[i - 1], 4 * i - 4
            if gave == GAVE_S and code == SYSTEM:
                out.append((base + START, more))
            for q in before:
                out.append((base + q, more if code == gave else more + REROLE))
    return out


def cheapest_edits(codes: bytes, faults: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equal ones the audit that is least in ASCII.

    Audits of equal cost that lead to one node never begin one another (an added Insert costs more),
    so the least one can be read edit by edit along the edges that keep the cost least.
    """
    rows = len(codes)
    size = 4 * rows + 4
    ends = (4 * rows + START, 4 * rows + GAVE_A)
    dist = (array("q", [FAR]) * size, array("q", [FAR]) * size)
    done = (bytearray(size), bytearray(size))
    heaps: tuple[list, list] = ([(0, 0)], [(0, x) for x in ends])
    dist[0][0] = 0
    for x in ends:
        dist[1][x] = 0
    best = 0 if rows == 0 else FAR
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        mine, other = dist[side], dist[1 - side]
        d, x = heapq.heappop(heaps[side])
        if done[side][x]:
            continue
        done[side][x] = 1
        edges = [(y, w) for _, y, w in _onward(x, rows, codes, faults)] if side == 0 else _back(x, codes, faults)
        for y, w in edges:
            if d + w < mine[y]:
                mine[y] = d + w
                heapq.heappush(heaps[side], (d + w, y))
                if other[y] < FAR:
                    best = min(best, d + w + other[y])
    forward, reverse = dist
    settled = done[1]
    for x in ends:
        settled[x] = 1  # their distance is 0, looked at or not
    # settled nodes of the forward search that lead to a crossing of least cost
    good = bytearray(size)
    todo = []
    for x in range(size):
        if done[0][x] and (
            (settled[x] and forward[x] + reverse[x] == best)
            or any(settled[y] and forward[x] + w + reverse[y] == best for _, y, w in _onward(x, rows, codes, faults))
        ):
            good[x] = 1
            todo.append(x)
    while todo:
        x = todo.pop()
        for y, w in _back(x, codes, faults):
            if done[0][y] and not good[y] and forward[y] + w == forward[x]:
                good[y] = 1
                todo.append(y)
    x, cost, audit = 0, 0, []
    while not (x in ends and cost == best):
        for letter, y, w in _onward(x, rows, codes, faults):
            c = cost + w
            if (settled[y] and c + reverse[y] == best) or (good[y] and c == forward[y]):
                x, cost = y, c
                audit.append(letter)
                break
        else:
            raise AssertionError("no edge keeps the cost least")
    return best, "".join(audit)


# --- rows ---------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, dropped): the rows of a conversation table after the damage.

    Nulls of any column read as one space, but a null turn stays null for the order. Rows that go are
    kept with ``dropped``, so a conversation without any row left is still known.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    base = rows.select(F.col("conv_id").alias("conv"), "turn", said[2].alias("role"), said[3].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def in_order() -> list:
    return [F.col("turn").asc_nulls_first(), "role", "digest"]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, dropped, code, fault) of rows with a digest; texts stay where they are read."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(
        "conv", "turn", "role", "digest", "dropped", code.alias("code"), last.alias("last")
    )
    same = Window.partitionBy("conv", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(F.col("last") == "", BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.col("last").rlike("[.!?]"), TRUNCATED)
        .otherwise(FINE)
    )
    return narrow.withColumn("fault", fault).drop("last")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[bool, tuple]]:
    """(whether a new conversation begins, row) of sorted batches."""
    none = object()
    last = none
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            yield last is none or row[0] != last, row
            last = row[0]


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _figures(turns: tuple, codes: bytes, marks: bytes) -> tuple:
    least, most, distinct = turns
    cost, audit = cheapest_edits(codes, marks)
    gaps = 0 if least is None else most - least + 1 - distinct
    illegal = sum(p not in LEGAL for p in zip(codes, codes[1:], strict=False))
    return gaps, *(marks.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of figures per conversation; two bytes are held for each row of the one at hand."""
    names = ["conv", *(f.split()[0] for f in FIGURES.split(", "))]
    held, conv, kind = [], None, None
    turns, codes, marks = (None, None, 0), bytearray(), bytearray()

    def out() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def typed(all_batches):
        nonlocal kind
        for b in all_batches:
            kind = b.schema.field("conv").type
            yield b

    begun = False
    for new, (c, dropped, turn, code, fault) in _groups(typed(batches), ("conv", "dropped", "turn", "code", "fault")):
        if new:
            if begun:
                held.append((conv, *_figures(turns, bytes(codes), bytes(marks))))
                if len(held) >= 1000:
                    yield out()
            begun, conv = True, c
            turns, codes, marks = (None, None, 0), bytearray(), bytearray()
        if not dropped:
            codes.append(code)
            marks.append(fault)
            if turn is not None:
                least, most, distinct = turns
                turns = (turn if least is None else least, turn, distinct + (turn != most))
    if begun:
        held.append((conv, *_figures(turns, bytes(codes), bytes(marks))))
        yield out()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation, from its audit (first) and its rows in order."""
    done, kind = [], pa.int64()
    digest = hashlib.sha256()
    audit, place, given, begun, conv, gave = "", 0, 0, False, None, START

    def say(role: str, text: str) -> None:
        nonlocal given
        digest.update(("\n" * (given > 0) + role + ":" + text).encode())
        given += 1

    def insert() -> None:
        nonlocal place, gave
        while place < len(audit) and audit[place] == "I":
            gave = _next(gave)
            say("user" if gave == GAVE_U else "assistant", "")
            place += 1

    def out() -> pa.RecordBatch:
        convs, sums = zip(*done, strict=True)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(sums, pa.string())], ["conv", "repaired_sha256"])

    def typed(all_batches):
        nonlocal kind
        for b in all_batches:
            kind = b.schema.field("conv").type
            yield b

    for new, (c, edits, role, text) in _groups(typed(batches), ("conv", "audit", "role", "text")):
        if new:
            if begun:
                insert()
                done.append((conv, digest.hexdigest()))
                if len(done) >= 1000:
                    yield out()
            digest, audit, place, given, begun, conv, gave = hashlib.sha256(), edits, 0, 0, True, c, START
            continue  # the first row of a conversation carries its audit
        insert()
        letter = audit[place]
        place += 1
        if letter == "K":
            gave = GAVE_S if role[:1] == "s" else _next(gave)
            say(role, text)
        elif letter == "R":
            gave = _next(gave)
            say("user" if gave == GAVE_U else "assistant", text)
    if begun:
        insert()
        done.append((conv, digest.hexdigest()))
        yield out()


def repair_figures(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of damaged rows with digests."""
    kind = rows.schema["conv"].dataType.simpleString()
    sorted_rows = faults(rows).select("conv", "dropped", "turn", "role", "digest", "code", "fault")
    sorted_rows = sorted_rows.repartition("conv").sortWithinPartitions("conv", "dropped", *in_order())
    return sorted_rows.select("conv", "dropped", "turn", "code", "fault").mapInArrow(_repair, f"conv {kind}, {FIGURES}")


def repaired_hashes(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): texts go once to the task of their conversation and are hashed in passing."""
    kind = rows.schema["conv"].dataType.simpleString()
    head = figures.select("conv", F.lit(0).alias("kind"), "audit")
    every = rows.filter(~F.col("dropped")).withColumn("kind", F.lit(1)).unionByName(head, allowMissingColumns=True)
    every = every.repartition("conv").sortWithinPartitions("conv", "kind", *in_order())
    return every.select("conv", "audit", "role", "text").mapInArrow(_hash, f"conv {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id.

    ``rows`` are damaged rows (``damaged``). A conversation is its rows by turn, nulls first; rows of one
    turn go by role, then by the SHA-256 digest of their text. Null conv_ids are one conversation.
    Rows count as often as they stand there. Roles are known by their first letter; others can only be
    rerolled or deleted. A conversation without rows has zeros, an empty audit and the hash of the empty
    string; an empty table gives an empty result. Long conversations cost two bytes and four nodes a row.
    """
    rows = with_digest(rows)
    figures = cut(repair_figures(rows) if figures is None else figures, "conversations")  # needed twice below
    sums = repaired_hashes(rows, figures).withColumnRenamed("conv", "_c")
    return figures.join(sums, F.col("conv").eqNullSafe(F.col("_c"))).drop("_c").withColumnRenamed("conv", "conv_id")
