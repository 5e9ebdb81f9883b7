"""Conversation repair against uniform-cost search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from quire.llm import repair

ROWS = "conv_id long, turn int, role string, text string"
KEEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
WANT = ["u", "u", "a", "u"]
NEXT = [2, 2, 3, 2]
NAMES = {"u": "user", "a": "assistant"}
BLANK = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        named = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(named.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's damaged rows: everything but the id."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANK)
        kinds.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "k")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, 0, ())], {}
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done[i, state] = True
        to = NAMES[WANT[state]]
        heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[state], (*lines, f"{to}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if kinds[i] in "tk":
                more = 5 if kinds[i] == "t" else 0
                if initials[i] in KEEP[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEEP[state][initials[i]], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, NEXT[state], (*lines, f"{to}:{text}")))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, sha


def held_against(spark, rows, block=repair.BLOCK):
    table = spark.createDataFrame(rows, ROWS)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damage(table), block).collect()}
    damaged = plain_damage(rows)
    want = {c: plain_repair([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def some_rows(rng, conversations, longest):
    texts = ["One.", "Two!", "Three", "", " \t", "Why?", "no end ", "One. ", "ü."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for c in range(conversations):
        n = rng.randint(1, longest)
        for t in range(n):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = f"Text {t}." if rng.random() < 0.6 else rng.choice([*texts, None])
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, t, 2 * t]), role, text))
    return rows


def test_equals_uniform_cost_search(spark):
    held_against(spark, some_rows(random.Random(1), 150, 12))


@pytest.mark.parametrize("block", [1, 3, 7])
def test_long_conversations_are_composed_from_blocks(spark, block):
    held_against(spark, some_rows(random.Random(block), 25, 60), block)


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (1, None, "user", "B."), (1, None, "user", "B."), (1, 3, "assistant", "C.")]
    rows += [(2, 5, "user", "same.")] * 40 + [(3, t, "user", "same.") for t in range(40)]
    rows += [(4, 1, "user", "x" * 300_000 + "."), (4, 2, "assistant", "é " * 100_000)]
    rows += [(c, 0, "system", "Only.") for c in range(100, 160)]
    held_against(spark, rows)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(9)
    held_against(spark, [(7, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"T{t}.", "x", "T."])) for t in range(1500)])


def test_dropped_conversations_empty_tables_and_other_columns(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 1, "user", "A.", 5)], ROWS + ", fault int")
    (row,) = repair.repair(repair.damage(table)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(repair.damage(table.limit(0))).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (1, 3, "system", "D.")]
    got = repair.repaired(repair.undamaged(spark.createDataFrame(rows, ROWS)))
    lines = [tuple(r) for r in got.orderBy("closing", "turn", "place").select("role", "text").collect()]
    assert lines == [("user", "A."), ("assistant", "B."), ("user", "C."), ("assistant", "D.")] or [r for r, _ in lines] == [
        "user", "assistant",
    ] * (len(lines) // 2)


def test_search_never_estimates_too_much():
    rng = random.Random(3)
    for _ in range(300):
        rows = tuple((rng.choice("usat"), rng.choice("kktx"), 1) for _ in range(rng.randint(1, 9)))
        search = repair.Search(rows)
        cost, path, state = search.run(0)
        assert search.least[0] <= cost and sum(e != "I" for e in path) == len(rows) and state in repair.STATES
