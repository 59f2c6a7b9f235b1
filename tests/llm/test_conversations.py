import hashlib
import heapq
import random
import re
import zlib

import pytest

from wirebook.llm import conversations

ROWS = "conv_id long, turn long, role string, text string, text_key string, kind int, copies string, part int"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
GIVEN = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def damaged(rows):
    """conv_id -> rows (turn, role, text) in order, by the rule of the contract."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for c, m in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, edits) over all repairs, by taking the least partial repair first."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, edits
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 3, edits + "I", i, GIVEN[state][0]))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state))
            if marks[i] not in ("blank", "duplicate"):
                more = 3 if marks[i] else 0
                heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, GIVEN[state][0]))
                if to := NEXT.get((state, rows[i][1][:1])):
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, to))
    raise AssertionError


def expected(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        marks = faults(mine)
        cost, edits = cheapest(mine, marks)
        lines, state, i = [], "", 0
        for e in edits:
            role = GIVEN[state] if e in "IR" else mine[i][1]
            if e != "D":
                lines.append(f"{role}:{'' if e == 'I' else mine[i][2]}")
                state = role[:1]
            i += e != "I"
        steps = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:], strict=False)]
        turns = [r[0] for r in mine if r[0] is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(marks.count(m) for m in conversations.FAULTS),
            sum(s not in ("su", "ua", "au") for s in steps),
            cost,
            edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def talk(n_convs, seed, longest=9):
    rng = random.Random(seed)
    words = "yes. no! maybe? well so then".split()
    rows = []
    for conv in range(n_convs):
        turn = rng.choice([0, 5, -3])
        for k in range(rng.randint(1, longest)):
            role = ("user", "assistant")[k % 2] if rng.random() < 0.8 else rng.choice(["system", "user", "assistant", "tool", "", None, "useful"])
            text = rng.choice([None, "", " \t\n", "cut", " ", "end. \n"]) if rng.random() < 0.15 else " ".join(rng.choices(words, k=rng.randint(1, 3)))
            rows.append((conv, turn if rng.random() < 0.95 else None, role, text))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    return rows


def run(spark, rows, parts=3, **options):
    table = spark.createDataFrame([(*r, "x", 1, "c", 2) for r in rows], ROWS).repartition(parts)
    found = conversations.digests(conversations.repair(conversations.damage(table), **options)).collect()
    names = ["gaps", *conversations.FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[n] for n in names) for r in found}


@pytest.mark.parametrize("stretch", [64, 3])
def test_against_least_repairs(spark, stretch):
    rows = talk(120, 1)
    rows += rows[:40]  # rows that repeat
    rows += [(None, t, r, "Who?") for t, r in enumerate(["user", "assistant", "assistant", "user"])]
    rows += [(900, None, "user", "One."), (900, None, None, None), (901, None, None, None), (902, 1, "user", "Long. " * 100_000)]
    assert run(spark, rows, stretch=stretch) == expected(rows)


def test_one_long_conversation_over_many_tasks(spark):
    rows = [(7, t, r, x) for _, t, r, x in talk(150, 2)] + talk(5, 3)
    rows += [(7, 4, "user", "Copy.")] * 50
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert run(spark, rows, stretch=8) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_rows_dropped_and_no_rows(spark):
    gone = [t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0][:3]
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, [(1, t, "user", "Gone.") for t in gone]) == {1: nothing}
    assert run(spark, []) == {}


def test_pieces_hold_the_repaired_turns(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (1, 2, "assistant", "So.")], "conv_id int, turn int, role string, text string")
    rows = table.selectExpr("*", "CAST(1 AS BIGINT) AS copies")
    pieces = conversations.repair(rows.withColumn("turn", rows.turn.cast("bigint"))).pieces.collect()
    assert [tuple(x) for p in pieces for x in p.repaired] == [("user", "Hi."), ("assistant", ""), ("user", "Well."), ("assistant", "So.")]


def test_search_against_least_repairs():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(0, rng.choice(["system", "user", "assistant", "tool"]), "") for _ in range(rng.randint(0, 9))]
        marks = [rng.choice(["", "", "", "truncated", "blank"]) for _ in rows]
        items = [conversations.Item(r[1], "", m, 1) for r, m in zip(rows, marks, strict=True)]
        assert conversations.search(items) == cheapest(rows, marks)
