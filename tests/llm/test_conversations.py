"""Repaired conversations against a search over all edits, insertions too."""

from __future__ import annotations

import heapq
import random
import re
import zlib
from hashlib import sha256

import pytest

from splitloom.llm import conversations
from splitloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def shown(value):
    return " " if value is None else str(value)


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        hit, role, text = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv_id, turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return out


def cheapest(rows, faults):
    """The first end that a search in order of cost and letters meets."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, letters, n, state, kept = heapq.heappop(heap)
        if (n, state) in done:
            continue
        done.add((n, state))
        if n == len(rows) and state in (0, 3):
            return cost, letters, sha256("\n".join(kept).encode()).hexdigest()
        for role in ("user", "assistant"):
            if (role[0], state) in STEP:
                heapq.heappush(heap, (cost + 5, letters + "I", n, STEP[role[0], state], (*kept, f"{role}:")))
        if n == len(rows):
            continue
        _, role, text = rows[n]
        heapq.heappush(heap, (cost + 2, letters + "D", n + 1, state, kept))
        if faults[n] in ("blank", "duplicate"):
            continue
        more = 5 if faults[n] else 0
        for edit, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
            if (new[:1], state) in STEP:
                heapq.heappush(heap, (cost + more + price, letters + edit, n + 1, STEP[new[:1], state], (*kept, f"{new}:{text}")))


def brute(ids, rows):
    out = {}
    for conv_id in ids:
        own = [row[1:] for row in rows if row[0] == conv_id]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [turn for turn, _, _ in own if turn is not None]
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(
                "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            )
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv_id] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, *cheapest(own, faults))
    return out


def summarised(turns, table=None, **options):
    found = conversations.summaries(conversations.repair(turns, table, **options)).collect()
    assert len({row.conv_id for row in found}) == len(found)
    return {row.conv_id: tuple(row)[1:] for row in found}


def random_rows(seed, count=60):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys", "u"]
    texts = ["One.", "Two!", "Three", "", " \t", "One. ", "Why? \n", None, "Four\x0b", "é.", "\xa0"]
    rows = []
    for conv_id in [*range(count), None]:
        for turn in range(rng.randint(1, 9)):
            chosen = rng.choice([turn, turn, turn, turn + 3, None, -turn])
            rows.append((conv_id, chosen, rng.choice(roles[: rng.choice([3, 5, 10])]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = random_rows(seed)
    ids = {row[0] for row in rows}
    table = spark.createDataFrame([(*row, "x", 0) for row in rows], SCHEMA + ", edit string, kind int").repartition(4)
    want = brute(ids, damage(rows))
    assert summarised(conversations.damaged(table), table) == want
    assert summarised(conversations.damaged(table), table, segment_rows=2) == want


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {row.conv_id: tuple(row)[1:] for row in QUERIES["op13_conversations"](spark, sf_dir).collect()}
    assert got == brute({row[0] for row in rows}, damage(rows))


def test_a_long_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(7, n, rng.choice(["user", "assistant"]), f"T{rng.randint(0, 900)}" + rng.choice([".", ".", "!", ""])) for n in range(1500)]
    rows += [(1, 0, "user", "A."), (1, 1, "assistant", "B."), (9, 5, "assistant", "C.")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute({1, 7, 9}, rows)
    assert summarised(table, segment_rows=64) == want
    assert summarised(table) == want


def test_many_equal_rows(spark):
    rows = [(1, None, "user", "Same.")] * 300 + [(1, 1, "assistant", "Well.")]
    got = summarised(spark.createDataFrame(rows, SCHEMA).repartition(6), segment_rows=50)
    assert got == brute({1}, rows) and got[1][2] == 299


def test_rows_with_their_edits(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "Q?"), (1, 2, "assistant", "A."), (1, 3, "user", "  "), (1, 4, "user", "cut")]
    found = conversations.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.turn, r.fault, r.edit, r.new_role) for r in found] == [
        (0, "", "K", "system"), (1, "", "R", "user"), (2, "", "K", "assistant"), (3, "blank", "D", None), (4, "truncated", "D", None),
    ]


def test_ids_without_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    empty = sha256(b"").hexdigest()
    assert summarised(none) == {}
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    assert summarised(none, ids) == {i: (0, 0, 0, 0, 0, 0, "", empty) for i in (1, None)}


def test_costs_that_could_ask_for_insertions_are_errors():
    with pytest.raises(ValueError):
        conversations.Costs(insert=4)
