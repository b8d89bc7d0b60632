"""Conversation repair against a table search over all edits, on damaged and odd conversations."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from vitrine.llm import conversation_repair as cr
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        conv_rows = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        conv_rows.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else
                   "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired) by a table over rows and the sequences' states, all edits tried."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(table):
        for _ in range(4):
            for q in list(table):
                cost, audit, turns = table[q]
                for role, state in after[q].items():
                    if role in names:
                        new = (cost + 3, audit + "I", (*turns, names[role] + ":"))
                        if state not in table or new < table[state]:
                            table[state] = new
        return table

    table = with_inserts({0: (0, "", ())})
    for (_, role, text), kind in zip(rows, kinds):
        new = {}

        def offer(state, value):
            if state not in new or value < new[state]:
                new[state] = value

        for q, (cost, audit, turns) in table.items():
            offer(q, (cost + 4, audit + "D", turns))
            if kind in ("blank", "duplicate"):
                continue
            extra = 3 if kind == "truncated" else 0
            for r, state in after[q].items():
                if role[:1] == r:
                    offer(state, (cost + extra, audit + "K", (*turns, f"{role}:{text}")))
                if r in names:
                    offer(state, (cost + 3 + extra, audit + "R", (*turns, f"{names[r]}:{text}")))
        table = with_inserts(new)
    return min(table[q] for q in (0, 3) if q in table)


def expected(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        kept = in_order(kept)
        kinds = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = cheapest(kept, kinds)
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost,
                     audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, part int, copies string"


def got(df):
    rows = df.collect()
    out = {r[0]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def talk(rng, conv, n):
    rows = []
    for turn in range(n):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
        if rng.random() < 0.1:
            role = rng.choice(["system", "tool", "", None, "User", "usr", "\U0001F600x"])
        text = rng.choice(["Yes.", "No!", "why?  ", "cut off", "", " \t", None, "Ok. \n", "é", f"text {turn}."])
        rows.append((conv, None if rng.random() < 0.05 else turn - rng.randrange(2), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(4)
    rows = [r for conv in range(150) for r in talk(rng, conv, rng.randrange(1, 9))]
    rows += talk(rng, 1000, 700) + talk(rng, None, 12) + talk(rng, -3, 90)
    rows += [(2000, 7, "user", "Same.")] * 40 + [(2001, None, None, None)] * 3
    rows += [(2002, 2**62, "user", "Far."), (2002, -2**62, "system", "Near.")]
    rows += [(2003, t, ("user", "assistant")[t % 2], "Long word. " * 30000) for t in range(4)]
    return rows


@pytest.mark.parametrize("segment_rows", [256, 3, 1])
def test_repairs_equal_a_table_search(spark, conversations, segment_rows):
    found = got(cr.repair_damaged(frame(spark, conversations), segment_rows=segment_rows))
    assert found == expected(conversations)


def test_pieces_by_bytes(spark, conversations):
    assert got(cr.repair_damaged(frame(spark, conversations), segment_bytes=5)) == expected(conversations)


def test_query_equals_a_table_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_conversation_repair"](spark, SF)) == expected(rows)


def test_turns_give_the_digest(spark, conversations):
    rows = cr.damage_conversations(frame(spark, conversations))
    for size in (256, 4):
        turns = {}
        for r in cr.repaired_turns(rows, segment_rows=size).orderBy("id", "position").collect():
            turns.setdefault(r.id, []).append((r.position, f"{r.role}:{r.text}"))
        for conv, values in expected(conversations).items():
            mine = turns.get(conv, [])
            assert [p for p, _ in mine] == list(range(len(mine)))
            assert hashlib.sha256("\n".join(t for _, t in mine).encode()).hexdigest() == values[-1]


def test_empty_table_and_emptied_conversation(spark):
    assert cr.repair_damaged(frame(spark, [])).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(cr.repair_damaged(frame(spark, [(gone, 0, "user", "Hello.")]))) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_agenda_pops_by_weight_and_ties_by_audit():
    # two users in a row: a turn inserted between them and one at the end (cost 6) against the
    # second one as the assistant (3)
    elements = [(0, "u", False), (0, "u", False)]
    goal, = cr.agenda(2, cr.row_steps(elements), [0], to_goal=True).values()
    assert goal == (3, "KR")
    # a lone user: insert or re-role are no help, deleting costs 4, an inserted answer 3
    assert list(cr.agenda(1, cr.row_steps([(0, "u", False)]), [0], to_goal=True).values()) == [(3, "KI")]
    assert cr.agenda(1, cr.row_steps([(5, "u", False)]), [0], to_goal=True) == {(0, 1, 0): (20, "DDDDD")}
