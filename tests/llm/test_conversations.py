"""Conversation repair against a plain program that compares whole strings of edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from cinderlog.llm import conversations
from cinderlog.llm.common import table

LETTERS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
GIVEN = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def brute(rows):
    """rows: (turn, role, text) of one conversation, after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        if not last:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if last[0] in ".!?" else "truncated")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, initials, repaired) of everything from row i on."""
        ways = []
        if inserted < 4:
            role = GIVEN[state]
            cost, text, made = best(i, LETTERS[state][role[0]], inserted + 1)
            ways.append((cost + 3, "I" + text, (f"{role}:",) + made))
        if i == len(rows):
            if state in (0, 3):
                ways.append((0, "", ()))
            return min(ways, default=(10**9, "", ()))
        _, role, text = rows[i]
        cost, more, made = best(i + 1, state, 0)
        ways.append((cost + 4, "D" + more, made))
        if faults[i] not in ("blank", "duplicate"):
            late = 3 if faults[i] == "truncated" else 0
            if role[:1] in LETTERS[state]:
                cost, more, made = best(i + 1, LETTERS[state][role[:1]], 0)
                ways.append((cost + late, "K" + more, (f"{role}:{text}",) + made))
            given = GIVEN[state]
            cost, more, made = best(i + 1, LETTERS[state][given[0]], 0)
            ways.append((cost + 3 + late, "R" + more, (f"{given}:{text}",) + made))
        return min(ways)

    cost, audit, made = best(0, 0, 0) if rows else (0, "", ())
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


def damage(rows):
    """conv_id -> rows after damage, every conversation included."""
    out = defaultdict(list)
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        drawn = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        kept = out[conv]
        if drawn == 0:
            continue
        text = "" if drawn == 1 else re.sub("[.!?]", "", text) if drawn == 2 else text
        kept += [(turn, "user" if drawn == 4 else role, text)] * (2 if drawn == 3 else 1)
    return out


def check(found, groups):
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert set(got) == set(groups)
    for conv, rows in groups.items():
        assert got[conv] == brute(rows), (conv, rows)


def test_all_conversations(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    check(conversations.op11_conversations(spark, sf), damage(rows))


def made_up(seed, conversations_=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", "sys"]
    texts = ["Yes.", "No!", "why", " \t", "", "Yes.", " ", "é?", "one. two", "x.\n"]
    return [
        (conv, rng.choice([*range(12), None]), rng.choice(roles), rng.choice(texts))
        for conv in [None, *range(conversations_)]
        for _ in range(rng.choice([0, 1, 2, 5, 9, 14]))
    ]


@pytest.mark.parametrize("seed", range(3))
def test_made_up_conversations(spark, seed):
    rows = made_up(seed)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    check(conversations.repaired_digests(df), groups)


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_conversations_that_are_not_held(spark, chunk):
    rows = made_up(7)
    rows += [(3, i, "user" if i % 2 else "assistant", f"text {i % 40}.") for i in range(120)]
    rows += [(4, 5, "user", "same.")] * 30
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    check(conversations.repaired_digests(df, most_rows=6, chunk=chunk), groups)


def test_damage_with_nulls(spark):
    rows = [(c, t, r, x) for c in [None, *range(40)] for t, r, x in [(None, None, None), (0, "user", "Hi."), (1, "assistant", None), (1, "assistant", "Ok.")]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(conversations.repaired_digests(conversations.damaged(df)), damage(rows))


@pytest.mark.parametrize("most_rows", [4, 100])
def test_edits_tell_the_same_as_digests(spark, most_rows):
    rows = made_up(11, 20)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, kind string")
    told = defaultdict(list)
    for r in conversations.repair(df, most_rows=most_rows).orderBy("conv", "place").collect():
        told[None if r.conv is None else int(r.conv)].append(r)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role, text))
    assert set(told) == set(groups)
    for conv, group in groups.items():
        expected = brute(group)
        assert "".join(r.edit for r in told[conv]) == expected[6]
        text = "\n".join(f"{r.role}:{r.text}" for r in told[conv] if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == expected[7]
        assert [r.place for r in told[conv]] == list(range(len(told[conv])))


def test_empty_table_and_very_long_text(spark):
    kinds = "conv long, turn long, role string, text string"
    assert conversations.repaired_digests(spark.createDataFrame([], kinds)).collect() == []
    rows = [(1, 0, "user", "long " * 400_000 + "."), (1, 1, "assistant", "Yes.")]
    groups = {1: [r[1:] for r in rows]}
    check(conversations.repaired_digests(spark.createDataFrame(rows, kinds)), groups)
    check(conversations.repaired_digests(spark.createDataFrame(rows, kinds), most_chars=1000), groups)
