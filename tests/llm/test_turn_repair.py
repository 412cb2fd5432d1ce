"""Conversation repair against exhaustive search, and its odd cases."""
from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from epochloom.llm import registered, turn_repair

LEGAL = re.compile("(s?(ua)+)?")
TURNS = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for turn, role, text in rows:
        bare = re.sub(r"[ \t\n\x0b\x0c\r]+$", "", text)
        key = (role, text)
        out.append("blank" if not bare else "duplicate" if key in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add(key)
    return out


def cheapest(rows):
    """Every way to edit, by hand: cost, initials and what is left."""
    fault = faults(rows)
    best = None
    gaps = list(itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1))
    for acts in itertools.product("KRD", repeat=len(rows)):
        if any(a != "D" and f in ("blank", "duplicate") for a, f in zip(acts, fault)):
            continue
        ways = [["user", "assistant"] if a == "R" else [None] for a in acts]
        for roles in itertools.product(*ways):
            for gap in gaps:
                cost, audit, left = 0, "", []
                for k in range(len(rows) + 1):
                    for made in gap[k]:
                        cost += 2
                        audit += "I"
                        left.append({"u": "user:", "a": "assistant:"}[made])
                    if k < len(rows):
                        _, role, text = rows[k]
                        audit += acts[k]
                        cost += {"K": 0, "R": 2, "D": 3}[acts[k]] + (acts[k] != "D" and fault[k] == "truncated")
                        if acts[k] != "D":
                            left.append(f"{roles[k] or role}:{text}")
                if LEGAL.fullmatch("".join(x[0] for x in left)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, "\n".join(left))
    return best


def expected(conv_id, rows):
    fault = faults(rows)
    known = sorted({t for t, _, _ in rows if t is not None})
    cost, audit, left = cheapest(rows)
    return (
        conv_id, known[-1] - known[0] + 1 - len(known) if known else 0, *[fault.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
        hashlib.sha256(left.encode()).hexdigest(),
    )


def report(spark, table, ids=None):
    df = spark.createDataFrame(table, TURNS)
    ids = df if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id long")
    return {r["conv_id"]: tuple(r) for r in turn_repair.report(turn_repair.repair(df), ids).collect()}


def test_equals_exhaustive_search(spark):
    draw = random.Random(7)
    table, convs = [], {}
    for conv in range(90):
        rows = []
        for turn in range(draw.choice([1, 2, 2, 3])):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "unit"])
            rows.append((turn * draw.choice([1, 1, 3]) + (0 if not rows else rows[-1][0]), role, draw.choice(["Yes.", "No!", "cut", " \n", "Why? ", "a. b"])))
        rows.sort(key=lambda r: r)
        convs[conv] = rows
        table += [(conv, *r) for r in rows]
    draw.shuffle(table)
    got = report(spark, table)
    for conv, rows in convs.items():
        assert got[conv] == expected(conv, rows), rows


def test_nulls_copies_and_empty_conversations(spark):
    table = [
        (None, None, None, None), (1, None, "user", "Hi."), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 5, "assistant", "x"),
        (2, 1, "", "No role."), (2, 1, "user", "One."), (2, 1, "user", "One."),
    ]
    got = report(spark, table, [None, 1, 2, 3])
    assert got[None][1:8] == (0, 1, 0, 0, 0, 3, "D")
    assert got[1][1:8] == (2, 0, 2, 1, 2, 7, "KDDK")
    assert got[2][1:8] == (0, 0, 1, 0, 2, 7, "RRD")
    assert got[3] == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(spark, []) == {}


def test_unresolved_suffixes_are_compared_whole():
    """A long run whose survivors never coalesce keeps few nodes, and emits all edits at the end."""
    search = turn_repair.Search()
    early = "".join(search.turn("t", None) for _ in range(5_000))
    nodes, stack = 0, [search.root]
    while stack:
        nodes += 1
        stack += stack.pop().children
    assert nodes <= 8 and early == ""
    whole = early + search.close()
    assert len(whole.replace("I", "")) == 5_000 and set(whole) == {"R"}


def test_edits_come_early_once_survivors_agree():
    search, came = turn_repair.Search(), 0
    for k in range(2_000):
        came += len(search.turn("ua"[k % 2], None))
        assert k + 1 - came < 64


def test_a_conversation_of_all_rows_and_a_text_in_most_of_them(spark):
    table = [(5, t, "user" if t % 2 == 0 else "assistant", "Same." if t % 3 else f"Turn {t}.") for t in range(3_000)]
    got = report(spark, table)[5]
    seen, dup = set(), 0
    for _, _, role, text in table:
        dup += (role, text) in seen
        seen.add((role, text))
    assert got[3] == dup and got[7].count("D") >= dup and len(got[7].replace("I", "")) == 3_000


def test_damage(spark):
    table = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(table, TURNS).select("conv_id", "turn", "role", "text", F.lit(1).alias("kind"))
    got = sorted(map(tuple, registered.damaged(df).collect()), key=repr)
    want = []
    for c, t, role, text in table:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        role, text = ("user" if kind == 4 else role), {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    after = {}
    for r in registered.damaged(rows).orderBy(F.asc_nulls_first("turn"), "role", "text").collect():
        after.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: tuple(r) for r in registered.op13(spark, sf_dir).collect()}
    assert set(got) == {r["conv_id"] for r in rows.select("conv_id").distinct().collect()}
    for conv, turns in after.items():
        if len(turns) <= 2:
            assert got[conv] == expected(conv, turns)
