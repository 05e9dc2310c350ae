"""Operator 11 against plain dynamic programming over whole label strings."""

import hashlib
import random
import re
import zlib

import pytest

from lodestone.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    space = lambda x: " " if x is None else x
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if h == 4 else space(role), space(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def want(own):
    own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [r[1] for r in own if r[1] is not None]
    faults, seen = [], set()
    for _, _, role, text in own:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in own]
    # every partial repair of the rows so far, least (cost, labels) by the last initial, and its lines
    now = {"": (0, "", [])}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def insertions(to):
        for _ in range(6):
            for state, (cost, labels, lines) in list(to.items()):
                for c in NEXT[state].replace("s", ""):
                    put(to, c, (cost + 3, labels + "I", [*lines, {"u": "user", "a": "assistant"}[c] + ":"]))
        return to

    insertions(now)
    for (_, _, role, text), fault in zip(own, faults, strict=True):
        after = {}
        for state, (cost, labels, lines) in now.items():
            put(after, state, (cost + 4, labels + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in NEXT[state]:
                    put(after, role[:1], (cost + more, labels + "K", [*lines, f"{role}:{text}"]))
                for c in NEXT[state].replace("s", ""):
                    put(after, c, (cost + 3 + more, labels + "R", [*lines, f"{ {'u': 'user', 'a': 'assistant'}[c]}:{text}"]))
        now = insertions(after)
    cost, audit, lines = min(v for k, v in now.items() if k in ("", "a"))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def corpus(seed, convs, most):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randrange(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ü"])
            text = rnd.choice(["Hi.", "Hi.", "no stop", "what?", "é!", " \t", "", None, f"long {rnd.random()}."])
            rows.append((c if c else None, rnd.choice([t, t, t + 2, None]), role, text))
    return rows


def check(spark, rows, parts):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    harmed = damaged(rows)
    expected = {c: want([r for r in harmed if r[0] == c]) for c in {r[0] for r in rows}}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.repair(frame).collect()
        lines = {}
        for r in C.repaired(C.with_faults(frame)).collect():
            lines.setdefault(r.conv_id, []).append((r.position, f"{r.role}:{r.text}"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(expected)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: w for c, (w, _) in expected.items()}
    assert {c: [x for _, x in sorted(v)] for c, v in lines.items()} == {c: v for c, (_, v) in expected.items() if v}


@pytest.mark.parametrize(("seed", "convs", "most", "parts"), [(1, 60, 12, 4), (2, 12, 40, 20), (3, 2, 300, 9)])
def test_same_as_plain_programming(spark, seed, convs, most, parts):
    """The last two spread conversations over many pieces."""
    check(spark, corpus(seed, convs, most), parts)


def test_large_conversations_go_by_codes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD_ROWS", 5)
    monkeypatch.setattr(C, "BLOCK", 8)
    check(spark, corpus(4, 10, 60), 3)


def test_no_rows(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = C.repair(spark.createDataFrame([(7, gone, "user", "x", "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
