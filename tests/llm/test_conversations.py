"""Conversation repair: against an exhaustive search, in one pass and in blocks."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quarrylake.llm import conversations as V

SCHEMA = "conv_id long, turn long, role string, text string, copies int"


def damage(rows):
    """The rows that damage leaves, read from its description; every conversation is there."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        role, text = word(role), word(text)
        harm = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role = "user" if harm == 4 else role
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return out


def brute(rows, insert=5):
    """The contract by trying every edit of every row and up to two inserts anywhere."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = []
    for k, (_, role, text) in enumerate(rows):
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in [r[1:] for r in rows[:k]] else "truncated" if solid[-1] not in ".!?" else "")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    found = []

    def go(k, inserted, turns, cost, audit):
        if not re.fullmatch("s?(ua)*u?", "".join(t[0][:1] or "-" for t in turns)):
            return
        if inserted < 2:
            for role in ("user", "assistant"):
                go(k, inserted + 1, [*turns, (role, "")], cost + insert, audit + "I")
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] or "-" for t in turns)):
                found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in turns)))
            return
        _, role, text = rows[k]
        go(k + 1, 0, turns, cost + 2, audit + "D")
        if faults[k] not in ("blank", "duplicate"):
            more = 5 if faults[k] else 0
            go(k + 1, 0, [*turns, (role, text)], cost + more, audit + "K")
            for other in ("user", "assistant"):
                go(k + 1, 0, [*turns, (other, text)], cost + 1 + more, audit + "R")

    go(0, 0, [], 0, "")
    cost, audit, text = min(found)
    assert len({t for c, a, t in found if (c, a) == (cost, audit)}) == 1
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def cases():
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n\x0b", "x. \n", None, " ", "é?"]
    rows = []
    for conv in [*range(120), None]:
        for k in range(draw.randint(1, 5)):
            turn = draw.choice([k, k, k + 1, None, -3]) if draw.random() < 0.5 else k
            rows += [(conv, turn, draw.choice(roles[:3] if draw.random() < 0.8 else roles), draw.choice(texts))] * (1 + (draw.random() < 0.1))
    return rows


def collected(df):
    rows = [tuple(r) for r in df.collect()]
    found = {r[0]: r[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_damage_and_repair_against_all_edits(spark):
    rows = cases()
    given = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, AUDIT int")
    want = {c: brute(own) for c, own in damage(rows).items()}
    assert collected(V.repair(V.damaged(given))) == want
    assert {e for w in want.values() for e in w[6]} == set("DKR") and any(w[6] == "DD" for w in want.values())
    nothing = [(90 + k, 0, "user", "x.") for k in range(60)]
    kept = damage(nothing)
    got = collected(V.repair(V.damaged(spark.createDataFrame(nothing, "conv_id long, turn long, role string, text string"))))
    assert [c for c in got if not kept[c]] and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in got if not kept[c])
    assert V.repair(V.damaged(given.limit(0))).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rows = [(c, t, r, x, n) for (c, t, r, x), n in zip(cases(), [1, 1, 2, 1, 0, 3] * 1000, strict=False)]
    given = spark.createDataFrame(rows, SCHEMA)
    want = collected(V.repair(given))
    monkeypatch.setattr(V, "BLOCK", 2)
    left = spark.createDataFrame([r for r in rows if r[0] in {q[0] for q in rows if q[4]}], SCHEMA)
    got = collected(V.in_blocks(left.fillna(" ", ["role", "text"]), 5))
    assert got == {c: w for c, w in want.items() if c in got} and len(got) > 90
    monkeypatch.setattr(V, "LONG_ROWS", 3)
    assert collected(V.repair(given)) == want


def test_cheap_inserts(monkeypatch):
    monkeypatch.setattr(V, "INSERT", 1)
    by_conv = defaultdict(list)
    for conv, turn, role, text in cases():
        by_conv[conv].append((turn or 0, role or " ", text or " "))
    found = set()
    for own in by_conv.values():
        own.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        want = brute(own, insert=1)
        assert V.mended(own) == want
        found.add(want[6])
    assert sum("I" in audit for audit in found) > 10


def test_one_long_conversation(spark):
    draw = random.Random(9)
    rows = [(1, k, draw.choice(["user", "assistant", "tool"]), f"{draw.randrange(9000)}{draw.choice(['.', '.', '', '!'])}", 1) for k in range(9000)]
    rows += [(2, 0, "user", "a. " * 400_000, 1), (2, 1, "assistant", "b.", 1)]
    got = collected(V.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got[1] == V.mended([r[1:4] for r in rows if r[0] == 1])
    assert got[2][5:7] == (0, "KK")


@pytest.mark.parametrize("audit, left", [("KK", "user:a.\nassistant:b."), ("DD", ""), ("KIRK"[:2] + "D", "user:a.\nassistant:")])
def test_repaired(audit, left):
    assert "\n".join(f"{r}:{t}" for r, t in V.repaired([("user", "a."), ("assistant", "b.")], audit)) == left


def test_query(spark, small):
    from quarrylake.llm.queries import op12_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = collected(op12_conversation_repair(spark, small))
    left = damage(rows)
    assert set(got) == set(left)
    for conv in [c for c in sorted(left) if len(left[c]) <= 5][:40]:
        assert got[conv] == brute(left[conv])
