"""Conversation repair against a search over all edits, on edge rows, and with spilled pointers."""

import hashlib
import random
import zlib

import pytest
from answerloom.llm import conversations
from answerloom.llm.common import read, settle
from pyspark.sql import functions as F

ROWS = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def spark(spark):
    return settle(spark)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = {1: "", 2: text.replace(".", "").replace("!", "").replace("?", "")}.get(fate, text)
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def repair(rows):
    """The report of one conversation, by trying every edit of every row."""
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in order:
        body = text.rstrip(SPACES)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def legal(initials):
        rest = initials.removeprefix("s")
        return not initials or (rest != "" and rest == "ua" * (len(rest) // 2))

    def go(i, audit, lines, cost):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(x[:1] for x in lines)
        whole = initials.removeprefix("s")
        if whole != ("ua" * len(whole))[:len(whole)]:
            return
        if i == len(order) and legal(initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(i, audit + "I", [*lines, f"{role}:"], cost + 2)
        if i == len(order):
            return
        _, _, role, text = order[i]
        go(i + 1, audit + "D", lines, cost + 3)
        if faults[i] not in ("blank", "duplicate"):
            late = faults[i] == "truncated"
            go(i + 1, audit + "K", [*lines, f"{role}:{text}"], cost + late)
            for to in ("user", "assistant"):
                go(i + 1, audit + "R", [*lines, f"{to}:{text}"], cost + late + 2)

    go(0, "", [], 0)
    turns = {r[1] for r in order if r[1] is not None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(order, order[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def made_up(seed, conversations_, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        for _ in range(rng.randint(0, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "ugly", "", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", "Why?", "a\nb.", "é.", None])
            rows.append((conv if conv else None, rng.choice([None, 0, 1, 2, 2, 5, 9]), role, text))
    return rows


def reports(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_a_search_over_all_edits(spark, seed):
    rows = made_up(seed, 60, 5)
    got = reports(conversations.report(conversations.damage(spark.createDataFrame(rows, ROWS))))
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        assert got[conv] == repair([r for r in left if r[0] == conv]), conv
    assert set(got) == {r[0] for r in rows}


def test_pointers_spill_and_give_the_same(spark, monkeypatch):
    rows = [(7, i, ["user", "assistant", "system", "x"][i * i % 4], f"text {i % 50}{'.' * (i % 3)}") for i in range(3_000)]
    whole = conversations._Conversation()
    for r in rows:
        whole.add(r[1], r[2], r[3], False)
    monkeypatch.setattr(conversations, "SPILL_BYTES", 400)
    pieces = conversations._Conversation()
    for r in rows:
        pieces.add(r[1], r[2], r[3], False)
    assert pieces.pointers.file is not None and len(pieces.pointers.held) < 400
    assert pieces.report() == whole.report()


def test_repaired_rows_match_the_report(spark, sf):
    rows = made_up(3, 40, 8) + [(99, i, "user" if i % 2 else "assistant", f"line {i}.") for i in range(500)]
    given = conversations.damage(spark.createDataFrame(rows, ROWS))
    by = {}
    for r in conversations.repaired(given, part_rows=7).collect():
        by.setdefault(r.conv_id, []).append(r)
    for conv, want in reports(conversations.report(given)).items():
        lines = sorted(by.get(conv, []), key=lambda r: (r["at"], r["sub"]))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == want[-1]
        assert "".join(r.edit for r in lines) == want[-2].replace("D", "")
    parts = conversations.edits(given, part_rows=7)
    assert parts.select(F.max(F.size("edits"))).first()[0] <= 8


def test_edge_rows(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, None, None, None), (None, None, "user", "Hi."), (1, 1, "assistant", long)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("mine") for c in ("nth", "fate", "audit", "at", "cost", "part")})
    got = reports(conversations.report(df))
    assert got == {k: repair([(c, t, r or " ", x or " ") for c, t, r, x in rows if c == k]) for k in (1, 2, None)}
    assert got[1][2] == 1 and got[1][6] == "KKD"
    nothing = spark.createDataFrame([], ROWS)
    assert conversations.report(conversations.damage(nothing)).count() == 0
    assert conversations.repaired(nothing).count() == 0
