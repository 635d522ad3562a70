"""Conversation structure repair: cheapest edits that give every conversation a legal order of roles.

Rows are dealt by conversation and sorted by turn, and one function streams
over them: it carries four states (nothing yet, after a system, user or
assistant row), each with its cost, the digest of what it has repaired so far,
and its place among the four in the order of their audits. So a task holds
four states and one batch however long a conversation is. What each row did to
each state is four bytes of backpointers; beyond ``SPILL_BYTES`` they go to a
temporary file of the task and are read from its end once the conversation is
over. A lost executor costs the partitions it held.

Defined results: a null conversation id is one conversation; null roles and
texts are one space; rows of one turn are taken by role, then text, in byte
order; rows that repeat are kept apart and the later ones are duplicates; very
long texts pass through the digest once per state and are never copied; only
the columns named here are read, whatever others are called; an empty table
gives no rows. An audit is one string, so a conversation has at most 2**31 rows;
:func:`edits` gives the same in parts of bounded length.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fields, partitions, settle

SPILL_BYTES = 4 << 20
PART_ROWS = 65_536
SPACES = " \t\n\x0b\x0c\r"
REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)
EDITS = "part bigint, edits array<string>"

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = {"su", "ua", "au"}


def _inserted(state: int, n: int) -> list[int]:
    """The states that ``n`` inserted rows pass through."""
    out = []
    for _ in range(n):
        state = _NEXT[state]
        out.append(state)
    return out


def _moves(initial: str, deleted: bool) -> list[list[tuple]]:
    """Per state after a row: (state before, cost, edits, inserted lines, packed pointer), all ways there."""
    ways: list[list[tuple]] = [[] for _ in range(4)]
    for before in range(4):
        ways[before].append((before, DELETE, "D", "", before))
        if deleted:
            continue
        for n in range(3):
            passed = _inserted(before, n)
            at = passed[-1] if passed else before
            lines = "\n".join(f"{_NAMES[s]}:" for s in passed)
            to = _NEXT[at]
            if initial == "s" and at == START:
                ways[SYSTEM].append((before, KEEP, "K", "", before | 2 << 4))
            if initial == _NAMES[to][0]:
                ways[to].append((before, n * INSERT + KEEP, "I" * n + "K", lines, before | n << 2 | 2 << 4))
            ways[to].append((before, n * INSERT + REROLE, "I" * n + "R", lines, before | n << 2 | 3 << 4))
    return ways


_WAYS = {(r, d): _moves(r, d) for r in "sua-" for d in (False, True)}
_LAST = [0, 2, 1, 0]  # rows to insert at the end of a conversation, by state


class _Pointers:
    """Backpointers of one conversation: four bytes a row, in memory up to a bound, then in a temporary file."""

    def __init__(self):
        self.held, self.file, self.rows = bytearray(), None, 0

    def add(self, four: bytes) -> None:
        self.held += four
        self.rows += 1
        if len(self.held) >= SPILL_BYTES:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held = bytearray()

    def backwards(self) -> Iterator[bytes]:
        """Blocks of whole rows, last block first."""
        yield bytes(self.held)
        at = self.file.tell() if self.file else 0
        while at:
            size = min(SPILL_BYTES, at)
            at -= size
            self.file.seek(at)
            yield self.file.read(size)
        if self.file:
            self.file.close()


class _Conversation:
    def __init__(self):
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None  # turns
        self.turns = 0
        self.before = ""
        self.pointers = _Pointers()
        self.cost: list = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.digest: list = [None] * 4

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.pointers.rows and self.before + initial not in _LEGAL:
            self.illegal += 1
        self.before = initial
        body = text.rstrip(SPACES)
        late = 0
        if not body:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif body[-1] not in ".!?":
            self.truncated += 1
            late = 1
        self._step(initial if initial in ("s", "u", "a") else "-", not body or repeated, late, role, text)

    def _step(self, initial: str, deleted: bool, late: int, role: str, text: str) -> None:
        cost, rank, digest = self.cost, self.rank, self.digest
        found: list = [None] * 4
        for to, ways in enumerate(_WAYS[initial, deleted]):
            best = None
            for way in ways:
                before = cost[way[0]]
                if before is None:
                    continue
                # Audits of two states never begin one another, so their order stays whatever is appended.
                key = (before + way[1] + (late if way[2] != "D" else 0), rank[way[0]], way[2])
                if best is None or key < best[0]:
                    best = (key, way)
            found[to] = best
        row = {}
        new = [None] * 4
        four = bytearray(4)
        for to, best in enumerate(found):
            if best is None:
                continue
            before, _, letters, lines, pointer = best[1]
            four[to] = pointer
            if letters == "D":
                new[to] = digest[before]
                continue
            name = role if letters[-1] == "K" else _NAMES[to]
            if name not in row:
                row[name] = f"{name}:{text}".encode("utf-8", "surrogatepass")
            head = digest[before]
            if head is None:
                head = hashlib.sha256()
            else:
                head = head.copy()
                head.update(b"\n")
            if lines:
                head.update(lines.encode() + b"\n")
            head.update(row[name])
            new[to] = head
        order = sorted((best[0][1], best[0][2], to) for to, best in enumerate(found) if best)
        for at, (_, _, to) in enumerate(order):
            rank[to] = at
        self.cost = [best and best[0][0] for best in found]
        self.digest = new
        self.pointers.add(bytes(four))

    def end(self) -> tuple[int, int, str]:
        """State to trace back from, whole cost, and digest of the repaired rows."""
        _, _, state = min((c + INSERT * _LAST[s], self.rank[s], s) for s, c in enumerate(self.cost) if c is not None)
        head = self.digest[state]
        passed = _inserted(state, _LAST[state])
        if passed:
            head = head.copy()
            head.update("".join(f"\n{_NAMES[s]}:" for s in passed).encode())
        return state, self.cost[state] + INSERT * len(passed), (head or hashlib.sha256()).hexdigest()

    def back(self, state: int) -> Iterator[tuple[str, int, int]]:
        """(letter, rows inserted before, state after) of each row, last row first."""
        for block in self.pointers.backwards():
            for at in range(len(block) - 4, -1, -4):
                pointer = block[at + state]
                yield LETTERS[pointer >> 4], pointer >> 2 & 3, state
                state = pointer & 3

    def report(self) -> dict:
        state, cost, digest = self.end()
        audit = ["I" * _LAST[state]]
        audit += [letter + "I" * n for letter, n, _ in self.back(state)]
        gaps = 0 if self.first is None else int(self.last - self.first) + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "audit": "".join(audit)[::-1], "repaired_sha256": digest,
        }

    def parts(self, part_rows: int) -> Iterator[dict]:
        """Edits per row, two letters each (the edit, and the role it gives), in parts, last part first."""
        state, _, _ = self.end()
        n = self.pointers.rows
        held = ["".join(f"I{_NAMES[s][0]}" for s in _inserted(state, _LAST[state]))]
        part = n // part_rows
        for at, (letter, inserted, after) in zip(range(n - 1, -1, -1), self.back(state)):
            if at // part_rows != part:
                yield {"part": part, "edits": held[::-1]}
                part, held = at // part_rows, []
            role = _NAMES[after][0] if letter == "R" else "-"
            # What was inserted leads up to the state before the row.
            lead = ""
            if inserted:
                last = ASSISTANT if after == USER else USER
                passed = [last] if inserted == 1 else [ASSISTANT if last == USER else USER, last]
                lead = "".join(f"I{_NAMES[s][0]}" for s in passed)
            held.append(f"{lead}{letter}{role}")
        yield {"part": part, "edits": held[::-1]}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the checksum of ``conv_id:turn``; dropped ones are marked."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fate = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate"))
    return marked.select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("gone"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted as they are read; ``nth``: how often the row has been seen by then.

    One shuffle: the window that counts repeats and the final sort both keep to
    the conversation's partition, and both sort on disk where they must.
    """
    settle(rows.sparkSession)
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    given = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    dealt = given.repartition(partitions(rows.sparkSession), "conv_id")
    seen = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    return dealt.withColumn("nth", F.row_number().over(seen)).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")


def _conversations(batches) -> Iterator[tuple[object, _Conversation]]:
    """Each conversation once its last row has been read; the state crosses batches."""
    now, open_ = None, None
    for batch in batches:
        ids, turns, roles, texts, gone, nth = (c.to_pylist() for c in batch.columns)
        for i, conv in enumerate(ids):
            if open_ is None or conv != now:
                if open_ is not None:
                    yield now, open_
                now, open_ = conv, _Conversation()
            if not gone[i]:
                open_.add(turns[i], roles[i], texts[i], nth[i] > 1)
    if open_ is not None:
        yield now, open_


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2_000, characters: int = 8 << 20):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (str, list)))
        if len(held) >= most or size >= characters:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(batch: pa.RecordBatch, more: list[tuple]) -> pa.Schema:
    return pa.schema([("conv_id", batch.schema.field("conv_id").type), *more])


def _peek(batches):
    """The batches, and the first of them (None where there is none)."""
    batches = iter(batches)
    first = next(batches, None)

    def all_():
        if first is not None:
            yield first
        yield from batches

    return first, all_()


_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults of its rows, cost and audit of the cheapest edits, digest of what they give.

    ``rows``: conv_id, turn, role, text, and optionally ``gone`` (the row only
    says that the conversation exists).
    """

    def run(batches):
        first, batches = _peek(batches)
        if first is None:
            return
        schema = _arrow(first, [(c, pa.int64()) for c in _LONGS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
        yield from _batches(({"conv_id": conv, **talk.report()} for conv, talk in _conversations(batches)), schema)

    return ordered(rows).mapInArrow(run, fields(rows, ["conv_id"], REPORT))


def edits(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, part, edits): per row its edits in order, in parts of at most ``part_rows`` rows.

    An edit is two letters: D, I, K or R, and the initial of the role it gives
    (``-`` where it gives none of its own). The last part has one more element
    for what is inserted at the end.
    """

    def run(batches):
        first, batches = _peek(batches)
        if first is None:
            return
        schema = _arrow(first, [("part", pa.int64()), ("edits", pa.list_(pa.string()))])
        yield from _batches(
            ({"conv_id": conv, **part} for conv, talk in _conversations(batches) for part in talk.parts(part_rows)), schema)

    return ordered(rows).mapInArrow(run, fields(rows, ["conv_id"], EDITS))


def repaired(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The repaired conversations: (conv_id, at, sub, edit, turn, role, text), in order of ``at`` and ``sub``.

    ``at`` is the row's place in its conversation; rows inserted before it have
    a smaller ``sub``. Deleted rows are left out.
    """
    each = edits(rows, part_rows).select("conv_id", "part", F.posexplode("edits").alias("pos", "all")).select(
        F.col("conv_id").alias("_conv"), (F.col("part") * part_rows + F.col("pos")).alias("at"),
        F.posexplode(F.regexp_extract_all("all", F.lit("(..)"), F.lit(1))).alias("sub", "code"))
    each = each.filter("code not like 'D%'")
    inside = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "nth")
    own = ordered(rows).filter("not gone").withColumn("_at", (F.row_number().over(inside) - 1).cast("bigint"))
    met = each.join(own, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("_at")), "left")
    edit, to = F.substring("code", 1, 1), F.substring("code", 2, 1)
    role = F.when(edit == "K", F.col("role")).when(to == "u", "user").otherwise("assistant")
    fresh = edit == "I"
    return met.select(
        F.col("_conv").alias("conv_id"), "at", "sub", edit.alias("edit"),
        F.when(~fresh, F.col("turn")).alias("turn"), role.alias("role"), F.when(fresh, "").otherwise(F.col("text")).alias("text"))
