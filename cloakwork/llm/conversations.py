"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

The role initials of a repaired conversation are `(s?(ua)+)?`: nothing, or user and
assistant in turn, after a system turn or not. Rows have one fault at most: blank
(only white space), duplicate (role and text are an earlier row's), truncated (the
text doesn't end a sentence). Keeping a row costs 0, giving it the role user or
assistant 3, deleting it 4 (blank and duplicate rows must go), inserting an empty
user or assistant turn 3, and a truncated row that stays 3 more. Of equally cheap
edits those are taken whose initials, in order, are least as ASCII text.

How: rows are dealt by conversation and numbered; each then comes twice, sorted
behind each other by Spark. First all rows of a conversation from the last to the
first, without their texts: a pass over them keeps, for each of the four states of
the pattern, the least cost of what follows, and one byte a row with the four
choices. Then all rows from the first to the last, with texts: the choices, read from
the other end, give the edits, and texts go straight into the digest. State is
carried over from batch to batch, so memory doesn't grow with a conversation but by
its choices: a byte a row, in compressed blocks. The audit, one cell of the result, is
as long. (Blocks are kept in memory rather than in files: a worker has no folder that
outlives it.) A digest reads texts one after the other, so one task reads a
conversation, however long; it never holds it.

Defined results
* Rows are taken by turn, nulls first; rows of one turn by role, then text.
* Null roles and texts count as one space. A role that starts with none of s, u, a, or
  is empty, can't be kept as it is.
* A null conv_id is a conversation of its own. One row per conversation, also for one
  of which no row is left: zeros, an empty audit, and the digest of the empty text.
* gaps are turns missing between the least and the greatest: maximum - minimum + 1 -
  distinct ones, nulls left out; 0 if all are null.
* Columns besides the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 3, 4, 3, 3
#: Edits in ASCII order: what a row's choice holds for each state, in two bits.
EDITS = "DIKR"
#: States of the pattern: nothing yet, after the system turn, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where an inserted turn, or one of a new role, leads.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Cost to an end that the pattern allows: insertions only.
END = (0, 2 * INSERT, INSERT, 0)
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}
BLOCK = 1 << 20

SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv string, position long, edit string, role string, text string"


def step(after: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs from before a row to the end, given those from after it; and its choices."""
    stays = STAYS_TRUNCATED if fault == TRUNCATED else 0
    own = []
    for q in range(4):
        ways = [(DELETE + after[q], "D")]
        if fault not in (BLANK, DUPLICATE):
            ways.append((REROLE + stays + after[NEXT[q]], "R"))
            if q in FOLLOWS.get(initial, ()):
                ways.append((KEEP + stays + after[FOLLOWS[initial][q]], "K"))
        own.append(min(ways))
    best = [min(own[q][0], INSERT + own[NEXT[q]][0], 2 * INSERT + own[NEXT[NEXT[q]]][0]) for q in range(4)]
    choices = 0
    for q in range(4):
        ways = [own[q], (INSERT + best[NEXT[q]], "I")]
        choices |= EDITS.index(min(ways)[1]) << 2 * q
    return tuple(best), choices


class Choices:
    """A stack of bytes, in compressed blocks but for the last one."""

    def __init__(self) -> None:
        self.blocks: list[bytes] = []
        self.open = bytearray()

    def push(self, choice: int) -> None:
        if len(self.open) >= BLOCK:
            self.blocks.append(zlib.compress(self.open, 1))
            self.open = bytearray()
        self.open.append(choice)

    def pop(self) -> int:
        if not self.open:
            self.open = bytearray(zlib.decompress(self.blocks.pop()))
        return self.open.pop()


class Conversation:
    """One conversation while its rows come, first from the last to the first, then in order."""

    #: (costs less the least one, initial, fault) -> the same for the row before, what was taken off, choices: a few hundred at most
    moves: dict[tuple, tuple] = {}

    def __init__(self, name: str | None):
        self.name, self.choices = name, Choices()
        self.costs, self.base, self.later = END, 0, None
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.first_turn = self.last_turn = self.turns = None
        self.state, self.audit, self.digest, self.kept = START, bytearray(), hashlib.sha256(), 0

    def back(self, role: str, fault: int, turn: int | None) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        if self.later is not None and initial + self.later not in LEGAL:
            self.illegal += 1
        self.later = initial
        if turn is not None:
            if self.turns is None:
                self.last_turn, self.turns = turn, 0
            if turn != self.first_turn or not self.turns:
                self.turns += 1
            self.first_turn = turn
        key = self.costs, initial if initial in FOLLOWS else "", fault
        move = self.moves.get(key)
        if move is None:
            costs, choices = step(*key)
            least = min(costs)
            move = self.moves[key] = tuple(c - least for c in costs), least, choices
        self.costs, least, choices = move
        self.base += least
        self.choices.push(choices)

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"\n{role}:{text}".encode() if self.kept else f"{role}:{text}".encode())
        self.kept += 1

    def insert(self) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        self.audit += b"I"
        self.put(NAME[self.state], "")
        return "I", NAME[self.state], ""

    def forth(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The edits up to this row and of it: (initial, role, text) after it."""
        choices = self.choices.pop()
        while (edit := EDITS[choices >> 2 * self.state & 3]) == "I":
            yield self.insert()
        self.audit += edit.encode()
        if edit == "K":
            self.state = FOLLOWS[role[0]][self.state]
        elif edit == "R":
            self.state = NEXT[self.state]
            role = NAME[self.state]
        if edit != "D":
            self.put(role, text)
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state not in (START, ASSISTANT):
            yield self.insert()

    def summary(self) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost = self.base + self.costs[START]
        _, blank, duplicate, truncated = self.faults
        return self.name, gaps, blank, duplicate, truncated, self.illegal, cost, self.audit.decode(), self.digest.hexdigest()


def rows_of(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv, backward, place, role, fault, turn, has_turn, text: each row twice, in the order in which they are read."""
    n = F.lit(1) if copies is None else copies
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n.alias("n")
    )
    # a row that is left out stays as a mark that its conversation is there
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1))))).withColumn("gone", F.col("n") == 0)
    # all windows and the last sort are within what is dealt by conversation here
    rows = rows.repartition("conv")
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")))
    earlier = F.row_number().over(Window.partitionBy("conv", "gone", "role", F.md5("text")).orderBy("place")) > 1
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(earlier, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(NO_FAULT)
    )
    judged = numbered.withColumn("fault", fault)
    place = F.col("place").cast("long")
    back = F.struct(F.lit(0).alias("forth"), F.when(F.col("gone"), 0).otherwise(-place).alias("place"), F.lit(None).cast("string").alias("text"))
    forth = F.struct(F.lit(1).alias("forth"), place.alias("place"), F.col("text").alias("text"))
    twice = judged.select("conv", "gone", "turn", "role", "fault", F.explode(F.when(F.col("gone"), F.array(back)).otherwise(F.array(back, forth))).alias("x"))
    return twice.select(
        "conv", F.col("x.forth").alias("forth"), F.col("x.place").alias("place"), "gone", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "fault", F.col("x.text").alias("text")
    ).sortWithinPartitions("conv", "forth", "place")


def streamed(rows: DataFrame, turns: bool) -> DataFrame:
    """One pass over rows_of(): the repaired turns, or a summary of each conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        place, out = 0, []

        def told(edits: Iterator[tuple[str, str, str]]) -> None:
            nonlocal place
            for edit, role, text in edits:
                if turns:
                    place += edit != "D"
                    out.append((now.name, place if edit != "D" else None, edit, role, text))

        def closed() -> None:
            nonlocal place
            if now is not None:
                told(now.end())
                if not turns:
                    out.append(now.summary())
            place = 0

        names = [f.split()[0] for f in (TURNS if turns else SUMMARY).split(", ")]
        for pdf in batches:
            for conv, forth, gone, has_turn, turn, role, fault, text in zip(*(pdf[c].tolist() for c in ("conv", "forth", "gone", "has_turn", "turn", "role", "fault", "text"))):
                if now is None or conv != now.name:
                    closed()
                    now = Conversation(conv)
                if gone:
                    continue
                if forth:
                    told(now.forth(role, text))
                else:
                    now.back(role, fault, turn if has_turn else None)
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        closed()
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, TURNS if turns else SUMMARY)


def repair(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation (conv_id, turn, role, text).

    copies: how often a row counts; one that counts 0 times still names its conversation.
    """
    found = streamed(rows_of(conversations, copies), turns=False)
    kind = conversations.schema["conv_id"].dataType
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *found.columns[1:])


def repaired_turns(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, position (1, 2, 3...), edit, role, text of each turn after the repair; deleted ones have no position."""
    found = streamed(rows_of(conversations, copies), turns=True)
    kind = conversations.schema["conv_id"].dataType
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *found.columns[1:])


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows damaged by crc32 of `conv_id:turn` modulo 20 (nulls are one space), and how often each counts: 0 drops it, 1 empties
    its text, 2 takes out its sentence ends, 3 repeats it, 4 makes its role user; others stay."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("damage"))
    changed = rows.withColumns(
        {
            "role": F.when(F.col("damage") == 4, "user").otherwise(F.col("role")),
            "text": F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        }
    )
    return changed, F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1)
