"""Conversation repair against all edit sequences, and a plain reading of the contract, with awkward rows."""

import hashlib
import itertools
import random
import re
import time
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import conversations as C
from cloakwork.llm import queries
from tests.conftest import SMALL

BLANKS = " \t\n\x0b\x0c\r"


def judged(rows):
    """rows: (role, text) in order -> (role, text, must go, surcharge), faults."""
    seen, out, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        fault = "blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANKS)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
    return out, faults


def exhaustive(rows):
    """The cheapest edits of all: (cost, audit, lines)."""
    judged_rows, _ = judged(rows)
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    ways = []
    for role, text, must_go, more in judged_rows:
        w = [(4, "D", None)]
        if not must_go:
            w += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        ways.append(w)
    for before in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(*ways):
            cost, audit, lines = 0, "", []
            for i, put in enumerate(before):
                for role in put:
                    cost, audit = cost + 3, audit + "I"
                    lines.append((role, ""))
                if i < len(edits):
                    c, letter, line = edits[i]
                    cost, audit = cost + c, audit + letter
                    lines += [line] if line else []
            if (best is None or (cost, audit) <= best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = cost, audit, lines
    return best


def plainly(table):
    """The contract's summary of a table of (conv_id, turn, role, text, copies), with the edits by a search over states."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = [r for r in table if r[0] == conv for _ in range(r[4])]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " ").encode(), (r[3] if r[3] is not None else " ").encode()))
        pairs = [(" " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
        judged_rows, faults = judged(pairs)
        follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        states = {"": (0, "", ()), "s": None, "u": None, "a": None}

        def inserted(states):
            for _ in range(3):
                for q in ("", "s", "u", "a"):
                    if states.get(q):
                        to = "a" if q == "u" else "u"
                        c, a, lines = states[q]
                        way = (c + 3, a + "I", (*lines, ("user" if to == "u" else "assistant", "")))
                        if states.get(to) is None or way[:2] < states[to][:2]:
                            states[to] = way
            return states

        for role, text, must_go, more in judged_rows:
            states, new = inserted(dict(states)), {}
            for q, held in states.items():
                if held is None:
                    continue
                c, a, lines = held
                ways = [(q, (c + 4, a + "D", lines))]
                if not must_go:
                    to = "a" if q == "u" else "u"
                    ways.append((to, (c + 3 + more, a + "R", (*lines, ("user" if to == "u" else "assistant", text)))))
                    if (q, role[:1]) in follow:
                        ways.append((follow[q, role[:1]], (c + more, a + "K", (*lines, (role, text)))))
                for to, way in ways:
                    if new.get(to) is None or way[:2] < new[to][:2]:
                        new[to] = way
            states = new
        states = inserted(dict(states))
        cost, audit, lines = min((states[q] for q in ("", "a") if states.get(q)), key=lambda x: x[:2])
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def collected(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


TABLE = "conv_id long, turn long, role string, text string, copies int, conv string, place string, fault string"


def table_of(spark, rows):
    """Conversations with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TABLE)


def test_edits_equal_all_sequences():
    rng = random.Random(1)
    texts = ["One.", "Two!", "open", "", "Three?"]
    for n in (0, 1, 2, 3, 3):
        for _ in range(12 if n < 3 else 6):
            rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(n)]
            want = exhaustive(rows)
            faults = [C.BLANK if not t else C.DUPLICATE if (r, t) in rows[:i] else C.TRUNCATED if t == "open" else C.NO_FAULT for i, (r, t) in enumerate(rows)]
            c = C.Conversation("x")
            for (role, _), fault in reversed(list(zip(rows, faults))):
                c.back(role, fault, None)
            done = [e for role, text in rows for e in c.forth(role, text)] + list(c.end())
            assert (c.summary()[6], c.summary()[7]) == want[:2]
            assert [(r, t) for e, r, t in done if e != "D"] == want[2]


def test_tables_equal_the_plain_reading(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "User"])
            text = rng.choice(["A b.", "c", "", None, "   ", "Yes! \n", "no…", "q?", f"{turn}."])
            rows.append((conv, rng.choice([turn, turn, None, turn + 2]), role, text, rng.choice([1, 1, 1, 0, 2])))
    rows += [(900, 1, "user", "x", 0), (901, None, None, None, 1), (902, 5, "user", "y" * 300_000 + ".", 1)]
    df = table_of(spark, rows)
    assert collected(C.repair(df, F.col("copies"))) == plainly(rows)
    assert C.repair(df.limit(0)).count() == 0


def test_repaired_turns_follow_the_pattern(spark):
    rows = [(1, 0, "assistant", "Hello.", 1), (1, 1, "assistant", "Again.", 1), (1, 2, "user", "", 1), (2, 0, "user", "Hi", 1)]
    turns = sorted((r.conv_id, r.position or 0, r.edit, r.role, r.text) for r in C.repaired_turns(table_of(spark, rows)).collect())
    assert turns == [(1, 0, "D", "user", ""), (1, 1, "R", "user", "Hello."), (1, 2, "K", "assistant", "Again."), (2, 0, "D", "user", "Hi")]


def test_a_giant_conversation_is_streamed(spark):
    n = 60_000
    df = spark.range(n).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Text "), F.col("id").cast("string"), F.lit(".")).alias("text")
    )
    start = time.time()
    (row,) = C.repair(df).collect()
    assert (row.cost, row.audit, row.gaps, row.illegal) == (0, "K" * n, 0, 0) and time.time() - start < 60
    want = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:Text {i}." for i in range(n))
    assert row.repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_choices_come_back_in_reverse(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 100)
    stack, rng = C.Choices(), random.Random(3)
    put = [rng.randrange(256) for _ in range(1234)]
    for x in put:
        stack.push(x)
    assert len(stack.blocks) == 12
    assert [stack.pop() for _ in put] == put[::-1]


def test_query(spark):
    rows = []
    for conv, turn, role, text in pd.read_parquet(f"{SMALL}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False):
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows.append((conv, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    assert collected(queries.QUERIES["op13_conversation_repair"](spark, SMALL)) == plainly(rows)


def test_damage_takes_nulls_as_a_space(spark):
    df = spark.createDataFrame([(None, i, None, None) for i in range(40)] + [(i, None, "system", "A.") for i in range(40)], "conv_id long, turn long, role string, text string")
    changed, copies = C.damaged(df)
    for r in changed.select("*", copies.alias("copies")).collect():
        key = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        kind = zlib.crc32(key.encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(kind, 1)
        assert r.role == ("user" if kind == 4 else " " if r.conv_id is None else "system")
        assert r.text == ("" if kind == 1 else " " if r.conv_id is None else "A" if kind == 2 else "A.")
