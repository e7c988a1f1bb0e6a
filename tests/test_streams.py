"""Streams that are started: audit windows and pushes, rate limits, vault, heartbeats, policy, replies and tabs."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import mask
from cloakwork.operators.policy import RANK
from cloakwork.streaming import streams


@pytest.fixture
def source(spark, tmp_path):
    """feed(schema, batches): a stream of the batches, one file each, read in order."""

    def feed(schema, batches):
        folder = tmp_path / f"in{random.randrange(10**9)}"
        folder.mkdir()
        for i, rows in enumerate(batches):
            before = set(folder.iterdir())
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            for f in set(folder.iterdir()) - before:
                os.utime(f, (1_700_000_000 + 60 * i,) * 2)  # files are read in the order of their times
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return feed


def run(spark, df, mode, tmp_path, name):
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # a partition of state is a Python process a batch
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    ended = q.awaitTermination(240)
    if not ended:
        q.stop()
    assert ended and q.exception() is None
    return spark.table(name).collect()


EVENT = "id long, ts timestamp, event_type string, conversation_id string, entity_count int, latency_ms int, entity_types map<string,long>"


def events(spark, times):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{m:02}:00", t, "c") for i, (m, t) in enumerate(times)], "id long, ts string, event_type string, conversation_id string")
    made = rows.select("id", F.to_timestamp("ts").alias("ts"), "event_type", "conversation_id", F.lit(2).alias("entity_count"), F.lit(10).alias("latency_ms"), F.create_map(F.lit("EMAIL"), F.lit(2).cast("long")).alias("entity_types"))
    return made.collect()


def test_audit_windows_drop_late_events(spark, source, tmp_path):
    batches = [events(spark, [(1, "mask"), (1, "mask"), (2, "detect")]), events(spark, [(40, "mask")]), events(spark, [(45, "file")]), events(spark, [(1, "mask"), (41, "mask")]), events(spark, [(58, "mask")]), events(spark, [(59, "mask")])]
    got = run(spark, streams.audit_windows(source(EVENT, batches), "1 minute"), "append", tmp_path, "audit_w")
    assert {(r.t.minute, r.event_type): (r.events, r.entities) for r in got} == {(1, "mask"): (2, 4), (2, "detect"): (1, 2), (40, "mask"): (1, 2), (41, "mask"): (1, 2), (45, "file"): (1, 2)}


def test_pushed_batches_and_polls(spark, source, tmp_path):
    batches = [events(spark, [(1, "mask"), (1, "mask")]), events(spark, [(2, "mask"), (2, "fail_closed"), (2, "fail_closed")])]
    sent = {}
    q = streams.push_batches(source(EVENT, batches), lambda df, i: sent.update({i: [(r.event_type, r.entity_count) for r in df.collect()]}), str(tmp_path / "cp_push"), interval=None)
    q.awaitTermination(240)
    assert sorted(map(sorted, sent.values())) == [[("fail_closed", 2), ("fail_closed", 2), ("mask", 2)], [("mask", 4)]]
    got = run(spark, streams.polled_stats(source(EVENT, batches)), "complete", tmp_path, "polls")
    assert {r.event_type: (r.events, r.entities) for r in got} == {"mask": (3, 6), "fail_closed": (2, 4)}
    got = run(spark, streams.polled_hours(source(EVENT, batches)), "complete", tmp_path, "hours")
    assert {(r.t.hour, r.event_type): r.events for r in got} == {(0, "mask"): 3, (0, "fail_closed"): 2}


def test_rate_limits_like_the_replay(spark, source, tmp_path):
    rng = random.Random(3)
    calls = sorted((float(rng.randrange(3000)), rng.choice("ab")) for _ in range(60))
    batches = [[(k, t) for t, k in calls[i : i + 20]] for i in (0, 20, 40)]
    got = run(spark, streams.rate_limited(source("key string, t double", batches), 3, 300), "append", tmp_path, "limits")
    want = streams.replay_limits(spark.createDataFrame([(k, t) for t, k in calls], "key string, t double"), 3, 300).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.allowed for r in got} == {True, False}


PROPOSAL = "conv_id string, ts timestamp, label string, real string, idx string, base string, more string"


def proposals(spark, rows, pool):
    """Rows (conv, t, real) with candidates from a pool so small that they meet."""
    few = lambda label, real, h: F.concat(F.lit("f"), F.pmod(F.conv(F.substring(h, 1, 6), 16, 10).cast("long"), F.lit(pool)).cast("string"))
    v = spark.createDataFrame([(c, float(t), "PERSON", r, 2) for c, t, r in rows], "conv_id string, t double, label string, real string, action int")
    v = v.withColumn("action", F.lit(RANK["FAKER"])).withColumn("idx", mask.index_of(b"k", F.col("label"), F.col("real")))
    return v, mask.proposed(v, few).select("conv_id", F.timestamp_seconds("t").alias("ts"), "label", "real", "idx", "base", "more"), few


def test_two_way_vault_like_assign(spark, source, tmp_path):
    rng = random.Random(7)
    batches = [[(rng.choice("cd"), t, f"n{rng.randrange(30)}") for _ in range(14)] for t in (100, 104, 108, 113, 119)]
    want, vault = set(), None
    made = []
    for rows in batches:
        v, p, few = proposals(spark, rows, 9)
        made.append(p.collect())
        now = F.lit(rows[0][1]).cast("long")
        vault = spark.createDataFrame(mask.assign(v, b"k", now, vault, ttl=10, cap=12, provider=few).collect(), "conv_id string, label string, real string, fake string, idx string, expires_at double")
        held = {(r.conv_id, r.idx): r.fake for r in vault.collect()}
        want |= {(c, rows[0][1], i, held.get((c, i))) for c, i in {(r.conv_id, r.idx) for r in made[-1]}}
    got = run(spark, streams.two_way_vault(source(PROPOSAL, made), 10, 12), "append", tmp_path, "two_way")
    by_batch = {(c, t, i): f for c, t, i, f in want}
    asked = [(r.conv_id, b[0][1], r.idx) for b, rows in zip(batches, made) for r in rows]
    assert sorted((r.conv_id, r.idx, str(r.fake)) for r in got) == sorted((c, i, str(by_batch[c, t, i])) for c, t, i in asked)
    assert any(r.fake is None for r in got) and any(r.fake and " " in r.fake for r in got) and any(r.reused for r in got)


def test_expired_slots_are_free_both_ways(spark, source, tmp_path):
    row = lambda t, real, base: ("c", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), "PERSON", real, f"i-{real}", base, f"{base} more")
    batches = [[row(0, "Ann", "Zed")], [row(4, "Bob", "Yan"), row(5, "Dan", "Zed")], [row(11, "Ann", "Other"), row(12, "Cat", "Zed"), row(13, "Bob", "New")]]
    got = run(spark, streams.two_way_vault(source(PROPOSAL, batches), 10, 100), "append", tmp_path, "slots")
    assert [(r.idx, r.fake, r.reused) for r in got] == [
        ("i-Ann", "Zed", False), ("i-Bob", "Yan", False), ("i-Dan", "Zed more", False), ("i-Ann", "Other", False), ("i-Cat", "Zed", False), ("i-Bob", "Yan", True),
    ]


def test_heartbeats_and_policy(spark, source, tmp_path):
    beats = lambda *xs: [r[:] for r in spark.createDataFrame([(e, f"2024-01-01 00:{m:02}:00", v) for e, m, v in xs], "endpoint string, ts string, version string").withColumn("ts", F.to_timestamp("ts")).collect()]
    got = run(spark, streams.endpoint_stream(source("endpoint string, ts timestamp, version string", [beats(("a", 1, "v1"), ("b", 2, "v1")), beats(("a", 5, "v2"))])), "complete", tmp_path, "beats")
    assert {r.endpoint: (r.last_seen.minute, r.version) for r in got} == {"a": (5, "v2"), "b": (2, "v1")}
    policy = spark.createDataFrame([("EMAIL", "BLOCK", 3), ("URL", "KEEP", 1)], "label string, action string, version int")
    got = run(spark, streams.with_current_policy(source("id long, label string", [[(1, "EMAIL"), (2, "URL")]]), policy, 1), "append", tmp_path, "pol")
    assert {r.id: r.action for r in got} == {1: "BLOCK", 2: None}


def test_masked_stream_writes_each_batch_once(spark, source, tmp_path):
    q = streams.masked_stream(source("id long, text string", [[(1, "a")], [(2, "b")]]), lambda df: df.withColumn("text", F.upper("text")), str(tmp_path / "out"), str(tmp_path / "cp_m"))
    q.awaitTermination(240)
    assert {(r.id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "A"), (2, "B")}


def test_replies_in_pieces(spark, source, tmp_path):
    known = {"Avery Birch": "Ann Lee", "Avery": "Ann", "org-12": "Acme"}
    text = "Dear Avery Birch, Avery of org-12, not org-123 nor Averyx: org-12"
    rng = random.Random(5)
    for _ in range(200):
        out, held, at = "", "", 0
        while at < len(text):
            n = rng.randint(1, 9)
            at += n
            done, held = streams.restored_so_far(held + text[at - n : at], known, at >= len(text))
            out += done
        assert out == "Dear Ann Lee, Ann of Acme, not org-123 nor Averyx: Acme"
    fakes = [(f, r) for f, r in known.items()]
    pieces = [[("r", i, text[i * 7 : i * 7 + 7], (i + 1) * 7 >= len(text), fakes)] for i in range(-(-len(text) // 7))]
    schema = "reply string, seq int, piece string, last boolean, fakes array<struct<fake:string,real:string>>"
    got = run(spark, streams.restored_replies(source(schema, pieces)), "append", tmp_path, "replies")
    assert "".join(r.text for r in got) == "Dear Ann Lee, Ann of Acme, not org-123 nor Averyx: Acme"


def test_one_vault_a_conversation(spark, source, tmp_path):
    calls = [[("t", 1, None), ("t", 2, None)], [("t", 3, "s1"), ("t", 4, None)], [("t", 5, "s2"), ("t", 6, "s1"), ("u", 1, "s1")]]
    got = run(spark, streams.resolved_vaults(source("tab string, call long, server string", calls)), "append", tmp_path, "tabs")
    assert {(r.tab, r.call): r.vault for r in got} == {("t", 1): "new_t_1", ("t", 2): "new_t_1", ("t", 3): "new_t_1", ("t", 4): "new_t_1", ("t", 5): "new_t_1", ("t", 6): "new_t_1", ("u", 1): "conv_s1"}
