"""Structured Streaming forms: audit windows, the vault, rate limits, heartbeats, restoring."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cloakwork.operators import audit

LATE = "10 minutes"
#: The state store of streams with states of their own: the default one holds a single state a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_states(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    """A stream's rows by key through a processor with states; the session's streams take the store that these need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)


def audit_windows(events: DataFrame, window: str = "10 seconds", late: str = LATE) -> DataFrame:
    """Tumbling windows of an audit stream: window start, event_type, conversation_id, events, entities, latency. Our policy for
    late events is a watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type", "conversation_id")
        .agg(F.count("*").alias("events"), F.sum("entity_count").alias("entities"), F.avg("latency_ms").alias("latency_ms"))
        .select(F.col("w.start").alias("t"), "event_type", "conversation_id", "events", "entities", "latency_ms")
    )


def push_batches(events: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "10 seconds"):
    """Pre-aggregated audit batches to deliver(batch, id). A batch that fails is replayed from the checkpoint under the same id."""
    writer = events.writeStream.foreachBatch(lambda df, i: deliver(audit.preaggregated(df), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def masked_stream(texts: DataFrame, mask_batch: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Masks each micro-batch and appends it, once a batch id: a replayed batch overwrites its own partition."""

    def write(df: DataFrame, i: int) -> None:
        mask_batch(df).write.mode("overwrite").parquet(f"{sink}/batch={i}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RateLimiter(StatefulProcessor):
    """At most `calls` accepted calls of a key in `seconds`; refused calls don't count. State is the accepted times of the
    last seconds, so at most `calls` numbers a key."""

    def __init__(self, calls: int = 100, seconds: int = 600):
        self.calls, self.seconds = calls, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.times.get()] if self.times.exists() else []
        for pdf in rows:
            pdf = pdf.sort_values("t")
            allowed = []
            for t in pdf["t"]:
                held = [x for x in held if x > t - self.seconds]
                allowed.append(len(held) < self.calls)
                if allowed[-1]:
                    held.append(t)
            yield pd.DataFrame({"key": key[0], "t": pdf["t"].to_numpy(), "allowed": allowed})
        self.times.put([(t,) for t in held])

    def close(self) -> None:
        pass


def rate_limited(calls: DataFrame, limit: int = 100, seconds: int = 600) -> DataFrame:
    """key, t (epoch seconds), allowed of a stream of calls (key, t)."""
    return with_states(calls, "key", RateLimiter(limit, seconds), "key string, t double, allowed boolean")


def replay_limits(calls: DataFrame, limit: int = 100, seconds: int = 600) -> DataFrame:
    """The same decisions over a table: a key's calls in order. A key is one sequence by nature; its state is bounded by limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf["key"], pdf["t"]):
                if k != now:
                    now, held = k, []
                held = [x for x in held if x > t - seconds]
                allowed.append(len(held) < limit)
                if allowed[-1]:
                    held.append(t)
            yield pdf.assign(allowed=allowed)

    ordered = calls.select(F.col("key").cast("string"), F.col("t").cast("double")).repartition("key").sortWithinPartitions("key", "t")
    return ordered.mapInPandas(run, "key string, t double, allowed boolean")


class TwoWayVault(StatefulProcessor):
    """A conversation's vault both ways: value to fake and fake to value, how many entries it has, and the timer at which all have expired."""

    def __init__(self, ttl: int, cap: int):
        self.ttl, self.cap = ttl, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fakes = handle.getMapState("fakes", "idx string", "fake string")
        self.owners = handle.getMapState("owners", "fake string", "idx string")
        self.due = handle.getMapState("due", "expires_at double", "idx array<string>")
        self.count = handle.getValueState("count", "n long, timer long")

    def note_due(self, t: float | None, fresh: list[str]) -> None:
        """The values that came at t expire together: one list, written once a batch."""
        if fresh:
            at = float(t + self.ttl)
            held = list(self.due.getValue((at,))[0]) if self.due.containsKey((at,)) else []
            self.due.updateValue((at,), (held + fresh,))

    def drop_expired(self, now: float) -> int:
        """Frees the values and fakes whose time is over; how many. Each entry is dropped once, by the list of its own time."""
        over = [at for (at,) in self.due.keys() if at <= now]
        n = 0
        for at in over:
            for idx in self.due.getValue((at,))[0]:
                fake = self.fakes.getValue((idx,))[0]
                self.fakes.removeKey((idx,))
                self.owners.removeKey((fake,))
                n += 1
            self.due.removeKey((at,))
        return n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, timer = self.count.get() if self.count.exists() else (0, 0)
        before = timer
        seen: set[str] = set()  # bases that this batch has taken or passed over
        for pdf in rows:
            out, last, fresh = [], None, []
            for t, idx, real, base, more in pdf.sort_values(["t", "idx"])[["t", "idx", "real", "base", "more"]].itertuples(index=False):
                if t != last:
                    self.note_due(last, fresh)
                    fresh = []
                    n, last, timer = n - self.drop_expired(t), t, max(timer, int((t + self.ttl) * 1000))
                if self.fakes.containsKey((idx,)):
                    out.append((key[0], idx, self.fakes.getValue((idx,))[0], True))
                    continue
                taken = base in seen or base == real or self.owners.containsKey((base,))
                seen.add(base)
                fake = more if taken else base
                if n >= self.cap or self.owners.containsKey((fake,)):
                    out.append((key[0], idx, None, False))
                    continue
                self.fakes.updateValue((idx,), (fake,))
                self.owners.updateValue((fake,), (idx,))
                fresh.append(idx)
                n += 1
                out.append((key[0], idx, fake, False))
            self.note_due(last, fresh)
            yield pd.DataFrame(out, columns=["conv_id", "idx", "fake", "reused"])
        if timer != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.count.update((n, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.fakes, self.owners, self.due, self.count):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def two_way_vault(proposals: DataFrame, ttl: int = 24 * 3600, cap: int = 100_000, late: str = LATE) -> DataFrame:
    """conv_id, idx, fake, reused of a stream of mask.proposed() values with ts, the time of each.

    A live value keeps its fake: the first writer wins. No fake of a conversation is used twice, and both are free again once the entry has
    expired, ttl seconds after it by the rows' own times. A conversation of `cap` live entries takes no more: fake is null, so the value is
    redacted for good. Rows of one time are taken by idx, so that a batch gives what mask.assign() gives for it. A conversation is forgotten
    once the watermark says that all its entries have expired. Rows later than the watermark have no answer, so their values stay redacted.
    """
    timed = proposals.withWatermark("ts", late).withColumn("t", F.unix_micros("ts") / 1e6)
    return with_states(timed, "conv_id", TwoWayVault(ttl, cap), "conv_id string, idx string, fake string, reused boolean", "EventTime")


def endpoint_stream(heartbeats: DataFrame, late: str = LATE) -> DataFrame:
    """endpoint, last_seen and version of a heartbeat stream, for complete or update output."""
    return heartbeats.withWatermark("ts", late).groupBy("endpoint").agg(F.max("ts").alias("last_seen"), F.max_by("version", "ts").alias("version"))


def with_current_policy(entities: DataFrame, policy: DataFrame, version: int | None = None) -> DataFrame:
    """Stream-static join: the policy table is read again each micro-batch. version: only entries of later ones than that count, as for a
    caller who has that version already."""
    newer = policy if version is None else policy.where(F.col("version") > version)
    return entities.join(newer, "label", "left")


def polled_hours(events: DataFrame, late: str = LATE) -> DataFrame:
    """t, event_type, events, entities of each hour, for complete or update output: a poll of the time series."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by.agg(F.count("*").alias("events"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities")).select(F.col("w.start").alias("t"), "event_type", "events", "entities")


def polled_stats(events: DataFrame) -> DataFrame:
    """Events and entities by type from the start of the stream, for complete output: each poll is the whole table."""
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities"))


class ReplyState(StatefulProcessor):
    """Restores a reply that comes in pieces. What may be the start of a fake is held back until more comes, or the reply ends."""

    def __init__(self, longest: int):
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text = self.held.get()[0] if self.held.exists() else ""
        for pdf in rows:
            for piece, last, fakes in pdf.sort_values("seq")[["piece", "last", "fakes"]].itertuples(index=False):
                known = dict(zip(fakes["fake"], fakes["real"])) if isinstance(fakes, dict) else {f["fake"]: f["real"] for f in fakes}
                text += piece
                done, text = restored_so_far(text, known, bool(last))
                yield pd.DataFrame({"reply": [key[0]], "text": [done]})
        self.held.update((text,))

    def close(self) -> None:
        pass


def restored_so_far(text: str, known: dict[str, str], last: bool) -> tuple[str, str]:
    """(restored, held back): fakes become their values, the longest first, not inside a word; the end of the text that may still become a
    fake, or go on as a word, is held back."""
    keep = len(text)
    if not last and known:
        longest = max(map(len, known))
        for at in range(max(0, len(text) - longest), len(text)):
            if any(f.startswith(text[at:]) for f in known):
                keep = at
                break
        # a fake that ends here may turn out to be part of a longer word
    word = lambda c: c.isalnum() or c == "_"
    guarded = [(r"(?<!\w)" if word(f[0]) else "") + re.escape(f) + (r"(?!\w)" if word(f[-1]) else "") for f in sorted(known, key=lambda f: (-len(f), f))]
    if not guarded:
        return text, ""
    return re.sub("|".join(guarded), lambda m: known[m[0]], text[:keep]), text[keep:]


def restored_replies(pieces: DataFrame, longest: int = 256) -> DataFrame:
    """reply, text of a stream of pieces (reply, seq, piece, last, fakes: array of fake and real): joined in order, the texts are the restored
    reply."""
    return with_states(pieces, "reply", ReplyState(longest), "reply string, text string")


class TabState(StatefulProcessor):
    """One vault a conversation of a tab: known by the server's id once there is one, before that pending under a new one. What came first
    is kept, one call after the other."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "server string", "vault string")
        self.now = handle.getValueState("now", "pending string, last string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending, last = self.now.get() if self.now.exists() else (None, None)
        for pdf in rows:
            out = []
            for call, server in pdf.sort_values("call")[["call", "server"]].itertuples(index=False):
                server = server if isinstance(server, str) and server else None
                if server is not None and self.known.containsKey((server,)):
                    vault = self.known.getValue((server,))[0]
                elif server is not None:
                    vault = pending or last or f"conv_{server}"
                    pending = None
                    self.known.updateValue((server,), (vault,))
                else:
                    vault = pending or last
                    if vault is None:
                        vault = pending = f"new_{key[0]}_{call}"
                last = vault
                out.append((key[0], call, vault))
            yield pd.DataFrame(out, columns=["tab", "call", "vault"])
        self.now.update((pending, last))

    def close(self) -> None:
        pass


def resolved_vaults(calls: DataFrame) -> DataFrame:
    """tab, call, vault of a stream of calls (tab, call: a number in order, server: the server's id of the conversation or null)."""
    return with_states(calls, "tab", TabState(), "tab string, call long, vault string")
