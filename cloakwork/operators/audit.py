"""Audit analytics over events: event_type, conversation_id, entity_types (map), entity_count, latency_ms, ts and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_TYPES = ("mask", "detect", "file", "fail_closed", "demask")
LABEL = r"^[A-Z][A-Z0-9_]{0,63}$"
MAX_COUNT, MAX_LATENCY, MAX_LABELS = 10_000_000, 3_600_000, 64


def validated(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events within bounds, and the others with the reason; no event is lost."""
    types = F.col("entity_types")
    reason = (
        F.when(~F.col("event_type").isin(*EVENT_TYPES), "event_type")
        .when(~F.col("entity_count").between(0, MAX_COUNT), "entity_count")
        .when(F.col("latency_ms").isNotNull() & ~F.col("latency_ms").between(0, MAX_LATENCY), "latency_ms")
        .when(F.coalesce(F.cardinality(types), F.lit(0)) > MAX_LABELS, "too many labels")
        .when(F.coalesce(F.exists(F.map_entries(types), lambda e: ~e["key"].rlike(LABEL) | ~e["value"].between(0, MAX_COUNT)), F.lit(False)), "entity_types")
        .when(F.col("conversation_id").isNotNull() & ~F.col("conversation_id").rlike(r"^[A-Za-z0-9_.:-]{1,64}$"), "conversation_id")
    )
    tagged = events.withColumn("reason", F.coalesce(reason, F.when(F.col("event_type").isNull() | F.col("entity_count").isNull(), "missing")))
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def recent(events: DataFrame, org: str, now: Column, hours: int = 24, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """An organisation's newest events of the last hours."""
    if not (1 <= hours <= 720 and 1 <= limit <= 1000):
        raise ValueError("hours 1 to 720, limit 1 to 1000")
    out = of_tenant(events, org).where(F.col("ts") >= now - F.expr(f"interval {hours} hours"))
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    return out.orderBy(F.desc("ts"), "id").limit(limit)


def of_tenant(table: DataFrame, org: str) -> DataFrame:
    """An organisation's own rows: what every query of a tenant starts from. Rows without an organisation are nobody's."""
    return table.where(F.col("org_id") == org)


def endpoint_list(known: DataFrame, org: str, active_only: bool = False) -> DataFrame:
    """An organisation's endpoints (org_id, endpoint, last_seen, is_active), those seen last first, never seen ones at the end."""
    own = of_tenant(known, org)
    return (own.where("is_active") if active_only else own).orderBy(F.desc_nulls_last("last_seen"), "endpoint")


def newest(table: DataFrame, org: str, limit: int = 100, id_col: str = "id") -> DataFrame:
    """An organisation's newest rows of a log, by id: policy changes, actions of administrators, the six newest events of an overview."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit 1 to 1000")
    return of_tenant(table, org).orderBy(F.desc(id_col)).limit(limit)


def by_severity(policies: DataFrame) -> DataFrame:
    """Policies with the severest action first: block, redact, faker, keep; an unknown one counts as faker."""
    order = F.create_map(*[x for i, a in enumerate(("block", "redact", "faker", "keep")) for x in (F.lit(a), F.lit(i))])
    return policies.orderBy(F.coalesce(F.element_at(order, F.lower("action")), F.lit(2)), "label")


def tenths(whole: Column) -> Column:
    """The mean of whole numbers to one place, halves up, computed in integers."""
    total, n = F.sum(whole.cast("long")), F.count(whole)
    return F.when(n > 0, F.floor((total * 20 + n) / (2 * n)) / 10.0)


def stats(events: DataFrame) -> DataFrame:
    """One row: total_events, fail_closed_events, avg_latency_ms (of masks; 0 reads as null), total_entities_masked."""
    is_mask = F.col("event_type") == "mask"
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("event_type") == "fail_closed").alias("fail_closed_events"),
        F.nullif(tenths(F.when(is_mask, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum(F.when(is_mask, F.col("entity_count"))), F.lit(0)).alias("total_entities_masked"),
    )


def by_event_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def breakdown(events: DataFrame) -> DataFrame:
    """entity_type, n: the label maps of masks, summed."""
    return events.where("event_type = 'mask'").select(F.explode("entity_types").alias("entity_type", "k")).groupBy("entity_type").agg(F.sum("k").alias("n"))


def timeseries(events: DataFrame, since: Column, until: Column, bucket: str = "hour") -> DataFrame:
    """t, events, entities, by_event_type (map): every bucket from since to until, empty ones too. since and until are aggregates
    or literals; the axis is one row a bucket, whatever the number of events."""
    counted = events.groupBy(F.date_trunc(bucket, "ts").alias("t"), "event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entities"))
    slots = counted.groupBy("t").agg(
        F.sum("n").alias("events"), F.sum("entities").alias("entities"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("by_event_type")
    )
    span = events.agg(F.date_trunc(bucket, since).alias("a"), F.date_trunc(bucket, until).alias("b")).where("a is not null")
    axis = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {bucket}"))).alias("t"))
    out = axis.join(slots, "t", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.select("t", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("by_event_type", none).alias("by_event_type"))


def preaggregated(events: DataFrame) -> DataFrame:
    """One event per (event_type, conversation); fail_closed ones stay apart. Counts and maps are summed, latency is averaged."""
    apart = F.when(F.col("event_type") == "fail_closed", F.col("id"))
    e = events.withColumn("_apart", apart)
    keys = ["event_type", "conversation_id", "_apart"]
    sums = e.groupBy(*keys).agg(F.sum("entity_count").alias("entity_count"), F.bround(F.avg(F.col("latency_ms").cast("int"))).cast("int").alias("latency_ms"))
    maps = e.select(*keys, F.explode("entity_types").alias("label", "n")).groupBy(*keys, "label").agg(F.sum("n").alias("n"))
    maps = maps.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("entity_types"))
    same = [sums[k].eqNullSafe(maps[k]) for k in keys]
    out = sums.join(maps, same[0] & same[1] & same[2], "left")
    return out.select(sums["event_type"], sums["conversation_id"], "entity_types", "entity_count", "latency_ms")


def dashboard(events: DataFrame) -> DataFrame:
    """masked, held and other events, prompts and files masked, entities masked."""
    t = F.col("event_type")
    return events.agg(
        F.count_if(t == "mask").alias("masked"), F.count_if(t == "fail_closed").alias("held"), F.count_if(~t.isin("mask", "fail_closed")).alias("other"),
        F.count_if(t == "file").alias("files_masked"), F.coalesce(F.sum(F.when(t.isin("mask", "file"), F.col("entity_count"))), F.lit(0)).alias("entities_masked"),
    )


def hourly_bars(events: DataFrame) -> DataFrame:
    return events.where("event_type in ('mask', 'file')").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def top_entity_types(events: DataFrame, k: int = 8) -> DataFrame:
    return breakdown(events).orderBy(F.desc("n"), "entity_type").limit(k)


def endpoints(heartbeats: DataFrame, now: Column, stale_after: int = 300) -> DataFrame:
    """endpoint, last_seen, version, stale: the newest heartbeat of each (combined before the shuffle)."""
    last = heartbeats.groupBy("endpoint").agg(F.max("ts").alias("last_seen"), F.max_by("version", F.struct("ts", "version")).alias("version"))
    return last.withColumn("stale", F.coalesce(F.col("last_seen") < now - F.expr(f"interval {stale_after} seconds"), F.lit(True)))


def recent_calls(events: DataFrame, key: str, seconds: int = 600) -> DataFrame:
    """events with n_recent: those of the key in the seconds up to and with each, over (key, time block) so that a busy key is
    spread: a block meets itself and the one before."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    block = F.floor(t / (seconds * 1_000_000)).cast("long")
    e = events.withColumns({"_t": t, "_b": block})
    copied = e.withColumn("_own", F.lit(True)).unionByName(e.withColumns({"_own": F.lit(False), "_b": F.col("_b") + 1}))
    w = W.partitionBy(key, "_b").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return copied.withColumn("n_recent", F.count("*").over(w)).where("_own").drop("_t", "_b", "_own")


def newest_per_key(table: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """The row of the largest id of each key."""
    rest = [c for c in table.columns if c not in keys]
    best = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), id_col).alias("r"))
    return best.select(*keys, "r.*").select(table.columns)


def activity(events: DataFrame) -> DataFrame:
    """One row: prompts masked, entities masked in them, files masked, calls blocked."""
    of = lambda kind: F.col("event_type") == kind
    return events.agg(
        F.count_if(of("mask")).alias("prompts_masked"), F.coalesce(F.sum(F.when(of("mask"), F.col("entity_count"))), F.lit(0)).cast("long").alias("entities_masked"),
        F.count_if(of("file")).alias("files_masked"), F.count_if(of("fail_closed")).alias("blocks"),
    )


def owned(events: DataFrame, endpoints_: DataFrame) -> DataFrame:
    """Events whose endpoint is registered in the same organisation."""
    return events.join(endpoints_.select("org_id", "endpoint").distinct(), ["org_id", "endpoint"], "left_semi")


def callers(calls: DataFrame, register: DataFrame, key: str = "api_key") -> DataFrame:
    """calls with the columns of the active row of the register, (key_hash, active, ...), that has the SHA-256 of their key; calls of others go.
    Hashes of a register are unique, so no call is doubled."""
    known = register.where("active").drop("active")
    return calls.withColumn("key_hash", F.sha2(F.col(key), 256)).join(known, "key_hash").drop("key_hash", key)


def utc(stamp: Column) -> Column:
    """A timestamp of an ISO text; one without a zone is in UTC."""
    return F.try_to_timestamp(F.when(stamp.rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2})$"), stamp).otherwise(F.concat(stamp, F.lit("Z"))))


def relative(at: Column, now: Column) -> Column:
    """'just now', '5m ago', '2h ago' or '3d ago'."""
    m = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 60_000_000).cast("long")
    h = F.floor(m / 60).cast("long")
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(m < 1, "just now").when(m < 60, ago(m, "m")).when(h < 24, ago(h, "h")).otherwise(ago(F.floor(h / 24).cast("long"), "d"))


def fleet_versions(heartbeats: DataFrame, now: Column) -> DataFrame:
    """version, endpoints, stale: how many endpoints run each version."""
    return endpoints(heartbeats, now).groupBy("version").agg(F.count("*").alias("endpoints"), F.count_if("stale").alias("stale"))


def scan_summary(windows: DataFrame) -> DataFrame:
    """windows_total, processed, skipped, infer_avg_ms, infer_max_ms of a model's windows (processed, ms)."""
    ms = F.when(F.col("processed"), F.col("ms"))
    return windows.agg(
        F.count("*").alias("windows_total"), F.count_if("processed").alias("processed"), F.count_if(~F.col("processed")).alias("skipped"), F.bround(F.avg(ms), 1).alias("infer_avg_ms"), F.max(ms).alias("infer_max_ms")
    )
