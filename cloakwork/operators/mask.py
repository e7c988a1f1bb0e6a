"""Masking: surrogates and placeholders kept in a vault, offset splices, and restoring.

A surrogate is a keyed hash of (conversation, label, value), so that a task that
runs again gives the same one. Values meet once, in a shuffle on (conversation,
candidate), which keeps surrogates unique in a conversation however many texts it
has; everything else is done in the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakwork.functions.positions import let, splice, sums_before
from cloakwork.operators.describing import quickly
from cloakwork.operators.fakes import restore  # noqa: F401
from cloakwork.operators.policy import RANK, Policy

TTL_SECONDS = 24 * 3600
MAX_PER_CONVERSATION = 100_000
FIRST = "Avery Blake Casey Devon Ellis Finley Gray Harper Indigo Jules Kendall Logan Morgan Noel Oakley Parker".split()
LAST = "Ashdown Birch Calder Dunmore Easton Farrow Garland Holt Ingram Jarrow Kestrel Larkin Marlow Norwood Orchard Pemberton".split()
CITY = "Alderton Brackwell Coldharbour Dunhollow Eastmere Fairholt Greyford Highcombe".split()

def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC of a binary column, for a key of at most 64 bytes."""
    if len(key) > 64:
        raise ValueError("a key of at most 64 bytes is needed")
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def index_of(key: bytes, label: Column, real: Column) -> Column:
    return hmac_sha256(key, F.concat(label.cast("binary"), F.lit(b"\0"), real.cast("binary")))


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def surrogate(label: Column, real: Column, h: Column) -> Column:
    """A value of the label's shape from the hex digest h."""
    n = lambda i: F.conv(F.substring(h, i, 6), 16, 10).cast("long")
    eight = F.substring(h, 1, 8)
    return (
        F.when(label == "PERSON", F.when(F.trim(real).contains(" "), F.concat(_pick(FIRST, n(1)), F.lit(" "), _pick(LAST, n(7)))).otherwise(_pick(FIRST, n(1))))
        .when(label == "EMAIL", F.concat(F.lower(_pick(FIRST, n(9))), F.lit("."), eight, F.lit("@masked.example")))
        .when(label.isin("PHONE_NUMBER", "PHONE_E164"), F.concat(F.lit("+1 555 "), F.lpad(F.pmod(n(1), F.lit(1000)).cast("string"), 3, "0"), F.lit(" "), F.lpad(F.pmod(n(7), F.lit(10000)).cast("string"), 4, "0")))
        .when(label == "LOCATION", _pick(CITY, n(1)))
        .when(label == "ADDRESS", F.concat((F.pmod(n(1), F.lit(98)) + 1).cast("string"), F.lit(" "), _pick(["Larch", "Maple", "Rowan", "Willow"], n(7)), F.lit(" Lane")))
        .when(label == "DATE_OF_BIRTH", F.concat(F.lit("19"), (F.pmod(n(1), F.lit(50)) + 50).cast("string"), F.lit("-0"), (F.pmod(n(7), F.lit(9)) + 1).cast("string"), F.lit("-"), (F.pmod(n(13), F.lit(19)) + 10).cast("string")))
        .when(label == "USERNAME", F.concat(F.lit("user-"), eight))
        .when(label == "ORGANIZATION", F.concat(F.lit("org-"), eight))
        .otherwise(F.concat(F.lit("value-"), eight))
    )


def wanted(merged: DataFrame, conv: str, text: str, policy: Policy) -> DataFrame:
    """Rows (conv, label, real, action) of the values that a vault has to hold."""
    one = merged.where(~blocks(F.col(text), F.col("merged"), policy)).select(F.col(conv).cast("string").alias("conv_id"), text, F.explode("merged").alias("m"))
    real = F.substring(F.col(text), F.col("m.start") + 1, F.col("m.end") - F.col("m.start"))
    held = (F.col("m.action") == RANK["FAKER"]) | ((F.col("m.action") == RANK["REDACT"]) & policy.stored(F.col("m.label")))
    return one.where(held).select("conv_id", F.col("m.label").alias("label"), real.alias("real"), F.col("m.action").alias("action"))


def proposed(values: DataFrame, provider: Callable[[Column, Column, Column], Column] = surrogate) -> DataFrame:
    """values (conv_id, label, real, action, idx) with base, the fake that each would have, and more, which takes more of its digest: for a
    second value of the same base."""
    h = F.sha2(F.concat_ws("\u0001", "conv_id", "idx"), 256)
    plain = lambda n: F.concat(F.lit("[[REDACTED:"), F.col("label"), F.lit(":"), F.substring(h, 1, n), F.lit("]]"))
    base = F.when(F.col("action") == RANK["FAKER"], provider(F.col("label"), F.col("real"), h)).otherwise(plain(8))
    more = F.when(F.col("base").startswith("[["), plain(16)).otherwise(F.concat(F.col("base"), F.lit(" "), F.substring(h, 9, 8)))
    return values.withColumn("base", base).withColumn("more", more)


@quickly
def assign(values: DataFrame, key: bytes, now: Column | None = None, vault: DataFrame | None = None, ttl: int = TTL_SECONDS, cap: int = MAX_PER_CONVERSATION, provider: Callable[[Column, Column, Column], Column] = surrogate) -> DataFrame:
    """The vault with the values added: conv_id, label, real, fake, idx, expires_at (epoch seconds). Values that a live entry
    holds keep it. Each (conversation, label, value) has one fake, and each fake of a conversation one value. Values beyond a
    conversation's cap get no entry: they are redacted for good. provider: label, value and a hex digest to a fake of any shape."""
    now = F.unix_timestamp() if now is None else now
    v = values.groupBy("conv_id", "label", "real").agg(F.max("action").alias("action")).withColumn("idx", index_of(key, F.col("label"), F.col("real")))
    held = None
    if vault is not None:
        held = live(vault, now).select("conv_id", "label", "real", "fake", "idx", "expires_at")
        v = v.join(held.select("conv_id", "idx"), ["conv_id", "idx"], "left_anti")
    v = proposed(v, provider)
    taken = F.row_number().over(W.partitionBy("conv_id", "base").orderBy("idx"))
    used = v.withColumn("_n", taken)
    if held is not None:
        old = held.select("conv_id", F.col("fake").alias("base"), F.lit(1).alias("_old"))
        used = used.join(old, ["conv_id", "base"], "left").withColumn("_n", F.col("_n") + F.coalesce("_old", F.lit(0)))
    fake = F.when((F.col("_n") == 1) & (F.col("base") != F.col("real")), F.col("base")).otherwise(F.col("more"))
    fresh = used.withColumn("fake", fake)
    # a full conversation takes no more entries; none that it holds is lost
    room = F.lit(cap)
    if held is not None:
        counts = held.groupBy("conv_id").agg(F.count("*").alias("_held"))
        fresh, room = fresh.join(counts, "conv_id", "left"), F.lit(cap) - F.coalesce(F.col("_held"), F.lit(0))
    turn = F.row_number().over(W.partitionBy("conv_id").orderBy("idx"))
    fresh = fresh.withColumn("_turn", turn).where(F.col("_turn") <= room)
    fresh = fresh.select("conv_id", "label", "real", "fake", "idx", (now + ttl).cast("double").alias("expires_at"))
    return fresh if held is None else held.unionByName(fresh)


def sealed(vault: DataFrame, key: bytes) -> DataFrame:
    """The vault as it is stored: the value encrypted (AES-GCM, key of 16, 24 or 32 bytes) in place of the value."""
    return vault.select("conv_id", "label", "fake", F.aes_encrypt(F.col("real").cast("binary"), F.lit(key), F.lit("GCM")).alias("sealed_real"), "expires_at", "idx")


def unsealed(stored: DataFrame, key: bytes) -> DataFrame:
    return stored.select("conv_id", "label", F.aes_decrypt("sealed_real", F.lit(key), F.lit("GCM")).cast("string").alias("real"), "fake", "idx", "expires_at")


def live(vault: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired."""
    return vault.where(F.col("expires_at") > now)


@quickly
def redacted(text: Column, merged: Column) -> Column:
    """text with [REDACTED:LABEL] for every merged span: no vault, no shuffle."""
    edits = F.transform(
        merged, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("[REDACTED:"), m["label"], F.lit("]")).alias("replacement"))
    )
    return splice(text, edits)


def checked(text: Column, merged: Column) -> Column:
    """merged, if its spans lie in the text, in order and apart; anything else is an error."""
    after_last = lambda m, i: F.when(i == 0, F.lit(0)).otherwise(F.get(merged, i - 1)["end"])
    good = F.transform(merged, lambda m, i: (m["start"] >= after_last(m, i)) & (m["start"] < m["end"]) & (m["end"] <= F.length(text)))
    return F.when(F.coalesce(F.forall(good, lambda g: F.coalesce(g, F.lit(False))), F.lit(True)), merged).otherwise(F.raise_error(F.lit("spans must lie in the text, in order and apart")))


def blocks(text: Column, merged: Column, policy: Policy) -> Column:
    """Does a span stop the text, by the action it was merged with or by the policy's for its label and value?"""
    value = lambda m: F.substring(text, m["start"] + 1, m["end"] - m["start"])
    return F.exists(merged, lambda m: (m["action"] == RANK["BLOCK"]) | (policy.rank_of(m["label"], value(m)) == RANK["BLOCK"]))


@quickly
def mask(merged: DataFrame, key_col: str, conv: str, vault: DataFrame, text: str = "text", policy: Policy = Policy()) -> DataFrame:
    """key, masked_text (null if blocked), blocked, infos: array<struct<label,action,start,end,masked_start,masked_end,stored>>.

    merged has the column of that name. A value without an entry, or whose fake
    the text holds already, becomes [REDACTED:LABEL]. Only values meet the vault:
    the texts themselves are joined once, with what became of their spans.
    """
    sound = checked(F.col(text), F.col("merged"))
    # explode_outer: the spans are computed once, and texts without any have no row
    rows = merged.select(F.col(key_col), F.col(conv).cast("string").alias("conv_id"), text, F.posexplode_outer(sound).alias("pos", "m")).where(F.col("m").isNotNull())
    real = F.substring(F.col(text), F.col("m.start") + 1, F.col("m.end") - F.col("m.start"))
    rows = rows.where(~F.col("m.action").isin(RANK["KEEP"], RANK["BLOCK"])).select(
        key_col, "conv_id", F.col("m.label").alias("label"), real.alias("real"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.action").alias("rank")
    )
    found = rows.join(vault.select("conv_id", "label", "real", "fake"), ["conv_id", "label", "real"], "left")
    allowed = (F.col("rank") == RANK["FAKER"]) | policy.stored(F.col("label"))
    edit = F.struct("start", "end", F.when(allowed, F.col("fake")).alias("fake"), "label", (F.col("rank") == RANK["FAKER"]).alias("faker"))
    edits = found.groupBy(key_col).agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    blocked = F.coalesce(blocks(F.col(text), F.col("merged"), policy), F.lit(False))
    out = merged.select(key_col, text, blocked.alias("blocked")).join(edits, key_col, "left")

    def settled(e: Column) -> Column:
        usable = e["fake"].isNotNull() & ~F.contains(F.col(text), e["fake"])
        plain = F.concat(F.lit("[REDACTED:"), e["label"], F.lit("]"))
        return F.struct(
            e["start"].alias("start"), e["end"].alias("end"), F.when(usable, e["fake"]).otherwise(plain).alias("replacement"), e["label"].alias("label"),
            F.when(usable & e["faker"], "FAKER").otherwise("REDACT").alias("action"), usable.alias("stored"),
        )

    none = "array<struct<start:int,end:int,replacement:string,label:string,action:string,stored:boolean>>"
    out = out.withColumn("edits", F.coalesce(F.transform("edits", settled), F.array().cast(none)))
    infos = F.when(~F.col("blocked"), masked_offsets(F.col("edits"))).otherwise(F.slice(masked_offsets(F.col("edits")), 1, 0))
    return out.select(key_col, F.when(~F.col("blocked"), splice(F.col(text), F.col("edits"))).alias("masked_text"), "blocked", infos.alias("infos"))


def masked_offsets(edits: Column) -> Column:
    """Where each replacement lies in the masked text: the running difference of lengths."""

    def one(e: Column, delta: Column) -> Column:
        start = e["start"] + delta
        return F.struct(
            e["label"].alias("label"), e["action"].alias("action"), e["start"].alias("start"), e["end"].alias("end"), start.alias("masked_start"),
            (start + F.length(e["replacement"])).alias("masked_end"), e["stored"].alias("stored"),
        )

    grown = lambda all_: F.transform(all_, lambda e: F.length(e["replacement"]) - (e["end"] - e["start"]))
    return let(edits, lambda all_: let(sums_before(grown(all_)), lambda deltas: F.transform(all_, lambda e, i: one(e, F.get(deltas, i)))))


# ---- the vault as those who restore see it
def items(vault: DataFrame, conv_id: str, now: Column) -> DataFrame:
    """fake, real of a conversation's live entries."""
    return live(vault, now).where(F.col("conv_id") == conv_id).select("fake", "real")


def cleared(vault: DataFrame, conv_ids: list[str]) -> DataFrame:
    """The vault without some conversations."""
    return vault.where(~F.col("conv_id").isin(*conv_ids))


def versions(vault: DataFrame, now: Column) -> DataFrame:
    """conv_id, version: how often the conversation's entries changed: each that came, and each time when some expired."""
    gone = F.count_distinct(F.when(F.col("expires_at") <= now, F.col("expires_at")))
    return vault.groupBy("conv_id").agg((F.count("*") + gone).alias("version"))


def mapping(vault: DataFrame, asked: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """For calls (conv_id, since_version): conv_id, version (-1 for an unknown one), changed, entries (fake, real) where it changed; and
    the audit events of those that got any: counts, never values."""
    held = live(vault, now).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("fake", "real"))).alias("entries"))
    known = asked.join(versions(vault, now), "conv_id", "left").join(held, "conv_id", "left").withColumn("version", F.coalesce("version", F.lit(-1)))
    changed = ~F.col("since_version").eqNullSafe(F.col("version"))
    none = F.slice(F.array(F.struct(F.lit("").alias("fake"), F.lit("").alias("real"))), 1, 0)
    out = known.select("conv_id", "version", changed.alias("changed"), F.when(changed, F.coalesce("entries", none)).otherwise(none).alias("entries"))
    events = out.where(F.size("entries") > 0).select(F.lit("demask").alias("event_type"), "conv_id", F.size("entries").alias("entity_count"))
    return out, events


def originals_left(text: Column, entries: Column) -> Column:
    """How many values of a vault's entries (array of fake, real) the text still has; not those that are part of their fake."""
    return F.size(F.filter(entries, lambda e: F.contains(text, e["real"]) & ~F.contains(e["fake"], e["real"])))


def response(scanned: DataFrame, key: str) -> DataFrame:
    """key, entities_found and entities_types of the raw spans, and the counts by label of the merged ones, for the audit: scanned has
    both arrays."""
    labels = lambda c: F.transform(c, lambda x: x["label"])
    counts = lambda c: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(labels(c))), lambda x: F.struct(x.alias("label"), F.size(F.filter(labels(c), lambda y: y == x)).alias("n"))))
    return scanned.select(key, F.size("spans").alias("entities_found"), F.array_sort(F.array_distinct(labels("spans"))).alias("entity_types"), counts("merged").alias("audit_counts"))
