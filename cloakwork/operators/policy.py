"""Policy: from a label (and for addresses its value) to an action, risk, category and storage."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.functions import fixed
from cloakwork.functions import validators as V
from cloakwork.operators.tables import free_name

RANK = {a: i for i, a in enumerate(fixed.ACTIONS)}
STRATEGY = {"KEEP": "keep", "FAKER": "pseudonymize", "REDACT": "redact", "BLOCK": "block"}


@dataclass(frozen=True)
class Entry:
    action: str
    risk: str = "UNKNOWN"
    category: str = "UNKNOWN"
    store: bool = False


DEFAULTS = {label: Entry(action, risk, category, store) for label, action, risk, category, store in fixed.ROUTING}
#: Labels whose value may never be kept.
CRITICAL = frozenset(k for k, e in DEFAULTS.items() if e.risk == "CRITICAL" and e.category == "CREDENTIAL")


def _word(known: dict, word: object, what: str):
    """What a word of a config stands for, in any case."""
    found = None if word is None else known.get(str(word).strip().upper())
    if found is None:
        raise ValueError(f"{what}: {word!r} isn't known")
    return found


def canonical(label: str) -> str:
    key = label.strip().upper()
    return fixed.ALIASES.get(key, key)


@dataclass(frozen=True)
class Policy:
    """An immutable table of entries; a changed one is a new object."""

    table: dict[str, Entry] = field(default_factory=lambda: dict(DEFAULTS))
    default: str = "REDACT"

    def __post_init__(self) -> None:
        if self.default == "KEEP":
            raise ValueError("an unknown label must not be kept")

    def override(self, changes: dict[str, str | dict]) -> Policy:
        """Actions by label; an entry's risk, category and storage stay unless they are given. Critical secrets can't be kept."""
        table = dict(self.table)
        for label, change in changes.items():
            key = canonical(label)
            if not key:
                raise ValueError("a label is needed")
            change = {"action": change} if isinstance(change, str) else dict(change)
            action = _word(fixed.ACTION_WORDS, change.get("action"), f"{label}: action")
            if action == "KEEP" and key in CRITICAL:
                raise ValueError(f"{label}: a critical secret can't be kept")
            old = table.get(key) or DEFAULTS.get(key) or Entry(action, "MEDIUM", "UNKNOWN", action == "FAKER")
            given = lambda name, words, stays: stays if change.get(name) is None else _word(words, change[name], f"{label}: {name}")
            table[key] = Entry(
                action, given("risk_level", dict(zip(fixed.RISKS, fixed.RISKS)), old.risk), given("entity_category", dict(zip(fixed.CATEGORIES, fixed.CATEGORIES)), old.category),
                given("storage", fixed.STORE_WORDS, old.store),
            )
        return Policy(table, self.default)

    @staticmethod
    def from_json(text: str) -> Policy:
        """The defaults with a config's overrides: {"OVERRIDES": {...}}, or the inner object itself."""
        found = json.loads(text)
        return Policy().override(found.get("OVERRIDES", found))

    @staticmethod
    def snapshot(changes: dict[str, str], strict: bool = True) -> Policy:
        """A whole state: labels that aren't listed are at their default. Not strict: entries that are wrong are left out."""
        out = Policy()
        for label, action in changes.items():
            try:
                out = out.override({label: action})
            except ValueError:
                if strict:
                    raise
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, e.action, RANK[e.action], e.risk, e.category, e.store, e != DEFAULTS.get(k)) for k, e in sorted(self.table.items())]
        return spark.createDataFrame(rows, "label string, action string, rank int, risk string, category string, store boolean, overridden boolean")

    def _lookup(self, what) -> Column:
        """The table as a literal map: some forty entries, so it needs no join inside arrays."""
        return F.create_map(*[F.lit(x) for k, e in sorted(self.table.items()) for x in (k, what(e))])

    def rank_of(self, label: Column, value: Column) -> Column:
        """0 KEEP to 3 BLOCK."""
        c = canonical_label(label)
        known = F.coalesce(F.try_element_at(self._lookup(lambda e: RANK[e.action]), c), F.lit(RANK[self.default]))
        return F.when(c.isin(*fixed.IP_LABELS), F.when(V.publicly_routable(value), RANK["KEEP"]).otherwise(RANK["REDACT"])).otherwise(known)

    def stored(self, label: Column) -> Column:
        """Whether the value may be kept for restoring it."""
        return F.coalesce(F.try_element_at(self._lookup(lambda e: e.store), canonical_label(label)), F.lit(False))


def canonical_label(label: Column) -> Column:
    key = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    aliases = F.create_map(*[F.lit(x) for kv in fixed.ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, key), key)


def route(entities: DataFrame, policy: Policy = Policy(), label_col: str = "label", value_col: str = "value") -> DataFrame:
    """entities with canonical, action, risk, category, store, strategy and rule: a broadcast join with the policy table (tens of rows)."""
    spark = entities.sparkSession
    table = policy.frame(spark).withColumnsRenamed({c: f"_{c}" for c in ("label", "action", "rank", "risk", "category", "store", "overridden")})
    e = entities.withColumn("canonical", canonical_label(F.col(label_col)))
    e = e.join(F.broadcast(table), e["canonical"] == table["_label"], "left")
    is_ip = F.col("canonical").isin(*fixed.IP_LABELS)
    public = V.publicly_routable(F.col(value_col))
    pick = lambda known, keep, redact, unknown: F.when(is_ip, F.when(public, keep).otherwise(redact)).otherwise(F.coalesce(F.col(known), F.lit(unknown)))
    rule = (
        F.when(is_ip, F.when(public, "ip:globally-reachable").otherwise("ip:non-global-or-unparseable"))
        .when(F.col("_label").isNull(), "default:unknown-type")
        .otherwise(F.concat(F.when(F.col("_overridden"), "override:").otherwise("policy:"), F.col("canonical")))
    )
    e = e.withColumns(
        {
            "action": pick("_action", "KEEP", "REDACT", policy.default),
            "risk": pick("_risk", "LOW", "HIGH", "UNKNOWN"),
            "category": pick("_category", "INFRASTRUCTURE", "INFRASTRUCTURE", "UNKNOWN"),
            "store": F.when(is_ip, False).otherwise(F.coalesce(F.col("_store"), F.lit(False))),
            "rule": rule,
        }
    )
    strategy = F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv])
    return e.withColumn("strategy", F.try_element_at(strategy, F.col("action"))).drop(*table.columns)


def should_block(actions: Column) -> Column:
    """Does an array of actions stop its text? One BLOCK is enough."""
    return F.coalesce(F.exists(actions, lambda a: a == "BLOCK"), F.lit(False))


def parse_min_scores(text: str) -> dict[str, float]:
    """{label: score} or {"min_scores": {...}}; critical labels are left out, since they have no floor."""
    found = json.loads(text)
    found = found.get("min_scores", found)
    out = {}
    for label, score in found.items():
        if isinstance(score, bool) or not isinstance(score, (int, float)) or not 0 <= score <= 1:
            raise ValueError(f"{label}: a score from 0 to 1 is needed")
        if canonical(label) not in CRITICAL:
            out[label.upper()] = float(score)
    return out


def contract_differences(local: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Labels whose action differs between two tables (label, action), or that only one has."""
    a, b = local.select("label", F.col("action").alias("local_action")), catalogue.select("label", F.col("action").alias("cloud_action"))
    return a.join(b, "label", "full").where(~F.col("local_action").eqNullSafe(F.col("cloud_action")))


def change_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """(label, old_action, new_action) of two snapshots (label, action): a rename gives two rows."""
    return contract_differences(old, new).withColumnsRenamed({"local_action": "old_action", "cloud_action": "new_action"})


def history(changes: DataFrame, keys: tuple[str, ...] = ("org_id", "label"), at: str = "at", order: str = "change_id") -> DataFrame:
    """The versions of each key's action (keys, version, action, valid_from, valid_to): changes (keys, action, at, an order of those of one
    time) that change nothing make no version. Null times are left out; valid_to is null for the last version."""
    timed = changes.where(F.col(at).isNotNull())
    of_key = W.partitionBy(*keys).orderBy(at, order)
    changed = timed.withColumn("_before", F.lag("action").over(of_key)).withColumn("_n", F.row_number().over(of_key))
    made = changed.where((F.col("_n") == 1) | ~F.col("action").eqNullSafe(F.col("_before")))
    by_time = W.partitionBy(*keys).orderBy("_n")
    return made.select(*keys, F.row_number().over(by_time).alias("version"), "action", F.col(at).alias("valid_from"), F.lead(at).over(by_time).alias("valid_to"))


def _block(at: Column, kind: T.DataType) -> Column:
    """A number that never falls as time goes on, of the time that column holds: its hour, or 3600 units of a number."""
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_micros(at) / 3_600_000_000)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        day = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return day * 24 + F.hour(at) if isinstance(kind, T.TimestampNTZType) else day
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(at), F.lit(2**63 - 1)).otherwise(F.floor(at / 3600))
    return F.floor(at / 3600) if isinstance(kind, T.NumericType) else F.lit(0)


def in_force(events: DataFrame, versions: DataFrame, keys: tuple[str, ...] = ("org_id", "label"), at: str = "ts") -> DataFrame:
    """events with version and action of the policy in force at their time (0 and null before the first one, and at no time). An as-of join:
    events and versions of a key and a block of time are one sorted run, and what a block has to know of those before it, the last version
    made, is one row a block; so each event is read once however many versions there are, and a key with most of the events is many
    tasks' work."""
    own = {x: free_name(events, x) for x in ("block", "here", "near", "before", "is_event")}
    block, here, near, before, is_event = own.values()
    made = versions.where(F.col("valid_from").isNotNull()).dropna(subset=list(keys)).select(*keys, F.col("valid_from").alias(at), F.struct("valid_from", "version", "action").alias(here))
    both = events.withColumn(is_event, F.lit(True)).unionByName(made, allowMissingColumns=True)
    cut = both.withColumn(block, _block(F.col(at), both.schema[at].dataType))
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    befores = cut.groupBy(*keys, block).agg(F.max(here).alias(before)).withColumn(before, F.max(before).over(earlier))
    # those of one time count at it
    upto = W.partitionBy(*keys, block).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    joined = cut.withColumn(near, F.max(here).over(upto)).where(is_event).join(befores, [*keys, block], "left")
    last = F.coalesce(near, before)
    return joined.withColumns({"version": F.coalesce(last["version"], F.lit(0)), "action": last["action"]}).drop(*own.values())


def seeded(existing: DataFrame, spark: SparkSession, org: str) -> DataFrame:
    """An organisation's policies (org_id, label, action, is_default) with the missing defaults added; nothing is overwritten.
    An old SSN row becomes US_SSN with its action, and default rows of address labels go."""
    kept = existing.where(~(F.col("is_default") & F.col("label").isin("IPV4", "IPV6")))
    has = F.max((F.col("label") == "US_SSN").cast("int")).over(_whole_org())
    kept = kept.withColumn("_has", has).where((F.col("label") != "SSN") | (F.col("_has") == 0)).drop("_has")
    kept = kept.withColumn("label", F.when(F.col("label") == "SSN", "US_SSN").otherwise(F.col("label")))
    defaults = Policy().frame(spark).select(F.lit(org).alias("org_id"), "label", "action", F.lit(True).alias("is_default"))
    return kept.unionByName(defaults.join(kept, ["org_id", "label"], "left_anti"))


def _whole_org():
    from pyspark.sql import Window

    return Window.partitionBy("org_id")


#: Terms and domains of a tenant, and what may be done with images.
MAX_TERMS, MAX_DOMAINS, IMAGES = 500, 100, ("default", "block", "warn")
_HOST = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$"


def tenant_configs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Configurations (org_id, deny_terms, tenant_domains, image_policy) as they are kept, and those that are wrong with the reason.
    Terms are trimmed, 2 to 100 printable characters, the first of those that differ only in case; domains are lower case, without
    a leading '*.', each once."""
    terms = F.transform(F.coalesce("deny_terms", F.array().cast("array<string>")), lambda t: F.trim(t))
    domains = F.transform(F.coalesce("tenant_domains", F.array().cast("array<string>")), lambda d: F.ltrim(F.regexp_replace(F.lower(F.trim(d)), r"^\*\.", ""), F.lit(".")))
    good_term = lambda t: F.length(t).between(2, 100) & ~t.rlike(r"[\x00-\x1f\x7f]")
    low = F.transform(terms, F.lower)
    kept = F.filter(terms, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    images = F.coalesce("image_policy", F.lit("default"))
    reason = (
        F.when(F.size(terms) > MAX_TERMS, "too many terms").when(F.size(domains) > MAX_DOMAINS, "too many domains").when(~F.forall(terms, good_term), "term")
        .when(~F.forall(domains, lambda d: d.rlike(_HOST)), "domain").when(~images.isin(*IMAGES), "image_policy")
    )
    told = rows.select("org_id", kept.alias("deny_terms"), F.array_distinct(domains).alias("tenant_domains"), images.alias("image_policy"), reason.alias("reason"))
    return told.where("reason is null").drop("reason"), told.where("reason is not null").select("org_id", "reason")
