"""Registered queries over the given tables, and the SQL that must give the same rows.

SQL engines without lookaround restate a pattern as maximal runs and check the
neighbours by position. Where SQL can't say it, a query has no SQL and tests hold
it against brute force.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions import validators as V
from cloakwork.functions.positions import matches, splice
from cloakwork.operators import audit, bank, detect, evaluate, mask, merge, nearest, policy, residual, scan, segments, texts, vault_store
from cloakwork.operators.describing import quickly
from cloakwork.operators.recognizers import SPANS, Config, registry
from cloakwork.operators.tables import exploded, materialised, shared_dir, spread
from cloakwork.plans import planted
from cloakwork.sources import files, requests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = b"a key for tests: another is given"


def fixed_list(values) -> str:
    """SQL for a list of plain words."""
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = quickly(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, dealt over the cores where they lie in few files: what follows is work on texts."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_spans(pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text", guard: str | None = None) -> str:
    """SQL for (key, start, end, value) of a pattern's matches, by the lengths of matches and gaps, in texts that match the guard."""
    p = _quoted(pattern)
    return f"""
        (SELECT k, s AS "start", s + length(v) AS "end", v AS value FROM (
            SELECT {key} AS k, h[i] AS v,
                   (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::INT AS s
            FROM (SELECT {key}, h, g, unnest(range(1, len(h) + 1)) AS i FROM (
                SELECT {key}, regexp_extract_all({text}, {p}) AS h, string_split_regex({text}, {p}) AS g FROM {source} WHERE regexp_matches({text}, {_quoted(guard or pattern)})))))"""


def span_rows(df: DataFrame, key: str, pattern: str, text: str = "text", group: int = 0) -> DataFrame:
    one = exploded(df, matches(F.col(text), pattern, group), "m", key)
    return one.select(key, "m.start", "m.end", "m.value")


# ---------------------------------------------------------------- positions and validators
DIGITS = sql_spans(r"[0-9]+")
LUHN = "(list_sum(list_transform(range(0, length(value)), lambda i: CASE WHEN i % 2 = 0 THEN substr(value, length(value) - i, 1)::INT ELSE [0,2,4,6,8,1,3,5,7,9][substr(value, length(value) - i, 1)::INT + 1] END)) % 10 = 0)"


@query(f'SELECT k AS doc_id, "start", "end", value FROM {DIGITS} WHERE length(value) BETWEEN 13 AND 19')
def digit_run_spans(spark, d):
    return span_rows(documents(spark, d, "doc_id", "text"), "doc_id", r"(?<![0-9])[0-9]{13,19}(?![0-9])")


@query(f'SELECT k AS doc_id, "start", "end", value, {LUHN} AS luhn FROM {DIGITS} WHERE length(value) BETWEEN 13 AND 19')
def luhn_digit_runs(spark, d):
    return digit_run_spans(spark, d).withColumn("luhn", V.luhn(F.col("value")))


BRAND = """CASE WHEN value[1] = '4' AND n IN (13, 16, 19) THEN 'visa' WHEN n = 16 AND (p2 BETWEEN 51 AND 55 OR p4 BETWEEN 2221 AND 2720) THEN 'mastercard'
    WHEN n = 15 AND p2 IN (34, 37) THEN 'amex' WHEN n BETWEEN 16 AND 19 AND (p4 = 6011 OR p2 = 65 OR p3 BETWEEN 644 AND 649 OR p6 BETWEEN 622126 AND 622925) THEN 'discover'
    WHEN n BETWEEN 14 AND 19 AND (p3 BETWEEN 300 AND 305 OR p3 = 309 OR p2 IN (36, 38, 39)) THEN 'diners' WHEN n BETWEEN 16 AND 19 AND p4 BETWEEN 3528 AND 3589 THEN 'jcb'
    WHEN n BETWEEN 16 AND 19 AND p2 = 62 THEN 'unionpay' END"""


@query(
    f"""SELECT brand, count(*) AS n FROM (SELECT {BRAND} AS brand FROM (SELECT value, length(value) AS n, value[1:2]::INT AS p2, value[1:3]::INT AS p3, value[1:4]::INT AS p4, value[1:6]::INT AS p6
        FROM {DIGITS} WHERE length(value) BETWEEN 13 AND 19)) GROUP BY brand"""
)
def card_brand_counts(spark, d):
    return digit_run_spans(spark, d).groupBy(V.card_brand(F.col("value")).alias("brand")).agg(F.count("*").alias("n"))


IPV4_TOKEN = r"[0-9A-Za-z_.À-ÖØ-öø-ÿ]+"
IPV4_SHAPE = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.?$"
IPV4_SQL = f"""(SELECT k, "start", "start" + length(rtrim(value, '.')) AS "end", rtrim(value, '.') AS value FROM {sql_spans(IPV4_TOKEN, guard=r"[0-9][.][0-9]{1,3}[.][0-9]")} WHERE regexp_matches(value, '{IPV4_SHAPE}'))"""
IPV4_N = "(split_part(value, '.', 1)::BIGINT * 16777216 + split_part(value, '.', 2)::BIGINT * 65536 + split_part(value, '.', 3)::BIGINT * 256 + split_part(value, '.', 4)::BIGINT)"


def _sql_blocks(blocks) -> str:
    parts = []
    for block in blocks:
        base, bits = block.split("/")
        first = sum(int(x) * 256 ** (3 - i) for i, x in enumerate(base.split(".")))
        parts.append(f"n BETWEEN {first} AND {first + 2 ** (32 - int(bits)) - 1}")
    return "(" + " OR ".join(parts) + ")"


@query(f'SELECT k AS doc_id, "start"::INT AS "start", "end"::INT AS "end", value FROM {IPV4_SQL}')
def ipv4_spans(spark, d):
    docs = table(spark, d, "documents")
    return span_rows(docs.where(F.col("text").rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]")), "doc_id", fixed.IPV4)


IPV4_GLOBAL = f"NOT ({_sql_blocks((*V.PRIVATE_BLOCKS, '100.64.0.0/10', '224.0.0.0/4'))} AND NOT {_sql_blocks(V.GLOBAL_EXCEPTIONS)})"


@query(f"SELECT k AS doc_id, value, CASE WHEN {IPV4_GLOBAL} THEN 'KEEP' ELSE 'REDACT' END AS action, CASE WHEN {IPV4_GLOBAL} THEN 'ip:globally-reachable' ELSE 'ip:non-global-or-unparseable' END AS rule FROM (SELECT *, {IPV4_N} AS n FROM {IPV4_SQL})")
def ipv4_routing(spark, d):
    spans = ipv4_spans(spark, d).withColumn("label", F.lit("IP_ADDRESS"))
    return policy.route(spans).select("doc_id", "value", "action", "rule")


EMAIL_TOKEN = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"
EMAIL_SQL = f"""(SELECT k, "start", "end", value FROM {sql_spans(EMAIL_TOKEN)} WHERE length(split_part(value, '@', 1)) <= 64 AND position('..' IN value) = 0 AND value[1] <> '.'
    AND split_part(value, '@', 1)[-1] <> '.' AND lower(regexp_extract(value, '[A-Za-z]+$')) NOT IN ({", ".join(map(_quoted, fixed.FILE_TLDS))}))"""


@query(f'SELECT k AS doc_id, "start", "end", value FROM {EMAIL_SQL}')
def email_spans(spark, d):
    return _label_spans(spark, d, "EMAIL").select("doc_id", "start", "end", "value")


def _label_spans(spark, d, *labels: str, **config) -> DataFrame:
    """Scanned spans of some labels: only their recognizers are in the plan."""
    found = scan.scan(documents(spark, d, "doc_id", "text", "source"), config=Config(enabled_labels=frozenset(labels), **config))
    return scan.explode_spans(found, ["doc_id", "source"])


TOKEN_SQL = sql_spans(r"""(?i)token\s*=\s*"[0-9a-f]{40}\"""")


@query(f"""SELECT k AS doc_id, ("end" - 41)::INT AS "start", ("end" - 1)::INT AS "end", value[-41:-2] AS value FROM {TOKEN_SQL}""")
def secret_kv_spans(spark, d):
    return _spans_of_source(spark, d, "generic_secret_kv").select("doc_id", "start", "end", "value")


def _spans_of_source(spark, d, name: str) -> DataFrame:
    chosen = [r for r in registry() if r.name == name]
    found = scan.scan(documents(spark, d, "doc_id", "text"), recognizers=chosen)
    return scan.explode_spans(found, ["doc_id"])


@query(
    f"""SELECT k AS doc_id, round(-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v)::DOUBLE * log2((length(v) - length(replace(v, c, ''))) / length(v)::DOUBLE))), 6) AS bits
        FROM (SELECT k, value[-41:-2] AS v FROM {TOKEN_SQL})"""
)
def token_entropy(spark, d):
    return _spans_of_source(spark, d, "generic_secret_kv").select("doc_id", F.round(V.entropy(F.col("value")), 6).alias("bits"))


#: The documents' numbers are written one way, which both patterns of uncued phones match; of two equal spans the first source stays.
PHONE_SQL = f"""(SELECT k, "start", "end", value FROM {sql_spans(r"[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}")})"""


@query(f"""SELECT k AS doc_id, "start", "end", 'PHONE_NUMBER' AS label, 0.7::DOUBLE AS score, 'tier1.phone_e164' AS source, value FROM {PHONE_SQL}""")
def phone_spans(spark, d):
    chosen = [r for r in registry(Config(uncued_phones=True)) if r.name.startswith("phone")]
    found = scan.scan(documents(spark, d, "doc_id", "text"), recognizers=chosen)
    return scan.explode_spans(found, ["doc_id"]).select("doc_id", "start", "end", "label", "score", F.col("source"), "value")


CARD_SQL = f"""(SELECT k, "start", "end", value FROM (SELECT *, length(value) AS n, value[1:2]::INT AS p2, value[1:3]::INT AS p3, value[1:4]::INT AS p4, value[1:6]::INT AS p6 FROM {DIGITS}
    WHERE length(value) BETWEEN 13 AND 19) WHERE {LUHN} AND ({BRAND}) IS NOT NULL)"""
#: Addresses that aren't loopback, unspecified, multicast, broadcast or a netmask.
_PARTS = "list_transform(string_split(value, '.'), lambda x: x::INT)"
HOSTS_SQL = f"""(SELECT k, "start", "end", value FROM (SELECT *, {IPV4_N} AS n FROM {IPV4_SQL}) WHERE NOT {_sql_blocks(("127.0.0.0/8", "0.0.0.0/32", "224.0.0.0/4", "255.255.255.255/32"))}
    AND NOT ({_PARTS}[1] = 255 AND list_has_all([0, 128, 192, 224, 240, 248, 252, 254, 255], {_PARTS}) AND {_PARTS} = list_reverse_sort({_PARTS})))"""
#: What the documents hold that a rule finds, by the SQL of each.
SPANS_SQL = "(" + " UNION ALL ".join(
    f"""SELECT k AS doc_id, {start}::INT AS "start", {end}::INT AS "end", '{label}' AS label, {score}::DOUBLE AS score, 'tier1.{source}' AS source, {proof} AS validated, {cue} AS context, {value} AS value FROM {sql}"""
    for sql, label, score, source, proof, cue, start, end, value in (
        (EMAIL_SQL, "EMAIL", 0.99, "email", "NULL::BOOLEAN", "false", '"start"', '"end"', "value"),
        (HOSTS_SQL, "IP_ADDRESS", 0.95, "ipv4", "NULL::BOOLEAN", "false", '"start"', '"end"', "value"),
        (CARD_SQL, "CREDIT_CARD", 0.98, "payment_card", "true", "false", '"start"', '"end"', "value"),
        (PHONE_SQL, "PHONE_NUMBER", 0.7, "phone_e164", "NULL::BOOLEAN", "false", '"start"', '"end"', "value"),
        (TOKEN_SQL, "API_KEY", 0.8, "generic_secret_kv", "NULL::BOOLEAN", "true", '("end" - 41)', '("end" - 1)', "value[-41:-2]"),
    )
) + ")"
#: They don't overlap: merged, each stays, but for those that are kept (public addresses).
MERGED_SQL = f"""(SELECT doc_id, "start", "end", label, CASE WHEN label IN ('EMAIL', 'PHONE_NUMBER') THEN 1 ELSE 2 END::INT AS action, score, (CASE WHEN validated THEN 2 WHEN context THEN 1 ELSE 0 END)::INT AS evidence,
    [source] AS sources, [label] AS labels, value FROM (SELECT *, CASE WHEN label = 'IP_ADDRESS' THEN {IPV4_N} END AS n FROM {SPANS_SQL}) WHERE label <> 'IP_ADDRESS' OR NOT ({IPV4_GLOBAL}))"""


def spliced_sql(edits: str) -> str:
    """SQL for doc_id and text with edits (doc_id, start, end, replacement) of the documents."""
    return f"""(SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN d.text ELSE e.head || substr(d.text, e.last + 1) END AS text FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg(substr(text, before + 1, "start" - before) || replacement, '' ORDER BY "start") AS head, max("end") AS last FROM (
            SELECT e.*, d.text, coalesce(lag(e."end") OVER (PARTITION BY doc_id ORDER BY e."start"), 0) AS before FROM {edits} e JOIN documents d USING (doc_id)) GROUP BY doc_id) e ON e.doc_id = d.doc_id)"""


REDACTED_SQL = f"""(SELECT doc_id, "start", "end", '[REDACTED:' || label || ']' AS replacement FROM {MERGED_SQL})"""


# ---------------------------------------------------------------- values planted by rule
def _planted(spark, d) -> DataFrame:
    """A text a row of events, with a value of one rule or a look-alike in it."""
    return table(spark, d, "events").select("event_id", F.expr(planted.text_sql()).alias("text"))


def _planted_scan(spark, d) -> DataFrame:
    return scan.scan(spread(_planted(spark, d)), config=Config(uncued_phones=True, deny_terms=(planted.TERM,)))


@query(planted.expected_sql())
def planted_spans(spark, d):
    """Every rule on texts that hold its values and look-alikes: all that it finds, and nothing else."""
    found = scan.explode_spans(_planted_scan(spark, d), ["event_id"])
    return found.select("event_id", "start", "end", "label", "source", "score", "value")


def _planted_merged(spark, d) -> DataFrame:
    return _planted_scan(spark, d).withColumn("merged", merge.merge(F.col("text"), F.col("spans")))


@query(planted.masked_sql())
def planted_masked(spark, d):
    """The planted values merged and redacted, and what the policy makes of each label."""
    return _planted_merged(spark, d).select("event_id", mask.redacted(F.col("text"), F.col("merged")).alias("masked_text"), F.transform("merged", lambda m: m["action"]).cast("string").alias("actions"))


@query(planted.restored_sql())
def planted_restored(spark, d):
    """The planted values masked with a vault and restored: what the policy stores comes back, the rest stays redacted."""
    m = materialised(_planted_merged(spark, d).select("event_id", F.concat(F.lit("c"), F.pmod("event_id", F.lit(97))).alias("conv"), "text", "merged"))
    vault = materialised(mask.assign(mask.wanted(m, "conv", "text", policy.Policy()), KEY, now=F.lit(1_700_000_000).cast("long")))
    masked = mask.mask(m, "event_id", "conv", vault)
    back = mask.restore(masked.join(m.select("event_id", "conv"), "event_id"), "event_id", "conv", vault)
    stored = masked.select("event_id", F.size(F.filter("infos", lambda i: i["stored"])).alias("n_stored"))
    return back.join(stored, "event_id").select("event_id", "restored_text", "n_stored")


@query(planted.residual_sql())
def planted_residual(spark, d):
    """What the residual scan finds in the planted texts as they are: all its kinds."""
    return exploded(_planted(spark, d), residual.residual_scan(F.col("text")), "f", "event_id").select("event_id", "f.type", "f.start", "f.end")


# ---------------------------------------------------------------- scan, merge, mask
def _scanned(spark, d) -> DataFrame:
    return scan.scan(documents(spark, d, "doc_id", "source", "text"), config=Config(uncued_phones=True))


def _merged(spark, d) -> DataFrame:
    return _scanned(spark, d).withColumn("merged", merge.merge(F.col("text"), F.col("spans")))


@query(f"SELECT * FROM {SPANS_SQL}")
def all_spans(spark, d):
    """Every recognizer over every document."""
    return scan.explode_spans(_scanned(spark, d).drop("source"), ["doc_id"])


@query(f"SELECT * EXCLUDE (value) FROM {MERGED_SQL}")
def merged_spans(spark, d):
    return exploded(_merged(spark, d), "merged", "m", "doc_id").select("doc_id", "m.*")


@query(f"SELECT doc_id, text AS masked_text FROM {spliced_sql(REDACTED_SQL)}")
def masked_documents(spark, d):
    return _merged(spark, d).select("doc_id", mask.redacted(F.col("text"), F.col("merged")).alias("masked_text"))


@query(f"""SELECT label, action, count(*) AS spans, sum("end" - "start")::BIGINT AS chars, count(*) AS safe FROM {MERGED_SQL} GROUP BY 1, 2""")
def masked_summary(spark, d):
    """Flagship: spans found, merged and masked; per label how many, and what the residual scan still finds."""
    m = _merged(spark, d).withColumn("masked", mask.redacted(F.col("text"), F.col("merged")))
    m = m.withColumn("left", residual.residual_scan(F.col("masked")))
    one = exploded(m, "merged", "m", "doc_id", F.size("left").alias("n_left"))
    return one.groupBy("m.label", "m.action").agg(F.count("*").alias("spans"), F.sum(F.col("m.end") - F.col("m.start")).alias("chars"), F.count_if(F.col("n_left") == 0).alias("safe"))


@query(f"SELECT doc_id, regexp_replace(text, {_quoted(EMAIL_TOKEN)}, '[REDACTED:EMAIL]', 'g') AS masked_text FROM documents")
def masked_emails(spark, d):
    chosen = registry(Config(enabled_labels=frozenset({"EMAIL"})))
    found = scan.scan(documents(spark, d, "doc_id", "text"), recognizers=chosen)
    merged = found.withColumn("merged", merge.merge(F.col("text"), F.col("spans"), snap=False))
    return merged.select("doc_id", mask.redacted(F.col("text"), F.col("merged")).alias("masked_text"))


SPAN_SQL = """SELECT event_id // 40 AS grp, (event_id * 37 % 400)::INT AS "start", (event_id * 37 % 400 + 1 + event_id * 11 % 23)::INT AS "end", 'L' || (event_id % 7) AS label,
    (event_id % 10) / 10.0::DOUBLE AS score, (event_id % 3)::INT AS evidence, 's' || (event_id % 4) AS source, (event_id * 7 % 4)::INT AS action FROM events"""


def _made_spans(spark, d) -> DataFrame:
    e = F.col("event_id")
    start = (e * 37 % 400).cast("int")
    return table(spark, d, "events").select(
        F.floor(e / 40).alias("grp"), start.alias("start"), (start + 1 + (e * 11 % 23)).cast("int").alias("end"), F.concat(F.lit("L"), e % 7).alias("label"),
        ((e % 10) / 10.0).alias("score"), (e % 3).cast("int").alias("evidence"), F.concat(F.lit("s"), e % 4).alias("source"), (e * 7 % 4).cast("int").alias("action"),
    )


@query(
    f"""WITH s AS ({SPAN_SQL}), a AS (SELECT *, max("end") OVER (PARTITION BY grp ORDER BY "start", "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE action > 0),
    b AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY "start", "end" DESC ROWS UNBOUNDED PRECEDING) AS island FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY grp, island ORDER BY action DESC, evidence DESC, "end" - "start" DESC, score DESC, label DESC) AS r FROM b)
    SELECT grp, min("start") AS "start", max("end") AS "end", max(CASE WHEN r = 1 THEN label END) AS label, max(CASE WHEN r = 1 THEN action END) AS action,
           max(CASE WHEN r = 1 THEN evidence END) AS evidence, count(DISTINCT label) AS n_labels, count(DISTINCT source) AS n_sources FROM c GROUP BY grp, island"""
)
def merged_islands(spark, d):
    out = merge.merged_rows(_made_spans(spark, d), "grp")
    return out.select("grp", "start", "end", "label", "action", "evidence", F.size("labels").cast("long").alias("n_labels"), F.size("sources").cast("long").alias("n_sources"))


def _held(spark, d):
    merged = materialised(_merged(spark, d).select("doc_id", F.concat_ws("-", "source", F.pmod("doc_id", F.lit(64))).alias("conv"), "text", "merged"))
    vault = mask.assign(mask.wanted(merged, "conv", "text", policy.Policy()), KEY, now=F.lit(1_700_000_000).cast("long"))
    return merged, materialised(vault)


def _blob(b: bytes) -> str:
    return "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


_INNER, _OUTER = (_blob(bytes(b ^ pad for b in KEY.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
_HEX = "('0x' || substr(h, {}, 6))::BIGINT"
_NAME = "[" + ", ".join(f"'{x.lower()}'" for x in mask.FIRST) + "]"
HELD_SQL = f"""(SELECT doc_id, "start", "end", label, action, value, source || '-' || (doc_id % 64) AS conv_id FROM {MERGED_SQL} JOIN (SELECT doc_id, source FROM documents) USING (doc_id))"""
#: E-mail addresses and phone numbers are what the policy stores of the documents' values.
VAULT_SQL = f"""(SELECT conv_id, label, value, CASE WHEN n = 1 AND base <> value THEN base ELSE base || ' ' || substr(h, 9, 8) END AS fake, idx, {1_700_000_000 + mask.TTL_SECONDS}::DOUBLE AS expires_at FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, base ORDER BY idx) AS n FROM (
        SELECT *, CASE label WHEN 'EMAIL' THEN {_NAME}[({_HEX.format(9)} % {len(mask.FIRST)} + 1)::INT] || '.' || substr(h, 1, 8) || '@masked.example'
               ELSE '+1 555 ' || lpad(({_HEX.format(1)} % 1000)::VARCHAR, 3, '0') || ' ' || lpad(({_HEX.format(7)} % 10000)::VARCHAR, 4, '0') END AS base
        FROM (SELECT *, sha256(conv_id || chr(1) || idx) AS h FROM (
            SELECT DISTINCT conv_id, label, value, sha256({_OUTER} || unhex(sha256({_INNER} || encode(label) || '\x00'::BLOB || encode(value)))) AS idx FROM {HELD_SQL} WHERE action = 1)))))"""


@query(f"SELECT conv_id, label, fake, idx, expires_at FROM {VAULT_SQL}")
def conversation_surrogates(spark, d):
    _, vault = _held(spark, d)
    return vault.select("conv_id", "label", "fake", "idx", "expires_at")


EDITS_SQL = f"""(SELECT doc_id, "start", "end", label, fake IS NOT NULL AS stored, coalesce(fake, '[REDACTED:' || label || ']') AS replacement FROM {HELD_SQL} LEFT JOIN {VAULT_SQL} USING (conv_id, label, value))"""


@query(
    f"""WITH e AS MATERIALIZED (SELECT * FROM {EDITS_SQL}), o AS (SELECT *, "start" + sum(length(replacement) - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start") - (length(replacement) - ("end" - "start")) AS pos FROM e),
    i AS (SELECT doc_id, '[' || string_agg('{{"label":"' || label || '","action":"' || CASE WHEN stored THEN 'FAKER' ELSE 'REDACT' END || '","start":' || "start" || ',"end":' || "end" || ',"masked_start":' || pos::INT || ',"masked_end":' || (pos + length(replacement))::INT
        || ',"stored":' || stored || '}}', ',' ORDER BY "start") || ']' AS infos FROM o GROUP BY 1)
    SELECT t.doc_id, t.text AS masked_text, false AS blocked, coalesce(i.infos, '[]') AS infos FROM {spliced_sql("(SELECT * FROM e)")} t LEFT JOIN i USING (doc_id)"""
)
def masked_with_vault(spark, d):
    merged, vault = _held(spark, d)
    return mask.mask(merged, "doc_id", "conv", vault).withColumn("infos", F.to_json("infos"))


@query(f"""SELECT doc_id, text AS restored_text, n AS n_restored FROM {spliced_sql(f"(SELECT * FROM {REDACTED_SQL} JOIN (SELECT doc_id, label, " + chr(34) + "start" + chr(34) + f" FROM {MERGED_SQL}) USING (doc_id, " + chr(34) + "start" + chr(34) + ") WHERE label NOT IN ('EMAIL', 'PHONE_NUMBER'))")}
    JOIN (SELECT doc_id, count(*) FILTER (label IN ('EMAIL', 'PHONE_NUMBER')) AS n FROM documents LEFT JOIN {MERGED_SQL} USING (doc_id) GROUP BY doc_id) USING (doc_id)""")
def demask_roundtrip(spark, d):
    """Masked texts restored: all that the vault holds comes back, and what isn't stored stays redacted."""
    merged, vault = _held(spark, d)
    masked = mask.mask(merged, "doc_id", "conv", vault).select("doc_id", "masked_text").join(merged.select("doc_id", "conv"), "doc_id")
    return mask.restore(masked, "doc_id", "conv", vault).select("doc_id", "restored_text", F.col("n_restored").cast("long").alias("n_restored"))


@query(f"""
    WITH c AS (SELECT c_custkey AS k, c_name AS name, 'Account ' || c_custkey AS account, {fixed_list(mask.FIRST)}[c_custkey % 16 + 1] AS f, {fixed_list(mask.LAST)}[(c_custkey + 1) % 16 + 1] AS other FROM customer)
    SELECT c.k AS c_custkey, account || ' said so. ' || c.name || ', ' || f || 'son and x' || f || ' met ' || c.name || ' ' || other || ' in ' || t.name || ' Hall 20240101; ' || c.name || '_no ' || c.name || '_no ("' || account || '").' AS restored_text,
           7 AS n_restored FROM c JOIN (SELECT k, name FROM c) t ON t.k = c.k - c.k % 16 + c.k % 8""")
def restored_names(spark, d):
    """Fakes of any shape beside words of their own pools: the longest at a place, whole words only."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("c_custkey", F.lit(n)) + 1).cast("int"))
    c = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_custkey") - F.pmod("c_custkey", F.lit(16))).cast("string").alias("conv"), "c_name", F.concat(F.lit("Account "), F.col("c_custkey").cast("string")).alias("account"), pick(mask.FIRST, 16).alias("f"), pick(mask.LAST, 16).alias("l"), pick(mask.LAST[1:] + mask.LAST[:1], 16).alias("other"), pick(mask.CITY, 8).alias("city"),
    )
    pair = lambda fake, real: F.struct(fake.alias("fake"), real.alias("real"))
    named = pair(F.col("f"), F.col("c_name")), pair(F.concat_ws(" ", "f", "l"), F.col("account")), pair(F.concat(F.col("f"), F.lit("_no")), F.concat(F.col("c_name"), F.lit("_no")))
    towns = F.when(F.pmod("c_custkey", F.lit(16)) < 8, pair(F.col("city"), F.concat(F.col("c_name"), F.lit(" Hall"))))
    vault = exploded(c, F.array(*named, towns), "e", F.col("conv").alias("conv_id")).select("conv_id", "e.fake", "e.real")
    said = F.concat(
        "f", F.lit(" "), "l", F.lit(" said so. "), "f", F.lit(", "), "f", F.lit("son and x"), "f", F.lit(" met "), "f", F.lit(" "), "other", F.lit(" in "), "city", F.lit(" 20240101; "), "f", F.lit("_no "), "f", F.lit('_no ("'), "f", F.lit(" "), "l", F.lit('").')
    )
    return mask.restore(c.select("c_custkey", "conv", said.alias("masked_text")), "c_custkey", "conv", vault).withColumn("n_restored", F.col("n_restored").cast("long"))


@query("""
    WITH e AS (
        SELECT 'c' || c_custkey % 97 AS conv_id, c_name AS real, c_custkey AS k,
               CASE WHEN c_custkey % 5 = 0 THEN 'h' WHEN c_custkey % 3 = 0 THEN 'g' ELSE 'f' END || c_custkey AS fake,
               (CASE WHEN c_custkey % 5 = 0 THEN 9000 WHEN c_custkey % 3 = 0 THEN 5000 ELSE 1000 END + c_custkey)::DOUBLE AS expires_at FROM customer)
    SELECT conv_id, real, fake, expires_at FROM e WHERE expires_at > 1200 AND conv_id <> 'c13'""")
def vault_snapshots(spark, d):
    """A vault in files: three batches, the last under a new index key, then what has expired and a conversation taken out."""
    store = vault_store.VaultStore(spark, f"{shared_dir(spark)}/vault-{uuid.uuid4().hex}", KEY[:32])
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.pmod("c_custkey", F.lit(97)).cast("string")).alias("conv_id"), F.lit("PERSON").alias("label"), F.col("c_name").alias("real"), F.col("c_custkey").alias("k"))

    def batch(rows: DataFrame, letter: str, start: int, key: bytes) -> DataFrame:
        fake, until = F.concat(F.lit(letter), F.col("k").cast("string")), (F.col("k") + start).cast("double")
        return rows.select("conv_id", "label", "real", fake.alias("fake"), mask.index_of(key, F.col("label"), F.col("real")).alias("idx"), until.alias("expires_at"))

    store.merge(batch(c, "f", 1000, KEY))
    store.merge(batch(c.where("k % 3 = 0"), "g", 5000, KEY))
    store.reindexed(KEY[::-1])
    store.merge(batch(c.where("k % 5 = 0"), "h", 9000, KEY[::-1]))
    store.purge(F.lit(1200), ["c13"])
    return store.read().select("conv_id", "real", "fake", "expires_at")


@query(f"SELECT doc_id, string_agg(text, chr(10) ORDER BY k) AS masked_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT doc_id, text FROM {spliced_sql('(SELECT doc_id, ' + chr(34) + 'start' + chr(34) + ', ' + chr(34) + 'end' + chr(34) + ', replacement FROM ' + EDITS_SQL + ')')})) GROUP BY 1")
def masked_lines(spark, d):
    """Each document as a file whose lines are segments: masked in batches, edited line by line."""
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat_ws("-", "source", F.pmod("doc_id", F.lit(64))).alias("conv"), "text"))
    lines = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.cast("string").alias("key"), line.alias("text"), F.lit("").alias("context")))
    files_ = docs.select("path", "conv", lines.alias("segments"))
    edits, _ = segments.segment_edits(files_, "path", "conv", KEY, config=Config(uncued_phones=True), now=F.lit(1_700_000_000).cast("long"))
    done = files_.join(edits.select(F.col("key").alias("path"), "edits"), "path")
    return done.select(F.col("path").cast("long").alias("doc_id"), F.array_join(segments.applied(F.col("segments"), F.col("edits")), "\n").alias("masked_text"))


ISSUER = """((value[1] = '4' AND n IN (13, 16, 19)) OR (n = 16 AND (p2 BETWEEN 51 AND 55 OR p4 BETWEEN 2221 AND 2720)) OR (n = 15 AND p2 IN (34, 37))
    OR (n BETWEEN 16 AND 19 AND (p4 = 6011 OR p2 IN (62, 65) OR p3 BETWEEN 644 AND 649)) OR (n BETWEEN 14 AND 19 AND (p3 BETWEEN 300 AND 305 OR p2 IN (36, 38, 39))) OR (n BETWEEN 16 AND 19 AND p4 BETWEEN 3528 AND 3589))"""
RESIDUAL_CARDS = f"""SELECT k AS doc_id, 'CREDIT_CARD' AS type, "start", "end" FROM (SELECT *, length(value) AS n, value[1:2]::INT AS p2, value[1:3]::INT AS p3, value[1:4]::INT AS p4 FROM {DIGITS}
    WHERE length(value) BETWEEN 13 AND 19) WHERE {LUHN} AND {ISSUER}"""


@query(RESIDUAL_CARDS)
def residual_findings(spark, d):
    """What the residual scan finds in the documents as they are."""
    docs = documents(spark, d, "doc_id", "text")
    return exploded(docs, residual.residual_scan(F.col("text")), "f", "doc_id").select("doc_id", "f.type", "f.start", "f.end")


# ---------------------------------------------------------------- policy
LABELS = [*(r[0] for r in fixed.ROUTING), *fixed.ALIASES, "SOMETHING_NEW"]
ROUTING_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{e}', {str(s).lower()})" for a, b, c, e, s in fixed.ROUTING)
ALIAS_CASE = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.ALIASES.items()) + " ELSE label END"
LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
ROUTED_SQL = f"""(SELECT event_id, c AS canonical, coalesce(action, 'REDACT') AS action, coalesce(risk, 'UNKNOWN') AS risk, coalesce(category, 'UNKNOWN') AS category, coalesce(store, false) AS store,
    CASE WHEN action IS NULL THEN 'default:unknown-type' ELSE 'policy:' || c END AS rule
    FROM (SELECT event_id, {ALIAS_CASE} AS c FROM (SELECT event_id, {LABEL_LIST}[(event_id % {len(LABELS)} + 1)::INT] AS label FROM events)) e
    LEFT JOIN (VALUES {ROUTING_VALUES}) r(label, action, risk, category, store) ON r.label = e.c)"""


def _routed(spark, d, p: policy.Policy = policy.Policy()) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("event_id") % len(LABELS) + 1).cast("int"))
    return policy.route(table(spark, d, "events").select("event_id", label.alias("label"), F.lit(None).cast("string").alias("value")), p)


@query(f"SELECT event_id, canonical, action, risk, category, store, rule FROM {ROUTED_SQL}")
def label_routing(spark, d):
    return _routed(spark, d).select("event_id", "canonical", "action", "risk", "category", "store", "rule")


@query(f"SELECT action, risk, category, count(*) AS n FROM {ROUTED_SQL} GROUP BY ALL")
def routing_risk_summary(spark, d):
    return _routed(spark, d).groupBy("action", "risk", "category").agg(F.count("*").alias("n"))


@query(f"SELECT CASE canonical WHEN 'EMAIL' THEN 'BLOCK' WHEN 'PERSON' THEN 'REDACT' WHEN 'IBAN' THEN 'FAKER' WHEN 'ADDRESS' THEN 'KEEP' ELSE action END AS action, count(*) AS n FROM {ROUTED_SQL} GROUP BY ALL")
def policy_snapshot_apply(spark, d):
    """A snapshot of four changes; every other label is at its default."""
    return _routed(spark, d, policy.Policy.snapshot({"EMAIL": "rejection", "PERSON": "Redaction", "IBAN": "MASK", "ADDRESS": "none"})).groupBy("action").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT user_id::VARCHAR AS label, arg_max(event_type, event_id) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id::VARCHAR AS label, arg_max(event_type, event_id) AS x FROM events WHERE event_id % 3 = 0 GROUP BY 1)
    SELECT coalesce(a.label, b.label) AS label, a.x AS old_action, b.x AS new_action FROM a FULL JOIN b ON a.label = b.label WHERE a.x IS DISTINCT FROM b.x"""
)
def policy_change_log(spark, d):
    e = table(spark, d, "events")
    snap = lambda k: e.where(f"event_id % {k} = 0").groupBy(F.col("user_id").cast("string").alias("label")).agg(F.max_by("event_type", "event_id").alias("action"))
    return policy.change_log(snap(2), snap(3))


# ---------------------------------------------------------------- audit
KINDS = {"error": "fail_closed", "purchase": "mask", "view": "detect", "click": "file", "signup": "demask"}
SHORT = LABELS[:12]
AUDIT_SQL = f"""(SELECT event_id AS id, 'org' || (user_id % 3) AS org_id, user_id AS endpoint, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS event_type,
    'c' || (user_id % 20) AS conversation_id, k % 10 AS entity_count, [{", ".join(f"'{x}'" for x in SHORT)}][k % 12 + 1] AS label, CASE WHEN k % 17 <> 0 THEN floor(value * 10)::INT END AS latency_ms, ts, 'v' || (k % 4) AS version
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events))"""


def audit_events(spark, d) -> DataFrame:
    """The events table as audit events."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    label = F.element_at(F.array(*[F.lit(x) for x in SHORT]), F.col("k") % 12 + 1)
    return table(spark, d, "events").withColumn("k", k).select(
        F.col("event_id").alias("id"), F.concat(F.lit("org"), F.col("user_id") % 3).alias("org_id"), F.col("user_id").alias("endpoint"), kinds[F.col("event_type")].alias("event_type"),
        F.concat(F.lit("c"), F.col("user_id") % 20).alias("conversation_id"), (F.col("k") % 10).alias("entity_count"), F.create_map(label, (F.col("k") % 10).cast("long")).alias("entity_types"),
        F.when(F.col("k") % 17 != 0, F.floor(F.col("value") * 10).cast("int")).alias("latency_ms"), "ts", F.concat(F.lit("v"), F.col("k") % 4).alias("version"),
    )


@query(f"""
    WITH e AS (SELECT id, org_id, label, event_type, ts, ['KEEP', 'REDACT', 'FAKER', 'BLOCK'][id % 4 + 1] AS action FROM {AUDIT_SQL}),
    c AS (SELECT *, lag(action) OVER (PARTITION BY org_id, label ORDER BY ts, id) AS before FROM e WHERE event_type = 'mask'),
    v AS (SELECT *, row_number() OVER (PARTITION BY org_id, label ORDER BY ts, id) AS version FROM c WHERE action IS DISTINCT FROM before)
    SELECT e.id, coalesce(max(v.version), 0)::INT AS version, arg_max(v.action, v.version) AS action
    FROM e LEFT JOIN v ON v.org_id = e.org_id AND v.label = e.label AND v.ts <= e.ts GROUP BY e.id""")
def policy_in_force(spark, d):
    """Each audit event with the version of its organisation's policy for its label at that time."""
    e = audit_events(spark, d).select("id", "org_id", F.map_keys("entity_types")[0].alias("label"), "event_type", "ts")
    word = F.element_at(F.array(*[F.lit(a) for a in ("KEEP", "REDACT", "FAKER", "BLOCK")]), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    changes = e.where("event_type = 'mask'").select("org_id", "label", word.alias("action"), F.col("ts").alias("at"), F.col("id").alias("change_id"))
    return policy.in_force(e, policy.history(changes)).select("id", "version", "action")



@query(f"SELECT event_type, count(*) AS n FROM {AUDIT_SQL} GROUP BY 1")
def audit_by_event_type(spark, d):
    return audit.by_event_type(audit_events(spark, d))


@query(
    f"""SELECT count(*) AS total_events, count(*) FILTER (event_type = 'fail_closed') AS fail_closed_events, (((sum(latency_ms) FILTER (event_type = 'mask')) * 20 + count(latency_ms) FILTER (event_type = 'mask')) // (2 * count(latency_ms) FILTER (event_type = 'mask')))::BIGINT / 10.0::DOUBLE AS avg_latency_ms,
    (sum(entity_count) FILTER (event_type = 'mask'))::BIGINT AS total_entities_masked FROM {AUDIT_SQL}"""
)
def audit_stats(spark, d):
    return audit.stats(audit_events(spark, d))


@query(f"SELECT label AS entity_type, sum(entity_count)::BIGINT AS n FROM {AUDIT_SQL} WHERE event_type = 'mask' GROUP BY 1")
def audit_breakdown_map(spark, d):
    return audit.breakdown(audit_events(spark, d))


@query(f"SELECT label AS entity_type, sum(entity_count)::BIGINT AS n FROM {AUDIT_SQL} WHERE event_type = 'mask' GROUP BY 1 ORDER BY n DESC, entity_type LIMIT 8")
def audit_top8(spark, d):
    return audit.top_entity_types(audit_events(spark, d))


@query(
    f"""WITH e AS (SELECT * FROM {AUDIT_SQL}), b AS (SELECT date_trunc('hour', ts) AS t, count(*) AS events, sum(entity_count)::BIGINT AS entities, count(*) FILTER (event_type = 'mask') AS masks FROM e GROUP BY 1),
    x AS (SELECT unnest(generate_series((SELECT min(date_trunc('hour', ts)) FROM e), (SELECT max(date_trunc('hour', ts)) FROM e), INTERVAL 1 HOUR)) AS t)
    SELECT x.t::TIMESTAMP AS t, coalesce(events, 0) AS events, coalesce(entities, 0) AS entities, coalesce(masks, 0) AS masks FROM x LEFT JOIN b ON b.t = x.t"""
)
def audit_timeseries_zero_filled(spark, d):
    out = audit.timeseries(audit_events(spark, d), F.min("ts"), F.max("ts"))
    return out.select("t", "events", "entities", F.coalesce(F.try_element_at("by_event_type", F.lit("mask")), F.lit(0)).alias("masks"))


@query(
    f"""SELECT event_type, conversation_id, sum(entity_count)::BIGINT AS entity_count, count(DISTINCT label) AS n_labels, coalesce(round_even(avg(latency_ms), 0), -1)::INT AS latency_ms FROM {AUDIT_SQL}
    GROUP BY event_type, conversation_id, CASE WHEN event_type = 'fail_closed' THEN id END"""
)
def audit_preaggregate(spark, d):
    out = audit.preaggregated(audit_events(spark, d))
    return out.select("event_type", "conversation_id", "entity_count", F.cardinality("entity_types").cast("long").alias("n_labels"), F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"))


@query(
    f"""SELECT count(*) FILTER (event_type = 'mask') AS masked, count(*) FILTER (event_type = 'fail_closed') AS held, count(*) FILTER (event_type NOT IN ('mask', 'fail_closed')) AS other,
    count(*) FILTER (event_type = 'file') AS files_masked, (sum(entity_count) FILTER (event_type IN ('mask', 'file')))::BIGINT AS entities_masked FROM {AUDIT_SQL}"""
)
def audit_dashboard(spark, d):
    return audit.dashboard(audit_events(spark, d))


@query(f"SELECT hour(ts)::INT AS hour, count(*) AS n FROM {AUDIT_SQL} WHERE event_type IN ('mask', 'file') GROUP BY 1")
def audit_hourly_bars(spark, d):
    return audit.hourly_bars(audit_events(spark, d))


NOW = "2024-01-30 12:00:00"


@query(f"SELECT id, event_type, ts FROM {AUDIT_SQL} WHERE org_id = 'org1' AND event_type = 'mask' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOURS ORDER BY ts DESC, id LIMIT 100")
def audit_recent(spark, d):
    return audit.recent(audit_events(spark, d), "org1", F.lit(NOW).cast("timestamp_ntz"), 72, "mask").select("id", "event_type", "ts")


@query(f"SELECT endpoint, max(ts) AS last_seen, arg_max(version, ts) AS version, max(ts) < TIMESTAMP '{NOW}' - INTERVAL 300 SECONDS AS stale FROM {AUDIT_SQL} GROUP BY 1")
def endpoint_staleness(spark, d):
    return audit.endpoints(audit_events(spark, d), F.lit(NOW).cast("timestamp_ntz"))


@query(f"SELECT id, count(*) OVER (PARTITION BY conversation_id ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS n_recent FROM {AUDIT_SQL}")
def calls_in_window(spark, d):
    return audit.recent_calls(audit_events(spark, d), "conversation_id").select("id", "n_recent")


@query(
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT conversation_id AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY conversation_id ORDER BY ts) AS n FROM {AUDIT_SQL}),
    r AS (SELECT key, n, t, true AS allowed, [t] AS held FROM c WHERE n = 1 UNION ALL SELECT key, n, t, len(held) < 5, CASE WHEN len(held) < 5 THEN list_append(held, t) ELSE held END
          FROM (SELECT c.key, c.n, c.t, list_filter(r.held, lambda x: x > c.t - 3600) AS held FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1))
    SELECT key, t, allowed FROM r"""
)
def rate_limited_calls(spark, d):
    from cloakwork.streaming.streams import replay_limits

    e = audit_events(spark, d).select(F.col("conversation_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return replay_limits(e, limit=5, seconds=3600)


@query(f"SELECT org_id, event_type, max(id) AS id, arg_max(version, id) AS version FROM {AUDIT_SQL} GROUP BY 1, 2")
def newest_per_org_and_type(spark, d):
    return audit.newest_per_key(audit_events(spark, d).select("org_id", "event_type", "id", "version"), ["org_id", "event_type"])


@query(f"SELECT org_id, count(*) AS n, count(DISTINCT endpoint) AS endpoints FROM {AUDIT_SQL} WHERE org_id = 'org2' GROUP BY 1")
def tenant_isolation(spark, d):
    return audit_events(spark, d).where("org_id = 'org2'").groupBy("org_id").agg(F.count("*").alias("n"), F.count_distinct("endpoint").alias("endpoints"))


@query(f"SELECT event_type, list_sort(list(latency_ms))[least(len(list(latency_ms)), (floor(0.95 * len(list(latency_ms))) + 1)::INT)::INT] AS p95 FROM {AUDIT_SQL} WHERE latency_ms IS NOT NULL GROUP BY 1")
def latency_nearest_rank(spark, d):
    """The value of rank floor(0.95 n), counted and not collected: a type may hold most of the events."""
    return nearest_rank_by(audit_events(spark, d).where("latency_ms is not null"), "event_type", "latency_ms", 0.95, "p95")


def nearest_rank_by(df: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """sorted[min(n - 1, floor(q n))] of each key from the counts of distinct values."""
    from pyspark.sql import Window as W

    counts = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(key)
    ranked = counts.withColumns({"_to": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    rank = F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    return ranked.where((F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank)).select(key, F.col(value).alias(name))


# ---------------------------------------------------------------- evaluation
NUMBER = r"[0-9]+"
GOLD_SQL = f"""(SELECT k, "start", "end", CASE WHEN length(value) >= 13 THEN 'LONG' ELSE 'SHORT' END AS label FROM {DIGITS} WHERE length(value) >= 4)"""
PRED_SQL = f"""(SELECT k, "start", "end", CASE WHEN length(value) >= 16 THEN 'LONG' ELSE 'SHORT' END AS label, length(value) / 20.0::DOUBLE AS score FROM {DIGITS} WHERE length(value) >= 3 AND length(value) <> 5)"""


def _cases(spark, d) -> DataFrame:
    """Gold: digit runs of four or more. Predictions: runs of three or more but five, with another border between labels."""
    docs = documents(spark, d, "doc_id", "source", "text").withColumn("m", matches(F.col("text"), NUMBER))
    n = lambda x: F.length(x["value"])
    gold = F.transform(F.filter("m", lambda x: n(x) >= 4), lambda x: F.struct(x["start"], x["end"], F.when(n(x) >= 13, "LONG").otherwise("SHORT").alias("label"), F.lit(1).alias("tier")))
    preds = F.transform(F.filter("m", lambda x: (n(x) >= 3) & (n(x) != 5)), lambda x: F.struct(x["start"], x["end"], F.when(n(x) >= 16, "LONG").otherwise("SHORT").alias("label"), (n(x) / 20.0).alias("score")))
    return docs.select("doc_id", "text", F.array("source").alias("tags"), gold.alias("gold"), preds.alias("preds"))


STRICT_SQL = f"""(SELECT coalesce(g.label, p.label) AS label, (g.k IS NOT NULL AND p.k IS NOT NULL)::INT AS tp, (g.k IS NULL)::INT AS fp, (p.k IS NULL)::INT AS fn FROM {GOLD_SQL} g FULL JOIN {PRED_SQL} p
    ON g.k = p.k AND g."start" = p."start" AND g."end" = p."end" AND g.label = p.label)"""
PRF = "round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, {n}) AS {p}, round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, {n}) AS {r}, round_even(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, {n}) AS {f}"


@query(f"SELECT label, tp, fp, fn, {PRF.format(n=3, p='strict_p', r='strict_r', f='strict_f1')} FROM (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM {STRICT_SQL} GROUP BY 1)")
def strict_prf_by_label(spark, d):
    return evaluate.per_label(evaluate.scored(_cases(spark, d)))


@query(
    f"""WITH t AS (SELECT 'strict' AS mode, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM {STRICT_SQL}
    UNION ALL SELECT 'overlap', count(*) FILTER (g.label = p.label), count(p.k) - count(*) FILTER (g.label = p.label), count(g.k) - count(*) FILTER (g.label = p.label) FROM {GOLD_SQL} g FULL JOIN {PRED_SQL} p ON g.k = p.k AND g."start" = p."start"
    UNION ALL SELECT 'type_agnostic', count(*) FILTER (g.k = p.k), count(p.k) - count(*) FILTER (g.k = p.k), count(g.k) - count(*) FILTER (g.k = p.k) FROM {GOLD_SQL} g FULL JOIN {PRED_SQL} p ON g.k = p.k AND g."start" = p."start")
    SELECT mode, tp, fp, fn, {PRF.format(n=4, p="precision", r="recall", f="f1")} FROM t"""
)
def prf_totals(spark, d):
    return evaluate.totals(evaluate.scored(_cases(spark, d)))


@query(ORACLES["prf_totals"])
def prf_of_span_rows(spark, d):
    """prf_totals with gold and predictions as tables of spans: matched by islands of spans that meet."""
    m = exploded(documents(spark, d, "doc_id", "text"), matches(F.col("text"), NUMBER), "m", "doc_id")
    n = F.length("m.value")
    rows = lambda keep, border: m.where(keep).select("doc_id", "m.start", "m.end", F.when(n >= border, "LONG").otherwise("SHORT").alias("label"), F.col("m.start").alias("pos"))
    return evaluate.totals_of_spans(rows(n >= 4, 13), rows((n >= 3) & (n != 5), 16), "doc_id")


LEAK_SQL = f"""(SELECT g.k, g.label, g."end" - g."start" AS chars, CASE WHEN p.k IS NULL THEN 0 ELSE g."end" - g."start" END AS hit FROM {GOLD_SQL} g LEFT JOIN {PRED_SQL} p ON g.k = p.k AND g."start" = p."start")"""
LEAK_AGG = "sum(chars)::BIGINT AS gold_chars, sum(hit)::BIGINT AS covered_chars, count(*) AS spans, count(*) FILTER (hit = 0) AS fully_missed, count(*) FILTER (hit > 0 AND hit < chars) AS partial, round_even(sum(hit) / sum(chars)::DOUBLE, 4) AS char_recall"


@query(f"SELECT label, {LEAK_AGG} FROM {LEAK_SQL} GROUP BY 1")
def char_leak_recall(spark, d):
    return evaluate.leak_recall(evaluate.scored(_cases(spark, d)), "label").drop("low", "high")


@query(f"SELECT source AS tag, {LEAK_AGG} FROM {LEAK_SQL} JOIN documents ON k = doc_id GROUP BY 1")
def leak_recall_by_tag(spark, d):
    return evaluate.leak_recall(evaluate.scored(_cases(spark, d)), "tag").drop("low", "high")


@query(
    f"""SELECT source, n, k, round(greatest((k / n::DOUBLE + 3.8416 / (2 * n) - 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 0), 6) AS low,
    round(least((k / n::DOUBLE + 3.8416 / (2 * n) + 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 1), 6) AS high
    FROM (SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '{NUMBER}')) AS k FROM documents GROUP BY 1)"""
)
def wilson_by_source(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(NUMBER)).alias("k"))
    ci = V.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


@query(
    f"""SELECT count(*) AS cases, count(*) FILTER (n > 0) AS cases_with_fp, coalesce(sum(n), 0)::BIGINT AS fp_spans, coalesce(sum(length(text)), 0)::BIGINT AS chars, round_even(count(*) FILTER (n > 0) / count(*)::DOUBLE, 4) AS fp_case_rate
    FROM (SELECT text, (SELECT count(*) FROM {PRED_SQL} p WHERE p.k = doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT k FROM {GOLD_SQL}))"""
)
def benign_fp(spark, d):
    return evaluate.benign(evaluate.scored(_cases(spark, d)))


SWEEP = [round(0.1 * i, 2) for i in range(1, 10)]


@query(
    f"""WITH t AS (SELECT unnest({SWEEP})::DOUBLE AS threshold), x AS (SELECT threshold, count(*) FILTER (g.k = p.k) AS tp, count(p.k) - count(*) FILTER (g.k = p.k) AS fp FROM t JOIN {PRED_SQL} p ON p.score >= threshold LEFT JOIN {GOLD_SQL} g
    ON g.k = p.k AND g."start" = p."start" AND g.label = p.label GROUP BY 1), y AS (SELECT t.threshold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, (SELECT count(*) FROM {GOLD_SQL}) - coalesce(tp, 0) AS fn FROM t LEFT JOIN x USING (threshold))
    SELECT threshold, tp, fp, fn, {PRF.format(n=4, p="precision", r="recall", f="f1")} FROM y"""
)
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(_cases(spark, d), SWEEP)


@query(
    f"""SELECT p.label, count(*) FILTER (g.label = p.label) AS tp, count(*) FILTER (g.label <> p.label) AS nested, count(*) FILTER (false) AS mism, count(*) FILTER (g.k IS NULL) AS fp
    FROM {PRED_SQL} p LEFT JOIN {GOLD_SQL} g ON g.k = p.k AND g."start" = p."start" GROUP BY 1"""
)
def overlap_classes(spark, d):
    return evaluate.overlap_classes(_cases(spark, d))


CUTS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940581)


@query(
    f"""WITH c AS MATERIALIZED (SELECT k, sum(chars) AS chars, sum(hit) AS hit FROM {LEAK_SQL} GROUP BY 1), u AS (SELECT i, chars, hit, ('0x' || substr(md5(k || ':' || i || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c, range(1, 1001) t(i)),
    w AS (SELECT i, chars, hit, {" + ".join(f"(u >= {x})::INT" for x in CUTS)} AS w FROM u), r AS (SELECT i, sum(w * hit) / sum(w * chars)::DOUBLE AS r FROM w GROUP BY 1)
    SELECT quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM r"""
)
def bootstrap_recall(spark, d):
    s = evaluate.scored(_cases(spark, d)).select("doc_id", F.aggregate("leaks", F.lit(0), lambda a, x: a + x["hit"]).alias("hit"), F.aggregate("leaks", F.lit(0), lambda a, x: a + x["chars"]).alias("chars"))
    return evaluate.bootstrap(s.where("chars > 0"), "doc_id", "hit", "chars")


# ---------------------------------------------------------------- texts, requests, pages
@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def user_slot_texts(spark, d):
    return requests.user_texts(table(spark, d, "conversations"))


COUNTS = ", ".join(
    f"len(list_filter([{', '.join(_quoted(s) for s in ss)}], lambda s: contains(low, s))) AS c_{c}" for c, ss in fixed.SIGNALS.items()
)
MOST = "greatest(" + ", ".join(f"c_{c}" for c in fixed.SIGNALS) + ")"
CATEGORY_SQL = f"CASE WHEN {MOST} = 0 THEN 'general' " + " ".join(f"WHEN c_{c} = {MOST} THEN '{c}'" for c in fixed.SIGNALS) + " END"


@query(f"SELECT conv_id, turn, {CATEGORY_SQL} AS category FROM (SELECT conv_id, turn, {COUNTS} FROM (SELECT conv_id, turn, lower(text) AS low FROM conversations))")
def prompt_category(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", texts.prompt_category(F.col("text")).alias("category"))


@query(f"SELECT {CATEGORY_SQL} AS category, count(*) AS n FROM (SELECT {COUNTS} FROM (SELECT lower(text) AS low FROM documents)) GROUP BY 1")
def category_distribution(spark, d):
    return documents(spark, d, "text").groupBy(texts.prompt_category(F.col("text")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def leak_guard_exact(spark, d):
    return texts.leak_guard(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 14 OR (length(b.text) >= 8 AND contains(b.text, ' '))")
def leak_guard_contains(spark, d):
    items = table(spark, d, "benchmark")
    held = texts.holding(table(spark, d, "documents"), texts.values_of(items.select(F.col("text").alias("value"))), "doc_id")
    return held.join(items.select("item_id", F.col("text").alias("value")), "value").select("doc_id", "item_id")


@query("SELECT doc_id, substr(sha1(text), 1, 16) AS key FROM documents")
def text_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", V.text_key(F.col("text")).alias("key"))


WEIGHTS = {"person": 14, "address": 8, "secret": 5, "lookalike": 6, "plain": 3}
_KEPT, _OTHER = texts.alias_table(list(WEIGHTS.values()))
_PART = "('0x' || substr(md5('made:' || c_custkey), {}, 8))::BIGINT"


@query(
    f"""SELECT c_custkey, CASE WHEN b < floor(({_KEPT}::DOUBLE[])[i] * 4294967296::DOUBLE) THEN {list(WEIGHTS)}[i] ELSE {[list(WEIGHTS)[j] for j in _OTHER]}[i] END AS template
    FROM (SELECT c_custkey, ({_PART.format(1)} % {len(WEIGHTS)} + 1)::INT AS i, {_PART.format(9)} AS b FROM customer)"""
)
def weighted_templates(spark, d):
    """A template for each customer, drawn by weight: the same one in every run."""
    return table(spark, d, "customer").select("c_custkey", texts.weighted_choice(F.col("c_custkey"), WEIGHTS, "made").alias("template"))


def windows_sql(size: int, overlap: int, source: str = "documents") -> str:
    """SQL for (doc_id, text, s, e) of texts.windows()."""
    half = size // 2
    end = lambda at: rf"""CASE WHEN {at} + {size} >= length(text) THEN length(text) ELSE {at} + CASE WHEN regexp_matches(substr(text, {at} + {half + 1}, {size - half}), '\s') THEN {half} + length(regexp_extract(substr(text, {at} + {half + 1}, {size - half}), '(?s)^.*\s')) ELSE {size} END END"""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS s, {end(0)} AS e FROM {source} WHERE length(text) > 0
        UNION ALL SELECT doc_id, text, b, {end("b")} FROM (SELECT doc_id, text, greatest(e - {overlap}, s + 1) AS b FROM w WHERE e < length(text)))"""


@query(f'{windows_sql(6000, 200)} SELECT doc_id, s::INT AS "start", e::INT AS "end" FROM w')
def text_windows(spark, d):
    return documents(spark, d, "doc_id", "text").select("doc_id", F.inline(texts.windows(F.col("text"))))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents WHERE contains(text, ' | ')),
    c AS (SELECT doc_id, row, unnest(string_split(line, ' | ')) AS text, generate_subscripts(string_split(line, ' | '), 1) - 1 AS col FROM l)
    SELECT c.doc_id, c.row::INT AS row, c.col::INT AS col, c.text, CASE WHEN c.row > 0 AND h.text IS NOT NULL AND trim(h.text) <> '' THEN substr(trim(h.text), 1, 80) || ': ' ELSE '' END AS context
    FROM c LEFT JOIN c h ON h.doc_id = c.doc_id AND h.col = c.col AND h.row = 0"""
)
def csv_header_context(spark, d):
    lines = table(spark, d, "documents").where(F.col("text").contains(" | ")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    cells = lines.select("doc_id", "row", F.posexplode(F.split("line", r" \| ", -1)).alias("col", "text"))
    return files.with_headers(cells, "doc_id").select("doc_id", "row", "col", "text", "context")


RAW_RUNS = sql_spans("[0-9](?:[ -]?[0-9])*", "(SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages)", "page_id")


#: A run of too many digits is one of groups: each that is long enough counts by itself.
RAW_GROUPS = sql_spans("[0-9]+", f"""(SELECT k || ':' || "start" AS rk, value AS text FROM {RAW_RUNS} WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) > 19)""", "rk")
RAW_CANDIDATES = f"""(SELECT k, "start", "end", regexp_replace(value, '[^0-9]', '', 'g') AS value FROM {RAW_RUNS}
    UNION ALL SELECT split_part(k, ':', 1)::BIGINT, split_part(k, ':', 2)::INT + "start", split_part(k, ':', 2)::INT + "end", value FROM {RAW_GROUPS})"""


@query(
    f"""SELECT k AS page_id, 'CREDIT_CARD' AS type, "start", "end", 'Luhn-valid card survived' AS reason FROM (SELECT *, length(value) AS n, value[1:2]::INT AS p2, value[1:3]::INT AS p3, value[1:4]::INT AS p4 FROM {RAW_CANDIDATES}
        WHERE length(value) BETWEEN 13 AND 19) WHERE {LUHN} AND {ISSUER}"""
)
def html_raw_scan(spark, d):
    return files.raw_scan(table(spark, d, "pages"), ["page_id"], "html")


@query(
    r"""SELECT page_id, nullif(regexp_extract(url, '^https?://([^/?#]*)', 1), '') AS host, nullif(regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/c/([0-9a-zA-Z-]{8,})', 1), '') AS conversation,
    CASE WHEN page_id % 3 = 0 AND regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) IN ('/backend-api/conversation') THEN 'send' END AS kind FROM pages"""
)
def request_class(spark, d):
    p = table(spark, d, "pages")
    method = F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET")
    return p.select("page_id", requests.part(F.col("url"), "HOST").alias("host"), requests.conversation_of(F.col("url")).alias("conversation"), requests.request_kind(method, F.col("url")).alias("kind"))


REID_SQL = """(SELECT q.vec_id AS query_id, q.label, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)"""
RANKED_SQL = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM {REID_SQL})"


@query(f"SELECT query_id, label, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM {RANKED_SQL} WHERE rank <= 3")
def reid_rank(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    out = texts.reidentification(v, q)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT label, count(*) AS n, count(*) FILTER (rank = 1 AND similarity >= 0.5) AS top1, round(avg(similarity), 6) AS mean FROM {RANKED_SQL} WHERE rank <= 3 GROUP BY 1")
def reid_summary(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    best = texts.reidentification(v, q)
    return best.groupBy("label").agg(F.count("*").alias("n"), F.count_if((F.col("rank") == 1) & (F.col("similarity") >= 0.5)).alias("top1"), F.round(F.avg("similarity"), 6).alias("mean"))


@query(
    f"""WITH f AS (SELECT label, arg_min(similarity, rank) >= 0.3 AS survived, min(rank) FILTER (vec_id % 20 = 1) AS own FROM {RANKED_SQL} GROUP BY label, query_id),
    e AS (SELECT unnest([label::VARCHAR, 'overall']) AS label, survived, own AS rank FROM f WHERE own IS NOT NULL)
    SELECT label, count(*) AS n, avg(survived::INT)::DOUBLE AS survival_rate, avg((rank = 1)::INT)::DOUBLE AS top1, avg((rank <= 3)::INT)::DOUBLE AS top3, avg(rank)::DOUBLE AS mean_rank FROM e GROUP BY 1"""
)
def reid_survival(spark, d):
    """For each query the rank of the first vector of its own kind (id % 20 = 1) among all of its label, and whether anything is near at all."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    found = nearest.own_ranks(v.withColumn("own", F.col("vec_id") % 20 == 1), q)
    return texts.reid_summary(found.select(F.col("label").cast("string").alias("label"), (F.col("top") >= 0.3).alias("survived"), "rank"))


# ---------------------------------------------------------------- detectors, classes and callers
NAMES = [("short", "PERSON", 0.9, ["Orre", "Eriner", "Eren"]), ("long", "ORGANIZATION", 0.25, ["Erachtz", "Enststung", "Enmentai"])]


@query(
    " UNION ALL ".join(
        f"""SELECT k AS doc_id, "start", "end", '{label}' AS label, {score}::DOUBLE AS score, value FROM {sql_spans(chr(92) + "b(?:" + "|".join(words) + ")" + chr(92) + "b")}""" for _, label, score, words in NAMES
    )
)
def dictionary_entities(spark, d):
    """The stand-in for a model: words of a dictionary."""
    docs = documents(spark, d, "doc_id", "text")
    found = docs.withColumn("spans", scan.raw_spans(F.col("text"), detect.dictionary(NAMES)))
    return scan.explode_spans(found, ["doc_id"]).select("doc_id", "start", "end", "label", "score", "value")


@query()
def window_entities(spark, d):
    """Long capitalised words as a model would report them for windows of a text; each at its best score wherever the text has it."""
    docs = documents(spark, d, "doc_id", "text")
    pieces = exploded(docs, texts.windows(F.col("text"), 600, 60), "w", "doc_id", "text")
    told = pieces.select("doc_id", F.regexp_extract_all(F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")), F.lit("[A-Z][a-z]{11,}"), F.lit(0)).alias("e"))
    words, n = exploded(told, "e", "entity", "doc_id"), F.length("entity")
    found = words.select("doc_id", F.when(n % 2 == 0, "PERSON").otherwise("ORGANIZATION").alias("label"), "entity", (F.least(n, F.lit(30)) / 30.0).alias("score"))
    return detect.found_everywhere(found, docs, "doc_id")


@query(
    """WITH r AS (SELECT lang, 0.09 * length(text) / 1000 <= least(0.2 + 0.05 * length(text) / 1000, 0.6) AS a, lang = 'en' AS b FROM documents)
    SELECT lang, count(*) AS texts, count(*) FILTER (NOT a OR NOT b) AS degraded, count(*) FILTER (NOT a) AS blocked,
    sum(CASE WHEN a THEN 0 ELSE 1 END + CASE WHEN a OR b THEN 0 ELSE 1 END + CASE WHEN b THEN 0 ELSE 1 END)::BIGINT AS uncovered_labels FROM r GROUP BY 1"""
)
def detector_coverage(spark, d):
    """A critical detector with a budget (labels A and B) beside one for English alone (B and C): what the texts of a language are covered for."""
    text, n = F.col("text"), F.length("text")
    in_time = n * F.lit(0.09) / 1000 <= detect.Budget(0.2, 0.05, 0.6).seconds(n)
    spans = scan.raw_spans(text, [r for r in registry() if r.name == "ipv4"])
    first = detect.report("rules", ["A", "B"], True, spans, text, in_time=in_time)
    second = detect.report("model", ["B", "C"], False, F.array().cast(SPANS), text, available=F.col("lang") == "en")
    c = table(spark, d, "documents").select("lang", "text").withColumn("c", detect.coverage(F.array(first, second)))
    return c.groupBy("lang").agg(F.count("*").alias("texts"), F.count_if("c.degraded").alias("degraded"), F.count_if("c.blocked").alias("blocked"), F.sum(F.size("c.uncovered")).alias("uncovered_labels"))


@query("""SELECT CASE WHEN source LIKE 'src1%' THEN 'PERSON' WHEN source = 'src2' THEN 'LOCATION' WHEN source LIKE 'src%' THEN 'ORGANIZATION' END AS label, count(*) AS n FROM documents GROUP BY 1""")
def model_label_mapping(spark, d):
    """Labels mapped by the first entry that fits, whole or by prefix."""
    label = detect.canonical_of(F.col("source"), {"SRC1*": "person", "src2": "location", "src*": "organization"})
    return table(spark, d, "documents").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query(
    f"""WITH t AS (SELECT k AS doc_id, sum(tp)::BIGINT AS tp, sum(np)::BIGINT - sum(tp)::BIGINT AS fp, sum(ng)::BIGINT - sum(tp)::BIGINT AS fn FROM (
        SELECT coalesce(g.k, p.k) AS k, (g.k IS NOT NULL AND p.k IS NOT NULL AND g.label = p.label)::INT AS tp, (p.k IS NOT NULL)::INT AS np, (g.k IS NOT NULL)::INT AS ng FROM {GOLD_SQL} g FULL JOIN {PRED_SQL} p ON g.k = p.k AND g."start" = p."start") GROUP BY 1),
    u AS (SELECT source, sum(coalesce(tp, 0))::BIGINT AS tp, sum(coalesce(fp, 0))::BIGINT AS fp, sum(coalesce(fn, 0))::BIGINT AS fn FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1)
    SELECT source, tp, fp, fn, {PRF.format(n=4, p="precision", r="recall", f="f1")}, (CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END >= 0.85 AND CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END >= 0.80) AS passed FROM u"""
)
def class_scoring_gate(spark, d):
    """Predictions under names of their own, scored by class: card number and payment card are one."""
    named = lambda spans, long, short: F.transform(spans, lambda s: s.withField("label", F.when(s["label"] == "LONG", long).otherwise(short)))
    cases = _cases(spark, d).withColumns({"gold": named("gold", "CARD_NUMBER", "tax id"), "preds": named("preds", "payment-card", "passport_number"), "source": F.get("tags", 0)})
    return evaluate.class_totals(cases, ["source"])


F1_COLUMNS = ", ".join(f"round_even(count(*) FILTER ({c}) / count(*)::DOUBLE, 4) AS {m}" for m, c in {"SM": "l_quantity < 20", "GL": "l_discount < 0.05", "RX": "l_tax < 0.04", "CMB": "l_quantity < 23"}.items())


@query(f"SELECT *, CASE greatest(SM, GL, RX, CMB) WHEN SM THEN 'SM' WHEN GL THEN 'GL' WHEN RX THEN 'RX' ELSE 'CMB' END AS best, CMB >= greatest(SM, GL, RX) - 0.01 AND CMB > 0 AS starred FROM (SELECT l_suppkey % 50 AS type, {F1_COLUMNS} FROM lineitem GROUP BY 1)")
def best_model_per_type(spark, d):
    share = lambda c: F.bround(F.count_if(c) / F.count("*"), 4)
    q, off, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    f1 = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("type")).agg(share(q < 20).alias("SM"), share(off < 0.05).alias("GL"), share(tax < 0.04).alias("RX"), share(q < 23).alias("CMB"))
    return evaluate.best_model(f1, ["SM", "GL", "RX", "CMB"], "CMB")


@query(f"SELECT count(*) FILTER (event_type = 'mask') AS prompts_masked, (sum(entity_count) FILTER (event_type = 'mask'))::BIGINT AS entities_masked, count(*) FILTER (event_type = 'file') AS files_masked, count(*) FILTER (event_type = 'fail_closed') AS blocks FROM {AUDIT_SQL}")
def activity_counters(spark, d):
    return audit.activity(audit_events(spark, d))


@query(f"SELECT org_id, count(*) AS n FROM {AUDIT_SQL} WHERE endpoint % 4 <> 0 AND org_id = 'org' || (endpoint % 2) GROUP BY 1")
def owned_events(spark, d):
    """Events of endpoints that are registered, in two organisations, for their own."""
    e = audit_events(spark, d)
    register = e.where("endpoint % 4 <> 0").select(F.concat(F.lit("org"), F.col("endpoint") % 2).alias("org_id"), "endpoint")
    return audit.owned(e, register).groupBy("org_id").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS org, count(*) AS calls FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1")
def callers_by_key(spark, d):
    """Calls with a key, joined by its hash with the active keys of organisations."""
    key = lambda c: F.concat(F.lit("key-"), F.col(c).cast("string"))
    register = table(spark, d, "customer").select(F.sha2(key("c_custkey"), 256).alias("key_hash"), (F.col("c_acctbal") >= 0).alias("active"), F.col("c_mktsegment").alias("org"))
    calls = table(spark, d, "orders").select(key("o_custkey").alias("api_key"))
    return audit.callers(calls, register).groupBy("org").agg(F.count("*").alias("calls"))


# ---------------------------------------------------------------- reports, models, vault views and small rules
@query(
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, {x}::DOUBLE AS value FROM (SELECT list_sort(list(ms)) AS l, sum(ms) AS total, sum(chars) AS chars FROM (SELECT latency_ms AS ms, entity_count * 100 AS chars FROM {AUDIT_SQL} WHERE latency_ms IS NOT NULL))"""
        for m, x in (("p50", "l[least(len(l), floor(0.5 * len(l)) + 1)::INT]"), ("p95", "l[least(len(l), floor(0.95 * len(l)) + 1)::INT]"), ("max", "l[len(l)]"), ("ms_per_kb", "round_even(total / (chars / 1000.0), 3)"))
    )
)
def latency_report(spark, d):
    """Latency of the audit events by nearest rank, and for a thousand characters."""
    e = audit_events(spark, d).select(F.col("latency_ms").alias("ms"), (F.col("entity_count") * 100).alias("chars")).where("ms is not null")
    one = evaluate.latency(e)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("x")).select("x.*")


TOTALS_SQL = " UNION ALL ".join(f"SELECT mode AS key, '{m}' AS metric, {m}::DOUBLE AS value FROM t" for m in ("tp", "fp", "fn", "precision", "recall", "f1"))


@query(
    f"""WITH s AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM {STRICT_SQL}), t AS (SELECT 'strict' AS mode, tp, fp, fn, {PRF.format(n=4, p="precision", r="recall", f="f1")} FROM s), x AS ({TOTALS_SQL}),
    l AS (SELECT {LEAK_AGG} FROM {LEAK_SQL})
    SELECT 'mode' AS section, key, metric, value FROM x UNION ALL SELECT 'leak', '', 'gold_chars', gold_chars FROM l UNION ALL SELECT 'leak', '', 'covered_chars', covered_chars FROM l UNION ALL SELECT 'leak', '', 'char_recall', char_recall FROM l
    UNION ALL SELECT 'scope', '', 'out_of_scope_gold_spans', 0"""
)
def evaluation_report(spark, d):
    """Of the assembled report: strict totals, leak recall and what was out of scope."""
    r = evaluate.report(evaluate.scored(_cases(spark, d)))
    return r.where("(section = 'mode' and key = 'strict') or (section = 'leak' and metric in ('gold_chars', 'covered_chars', 'char_recall')) or section = 'scope'")


@query(f"""SELECT g.k AS id, g.label, g."start", substr(text, g."start" + 1, chars) AS text, hit AS covered_chars, chars AS "of" FROM (SELECT g.k, g.label, g."start", g."end" - g."start" AS chars, CASE WHEN p.k IS NULL THEN 0 ELSE g."end" - g."start" END AS hit
    FROM {GOLD_SQL} g LEFT JOIN {PRED_SQL} p ON g.k = p.k AND g."start" = p."start") g JOIN documents ON doc_id = g.k WHERE hit < chars ORDER BY id, "start", label LIMIT 500""")
def report_misses(spark, d):
    """The first missed spans, as the report lists them."""
    misses, _ = evaluate.examples(evaluate.scored(_cases(spark, d)), "doc_id")
    return misses.drop("context")


@query(
    f"""WITH p AS (SELECT *, CASE label WHEN 'LONG' THEN 0.9 ELSE 0.2 END AS floor FROM {PRED_SQL}) SELECT doc_id, count(p.k) AS n FROM documents LEFT JOIN p ON p.k = doc_id AND p.score >= p.floor GROUP BY 1"""
)
def predictions_above_floor(spark, d):
    """Predictions of a table, joined with the texts by their digest, of at least their label's floor ('*' for others)."""
    cases = _cases(spark, d)
    told = cases.select(V.text_key(F.col("text")).alias("key"), "preds").dropDuplicates(["key"])
    joined = evaluate.with_predictions(cases.drop("preds"), told)
    return joined.select("doc_id", F.size(evaluate.above_floor(F.col("preds"), {"LONG": 0.9, "*": 0.2})).cast("long").alias("n"))


@query(
    f"""WITH m AS (SELECT unnest(['half', 'whole']) AS model), p AS (SELECT model, k, "start", label FROM m JOIN {PRED_SQL} ON model = 'whole' OR "start" % 2 = 0), c AS (SELECT model, count(*) FILTER (g.k = p.k) AS tp, count(p.k) AS np FROM p LEFT JOIN {GOLD_SQL} g ON g.k = p.k AND g."start" = p."start" AND g.label = p.label
        WHERE p.label = 'LONG' GROUP BY 1), n AS (SELECT count(*) AS ng FROM {GOLD_SQL} WHERE label = 'LONG')
    SELECT model, round_even(2 * tp / (np + ng)::DOUBLE, 3) AS f1, round_even(2 * tp / (np + ng)::DOUBLE, 3) >= 0.8 AS passes FROM c, n"""
)
def model_kill_test(spark, d):
    """Two models' F1 of a label against the least that is asked."""
    c = _cases(spark, d)
    half = c.withColumn("preds", F.filter("preds", lambda p: p["start"] % 2 == 0))
    both = c.withColumn("model", F.lit("whole")).unionByName(half.withColumn("model", F.lit("half")))
    return evaluate.kill_test(both, "doc_id", "LONG", 0.8).select("model", "f1", "passes")


@query(f"""SELECT conv_id, count(*) + CASE WHEN sum(CASE WHEN label = 'EMAIL' THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS version, count(*) FILTER (label <> 'EMAIL') AS n_live FROM {VAULT_SQL} GROUP BY 1""")
def vault_versions(spark, d):
    """Versions and live entries of conversations of which the e-mail addresses have expired."""
    now = F.lit(1_700_000_000 + mask.TTL_SECONDS).cast("double")
    vault = _held(spark, d)[1].withColumn("expires_at", F.when(F.col("label") == "EMAIL", F.col("expires_at")).otherwise(F.col("expires_at") + 60))
    live = mask.live(vault, now).groupBy("conv_id").agg(F.count("*").alias("n_live"))
    return mask.versions(vault, now).join(live, "conv_id", "left").select("conv_id", "version", F.coalesce("n_live", F.lit(0)).alias("n_live"))


@query(f"""SELECT conv_id, count(*) AS version, conv_id NOT LIKE '%1' AS changed, CASE WHEN conv_id LIKE '%1' THEN 0 ELSE count(*) END::INT AS n_entries FROM {VAULT_SQL} GROUP BY 1""")
def vault_mapping(spark, d):
    """What callers get who have a version already: nothing where it is the present one."""
    vault, now = _held(spark, d)[1], F.lit(1_700_000_000).cast("double")
    asked = mask.versions(vault, now).select("conv_id", F.when(F.col("conv_id").endswith("1"), F.col("version")).alias("since_version"))
    out, _ = mask.mapping(vault, asked, now)
    return out.select("conv_id", "version", "changed", F.size("entries").alias("n_entries"))


@query(f"""SELECT doc_id, count(s.label)::INT AS entities_found, coalesce(array_to_string(list_sort(list(DISTINCT s.label)), ','), '') AS entity_types FROM documents LEFT JOIN {SPANS_SQL} s USING (doc_id) GROUP BY 1""")
def mask_responses(spark, d):
    """What a caller is told of each text: of all that was found, kept values too."""
    return mask.response(_merged(spark, d), "doc_id").select("doc_id", "entities_found", F.array_join("entity_types", ",").alias("entity_types"))


@query(f"""SELECT doc_id, count(v.value)::INT AS n FROM {spliced_sql(REDACTED_SQL)} t LEFT JOIN (SELECT DISTINCT source || '-' || (doc_id % 64) AS conv_id, doc_id FROM documents) c USING (doc_id) LEFT JOIN {VAULT_SQL} v ON v.conv_id = c.conv_id AND contains(t.text, v.value) GROUP BY 1""")
def originals_in_masked(spark, d):
    """Values of a conversation's vault that its redacted texts still have."""
    merged, vault = _held(spark, d)
    entries = vault.groupBy(F.col("conv_id").alias("conv")).agg(F.collect_list(F.struct("fake", "real")).alias("entries"))
    redacted = merged.select("doc_id", "conv", mask.redacted(F.col("text"), F.col("merged")).alias("t")).join(entries, "conv", "left")
    return redacted.select("doc_id", F.coalesce(mask.originals_left(F.col("t"), F.col("entries")), F.lit(0)).alias("n"))


@query(
    f"""SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS ago FROM (SELECT id, (floor((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) / 60000000.0))::BIGINT AS m FROM {AUDIT_SQL})"""
)
def relative_times(spark, d):
    now = F.lit("2024-03-01 00:00:00Z").cast("timestamp")
    return audit_events(spark, d).select("id", audit.relative(audit.utc(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), now).alias("ago"))


@query(
    """SELECT c_mktsegment || (c_custkey % 50) AS org_id, count(DISTINCT lower(c_name)) AS n_terms FROM customer GROUP BY 1"""
)
def tenant_terms(spark, d):
    """Deny terms of tenants, each in two spellings: the first one stays."""
    rows = table(spark, d, "customer").groupBy(F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("org_id")).agg(F.flatten(F.collect_list(F.array(F.concat(F.lit(" "), "c_name"), F.upper("c_name")))).alias("deny_terms"))
    good, _ = policy.tenant_configs(rows.withColumns({"tenant_domains": F.array(F.lit("*.Corp.example.com")), "image_policy": F.lit(None).cast("string")}))
    return good.where(F.get("tenant_domains", 0) == "corp.example.com").select("org_id", F.size("deny_terms").cast("long").alias("n_terms"))


@query(
    """SELECT conv_id, turn, 'Dear ' || text || ', order ' || (conv_id * 7 + turn) || '.' AS text, 5::INT AS s1, (5 + length(text))::INT AS e1, (13 + length(text))::INT AS s2, (13 + length(text) + length((conv_id * 7 + turn)::VARCHAR))::INT AS e2 FROM conversations WHERE length(text) > 0"""
)
def filled_templates(spark, d):
    """Templates filled with values of each row, and where these lie."""
    value = lambda v, label: F.struct(v.alias("value"), F.lit(label).alias("label"), F.lit(1).alias("tier"))
    c = table(spark, d, "conversations").where("length(text) > 0")
    slots = F.create_map(F.lit("who"), value(F.col("text"), "PERSON"), F.lit("no"), value((F.col("conv_id") * 7 + F.col("turn")).cast("string"), "ORDER"))
    made = c.select("conv_id", "turn", texts.filled(F.lit("Dear <<who>>, order <<no>>."), slots).alias("f"))
    span = lambda i: F.get("f.spans", i)
    return made.select("conv_id", "turn", "f.text", span(0)["start"].alias("s1"), span(0)["end"].alias("e1"), span(1)["start"].alias("s2"), span(1)["end"].alias("e2"))


@query(
    """SELECT item_id, n, CASE WHEN n > 8 THEN ceil(n / 6.0) ELSE 1 END::BIGINT AS chunks FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark)"""
)
def entity_chunk_counts(spark, d):
    """Long values cut into even pieces of whole words, which together are the value."""
    b = table(spark, d, "benchmark").withColumn("w", F.split("text", " ", -1)).withColumn("c", texts.entity_chunks(F.col("w")))
    return b.where(F.array_join("c", " ") == F.col("text")).select("item_id", F.size("w").cast("long").alias("n"), F.size("c").cast("long").alias("chunks"))


BANK_DIGITS = f"""(SELECT k, "start", "end", value FROM {sql_spans("[A-Za-z0-9_]+", guard="[23][0-9]{13}")} WHERE regexp_matches(value, '^[23][0-9]{{13}}$'))"""


@query(
    f"""SELECT k AS doc_id, "start", "end", value FROM {BANK_DIGITS} WHERE try_cast((CASE value[1] WHEN '2' THEN '19' ELSE '20' END) || value[2:3] || '-' || value[4:5] || '-' || value[6:7] AS DATE) IS NOT NULL"""
)
def egyptian_id_spans(spark, d):
    """A rule of the archived bank with its check."""
    found = scan.scan(documents(spark, d, "doc_id", "text"), recognizers=bank.bank_rules(frozenset({"EGYPTIAN_NATIONAL_ID"})))
    return scan.explode_spans(found, ["doc_id"]).select("doc_id", "start", "end", "value")


_PLANTED_ID = "(2 + event_id % 2)::VARCHAR || lpad((event_id % 100)::VARCHAR, 2, '0') || lpad((event_id % 14)::VARCHAR, 2, '0') || lpad((event_id % 33)::VARCHAR, 2, '0') || lpad((event_id % 10000000)::VARCHAR, 7, '0')"


@query(
    f"""SELECT event_id, (length(event_id::VARCHAR) + 8)::INT AS "start", (length(event_id::VARCHAR) + 22)::INT AS "end", value FROM (SELECT event_id, {_PLANTED_ID} AS value FROM events)
    WHERE try_cast((CASE value[1] WHEN '2' THEN '19' ELSE '20' END) || value[2:3] || '-' || value[4:5] || '-' || value[6:7] AS DATE) IS NOT NULL"""
)
def planted_egyptian_ids(spark, d):
    """The rule of the archived bank on a number a row of events: those whose date the calendar has, and no other."""
    e = F.col("event_id")
    digits = lambda n, width: F.lpad((e % n).cast("string"), width, "0")
    text = F.concat(e.cast("string"), F.lit(". He is "), (e % 2 + 2).cast("string"), digits(100, 2), digits(14, 2), digits(33, 2), digits(10_000_000, 7), F.lit(", said they"))
    found = scan.scan(spread(table(spark, d, "events").select("event_id", text.alias("text"))), recognizers=bank.bank_rules(frozenset({"EGYPTIAN_NATIONAL_ID"})))
    return scan.explode_spans(found, ["event_id"]).select("event_id", "start", "end", "value")


@query(f"""SELECT event_id, (length({planted.N}::VARCHAR) + 6)::INT AS "start", 'TICKET_ID' AS label FROM events UNION ALL SELECT event_id, (length({planted.N}::VARCHAR) + 18)::INT, 'IP_ADDRESS' FROM events""")
def bank_spans(spark, d):
    """Ticket numbers and hardware addresses by the archived bank."""
    hx = lambda i: F.substring(F.md5(F.col("event_id").cast("string")), i, 2)
    text = F.concat(F.col("event_id").cast("string"), F.lit(". See ABC-"), F.lpad((F.col("event_id") % 1000).cast("string"), 4, "7"), F.lit(" at "), F.lit("0a:"), hx(1), F.lit(":"), hx(3), F.lit(":"), hx(5), F.lit(":"), hx(7), F.lit(":0f now"))
    found = scan.scan(spread(table(spark, d, "events").select("event_id", text.alias("text"))), recognizers=bank.bank_rules(frozenset({"TICKET_ID", "IP_ADDRESS"})))
    return scan.explode_spans(found, ["event_id"]).select("event_id", "start", "label")


@query("SELECT lang, count(*) AS texts, count(*) AS degraded FROM documents GROUP BY 1")
def missing_model_coverage(spark, d):
    """A model that isn't there: every text is degraded, none is lost."""
    docs = detect.model_report(table(spark, d, "documents").select("lang", "text"), detect.Model("none", ("PERSON",)))
    return docs.groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(detect.coverage(F.array("report"))["degraded"]).alias("degraded"))


class Metered:
    """A stand-in for a model that names whole numbers of four digits and more. Its clock is the characters it has read, so that what is done
    in time is the same in every run."""

    def __init__(self):
        self.read = 0

    def load(self):
        return self.told

    def clock(self) -> int:
        return self.read

    def told(self, pieces: list[str], labels: list[str]) -> list[str]:
        self.read += sum(map(len, pieces))
        return [json.dumps({"entities": {"account id": sorted(set(re.findall(r"(?<!\w)[0-9]{4,}(?!\w)", p)))}}) for p in pieces]


LATE_BUDGET = detect.Budget(1500.0, 250.0, 4000.0)


@query(
    f"""{windows_sql(600, 60)}, o AS (SELECT doc_id, s, e, text, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i, coalesce(sum(e - s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
    t AS (SELECT *, before <= least({LATE_BUDGET.base} + n * {LATE_BUDGET.per_kchar} / 1000, {LATE_BUDGET.prompt_cap}) AS done, doc_id * 1000000 + i AS wid, substr(text, s + 1, e - s) AS piece FROM o),
    f AS (SELECT wid // 1000000 AS doc_id, count(DISTINCT (t.s + x."start")) AS n_spans FROM t JOIN {sql_spans(chr(92) + "b[0-9]{4,}" + chr(92) + "b", "t", "wid", "piece")} x ON x.k = wid WHERE done GROUP BY 1),
    c AS (SELECT doc_id, count(*) FILTER (done)::INT AS windows_done, count(*) FILTER (NOT done)::INT AS windows_skipped FROM t GROUP BY 1)
    SELECT d.doc_id, CASE WHEN windows_skipped > 0 THEN 'timeout' ELSE 'ok' END AS status, coalesce(windows_done, 0) AS windows_done, coalesce(windows_skipped, 0) AS windows_skipped, coalesce(n_spans, 0)::INT AS n_spans
    FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)"""
)
def partial_model_scan(spark, d):
    """A model with a budget: the windows done in time and what they hold; the others are counted."""
    meter = Metered()
    model = detect.Model("numbers", ("ACCOUNT_ID",), meter.load, 600, 60, LATE_BUDGET, meter.clock)
    out = detect.model_report(documents(spark, d, "doc_id", "text"), model)
    done = F.size(F.filter("report_windows", lambda w: w["processed"]))
    return out.select("doc_id", "report.status", done.alias("windows_done"), (F.size("report_windows") - done).alias("windows_skipped"), F.size(F.array_distinct(F.transform("report.spans", lambda s: s["start"]))).alias("n_spans"))


@query("SELECT version, count(*) AS endpoints, count(*) FILTER (stale) AS stale FROM (SELECT arg_max(version, ts) AS version, max(ts) < TIMESTAMP '" + NOW + f"' - INTERVAL 300 SECONDS AS stale FROM {AUDIT_SQL} GROUP BY endpoint) GROUP BY 1")
def fleet_versions(spark, d):
    return audit.fleet_versions(audit_events(spark, d), F.lit(NOW).cast("timestamp_ntz"))
