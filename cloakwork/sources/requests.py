"""Requests and conversations as sources: user slots, kinds of request, ids in URLs, multipart bodies, evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = (
    "id string, text string, tags array<string>, spans array<struct<start:int,end:int,label:string,tier:int>>"
)
BODY = (
    "messages array<struct<author:struct<role:string>,content:struct<parts:array<string>,text:string>,metadata:struct<attachments:array<struct<name:string>>>>>,"
    "partial_query struct<content:struct<parts:array<string>>>"
)


def slots(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, slot, text): the user's texts of a chat request: parts of user messages, their single text, the draft, names of
    attachments. A body that can't be understood gives one row with slot 'error', so that the caller can refuse it."""
    b = F.from_json(F.col(body), BODY)
    users = F.filter(b["messages"], lambda m: m["author"]["role"] == "user")
    empty = F.array().cast("array<struct<slot:string,text:string>>")
    part = lambda name: lambda p: F.struct(F.lit(name).alias("slot"), F.coalesce(F.get_json_object(p, "$.text"), p).alias("text"))
    parts = F.flatten(F.transform(users, lambda m: F.coalesce(F.transform(m["content"]["parts"], part("part")), empty)))
    whole = F.filter(F.transform(users, lambda m: F.struct(F.lit("text").alias("slot"), m["content"]["text"].alias("text"))), lambda s: s["text"].isNotNull())
    draft = F.coalesce(F.transform(b["partial_query"]["content"]["parts"], part("draft")), empty)
    names = F.flatten(F.transform(users, lambda m: F.coalesce(F.transform(m["metadata"]["attachments"], lambda a: F.struct(F.lit("attachment").alias("slot"), a["name"].alias("text"))), empty)))
    all_ = F.concat(F.coalesce(parts, empty), F.coalesce(whole, empty), draft, F.coalesce(names, empty))
    error = F.array(F.struct(F.lit("error").alias("slot"), F.lit("unknown shape").alias("text")))
    known = b["messages"].isNotNull() | b["partial_query"].isNotNull()
    return bodies.select(key, F.explode(F.when(known, all_).otherwise(error)).alias("s")).select(key, "s.slot", "s.text")


def user_texts(conversations: DataFrame) -> DataFrame:
    """The user's turns of a table of conversations (conv_id, turn, role, text)."""
    return conversations.where("role = 'user'").select("conv_id", "turn", "text")


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def request_kind(method: Column, url: Column) -> Column:
    """What a request does: send, prepare, file-put, file-chunk, file-reserve, or null for others."""
    path = F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", "")
    host = F.lower(F.coalesce(part(url, "HOST"), F.lit("")))
    comp = F.try_parse_url(url, F.lit("QUERY"), F.lit("comp"))
    post, put = method == "POST", method.isin("PUT", "POST")
    stored = host.endswith(".oaiusercontent.com") | host.endswith(".blob.core.windows.net")
    return (
        F.when(post & path.isin("/backend-api/conversation", "/backend-api/f/conversation"), "send")
        .when(post & (path == "/backend-api/f/conversation/prepare"), "prepare")
        .when(put & stored & comp.isin("blocklist", "properties", "metadata", "lease", "list"), None)
        .when(put & stored & comp.isin("block", "appendblock", "page"), "file-chunk")
        .when(put & stored, "file-put")
        .when(post & path.rlike(r"^/backend-api/files(/upload_reservations|/process_upload_stream)?$"), "file-reserve")
    )


def conversation_of(url: Column) -> Column:
    """The conversation's id in a URL's path; null in a new one."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    app, c = F.regexp_extract(path, "/app/([0-9a-zA-Z_-]+)", 1), F.regexp_extract(path, "/c/([0-9a-zA-Z-]{8,})", 1)
    return F.when(part(url, "HOST") == "gemini.google.com", F.when(app != "", F.concat(F.lit("c_"), app))).otherwise(F.when(c != "", c))


def file_name_parts(name: Column) -> Column:
    """struct<stem, ext>: the part before the last dot and after it."""
    return F.struct(F.regexp_extract(name, r"^(.+?)(?:\.([^.]*))?$", 1).alias("stem"), F.regexp_extract(name, r"^.+\.([^.]*)$", 1).alias("ext"))


def form_parts(bodies: DataFrame, key: str, body: str, boundary: str) -> DataFrame:
    """(key, name, filename, content_type, value) of multipart bodies; body and value are strings in ISO-8859-1, so bytes stay."""
    cut = F.split(F.concat(F.lit("\r\n"), F.col(body)), F.concat(F.lit(r"\r\n--\Q"), F.col(boundary), F.lit(r"\E(?:--)?[ \t]*(?=\r\n|$)")), -1)
    one = bodies.select(key, F.explode(F.filter(F.slice(cut, 2, F.size(cut)), lambda p: p.contains("\r\n\r\n"))).alias("p"))
    head, value = F.substring_index("p", "\r\n\r\n", 1), F.regexp_extract("p", r"(?s)\r\n\r\n(.*)$", 1)
    get = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    return one.select(key, get(r'(?i)[; ]name="([^"]*)"').alias("name"), get(r'(?i)filename="([^"]*)"').alias("filename"), get(r"(?i)content-type:\s*([^\r\n]+)").alias("content_type"), value.alias("value"))


def read_cases(spark: SparkSession, paths: str | list[str], semantic_labels: list[str] = ()) -> DataFrame:
    """Evaluation cases from JSON lines of one or more sets, each with the name of its set as a tag; missing ids are the file's name and a
    number from the text, missing tiers 2 for semantic labels and else 1."""
    raw = spark.read.schema(CASE).json(paths, mode="FAILFAST").withColumn("_file", F.col("_metadata.file_name"))
    tier = lambda s: F.coalesce(s["tier"], F.when(s["label"].isin(*semantic_labels), 2).otherwise(1) if semantic_labels else F.lit(1))
    name = F.regexp_replace("_file", r"\.[^.]*$", "")
    stem = F.concat(name, F.lit("-"), F.substring(F.sha1("text"), 1, 8))
    return raw.select(
        F.coalesce("id", stem).alias("id"), "text", F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.concat(F.lit("set:"), name)))).alias("tags"),
        F.transform(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,tier:int>>")), lambda s: s.withField("tier", tier(s))).alias("gold"),
    )


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """The entities of hand-built prompts, with their numbers as numbers."""
    schema = "prompt_id string, category string, hard_case string, entity_type string, surface string, canonical string, variant string, action string, start int, end int"
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")


def plain_label(label: Column) -> Column:
    """A label as other sets spell it: lower case, blanks for '_' and '-'."""
    return F.lower(F.translate(label, "_-", "  "))


def gold_of(row: Column) -> Column:
    """array<struct<start,end,label>> of a row (a JSON text) of any archived shape: entities, span_labels or privacy_mask, with start, end
    and label or entity_type; span_labels may be arrays [start, end, label]."""
    item = "array<struct<start:int,end:int,label:string,entity_type:string,type:string>>"
    named = F.from_json(row, f"struct<entities:{item},privacy_mask:{item},span_labels:{item}>")
    listed = F.from_json(F.coalesce(F.get_json_object(row, "$.span_labels"), F.get_json_object(row, "$.entities")), "array<array<string>>")
    one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), plain_label(F.coalesce(s["label"], s["entity_type"], s["type"])).alias("label"))
    triple = lambda t: F.struct(F.get(t, 0).try_cast("int").alias("start"), F.get(t, 1).try_cast("int").alias("end"), plain_label(F.get(t, 2)).alias("label"))
    sound = lambda spans: F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["label"].isNotNull())
    some = lambda spans: F.when(F.size(sound(spans)) > 0, sound(spans))
    return F.coalesce(some(F.transform(named["entities"], one)), some(F.transform(named["span_labels"], one)), some(F.transform(named["privacy_mask"], one)), some(F.transform(listed, triple)), F.array().cast("array<struct<start:int,end:int,label:string>>"))


def form_bodies(parts: DataFrame, key: str, boundary: str) -> DataFrame:
    """(key, body) of multipart parts (key, pos, name, filename, content_type, value), in their order: what form_parts() reads back."""
    head = F.concat(
        F.lit('Content-Disposition: form-data; name="'), F.coalesce("name", F.lit("")), F.lit('"'), F.coalesce(F.concat(F.lit('; filename="'), "filename", F.lit('"')), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nContent-Type: "), "content_type"), F.lit("")),
    )
    one = F.concat(F.lit("--"), F.col(boundary), F.lit("\r\n"), head, F.lit("\r\n\r\n"), F.coalesce("value", F.lit("")), F.lit("\r\n"))
    joined = parts.groupBy(key, boundary).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("p")))), lambda x: x["p"]), "").alias("b"))
    return joined.select(key, F.concat("b", F.lit("--"), boundary, F.lit("--\r\n")).alias("body"))


def form_slots(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, slot, text) of form-encoded bodies whose field f.req is nested JSON text: [..., "[[\"text\", ...], ...]"]. A body of another shape
    gives one row with slot 'error'."""
    field = F.regexp_extract(F.col(body), r"(?:^|&)f\.req=([^&]*)", 1)
    outer = F.from_json(F.try_url_decode(field), "array<string>")
    inner = F.from_json(F.get(F.filter(outer, lambda x: x.startswith("[")), 0), "array<string>")
    text = F.get(F.from_json(F.get(inner, 0), "array<string>"), 0)
    return bodies.select(key, F.when(text.isNotNull(), "part").otherwise("error").alias("slot"), F.coalesce(text, F.lit("unknown shape")).alias("text"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')
