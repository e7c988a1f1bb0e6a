"""Files masked end to end: type, blockers, segments, masking, writing back, scrubbing, and a second look at what was written.

A file is a row (path, content); each step is a table, so files of a folder are
masked side by side, and one that fails keeps its reason instead of an output.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.policy import Policy
from cloakwork.operators.recognizers import Config
from cloakwork.operators.residual import residual_scan
from cloakwork.operators.segments import SEGMENTS, segment_edits
from cloakwork.operators.tables import materialised
from cloakwork.sources import office
from cloakwork.sources.files import blockers, decoded, file_type, package_parts, raw_text

#: Separated values over this size are scanned as one text.
MAX_TABLE = 20_000_000
SEPARATORS = {"csv": ",", "tsv": "\t"}
OFFICE = ("docx", "xlsx")
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, UnicodeDecodeError, KeyError, ValueError, IndexError, AttributeError)


def separator_of(path: str, text: str) -> str | None:
    return SEPARATORS.get(path.rsplit(".", 1)[-1].lower()) if len(text) <= MAX_TABLE else None


def segments_of(path: str, kind: str, content: bytes) -> list[dict]:
    """The segments of a file of a known kind."""
    if kind in OFFICE:
        return [{"key": f[0], "text": office.text_of(f), "context": f[1]} for f in office.package_segments(content)]
    text = decoded(content)[0]
    separator = separator_of(path, text)
    if separator is None:
        return [{"key": "text", "text": text, "context": ""}]
    return [{"key": f"t:{i}", "text": cell, "context": context} for i, cell, context in office.value_segments(text, separator)]


def extracted(files: DataFrame) -> DataFrame:
    """path, kind, error, segments of files (path, kind, content); a file that can't be read has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
                try:
                    out.append((path, kind, None, segments_of(path, kind, content) if kind in (*OFFICE, "text") else []))
                except BROKEN as e:
                    out.append((path, kind, type(e).__name__, []))
            yield pd.DataFrame(out, columns=["path", "kind", "error", "segments"])

    return files.select("path", "kind", "content").mapInPandas(run, f"path string, kind string, error string, segments {SEGMENTS}")


def put_back(path: str, kind: str, content: bytes, edits: list[dict]) -> tuple[bytes | None, list[str], list[str]]:
    """The file with its edits, what keeps it from being sent, and what was taken out of it."""
    own: dict[int, list[tuple[int, int, str]]] = {}
    for e in edits:
        own.setdefault(e["segment"], []).append((e["start"], e["end"], e["replacement"]))
    if kind in OFFICE:
        if kind == "xlsx":
            keys = [f[0] for f in office.package_segments(content)]
            if any(keys[i].startswith("title:") for i in own):
                return None, ["sheet_name_contains_sensitive_data"], []
        clean, removed = office.scrubbed(office.with_edits(content, own))
        return clean, [], removed
    text, encoding = decoded(content)
    separator = separator_of(path, text)
    new = lambda i, t: office.runs_with_edits([t], sorted(own[i]))[0] if i in own else t
    if separator is None:
        masked = new(0, text)
    else:
        tokens, number = office.cells_of(text, separator), iter(range(len(text) + 1))
        masked = "".join(new(next(number), t) if is_cell else t for is_cell, t in tokens)
    # what a legacy encoding can't say becomes '?'
    return masked.encode(encoding, errors="replace"), [], []


def written(files: DataFrame) -> DataFrame:
    """path, kind, output, post_blockers, scrubbed, error of files (path, kind, content, edits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, content, edits in zip(pdf["path"], pdf["kind"], pdf["content"], pdf["edits"]):
                try:
                    out.append((path, kind, *put_back(path, kind, content, list(edits)), None))
                except BROKEN as e:
                    out.append((path, kind, None, [], [], type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "kind", "output", "post_blockers", "scrubbed", "error"])

    schema = "path string, kind string, output binary, post_blockers array<string>, scrubbed array<string>, error string"
    return files.select("path", "kind", "content", "edits").mapInPandas(run, schema)


def leaks_of(files: DataFrame) -> DataFrame:
    """path, leaks: kinds of what a second look at written files (path, kind, content) finds, in their segments and in their raw parts."""
    again = extracted(files)
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "\n")
    seen = again.select("path", F.when(F.col("error").isNotNull(), F.array(F.lit("VERIFY_ERROR"))).otherwise(F.transform(residual_scan(joined), lambda f: f["type"])).alias("found"))
    parts = package_parts(files.where(F.col("kind").isin(*OFFICE)))
    raw = parts.select("path", F.transform(residual_scan(raw_text(F.coalesce("text", F.lit("")))), lambda f: f["type"]).alias("found"))
    return seen.unionByName(raw).groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("leaks"))


def gate(images: str = "default", strict: bool = False) -> Column:
    """What becomes of a file before masking: null if it goes on."""
    has_text = F.exists("segments", lambda s: (F.trim(s["text"]) != "") & ~s["key"].startswith("alt:"))
    image = {"warn": "passed with warning"}.get(images, "blocked: image")
    return (
        F.when(F.col("kind").isin("unknown", "pdf"), F.concat(F.lit("blocked: "), F.col("kind"))).when(F.col("kind") == "image", image).when(F.col("error").isNotNull(), F.concat(F.lit("blocked: parse failed: "), F.col("error")))
        .when(F.size("blockers") > 0, "blocked: uninspected content").when(F.col("has_images") & (~has_text | F.lit(images == "block")), "blocked: images").when(F.col("degraded") & F.lit(strict), "blocked: degraded")
    )


def masked_files(
    files: DataFrame, conv: str, secret: bytes, policy: Policy = Policy(), config: Config = Config(), images: str = "default", strict: bool = False, warn_only: tuple[str, ...] = (), degraded: Column | None = None, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(path, kind, status, output, replacements, blockers, warnings, leaks) of files (path, content, and the column conv), and the vault.

    The output is null but for files masked, and images that the policy lets pass. degraded: was a detector missing for the row's file?
    """
    typed = files.select("path", F.col(conv).cast("string").alias("conv"), "content", F.coalesce(degraded if degraded is not None else F.lit(False), F.lit(True)).alias("degraded")).withColumn("kind", file_type(F.col("content"), F.col("path")))
    parts = materialised(package_parts(typed.where(F.col("kind").isin(*OFFICE))))
    stops = blockers(parts, warn_only)
    media = parts.groupBy("path").agg(F.bool_or(F.col("part").rlike("/media/")).alias("has_images"))
    none = F.array().cast("array<string>")
    found = extracted(typed).join(stops, "path", "left").join(media, "path", "left").join(typed.select("path", "conv", "degraded"), "path")
    found = found.withColumns({"blockers": F.coalesce("blockers", none), "warnings": F.coalesce("warnings", none), "has_images": F.coalesce("has_images", F.lit(False))})
    found = materialised(found.withColumn("status", gate(images, strict)))
    edits, vault = segment_edits(found.where("status is null"), "path", "conv", secret, policy, config, now=now)
    edits = materialised(edits.withColumnRenamed("key", "path"))
    out = materialised(written(typed.join(edits.where("not blocked"), "path")))
    leaks = leaks_of(out.where("output is not null").select("path", "kind", F.col("output").alias("content")))
    told = edits.select("path", "blocked", F.size("edits").alias("replacements"))
    done = found.join(told, "path", "left").join(out.select("path", "output", "post_blockers", "scrubbed", F.col("error").alias("write_error")), "path", "left").join(leaks, "path", "left")
    status = F.coalesce(
        "status", F.when(F.col("blocked"), "blocked: policy"), F.when(F.col("write_error").isNotNull(), F.concat(F.lit("blocked: write failed: "), F.col("write_error"))),
        F.when(F.size("post_blockers") > 0, "blocked: uninspected content"), F.when(F.size("leaks") > 0, "deleted: residual leak"), F.lit("masked"),
    )
    done = done.join(typed.select("path", "content"), "path").withColumn("final", status)
    output = F.when(F.col("final") == "masked", F.col("output")).when(F.col("final") == "passed with warning", F.col("content"))
    warned = F.concat("warnings", F.when(F.col("has_images"), F.array(F.lit("images_not_inspected"))).otherwise(none), F.when(F.col("kind") == "image", F.array(F.lit("image_not_inspected"))).otherwise(none), F.coalesce("scrubbed", none))
    stopped = F.array_distinct(F.concat("blockers", F.coalesce("post_blockers", none)))
    return done.select(
        "path", "kind", F.col("final").alias("status"), output.alias("output"), F.coalesce("replacements", F.lit(0)).alias("replacements"), stopped.alias("blockers"), warned.alias("warnings"), F.coalesce("leaks", none).alias("leaks")
    ), vault
