"""Segments of files (paragraphs, cells, pages): masked by offset, whatever file they came from.

Segments are packed into batches, so that a value that runs over two of them is
found; spans are clipped to the pieces of each segment and off its read-only
context, masked with the conversation's vault, and handed back as edits in the
segment's own offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.operators import mask, merge, scan
from cloakwork.operators.policy import Policy
from cloakwork.operators.recognizers import Config
from cloakwork.operators.tables import exploded, materialised
from cloakwork.operators.texts import clip

SEGMENTS = "array<struct<key:string,text:string,context:string>>"
EDITS = "array<struct<segment:int,start:int,end:int,replacement:string,label:string>>"
#: Characters of a batch, and of a segment's context that are shown to the scan.
BATCH, CONTEXT = 100_000, 200


def split_long(text: str, limit: int = BATCH) -> list[tuple[int, str]]:
    """(offset, piece) of at most limit characters each, cut after the last newline or blank where there is one."""
    out, at = [], 0
    while len(text) - at > limit:
        window = text[at : at + limit]
        cut = max(window.rfind("\n"), window.rfind(" ")) + 1
        size = cut if cut > 1 else limit
        out.append((at, text[at : at + size]))
        at += size
    return [*out, (at, text[at:])] if text[at:] or not out else out


def packed(segments: list[dict], limit: int = BATCH) -> Iterator[tuple[str, list[tuple[int, int, int, int, int]]]]:
    """(text, pieces) of batches: pieces of segments joined by newlines, each (segment, offset in it, start in the batch, size, characters of
    context in front). Blank segments are left out; a batch holds at least one piece."""
    parts: list[str] = []
    pieces: list[tuple[int, int, int, int, int]] = []
    size = 0
    for i, s in enumerate(segments):
        if not (s["text"] or "").strip():
            continue
        for offset, piece in split_long(s["text"], limit):
            context = (s["context"] or "")[:CONTEXT] if offset == 0 else ""
            shown = context + piece
            if parts and size + len(shown) + 1 > limit:
                yield "\n".join(parts), pieces
                parts, pieces, size = [], [], 0
            pieces.append((i, offset, size, len(shown), len(context)))
            parts.append(shown)
            size += len(shown) + 1
    if parts:
        yield "\n".join(parts), pieces


def batches(files: DataFrame, key: str, conv: str, limit: int = BATCH) -> DataFrame:
    """key, conv, batch, text, pieces of files (key, conv, segments)."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = [(k, c, i, *b) for k, c, s in zip(pdf["key"], pdf["conv"], pdf["segments"]) for i, b in enumerate(packed(list(s), limit))]
            yield pd.DataFrame(out, columns=["key", "conv", "batch", "text", "pieces"])

    rows = files.select(F.col(key).cast("string").alias("key"), F.col(conv).cast("string").alias("conv"), F.col("segments").cast(SEGMENTS))
    return rows.mapInPandas(run, "key string, conv string, batch int, text string, pieces array<struct<segment:int,offset:int,start:int,size:int,head:int>>")


def clipped(merged: Column, piece: Column) -> Column:
    """The merged spans inside a piece, in its offsets and off its context."""
    part = lambda m: clip(m["start"], m["end"], piece["start"] + piece["head"], piece["start"] + piece["size"])
    moved = F.transform(merged, lambda m: F.struct(m.alias("m"), part(m).alias("c")))
    inside = F.filter(moved, lambda x: x["c"].isNotNull())
    return F.transform(inside, lambda x: x["m"].withField("start", x["c"]["start"] + piece["head"]).withField("end", x["c"]["end"] + piece["head"]))


def segment_edits(
    files: DataFrame, key: str, conv: str, secret: bytes, policy: Policy = Policy(), config: Config = Config(), limit: int = BATCH, now: Column | None = None, vault: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(key, blocked, edits) of files (key, conv, segments), and the vault with their values. A file of which a span is blocked has no edits."""
    scanned = scan.scan(batches(files, key, conv, limit), config=config)
    found = scanned.withColumn("merged", merge.merge(F.col("text"), F.col("spans"), policy)).drop("spans")
    one = exploded(found, "pieces", "piece", "key", "conv", "batch", "text", "merged")
    pieces = materialised(
        one.select(
            "key", "conv", "piece", F.concat_ws(":", "key", "batch", "piece.start").alias("piece_id"),
            F.substring("text", F.col("piece.start") + 1, F.col("piece.size")).alias("text"), clipped(F.col("merged"), F.col("piece")).alias("merged"),
        ).where(F.size("merged") > 0)
    )
    held = materialised(mask.assign(mask.wanted(pieces, "conv", "text", policy), secret, now=now, vault=vault))
    masked = mask.mask(pieces, "piece_id", "conv", held, policy=policy).join(pieces.select("piece_id", "key", "piece"), "piece_id")
    moved = lambda i, at: i[at] - F.col("piece.head") + F.col("piece.offset")
    edits = F.transform(
        "infos",
        lambda i: F.struct(
            F.col("piece.segment").alias("segment"), moved(i, "start").alias("start"), moved(i, "end").alias("end"),
            F.substring(F.col("masked_text"), i["masked_start"] + 1, i["masked_end"] - i["masked_start"]).alias("replacement"), i["label"].alias("label"),
        ),
    )
    told = masked.select("key", "blocked", edits.alias("edits")).groupBy("key").agg(F.bool_or("blocked").alias("blocked"), F.array_sort(F.flatten(F.collect_list("edits"))).alias("edits"))
    out = files.select(F.col(key).cast("string").alias("key")).join(told, "key", "left")
    none = F.array().cast(EDITS)
    blocked = F.coalesce("blocked", F.lit(False))
    return out.select("key", blocked.alias("blocked"), F.when(blocked, none).otherwise(F.coalesce("edits", none)).cast(EDITS).alias("edits")), held


def applied(segments: Column, edits: Column) -> Column:
    """The texts of segments with their edits."""
    from cloakwork.functions.positions import splice

    return F.transform(segments, lambda s, i: splice(s["text"], F.filter(edits, lambda e: e["segment"] == i)))
