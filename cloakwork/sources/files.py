"""Files as segments: type detection, text decoding, CSV cells, office packages.

A file is a row of the binaryFile source (path, content). Its text becomes
segments (path, key, text, context); office files are opened inside the tasks,
one file at a time.
"""

from __future__ import annotations

import codecs
import contextlib
import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.residual import residual_scan

SEGMENT = "path string, key string, text string, context string"
MAX_HEADER, MAX_PART = 80, 50_000_000
#: Names that claim a binary format, and names of texts.
BINARY_EXTENSIONS, TEXT_EXTENSIONS = "pdf docx xlsx".split(), "txt md csv log py js json tsv".split()
#: Byte order marks and their encodings, and the encodings tried where there is none.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
UNMARKED = ("utf-8", "cp1252", "latin-1")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def frozen(files: DataFrame, digests: DataFrame) -> DataFrame:
    """files whose SHA-256 is the listed one (path, sha256); any other stops the job."""
    j = files.join(digests, "path", "left")
    same = F.sha2("content", 256).eqNullSafe(F.lower("sha256"))
    return j.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("not the frozen file: "), F.col("path"))).cast("boolean"))).drop("sha256")


def file_type(content: Column, path: Column) -> Column:
    """pdf, docx, xlsx, image, text or unknown, by content; a binary extension on other content is unknown. Texts have a byte order
    mark, or no NUL and a text's extension, or are UTF-8 as far as a sample goes."""
    head = F.hex(F.substring(content, 1, 12))
    # names of a package's parts stand in its bytes as they are
    names = F.decode(content, "ISO-8859-1")
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    start = F.substring(content, 1, 4096)
    # a character that is cut at the end of the sample isn't an error
    utf8 = F.exists(F.array(*[F.lit(i) for i in range(4)]), lambda i: ((i == 0) | (F.length(content) > 4096)) & F.is_valid_utf8(F.substring(start, F.lit(1), F.greatest(F.length(start) - i, F.lit(0))).cast("string")))
    package = F.when(names.contains("word/document.xml"), "docx").when(names.contains("xl/workbook.xml"), "xlsx").otherwise("unknown")
    image = head.rlike("^(89504E470D0A1A0A|FFD8FF|47494638|424D|49492A00|4D4D002A)") | (head.startswith("52494646") & (ext == "webp"))
    kinds = (
        (head.startswith("25504446"), "pdf"), (head.rlike("^504B(0304|0506)"), package), (head.startswith("D0CF11E0"), "unknown"), (image, "image"), (ext.isin(*BINARY_EXTENSIONS), "unknown"),
        (head.rlike("^(EFBBBF|FFFE|FEFF)"), "text"), (F.decode(start, "ISO-8859-1").contains("\0"), "unknown"), (ext.isin(*TEXT_EXTENSIONS) | utf8, "text"),
    )
    return F.coalesce(*[F.when(test, kind) for test, kind in kinds], F.lit("unknown"))


def decoded(data: bytes) -> tuple[str, str]:
    """A text and its encoding: that of its byte order mark, which must hold, or the first that fits. UnicodeDecodeError if none does."""
    marked = [name for mark, name in MARKS if data.startswith(mark)][:1]
    for name in marked or UNMARKED:
        with contextlib.suppress(UnicodeDecodeError):
            return data.decode(name), name
    raise UnicodeDecodeError(marked[0], data, 0, len(data), "not what its mark says")


def cells(text: str, separator: str = ",") -> list[tuple[int, int, str]]:
    """(row, column, cell) of separated values, quotes understood."""
    return [(r, c, cell) for r, row in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=separator)) for c, cell in enumerate(row)]


def cell_segments(files: DataFrame, separator: str = ",") -> DataFrame:
    """A segment a cell, key 'row:column', with its column's header as context ('Header: ') from the second row on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                header: dict[int, str] = {}
                for r, c, cell in cells(decoded(content)[0], separator):
                    if r == 0:
                        header[c] = cell.strip()[:MAX_HEADER]
                    out.append((path, f"{r}:{c}", cell, f"{header[c]}: " if r and header.get(c) else ""))
            yield pd.DataFrame(out, columns=["path", "key", "text", "context"])

    return files.select("path", "content").mapInPandas(run, SEGMENT)


def with_headers(cells_: DataFrame, file_col: str = "path") -> DataFrame:
    """cells (file, row, col, text) with header: the first row's cell of the column, by a join on (file, column)."""
    top = cells_.where("row = 0").select(file_col, "col", F.substring(F.trim("text"), 1, MAX_HEADER).alias("header"))
    return cells_.join(top, [file_col, "col"], "left").withColumn("context", F.when((F.col("row") > 0) & (F.col("header") != ""), F.concat("header", F.lit(": "))).otherwise(""))


def package_parts(files: DataFrame) -> DataFrame:
    """(path, part, size, text) of a package's parts; those that aren't text, or are over MAX_PART, have null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                if not zipfile.is_zipfile(io.BytesIO(content)):
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        textual = re.search(r"\.(?:xml|rels|vml|txt|html?)$", i.filename) and i.file_size <= MAX_PART
                        out.append((path, i.filename, i.file_size, z.read(i).decode("utf-8", "replace") if textual else None))
            yield pd.DataFrame(out, columns=["path", "part", "size", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, part string, size long, text string")


#: Parts that can't be looked into, and what they are called.
BLOCKERS = (
    (r"word/embeddings/|xl/embeddings/", "EMBEDDED_OBJECT"), (r"vbaProject\.bin", "MACROS"), (r"(?:word|xl)/charts/", "CHART"), (r"(?:word|xl)/diagrams/", "SMARTART"),
    (r"word/glossary/", "GLOSSARY"), (r"customXml/item", "CUSTOM_XML"), (r"word/comments", "COMMENTS"), (r"word/(?:foot|end)notes", "NOTES"),
)


def blockers(parts: DataFrame, warn_only: tuple[str, ...] = ()) -> DataFrame:
    """path, blockers, warnings (sorted, distinct) from the parts of packages; parts without text block nothing."""
    plain = F.trim(raw_text(F.coalesce("text", F.lit(""))))
    kind = F
    for pattern, name in BLOCKERS:
        kind = kind.when(F.col("part").rlike(pattern) & ((plain != "") | F.lit(name in ("EMBEDDED_OBJECT", "MACROS"))), name)
    kind = F.when(F.col("size") > MAX_PART, "OVERSIZED_PART").otherwise(kind.otherwise(None))
    deleted = F.when(F.col("text").rlike(r"<w:del[ >]"), "TRACKED_DELETION")
    found = parts.select("path", F.explode(F.array_compact(F.array(kind, deleted))).alias("kind"))
    warn = F.col("kind").isin(*warn_only) if warn_only else F.lit(False)
    return found.groupBy("path").agg(
        F.sort_array(F.collect_set(F.when(~warn, F.col("kind")))).alias("blockers"), F.sort_array(F.collect_set(F.when(warn, F.col("kind")))).alias("warnings")
    )


def raw_text(markup: Column) -> Column:
    return F.regexp_replace(markup, "<[^>]+>", " ")


def raw_scan(parts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys and findings: the residual scan of markup without its tags."""
    return parts.select(*keys, F.explode(residual_scan(raw_text(F.coalesce(text_col, F.lit(""))))).alias("f")).select(*keys, "f.*")
