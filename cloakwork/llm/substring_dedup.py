"""Substring dedup by sliding sentence spans.

Spans are every run of RUN consecutive sentences of a document (sentences without
a word apart), and every single sentence of LONG_SENTENCE words: a longer repeated
run is covered by the runs in it, from its first sentence to its last. Spans are
compared by a 128-bit hash of their lower-case words, so blanks and punctuation
don't matter. All documents' spans are grouped by hash; the first one (by doc_id,
then position) stays, and sentences that any other span of a repeated hash covers
are removed. Boundaries of sentences in a run don't matter to its hash but count
in its position.

A document is told by its doc_id and a digest of its text, so rows that share an
id but not a text lose only what each of them repeats.

Defined results
* One row per input row: doc_id, text (what is left), n_sentences, n_removed.
  Sentences keep their blanks; a text without repeats is unchanged.
* Null and empty texts have no sentences; the text left is null or empty.
* Rows of equal doc_id and text are one document, and lose the same sentences.
* Documents without a doc_id come after all others, by digest.
* Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import staged, words
from cloakwork.llm.skew import join_heavy

#: Sentences of a run, and words of a sentence that is a span by itself.
RUN, LONG_SENTENCE = 2, 50
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+(?=\s)\s*|\n\s*|\Z)")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence with the blanks after it; together they are the text."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()]


def spans(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first sentence, last sentence, digest of the words)."""
    if not text:
        return []
    found = [(i, w) for i, (a, b) in enumerate(sentences(text)) if (w := words(text[a:b]))]
    joined = [" ".join(w) for _, w in found]
    out = []
    for x in range(len(found)):
        if len(found[x][1]) >= LONG_SENTENCE:
            out.append((found[x][0], found[x][0], xxhash.xxh3_128_digest(joined[x])))
        if x + RUN <= len(found):
            out.append((found[x][0], found[x + RUN - 1][0], xxhash.xxh3_128_digest(" ".join(joined[x : x + RUN]))))
    return out


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, version (a digest of the text)."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("version"))


def document_spans(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = [spans(t) for t in part.column(1).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = [s for f in found for s in f]
                columns = [pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(2).take(row), *columns], names=["doc_id", "version", "first", "last", "key"])

    return documents(docs).mapInArrow(run, "doc_id long, version binary, first int, last int, key binary")


def place() -> Column:
    """Where a span stands in the order of all: documents without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "first")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, version, cover: the (first, last) sentences of its spans that occur earlier too."""
    found = staged(document_spans(docs), "spans")
    # one row a hash from each task; a document's own rows count once
    heads = found.groupBy("key").agg(F.min(place()).alias("head"), F.max(place()).alias("tail"), F.count("*").alias("n"))
    heads = staged(heads.where("not head <=> tail").select("key", "head", "n"), "heads")
    later = join_heavy(found, heads, "key", "n").where(~place().eqNullSafe(F.col("head")))
    return later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("cover"))


def _left(text: str | None, cover) -> tuple[str | None, int, int]:
    if not text:
        return text, 0, 0
    found = sentences(text)
    gone: set[int] = set()
    for c in cover if cover is not None else ():
        gone.update(range(c["first"], c["last"] + 1))
    kept = "".join(text[a:b] for i, (a, b) in enumerate(found) if i not in gone) if gone else text
    return kept, len(found), len(gone)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, text, n_sentences, n_removed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [_left(t, c) for t, c in zip(pdf["text"], pdf["cover"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [x[0] for x in out], "n_sentences": [x[1] for x in out], "n_removed": [x[2] for x in out]})

    cover = staged(repeats(docs), "cover").withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    same = (F.col("version") == F.col("_version")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = documents(docs).join(cover, same, "left").select("doc_id", "text", "cover")
    return texts.mapInPandas(run, "doc_id long, text string, n_sentences int, n_removed int")
