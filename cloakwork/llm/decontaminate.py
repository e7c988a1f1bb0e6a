"""Benchmark decontamination: BM25 over test items with block-max WAND, then verified overlap.

Test items are cut into units of at most UNIT words. An inverted index holds the
BM25 weight of each term in each unit, divided by the unit's score for itself,
so that a score is the share of a unit that a passage covers. Units are ordered
by length and dealt to blocks; the index keeps the largest weight of each term
in each block. Number, mean length and document frequencies are those of all
units, counted once with Spark, however the index is cut.

Every document is cut into overlapping passages of PASSAGE words, and every
passage queries the index. Coarse bounds, summed for all passages of a text at
once, and then finer ones of its distinct words, drop those that can reach no
unit. The others go through the postings by WAND: cursors in the order of their next unit, the pivot where their largest
weights add up to the threshold, a check of the pivot's block, and skips to the
pivot or past the block. Every unit above the threshold is retrieved.

A retrieved item is verified in the words around its
passages: the shares of the 5-word runs of its question and of its answer that
occur there. The question of an item is all but its last sentence, the answer
the last one (of a single sentence: the last third of its words).

The index is sent to the tasks in parts of at most INDEX_BYTES of item text,
PARTS of them at a time, so no broadcast grows with the number of items, and
the documents are read once for that many. Parts of a pass are dropped before the next.

Defined results
* One row per (document, item) of verified overlap; nothing for null or empty
  texts and items, and none at all if either table is empty.
* Repeated items and documents give their rows once (by id); an id with several
  texts is found by any of them.
* Items shorter than 5 words must occur whole.
* Columns besides doc_id, item_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import discard, giving_back, no_rows, staged, words

K1, B = 1.2, 0.75
#: A passage is two strides.
UNIT, STRIDE, PASSAGE, THRESHOLD = 64, 32, 64, 0.4
#: Units of a block of postings, and words of a run.
BLOCK, RUN = 8, 5
#: Blocks of the coarse bounds, and cells of the fine ones: these have as many blocks as that allows, at most one a unit.
COARSE, FINE_CELLS = 128, 16 << 20
QUESTION, ANSWER, QUESTION_ALONE = 0.6, 0.6, 0.8
INDEX_BYTES, PARTS = 16 << 20, 4
#: Scores this far below the threshold are still compared one by one: sums in another order differ by less.
SLACK = 1e-6
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def question_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for s in SENTENCE_END.split(text) if (w := words(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    return only[: len(only) - len(only) // 3], only[len(only) - len(only) // 3 :]


def overlap(part: list[str], around: list[str]) -> float:
    """Share of the runs of RUN words of part (all of it, if shorter) that occur in around; an empty part counts as present."""
    if not part:
        return 1.0
    n = min(RUN, len(part))
    there = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
    runs = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(r in there for r in runs) / len(runs)


def units_of(text: str) -> list[list[str]]:
    """The words of an item, question and answer, in overlapping units."""
    q, a = question_answer(text)
    w = q + a
    return [w[k : k + UNIT] for k in range(0, max(1, len(w) - UNIT // 2), UNIT // 2)] if w else []


@dataclass
class Entry:
    """An item's text, and in how many units of all items each of its words is."""

    item: int
    text: str
    df: dict[str, int]


class ItemIndex:
    """The index of some entries; n_units and mean_length are those of all."""

    def __init__(self, entries: list[Entry], n_units: int, mean_length: float):
        self.item = [e.item for e in entries]
        self.parsed = [question_answer(e.text) for e in entries]
        units = [(k, w) for k, e in enumerate(entries) for w in units_of(e.text)]
        units.sort(key=lambda u: (len(u[1]), u[0]))
        self.unit_entry = [k for k, _ in units]
        self.row: dict[str, int] = {}
        found: list[tuple[int, int, float]] = []
        for u, (k, w) in enumerate(units):
            df = entries[k].df
            weight = {
                t: math.log(1 + (n_units - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean_length))
                for t, n in sorted(Counter(w).items())
            }
            own = sum(weight.values())
            found += [(self.row.setdefault(t, len(self.row)), u, x / own) for t, x in weight.items()]
        found.sort()
        #: postings of row r: first[r] to first[r + 1]
        self.unit, self.weight = array("i", [u for _, u, _ in found]), array("d", [x for _, _, x in found])
        counts = np.bincount([r for r, _, _ in found], minlength=len(self.row)) if found else np.zeros(0, np.int64)
        self.first = array("q", [0, *np.cumsum(counts).tolist()])
        self.most = [0.0] * len(self.row)
        self.block_most: dict[tuple[int, int], float] = {}
        size = max(1, -(-len(units) // max(COARSE, FINE_CELLS // (len(self.row) + 1))))
        self.fine = np.zeros((max(1, len(self.row)), max(1, -(-len(units) // size))), dtype=np.float32)
        for r, u, x in found:
            self.most[r] = max(self.most[r], x)
            self.block_most[r, u // BLOCK] = max(self.block_most.get((r, u // BLOCK), 0.0), x)
            self.fine[r, u // size] = max(self.fine[r, u // size], x)
        self.bounds = np.maximum.reduceat(self.fine, np.arange(0, self.fine.shape[1], -(-self.fine.shape[1] // COARSE)), axis=1)

    def wand(self, rows: list[int], threshold: float) -> list[tuple[int, float]]:
        """(unit, score) of the units that the terms in rows (each once) cover by the threshold."""
        unit, weight, most, block_most = self.unit, self.weight, self.most, self.block_most
        least = threshold - SLACK
        # [next unit, term, place of its posting, end of its postings]
        cursors = [[unit[self.first[r]], r, self.first[r], self.first[r + 1]] for r in sorted(rows)]
        out = []

        def advance(c: list[int], to: int) -> None:
            c[2] = bisect_left(unit, to, c[2], c[3])
            c[0] = unit[c[2]] if c[2] < c[3] else -1

        while True:
            cursors = sorted(c for c in cursors if c[0] >= 0)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += most[c[1]]
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                return out
            u = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == u:
                pivot += 1
            block = u // BLOCK
            if sum(block_most.get((c[1], block), 0.0) for c in cursors[: pivot + 1]) < least:
                # no unit of this block up to the next cursor's can do
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, max(cursors[pivot + 1][0], u + 1))
                for c in cursors[: pivot + 1]:
                    if c[0] < to:
                        advance(c, to)
                continue
            if cursors[0][0] == u:
                here = [c for c in cursors[: pivot + 1] if c[0] == u]
                score = sum(weight[c[2]] for c in sorted(here, key=lambda c: c[1]))
                if score >= threshold:
                    out.append((u, score))
                for c in here:
                    advance(c, u + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < u:
                        advance(c, u)

    def retrieve(self, w: list[str], threshold: float = THRESHOLD) -> dict[int, list[tuple[float, int]]]:
        """entry -> (score, start) of the passages of the words w that retrieve one of its units."""
        size = len(self.row)
        rows = np.fromiter(map(self.row.get, w, repeat(-1)), dtype=np.int64, count=len(w))
        found: dict[int, list[tuple[float, int]]] = {}
        known = np.flatnonzero(rows >= 0)
        n_strides = -(-len(w) // STRIDE)
        n_passages = max(1, n_strides - 1)
        for lo in range(0, n_passages if len(known) else 0, 1024):  # a long document in pieces, each with the words that its last passage needs
            n = min(1024, n_passages - lo)
            some = known[np.searchsorted(known, lo * STRIDE) : np.searchsorted(known, (lo + n + 1) * STRIDE)]
            # the words of each stride, once each
            stride, row = np.divmod(np.unique((some // STRIDE - lo) * size + rows[some]), size)
            if not len(stride):
                continue
            first = np.flatnonzero(np.append(True, stride[1:] != stride[:-1]))
            sums = np.zeros((n + 1, self.bounds.shape[1]))
            sums[stride[first]] = np.add.reduceat(self.bounds[row], first, axis=0)
            near = np.flatnonzero(((sums[:-1] + sums[1:]) >= threshold - SLACK).any(axis=1))
            ends = np.searchsorted(stride, np.append(near, near + 2))
            for p, i, j in zip(near.tolist(), ends[: len(near)].tolist(), ends[len(near) :].tolist()):
                # a word of both strides counts once: a tighter bound, of the passages that are left
                distinct = np.unique(row[i:j])
                if (self.fine[distinct].sum(axis=0) >= threshold - SLACK).any():
                    for u, x in self.wand(distinct.tolist(), threshold):
                        found.setdefault(self.unit_entry[u], []).append((x, (lo + p) * STRIDE))
        return found

    def check(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of the entries that the text holds."""
        w = words(text)
        out = []
        for k, hits in self.retrieve(w).items():
            question, answer = self.parsed[k]
            room = len(question) + len(answer)
            around: list[str] = []
            end = 0
            for _, s in sorted(hits, key=lambda h: h[1]):
                around += w[max(end, s - room, 0) : s + PASSAGE + room]
                end = max(end, s + PASSAGE + room)
            q, a = overlap(question, around), overlap(answer, around)
            if (q >= QUESTION and a >= ANSWER) or (q >= QUESTION_ALONE and question):
                out.append((self.item[k], max(x for x, _ in hits), q, a))
        return sorted(out)


def _unit_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(i, text, k, len(w), t) for i, text in zip(pdf["item_id"], pdf["text"]) for k, w in enumerate(units_of(text)) for t in sorted(set(w))]
        yield pd.DataFrame(out, columns=["item_id", "text", "k", "length", "term"])


def index_parts(items: DataFrame, most: int = INDEX_BYTES) -> Iterator[ItemIndex]:
    """Indexes of at most `most` bytes of item text each (one item at least), with the statistics of all items."""
    texts = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and length(text) > 0").distinct()
    terms = staged(texts.mapInPandas(_unit_terms, "item_id long, text string, k int, length int, term string"), "units")
    n, mean = terms.select("item_id", "text", "k", "length").distinct().agg(F.count("*"), F.avg("length")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    # an item's own words, at most as many as it has
    known = terms.select("item_id", "text", "term").distinct().join(df, "term").groupBy("item_id", "text").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    part, size = [], 0
    for r in known.orderBy("item_id", "text").toLocalIterator():
        if part and size + len(r["text"]) * 4 > most:
            yield ItemIndex(part, n, mean)
            part, size = [], 0
        part.append(Entry(r["item_id"], r["text"], r["df"]))
        size += len(r["text"]) * 4
    if part:
        yield ItemIndex(part, n, mean)
    discard(terms)


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contamination(docs: DataFrame, items: DataFrame, most: int = INDEX_BYTES, parts: int = PARTS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, kind ('item', or 'question' if the answer is missing)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = no_rows(spark, SCHEMA)
    indexes = index_parts(items, most)
    while some := list(islice(indexes, parts)):
        sent = [spark.sparkContext.broadcast(x) for x in some]

        @giving_back
        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"]) for part in sent for x in part.value.check(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(staged(texts.mapInPandas(run, SCHEMA), "hits"))
        for b in sent:
            b.destroy()
    best = out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))
    return best.withColumn("kind", F.when(F.col("answer_overlap") >= ANSWER, "item").otherwise("question"))
