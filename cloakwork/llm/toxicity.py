"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

fit() takes at most MAX_EXAMPLES labelled rows (those with the least hash of
their id; a documented bound) and indexes every term of their texts, weighed by
its document frequency in the whole corpus; terms whose presence doesn't go with
the label count OTHER of that. Examples lie in blocks of BLOCK, by weight, with the
largest weight of each common term in each block. A query adds up the postings of
its rare terms, bounds every block by these sums and the largest weights of its
common terms, visits blocks from the highest bound down and stops when no bound
exceeds the K-th best cosine: the same neighbours as by brute force. Terms that no example has
count in a text's norm, as terms of one document (which is what most of them are). Votes weighted by
similarity, and PRIOR_WEIGHT votes at the base rate of examples without evidence,
give a raw score; a logistic fit of leave-one-out votes calibrates it.

Defined results
* score is in 0..1 for every row. Null, empty and term-free texts get the base
  rate of examples without any indexed term (0 where there is none).
* Ties of similarity go to the example that comes first by id hash.
* No label at all, or labels of one class only: every score is that class's rate
  (0 without labels).
* Repeated label rows of an id count once (the larger label); labels whose id has
  no document, or a null, are left out. An id with several texts is one example.
* Columns besides those named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import free_name, giving_back, staged, words

MAX_EXAMPLES, BLOCK, K = 4000, 64, 15
#: Least chi-square (one degree of freedom) and examples of a term that goes with the label, and what other terms weigh.
MIN_CHI2, MIN_EXAMPLES, OTHER = 25.0, 3, 0.1
#: A term that one example in DENSE has is common.
DENSE = 4
PRIOR_WEIGHT = 0.5
#: Rows of terms that a worker gathers before it hands them on: a batch of texts has hundreds of times as many terms.
TERM_ROWS = 20_000


class ToxicityIndex:
    """Bounded by MAX_EXAMPLES and their texts, whatever the corpus holds. terms: those of the examples, weigh: their weights.

    Everything but the terms is in arrays, so that the driver holds no object a posting.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: list[str], weigh: np.ndarray, base: float = 0.0):
        self.ids, self.labels = ids, labels  # of the examples, in index order
        self.rows = {t: i for i, t in enumerate(terms)}
        self.weigh = weigh
        self.base, self.slope, self.shift = base, 1.0, 0.0
        self.unseen = 0.0  # what a term weighs that no example has
        self.n_blocks = 0

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the terms that are indexed, and their weights. Together with the terms that no example has they are of length one."""
        rows = self.rows
        found = sorted((rows[t], n) for t, n in tf.items() if t in rows)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        r, n = np.array(found, dtype=np.int64).T
        x = (1 + np.log(n)) * self.weigh[r]
        unseen = np.array([n for t, n in tf.items() if t not in rows], dtype=np.int64)
        y = (1 + np.log(unseen)) * self.unseen
        return r, x / math.sqrt(x @ x + y @ y)

    def build(self, example: np.ndarray, r: np.ndarray, w: np.ndarray) -> None:
        """Of postings (example, row, weight) in the order of examples and rows: rare terms as lists; terms that one example in DENSE has
        as columns of each block, with their largest weights."""
        n = len(self.ids)
        # short texts have the large weights: they share blocks, and don't loosen the bounds of others
        most = np.zeros(n)
        np.maximum.at(most, example, w)
        self.example = np.argsort(-most, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[self.example] = np.arange(n)
        p = place[example]
        self.n_blocks = -(-n // BLOCK)
        df = np.bincount(r, minlength=len(self.rows))
        self.column = np.where(df * DENSE >= n, np.cumsum(df * DENSE >= n) - 1, -1)  # of the common terms
        common = self.column[r] >= 0
        self.dense = np.zeros((self.n_blocks, BLOCK, int(self.column.max(initial=-1)) + 1))
        self.dense[p[common] // BLOCK, p[common] % BLOCK, self.column[r[common]]] = w[common]
        self.most = self.dense.max(axis=1, initial=0.0)
        r, p, w = r[~common], p[~common], w[~common]
        by = np.lexsort((p, r))
        self.place, self.weight = p[by], w[by]
        self.first = np.searchsorted(r[by], np.arange(len(self.rows) + 1))

    def search(self, r: np.ndarray, x: np.ndarray, k: int = K, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, index) of the k best examples of cosine over 0 with the terms in rows r of weights x, best first. skip: an example left out."""
        if not len(r):
            return []
        column = self.column[r]
        rare = column < 0
        p, y = ranges(self.first[r[rare]], self.first[r[rare] + 1], x[rare])
        scores = np.bincount(self.place[p], y * self.weight[p], minlength=self.n_blocks * BLOCK).reshape(self.n_blocks, BLOCK)
        dense = np.zeros(self.most.shape[1])
        dense[column[~rare]] = x[~rare]
        bound = scores.max(axis=1) + self.most @ dense
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[float, int]] = []
        done, step = 0, 8
        while done < len(order):
            least = -best[-1][0] - 1e-12 if len(best) == k else 0.0
            group = order[done : done + step]
            group = group[(bound[group] > 0) & (bound[group] >= least)]
            if not len(group):
                break
            found = (scores[group] + self.dense[group] @ dense).ravel()
            hits = np.flatnonzero((found > 0) & (found >= least - 1e-12))
            if len(hits) > 2 * k:  # what can't be among the k best, even with one example left out, goes before the sort
                hits = hits[found[hits] >= np.partition(found[hits], -k - 1)[-k - 1] - 1e-9]
            index = self.example[group[hits // BLOCK] * BLOCK + hits % BLOCK]
            best = sorted(best + [(-round(s, 12), i) for s, i in zip(found[hits].tolist(), index.tolist()) if i != skip])[:k]
            done, step = done + step, 4 * step
        return [(-s, i) for s, i in best]

    def vote(self, found: list[tuple[float, int]]) -> float:
        w = [s * s for s, _ in found]
        return (PRIOR_WEIGHT * self.base + sum(x * self.labels[i] for x, (_, i) in zip(w, found))) / (PRIOR_WEIGHT + sum(w))

    def calibrated(self, vote: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * vote + self.shift))))

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """The score, and the ids of the neighbours that voted."""
        found = self.search(*self.vector(Counter(words(text)))) if self.n_blocks else []
        if not found:
            return self.base, []
        return self.calibrated(self.vote(found)), [int(self.ids[i]) for _, i in found]


def ranges(start: np.ndarray, end: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one after the other, and the x of the range each comes from."""
    n = end - start
    shift = start - np.cumsum(n) + n
    return np.repeat(shift, n) + np.arange(n.sum()), np.repeat(x, n)


def calibrate(votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton's method with a small ridge."""
    x = np.column_stack([votes, np.ones_like(votes)])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-6]), x.T @ (p - labels) + np.array([0.05, 1e-6]) * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@giving_back
def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "label", "term", "tf"]
    for pdf in batches:
        out: list[tuple[int, int, str, int]] = []
        for i, y, text in zip(pdf["doc_id"], pdf["label"], pdf["text"]):
            out += [(i, y, t, n) for t, n in (Counter(words(text)) or {"": 0}).items()]
            if len(out) >= TERM_ROWS:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


def document_frequency(docs: DataFrame, terms: pa.Array) -> tuple[int, np.ndarray]:
    """Documents in all, and how many have each of the given terms (those of the examples): one row a task and term is shuffled, a term as its number."""
    size = len(terms)
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms.to_pylist())})

    @giving_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, seen = sent.value.get, np.zeros(size + 1, dtype=np.int64)  # the last counts the documents
        for pdf in batches:
            seen[size] += len(pdf)
            for text in pdf["text"]:
                found = set(map(number, words(text)))
                found.discard(None)
                seen[np.fromiter(found, dtype=np.int64, count=len(found))] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": at, "n": seen[at]})

    sums = docs.select("text").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()  # workers are used again, and would keep it
    out = np.zeros(size + 1, dtype=np.int64)
    out[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return int(out[size]), out[:size]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, other: float = OTHER) -> ToxicityIndex:
    """docs: doc_id, text. labels: doc_id, label (0 or 1). Only the ids of labels are learnt from; docs also gives document frequencies.

    other: what terms weigh whose presence doesn't go with the label; with 1 the features are plain TF-IDF.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("int")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # the bounded sample: twice as many ids, since some have no document
    pool = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_examples)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(pool), "doc_id")
    terms = staged(texts.mapInPandas(_terms, "doc_id long, label int, term string, tf int"), "terms")
    chosen = terms.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    examples = chosen.toArrow()
    ids, ys = examples["doc_id"].to_numpy(), examples["label"].to_numpy().astype(float)
    if not len(ids) or ys.min() == ys.max():
        return ToxicityIndex(ids, ys, [], np.zeros(0), base=float(ys[0]) if len(ids) else 0.0)

    n, pos = len(ids), float(ys.sum())
    # an id with several texts has the terms of all, each as often as the text does that has it most
    own = terms.where("tf > 0").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id", "term").agg(F.max("tf").alias("tf"))
    # the examples' own terms, as codes in the terms' order: MAX_EXAMPLES texts at most
    held = own.toArrow()
    coded = held["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, rank = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    doc = pc.index_in(held["doc_id"].combine_chunks(), value_set=pa.array(ids)).to_numpy().astype(np.int64)
    by = np.lexsort((code, doc))  # the same sums in every run
    code, doc, count = code[by], doc[by], held["tf"].to_numpy()[by]
    del held, coded, order, rank, by
    df, a = np.bincount(code, minlength=len(names)), np.bincount(code, ys[doc], minlength=len(names))
    chi2 = n * (a * n - df * pos) ** 2 / np.maximum(df * pos * (n - df) * (n - pos), 1.0)
    share = np.where((df >= MIN_EXAMPLES) & (df < n) & (chi2 >= MIN_CHI2), 1.0, other)
    total, seen = document_frequency(docs, names)
    weigh = share * (np.log((1 + total) / (1 + seen)) + 1)
    index = ToxicityIndex(ids, ys, names.to_pylist(), weigh)
    index.unseen = other * (math.log((1 + total) / 2) + 1)
    w = (1 + np.log(count)) * weigh[code]
    w /= np.sqrt(np.bincount(doc, w * w, minlength=n))[doc]
    index.build(doc, code, w)
    ends = np.searchsorted(doc, np.arange(n + 1)).tolist()
    bare = np.diff(ends) == 0
    index.base = float(ys[bare].mean()) if bare.any() else 0.0
    votes = np.array([index.vote(index.search(code[i:j], w[i:j], skip=k)) for k, (i, j) in enumerate(zip(ends, ends[1:]))])
    index.slope, index.shift = calibrate(votes[~bare], ys[~bare]) if (~bare).any() else (1.0, 0.0)
    return index


def scorer(sent: Broadcast) -> Callable[[Column], Column]:
    """A column function text -> struct(score, evidence) of a broadcast index: evidence holds the ids of the examples that voted."""

    @F.pandas_udf("struct<score: double, evidence: array<long>>")
    @giving_back
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [sent.value.score(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in out], "evidence": [e for _, e in out]})

    return score


def toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """docs with the columns tox_score and tox_evidence (in place of any of these names)."""
    score = scorer(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples)))
    found = free_name(docs, "tox")
    scored = docs.withColumn(found, score(F.col("text")))
    return scored.withColumns({"tox_score": F.col(found)["score"], "tox_evidence": F.col(found)["evidence"]}).drop(found)


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
