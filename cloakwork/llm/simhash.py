"""SimHash near-dedup with BK-trees.

Fingerprints are made per document in Arrow batches. Distinct fingerprints are
dealt to shards that must share the links within the radius: of `blocks` equal
bit blocks two fingerprints within the radius agree in at least blocks - radius,
so a shard is a choice of that many blocks and their value. Each shard is a
BK-tree (children keyed by the integer Hamming distance to the parent), and a
search follows only edges within the radius. Shards larger than SHARD_MAX are
dealt again by more bits, LEVELS times, and what is crowded still is cut into
chunks, of which every two make a tree: no tree is larger than SHARD_MAX,
whatever the table holds. The trees are dealt to the tasks, not broadcast through
the driver: together they hold every fingerprint, which has no size bound.

Each shard gives a spanning forest of its links, not all pairs; components()
joins the forests.

Defined results
* Null and empty texts have fingerprint zero, linked like any other.
* A text of fewer than three words is one shingle.
* Repeated rows have equal fingerprints and so one component; a null doc_id
  takes the component of its fingerprint (null if no row there has an id).
* One row per input row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import components, giving_back, staged

SEED, SHINGLE, RADIUS, BITS = 42, 3, 3, 64
#: Fingerprints of a tree, and how often a crowded shard is dealt by more bits.
SHARD_MAX, LEVELS = 4096, 3
#: Shingle hashes counted at once: bounds the memory that one long text takes.
COUNT_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and blanks 20 and 09-0D
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), COUNT_AT_ONCE):
        ones += np.unpackbits(h[i : i + COUNT_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Insert a fingerprint and find those already there within the radius."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, fp: int, radius: int) -> list[int]:
        if self.root is None:
            self.root = (fp, {})
            return []
        near, stack = [], [self.root]
        while stack:
            value, children = stack.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                near.append(value)
            if children:
                stack += [children[x] for x in range(d - radius, d + radius + 1) if x in children]
        value, children = self.root
        while (nxt := children.get(d := (value ^ fp).bit_count())) is not None:
            value, children = nxt
        children[d] = (fp, {})
        return near


def forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by one BK-tree."""
    tree, parent, links = BKTree(), {}, []

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    for fp in fps:
        for other in tree.add(fp, radius):
            if (a := root(fp)) != (b := root(other)):
                parent[a] = b
                links.append((fp, other))
    return links


def shard_forests(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows (key, fp) sorted by key, as they come: one tree at a time."""
    key, fps, out = None, [], []

    def flush() -> None:
        if len(fps) > 1:
            out.extend(forest(fps, radius))

    for pdf in batches:
        for k, fp in zip(pdf["key"].tolist(), pdf["fp"].tolist()):
            if k != key:
                flush()
                key, fps = k, []
            fps.append(fp & (2**64 - 1))
        if len(out) > 10_000:
            yield pd.DataFrame(np.array(out, dtype=np.uint64).view(np.int64), columns=["a", "b"])
            out = []
    flush()
    if out:
        yield pd.DataFrame(np.array(out, dtype=np.uint64).view(np.int64), columns=["a", "b"])


def block_masks(blocks: int, radius: int, bits: int = BITS) -> list[int]:
    """Masks of every choice of blocks - radius of the `blocks` bit blocks."""
    cut = [range(bits * i // blocks, bits * (i + 1) // blocks) for i in range(blocks)]
    return [sum(1 << i for part in some for i in part) for some in combinations(cut, blocks - radius)]


def stripe_masks(level: int, radius: int, bits: int = BITS) -> list[int]:
    """radius + 1 masks that share out the bits, otherwise at each level: two fingerprints within the radius agree under one of them."""
    n = radius + 1
    return [sum(1 << i for i in range(bits) if i // n**level % n == k) for k in range(n)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _under(masks: list[int]) -> Column:
    """The fingerprint under each mask."""
    return F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])


def _crowded(dealt: DataFrame) -> DataFrame:
    return staged(dealt.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SHARD_MAX), "crowded")


def shards(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(key, fp): every two fingerprints within the radius share a key, and no key has more than SHARD_MAX of them. n: number of fingerprints.

    More rows take more blocks, whose keys have more bits, so that a shard stays
    small: 4 blocks give 4 keys of 16 bits, 5 give 10 of about 25, 6 give 20 of 32.
    """
    blocks = next(b for b in range(radius + 1, 12) if BITS * (b - radius) // b >= np.log2(max(n, 2)) - 6)
    dealt = distinct.select("fp", F.posexplode(_under(block_masks(blocks, radius))).alias("j", "v")).select(F.xxhash64("j", "v").alias("key"), "fp")
    for level in range(LEVELS):
        crowded = _crowded(dealt)
        if crowded.isEmpty():
            return dealt
        parts = F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).otherwise(_under(stripe_masks(level, radius)))
        again = dealt.join(crowded, "key", "left").select("fp", "key", "size", F.posexplode(parts).alias("j", "v"))
        dealt = again.select(F.when(F.col("size").isNull(), F.col("key")).otherwise(F.xxhash64("key", "j", "v")).alias("key"), "fp")
    crowded = _crowded(dealt)
    if crowded.isEmpty():
        return dealt
    # every two chunks of a shard make a tree
    chunks = F.ceil(2 * F.col("size") / SHARD_MAX * F.lit(1.25)).cast("long") + 1
    own = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("chunks"))
    cut = dealt.join(crowded, "key", "left").withColumn("chunks", F.coalesce(chunks, F.lit(1))).withColumn("own", own)
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda i: i != F.col("own"))
    )
    paired = cut.select("key", "fp", "chunks", "own", F.explode(others).alias("other"))
    both = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return paired.select(F.when(F.col("chunks") == 1, F.col("key")).otherwise(both).alias("key"), "fp")


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): fingerprints within the radius, enough of them to connect whatever is connected."""
    keyed = shards(distinct, n, radius).repartition("key").sortWithinPartitions("key", "fp")
    return keyed.mapInPandas(lambda it: shard_forests(it, radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_same (rows of equal fingerprint)."""
    fps = staged(fingerprints(docs), "fingerprints")
    # one row a fingerprint from each task: equal ones, however many, do not meet as rows
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "distinct")
    found = components(links(distinct, distinct.count(), radius)).select(F.col("node").alias("fp"), "component")
    classes = distinct.join(found, "fp", "left").select("fp", "least", "n_same", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = staged(classes.join(least, "component").select("fp", "n_same", "component_id"), "classes")
    hot = F.broadcast(staged(classes.orderBy(F.desc("n_same"), "fp").limit(1000), "hot").select("fp", "n_same", "component_id", F.lit(True).alias("hot")))
    tagged = fps.join(hot, "fp", "left")
    rest = tagged.where("hot is null").select("doc_id", "fp").join(classes, "fp")
    out = tagged.where("hot").select("doc_id", "fp", "n_same", "component_id").unionByName(rest.select("doc_id", "fp", "n_same", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")
