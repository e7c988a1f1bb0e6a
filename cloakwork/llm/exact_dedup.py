"""Exact dedup over a persistent digest index (native: DataFrame functions only).

The index is a table bucketed and sorted by the digest. A batch of new documents
becomes one row per digest, its best; a sort-merge anti-join against the index
tells which of them it doesn't hold yet, and those are appended.

An index is settled, or it isn't. A settled one keeps the row that came first: a
text that it holds stays with the doc_id kept there. In the other kind a better
row of a later batch (more code points, then a smaller doc_id) takes the place of
the one held: the anti-join then asks for a row at least as good, and the best of
a digest's few rows counts. dedup_table() feeds a table to such an index in
batches, and so gives the best row of the whole table.

Defined results
* Texts are equal when identical after deleting space and U+0009 to U+000D;
  null text counts as empty, and all empty texts are equal.
* Of equal texts of a batch the one with the most code points in the original
  stays, ties by the smallest doc_id (a null one comes last); of rows that repeat
  both, one is kept.
* Every input row gets a row, repeated rows too.
* Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.shared import discard, staged

#: Fixed by the contract: the deleted characters.
BLANKS = " \t\n\x0b\x0c\r"
#: The largest groups, at most so many, are joined by broadcast: a bounded table, so that no group of copies fills a task.
HOT_GROUPS = 1000
#: Digests that a bucket is made for, and the fewest buckets.
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS = 2_000_000, 16, 65_536


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row (that column, or a number of its own), doc_id, digest (binary SHA-256 of the normalised text), n (code points of the original)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    return docs.select(number.alias("row"), F.col("doc_id").cast("long"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.length(text).cast("long").alias("n"))


def _rank(n: str, doc_id: str) -> list[Column]:
    """The larger, the better."""
    return [F.col(n), F.coalesce(-F.col(doc_id), F.lit(-(2**63)))]


class DigestIndex:
    """A digest index kept as the table `name` in the warehouse: digest, keep_id, n. buckets counts for a table that is made new."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = MIN_BUCKETS, settled: bool = True):
        self.spark, self.name, self.settled = spark, name, settled
        self.buckets = self._buckets_of_table() or buckets

    def _buckets_of_table(self) -> int | None:
        if not self.spark.catalog.tableExists(self.name):
            return None
        told = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"describe extended {self.name}").collect()}
        return int(told["Num Buckets"])

    def known(self) -> DataFrame:
        if self.spark.catalog.tableExists(self.name):
            return self.spark.table(self.name)
        return self.spark.sql("select cast(null as binary) digest, cast(null as bigint) keep_id, cast(null as bigint) n where false")

    def held(self) -> DataFrame:
        """digest, keep_id: the best row of each digest. Rows of a digest share a bucket, so nothing is shuffled."""
        return self.known().groupBy("digest").agg(F.max_by("keep_id", F.struct(*_rank("n", "keep_id"))).alias("keep_id"))

    def unknown(self, best: DataFrame) -> DataFrame:
        """Those of best (digest, keep_id, n) that the index has yet to take."""
        held = self.known().select(F.col("digest").alias("_digest"), F.struct(*_rank("n", "keep_id")).alias("_rank"))
        same = F.col("digest") == F.col("_digest")
        if not self.settled:
            same = same & (F.col("_rank") >= F.struct(*_rank("n", "keep_id")))
        return best.join(held.hint("merge"), same, "left_anti")

    def append(self, best: DataFrame) -> None:
        """Adds what isn't known yet. A job that runs again finds its own rows and adds nothing."""
        new = self.unknown(best.select("digest", "keep_id", "n"))
        new.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def compact(self) -> None:
        """One file a bucket, and one row a digest: for an index that many batches were appended to."""
        best = self.known().groupBy("digest").agg(F.max_by(F.struct("keep_id", "n"), F.struct(*_rank("n", "keep_id"))).alias("b"))
        copy = staged(best.select("digest", "b.keep_id", "b.n"), "index")
        copy.repartition(self.buckets, "digest").write.mode("overwrite").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        discard(copy)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")

    def take(self, d: DataFrame) -> None:
        """Adds the best rows of d (from digests()), combined in each task before the shuffle."""
        best = d.groupBy("digest").agg(F.max_by(F.struct("doc_id", "n"), F.struct(*_rank("n", "doc_id"))).alias("b"))
        self.append(best.select("digest", F.col("b.doc_id").alias("keep_id"), "b.n"))

    def resolve(self, d: DataFrame) -> DataFrame:
        """One row per row of d, a staged table from digests(): row, doc_id, keep_id, group_size (rows of d), kept, digest."""
        # partial aggregation first: a group of any size leaves each task as one row
        first = F.max_by("row", F.struct(*_rank("n", "doc_id"), -F.col("row"))).alias("first")
        groups = staged(d.groupBy("digest").agg(first, F.count("*").alias("group_size")).hint("merge").join(self.held(), "digest"), "groups")
        columns = ["digest", "keep_id", "group_size", "first"]
        hot = staged(groups.orderBy(F.desc("group_size"), "digest").limit(HOT_GROUPS).select(*columns, F.lit(True).alias("hot")), "hot")
        tagged = d.join(F.broadcast(hot), "digest", "left")
        rows = ["row", "doc_id", *columns]
        rest = tagged.where("hot is null").select("row", "doc_id", "digest").join(groups.hint("merge"), "digest")
        out = tagged.where("hot").select(rows).unionByName(rest.select(rows))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("first"))
        return out.select("row", "doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")

    def dedup(self, docs: DataFrame, row: str | None = None) -> DataFrame:
        """Adds a batch to the index, and tells which of its rows stay."""
        d = staged(digests(docs, row), "digests")
        self.take(d)
        return self.resolve(d)


def dedup_table(docs: DataFrame, row: str | None = None, batches: int = 2) -> DataFrame:
    """A whole table by an index of its own: it comes in batches (dealt by id), each deduplicated against the index of those
    before and appended. The index is dropped at the end."""
    spark = docs.sparkSession
    d = staged(digests(docs, row), "digests")
    buckets = min(max(MIN_BUCKETS, -(-d.count() // BUCKET_ROWS)), MAX_BUCKETS)
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets, settled=False)
    for i in range(batches):
        index.take(d.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    out = staged(index.resolve(d), "resolved")
    index.drop()
    discard(d)
    return out
