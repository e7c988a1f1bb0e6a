"""What the training-data operators share: staged tables, words, graph components."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.tables import shared_dir

#: Letters, digits and underscore of any script; words are compared in lower case.
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-case words of a text; null counts as empty."""
    return WORD.findall(text.lower()) if text else []


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and at its end the memory that is free in the worker goes back to the machine: the same worker serves later
    stages, and would keep what the largest of them took, text by text between what is remembered."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return whole


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: a cut of lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table. createDataFrame([]) is read by Python workers of another kind, which executors hold beside those of the tasks."""
    return spark.range(0).select(F.lit(None).cast(f"struct<{schema}>").alias("r")).select("r.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it differ from df's columns (which Spark compares in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b), component the least node reachable.

    Alternating large-star and small-star rounds. Minima are combined before the
    shuffle and stars are joined, never gathered, so a hub costs no task more
    than its share; the number of rounds grows with the logarithm of the longest
    chain. Each round is a staged table, deleted once the next one is there.
    Raises if `rounds` do not suffice.
    """
    e = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_min, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        last, e = e, staged(small, "edges")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
