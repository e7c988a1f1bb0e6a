"""Tables that a plan reads more than once, tables of few tasks, and arrays as rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder of a local session;
    other sessions have no such folder of their own, and must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialised(df: DataFrame) -> DataFrame:
    """df computed once: a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, over all cores where these give fewer tasks than that.

    For costly narrow work. A row group can't be split, however many byte ranges a file is cut into: a table of few files is
    dealt anew, so that its work isn't one task's. A table of many files has tasks enough and isn't shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    # the files of a large table aren't listed: it has parts enough
    few = table.rdd.getNumPartitions() < 4 * cores and len(table.inputFiles()) < cores
    return table.repartition(cores) if few else table


def exploded(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """A row for each element that isn't null. explode() makes a filter on the array's size, pushed down as far as it goes:
    a computed array is computed twice then. explode_outer() makes none."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
