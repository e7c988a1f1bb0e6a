"""A training corpus from `documents`: five stages, each an operator of cloakwork.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents, whatever else these hold and
whatever their names. Dedup, near dedup and decontamination judge every row by
itself, under a key of its own: also rows without a doc_id, and rows that share
one. The last stage has one row per row, with doc_id, n_pieces, pieces and
decodes; null and empty texts have no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.decontaminate import contamination
from cloakwork.llm.exact_dedup import dedup_table
from cloakwork.llm.pieces import encode
from cloakwork.llm.queries import tokenizer
from cloakwork.llm.shared import free_name, staged, table
from cloakwork.llm.simhash import near_duplicates
from cloakwork.llm.toxicity import fit, held_out, scorer

#: Documents of this score or more go.
TOXIC = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    rows, row = keyed(docs)
    sent = spark.sparkContext.broadcast(fit(rows.select("doc_id", "text"), labels))
    gone = staged(rows.where(scorer(sent)(F.col("text"))["score"] >= TOXIC).select(row), "toxic")
    sent.destroy()  # the workers of later stages are the same ones, and would keep it
    return rows.join(gone, row, "left_anti").select(docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of its own for each row, which stays since the table is staged; and the name of that column."""
    row = free_name(docs, "row_key")
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    rows, row = keyed(docs)
    gone = staged(dedup_table(rows, row).where("not kept").select(F.col("row").alias(row)), "copies")
    return rows.join(gone, row, "left_anti").select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays (one without an id comes last)."""
    rows, row = keyed(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    in_groups = found.join(rows.select(row, "doc_id"), row)
    first = in_groups.groupBy("component_id").agg(F.min_by(row, order).alias(row))
    gone = staged(found.select(row).join(first.select(row), row, "left_anti"), "near_copies")
    return rows.join(gone, row, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows, row = keyed(docs)
    leaks = contamination(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = staged(leaks.select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return rows.join(gone, row, "left_anti").select(docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as pieces."""
    return encode(docs.select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL can express neither the nearest examples nor the pieces: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
