"""Reading tables, label splits and joins that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs that may be broadcast (about 64 MB); beyond it the join shuffles.
BROADCAST_ROWS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def join_small(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join that broadcasts ``right`` (two narrow columns) only after counting it."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row per id; ids and labels that are null are left out,
    contradicting rows of one id count as the larger label."""
    kept = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    return kept.groupBy("doc_id").agg(F.max("label").alias("label"))
