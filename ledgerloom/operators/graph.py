"""Accounts as vertices, transactions as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role(is_sender: Column, is_receiver: Column) -> Column:
    return (
        F.when((is_sender == 1) & (is_receiver == 1), "both")
        .when(is_sender == 1, "sender_only")
        .otherwise("receiver_only")
    )


def endpoints(df: DataFrame, source: str, target: str) -> DataFrame:
    """Each row turned into its two account ends: ``(id, is_sender, is_receiver)``."""
    sides = F.array(
        F.struct(F.col(source).alias("id"), F.lit(1).alias("is_sender"), F.lit(0).alias("is_receiver")),
        F.struct(F.col(target).alias("id"), F.lit(0).alias("is_sender"), F.lit(1).alias("is_receiver")),
    )
    return df.select(F.inline(sides))


def vertices(tx: DataFrame) -> DataFrame:
    """One row per account with its roles, from one scan and one shuffle.

    Flags combine by maximum before the shuffle, so a hot account travels once
    per task; this equals the full outer join of distinct senders and receivers.
    """
    flags = endpoints(tx, "nameOrig", "nameDest").groupBy("id").agg(
        F.max("is_sender").alias("is_sender"), F.max("is_receiver").alias("is_receiver")
    )
    return flags.withColumn("vertex_role", role(F.col("is_sender"), F.col("is_receiver")))


def edges(tx: DataFrame) -> DataFrame:
    renamed = tx.withColumnsRenamed({"nameOrig": "src", "nameDest": "dst"}).dropna(subset=["src", "dst"])
    rest = [c for c in renamed.columns if c not in ("txn_id", "src", "dst", "day")]
    return renamed.select("txn_id", "src", "dst", *rest)


def self_loops(edge_table: DataFrame) -> DataFrame:
    return edge_table.filter(F.col("src") == F.col("dst"))


def weighted_pairs(edge_table: DataFrame) -> DataFrame:
    """Parallel edges merged: ``(src, dst, edge_weight)``."""
    return edge_table.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("edge_weight"))


def distinct_pairs(edge_table: DataFrame) -> DataFrame:
    return edge_table.select("src", "dst").distinct()


def vertex_ids(edge_table: DataFrame) -> DataFrame:
    """Distinct accounts at either end of an edge."""
    return edge_table.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def graph_summary(vertex_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Vertices, edges, self-loops and distinct pairs.

    Pairs are merged once; edges and loops are then sums over the merged pairs.
    """
    pairs = weighted_pairs(edge_table)
    vertex_count = vertex_table.agg(F.count(F.lit(1)).alias("n"))
    loops = F.when(F.col("src") == F.col("dst"), F.col("edge_weight")).otherwise(F.lit(0))
    return pairs.agg(
        F.ifnull(F.sum("edge_weight"), F.lit(0)).alias("edge_count"),
        F.ifnull(F.sum(loops), F.lit(0)).alias("self_loops"),
        F.count(F.lit(1)).alias("distinct_pairs"),
    ).select(vertex_count.scalar().alias("vertex_count"), "edge_count", "self_loops", "distinct_pairs")


def transition_probabilities(edge_table: DataFrame) -> DataFrame:
    """Share of each pair in its source's edges.

    Source totals are a grouped sum joined back rather than a window, so one
    source with a third of all pairs is split by adaptive skew handling.
    """
    pairs = weighted_pairs(edge_table)
    totals = pairs.groupBy("src").agg(F.sum("edge_weight").alias("src_weight"))
    return pairs.join(totals, "src", "left").select(
        "src", "dst", (F.col("edge_weight") / F.col("src_weight")).alias("transition_prob")
    )


def dangling(edge_table: DataFrame) -> DataFrame:
    """Accounts that occur in the edges but never send."""
    senders = edge_table.select(F.col("src").alias("id")).distinct()
    return vertex_ids(edge_table).join(senders, "id", "left_anti")
