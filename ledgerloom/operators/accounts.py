"""Dense account ids, node features, and edge features keyed by those ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import EDGE_ATTRIBUTES, edge_attributes, packed_id, unpacked_id
from ledgerloom.operators.ordering import number_rows
from ledgerloom.operators.pagerank import unweighted_rank
from ledgerloom.operators.training import NODE_FEATURES

ROW_ORDER = ("step", "txn_id")


def account_ids(tx: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    """``(account, node_id)``: 0..n-1 by first appearance, senders before receivers.

    Row order is given by ``order`` because a distributed table has no other.
    """
    key = [F.col(c) for c in order]
    sides = F.array(
        F.struct(F.col("nameOrig").alias("account"), F.struct(F.lit(0).alias("side"), *key).alias("first")),
        F.struct(F.col("nameDest").alias("account"), F.struct(F.lit(1).alias("side"), *key).alias("first")),
    )
    firsts = (
        tx.select(F.inline(sides))
        .filter(F.col("account").isNotNull())
        .groupBy("account")
        .agg(F.min("first").alias("first"))
    )
    return number_rows(firsts, ["first", "account"], "node_id").select("account", "node_id")


def map_accounts(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """Add ``orig_id`` and ``dest_id``."""
    ids_held = [c for c in tx.columns if c == "txn_id" and tx.schema[c].dataType.simpleString() == "string"]
    mapped = tx.withColumns({c: packed_id(c) for c in ids_held})
    for account, name in (("nameOrig", "orig_id"), ("nameDest", "dest_id")):
        side = ids.select(F.col("account").alias(account), F.col("node_id").alias(name))
        mapped = mapped.join(side, account, "left")
    return mapped.select(*[unpacked_id(c) if c in ids_held else c for c in tx.columns], "orig_id", "dest_id")


def edge_features(mapped: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ids, step, four attributes and label per transaction."""
    return mapped.withColumns(edge_attributes()).select(
        *keep, "orig_id", "dest_id", "step", *EDGE_ATTRIBUTES, "isFraud"
    )


def node_activity(mapped: DataFrame) -> DataFrame:
    """Degrees and amounts for every id from 0 to the highest one.

    Both sides and the id spine flow into one grouping, so absent ids come out
    with zeros and nothing is joined.
    """
    top = mapped.agg(F.greatest(F.max("orig_id"), F.max("dest_id")).alias("top")).first().top
    none, one = F.lit(0), F.lit(1)

    def entry(node: Column, out: Column, out_amt: Column, into: Column, into_amt: Column) -> Column:
        cells = [node, out, out_amt, into, into_amt]
        return F.struct(*[c.alias(n) for c, n in zip(cells, ["node_id", *NODE_FEATURES[:4]], strict=True)])

    zero, amount = F.lit(0.0), F.col("amount")
    sides = F.array(
        entry(F.col("orig_id"), F.col("dest_id").isNotNull().cast("int"), amount, none, zero),
        entry(F.col("dest_id"), none, zero, F.col("orig_id").isNotNull().cast("int"), amount),
    )
    spine = mapped.sparkSession.range((top if top is not None else -1) + 1)
    spine = spine.select(F.inline(F.array(entry(F.col("id"), none, zero, none, zero))))
    return (
        mapped.select(F.inline(sides))
        .filter(F.col("node_id").isNotNull())
        .unionByName(spine)
        .groupBy("node_id")
        .agg(*[F.ifnull(F.sum(c), F.lit(0)).alias(c) for c in NODE_FEATURES[:4]])
    )


def node_features(mapped: DataFrame) -> DataFrame:
    """Degrees, amounts and the tolerance-based rank per id, unscaled."""
    links = mapped.select(F.col("orig_id").alias("src"), F.col("dest_id").alias("dst"))
    ranks = unweighted_rank(links).withColumnRenamed("id", "node_id")
    return node_activity(mapped).join(ranks, "node_id", "left").fillna(0.0, subset=["pagerank"])


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x - mean) / population std``; a constant column is only centred.

    A variance that is no more than summation error counts as constant. The
    statistics are one row, read as a scalar subquery.
    """
    measured = []
    for c in columns:
        mean, var, n = F.avg(c), F.var_pop(c), F.count(c)
        noise = n * F.lit(2.0**-52)
        flat = var <= noise * var + F.pow(noise * mean, F.lit(2.0))
        measured.append(
            F.struct(mean.alias("mean"), F.when(flat, 1.0).otherwise(F.sqrt(var)).alias("std")).alias(c)
        )
    stats = df.agg(F.struct(*measured).alias("stats")).scalar()
    rest = [c for c in df.columns if c not in columns]
    scaled = [((F.col(c) - F.col(f"_stats.{c}.mean")) / F.col(f"_stats.{c}.std")).alias(c) for c in columns]
    return df.withColumn("_stats", stats).select(*rest, *scaled)


def scaled_node_features(raw: DataFrame) -> DataFrame:
    return standardize(raw, NODE_FEATURES).select("node_id", *NODE_FEATURES)


STD_FLOOR = 1e-6


def edge_statistics(edges: DataFrame, train: Column, columns: Sequence[str] = EDGE_ATTRIBUTES) -> DataFrame:
    """One row: mean and floored sample std of each attribute over training rows."""
    picked = {c: F.when(train, F.col(c).cast("double")) for c in columns}
    return edges.agg(
        *[F.avg(v).alias(f"{c}_mean") for c, v in picked.items()],
        *[F.greatest(F.stddev_samp(v), F.lit(STD_FLOOR)).alias(f"{c}_std") for c, v in picked.items()],
    )


def normalize_edges(edges: DataFrame, statistics: DataFrame, columns: Sequence[str] = EDGE_ATTRIBUTES) -> DataFrame:
    """Apply stored training statistics to all rows."""
    stats = statistics.select(F.struct("*").alias("stats")).scalar()
    scaled = {c: (F.col(c) - F.col(f"_stats.{c}_mean")) / F.col(f"_stats.{c}_std") for c in columns}
    return edges.withColumn("_stats", stats).withColumns(scaled).drop("_stats")
