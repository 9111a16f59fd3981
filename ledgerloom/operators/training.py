"""Training rows, splits, class weights and the packed graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import Split
from ledgerloom.functions.expressions import EDGE_ATTRIBUTES, packed_id, unpacked_id
from ledgerloom.functions.splits import split_flags, split_label
from ledgerloom.operators.features import (
    DEGREE_FEATURES,
    RANK_FEATURES,
    RECEIVER,
    SENDER,
    TABULAR_BASE,
    activity,
    attach_side,
    tabular_expressions,
)
from ledgerloom.session import materialize, shuffles_freed
from ledgerloom.sources.schema import TRANSACTION_COLUMNS

CODEC = "zstd"
NODE_FEATURES = ["out_degree", "out_total_amt", "in_degree", "in_total_amt", "pagerank"]


class DuplicateRows(ValueError):
    """Row ids are not unique, so joining on them would multiply rows."""


def training_rows(tx: DataFrame, ranks: DataFrame, row_id: Column | None = None) -> DataFrame:
    """All 23 training columns straight from the transactions.

    Ranks ride on the (account, step) activity frames, which are far smaller than
    the transactions, so the transactions are joined twice in all and never on
    the long row id; equal rows stay as many as they were.

    ``row_id`` says how the id follows from a transaction's cells. It is then worked out
    behind the joins; without it the column ``txn_id`` moves through them. The activity of a
    side and the rows behind each join are stored, so the shuffles of one are gone before the next.
    """
    names = ["nameOrig", "nameDest"]
    cells = list(dict.fromkeys([*TABULAR_BASE[1:], *names, *(TRANSACTION_COLUMNS if row_id is not None else [])]))
    joined = tx.select(*([] if row_id is not None else [packed_id("txn_id")]), *cells)
    for account, features, rank in zip(names, (SENDER, RECEIVER), RANK_FEATURES):
        ranked = ranks.select(F.col("id").alias("account"), F.col("pagerank").alias(rank))
        side = materialize(activity(tx, account, features).join(ranked, "account", "left"), "ranked_activity", CODEC)
        joined = materialize(attach_side(joined, side, account), "training_cells", CODEC)
    found = unpacked_id("txn_id") if row_id is None else row_id.alias("txn_id")
    added = list(tabular_expressions())
    return (
        joined.withColumns(tabular_expressions())
        .select(found, *TABULAR_BASE[1:], *added, *DEGREE_FEATURES, *RANK_FEATURES)
        .fillna(0, subset=DEGREE_FEATURES)
        .fillna(0.0, subset=RANK_FEATURES)
    )


def join_feature_tables(
    tabular: DataFrame, degree: DataFrame, rank: DataFrame, dedup: bool = False, allow_copies: bool = False
) -> DataFrame:
    """Left-join the three stored feature tables on ``txn_id``.

    Row ids are content hashes: k equal rows would come out k³ times. Duplicates
    therefore raise, unless ``dedup`` keeps one of each or ``allow_copies`` asks
    for the plain join.
    """
    if dedup:
        tabular, degree, rank = (t.dropDuplicates(["txn_id"]) for t in (tabular, degree, rank))
    elif not allow_copies:
        require_unique_ids(tabular)
    tabular, degree, rank = (with_packed_id(t) for t in (tabular, degree, rank))
    return (
        with_text_id(tabular.join(degree, "txn_id", "left").join(rank, "txn_id", "left"))
        .fillna(0, subset=DEGREE_FEATURES)
        .fillna(0.0, subset=RANK_FEATURES)
    )


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "txn_id") -> DataFrame:
    """A stored table whose rows are dealt into ``buckets`` by ``key`` and sorted by it: tables of equal
    buckets join on the key where they lie. The rows are shuffled once, here, so that each bucket is one file."""
    dealt = df.repartition(buckets, key)
    with shuffles_freed(df.sparkSession):
        dealt.write.mode("overwrite").options(path=path, compression="zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def with_packed_id(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_id", packed_id("txn_id"))


def with_text_id(df: DataFrame) -> DataFrame:
    return df.withColumn("txn_id", unpacked_id("txn_id"))


def bucket_count(rows: int, least: int, rows_each: int = 1_000_000) -> int:
    """Buckets for so many rows: a bucket is sorted by one task, so it stays as large as it is."""
    return max(least, -(-rows // rows_each))


def join_bucketed(tabular: DataFrame, degree: DataFrame, rank: DataFrame) -> DataFrame:
    """``join_feature_tables`` of three tables of ``write_bucketed``: no row moves. Ids must be unique."""
    joined = tabular.hint("merge").join(degree.hint("merge"), "txn_id", "left").join(rank.hint("merge"), "txn_id", "left")
    return joined.fillna(0, subset=DEGREE_FEATURES).fillna(0.0, subset=RANK_FEATURES)


def require_unique_ids(df: DataFrame) -> None:
    # Equal ids have equal hashes: only ids whose hash occurs again are compared as they are.
    marked = df.select("txn_id", F.xxhash64("txn_id").alias("_mark"))
    again = marked.groupBy("_mark").count().filter("count > 1").select("_mark")
    if again.isEmpty():
        return
    repeated = marked.join(again, "_mark", "left_semi").groupBy("txn_id").count().filter("count > 1")
    if not repeated.isEmpty():
        raise DuplicateRows("txn_id is not unique; pass dedup=True to keep one row of each")


def assign_split(df: DataFrame, split: Split) -> DataFrame:
    return df.withColumn("split", split_label(split))


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("isFraud") == 1).alias("fraud_rows")
    )


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("isFraud").agg(F.count(F.lit(1)).alias("n"))


def positive_weight(train: DataFrame) -> DataFrame:
    """One row ``(pos_weight)``: negatives per positive; an absent class counts as one."""

    def seen(label: int):
        return F.greatest(F.count_if(F.col("isFraud") == label), F.lit(1)).cast("double")

    return train.agg((seen(0) / seen(1)).alias("pos_weight"))


def with_class_weight(df: DataFrame, split: Split) -> DataFrame:
    """``pos_weight`` on positive training rows, 1.0 elsewhere."""
    train = df.filter(split_label(split) == "train")
    boost = (split_label(split) == "train") & (F.col("isFraud") == 1)
    weight = positive_weight(train).scalar()
    return df.withColumn("class_weight", F.when(boost, weight).otherwise(F.lit(1.0)))


def pack_nodes(nodes: DataFrame) -> DataFrame:
    vector = F.array(*[F.col(c).cast("float") for c in NODE_FEATURES])
    return nodes.select("node_id", vector.alias("x"))


def pack_edges(edge_features: DataFrame, split: Split) -> DataFrame:
    """Edge table for graph learning: attribute vector, label, time and split flags."""
    vector = F.array(*[F.col(c).cast("float") for c in EDGE_ATTRIBUTES])
    return edge_features.select(
        "orig_id",
        "dest_id",
        vector.alias("edge_attr"),
        F.col("isFraud").cast("float").alias("edge_label"),
        F.col("step").cast("long").alias("edge_time"),
        *[flag.alias(name) for name, flag in split_flags(split).items()],
    )


def pack_report(nodes: DataFrame, packed_edges: DataFrame) -> DataFrame:
    node_count = nodes.agg(F.count(F.lit(1)).alias("n"))
    return packed_edges.agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.count("edge_label").alias("num_labels"),
        F.count("edge_time").alias("num_times"),
        *[F.count_if(f"is_{part}").alias(f"{part}_rows") for part in ("train", "val", "test")],
    ).select(node_count.scalar().alias("num_nodes"), "*")
