"""PageRank over merged account pairs.

Layout: pairs are hash-partitioned and sorted by source once and kept; a round
merges the account state into them and shuffles only contributions, which are
summed before they travel (a hot receiver costs one row per task). Each account
also has an identity row of weight zero, which carries its own state through the
same grouping, so a round is one join and one aggregation, reads the previous
state once (the plan stays linear) and yields the change as a by-product. Every
round is written, so it leaves no shuffle files behind, and the one before goes.

Sources with very many pairs would overload their partition; their pairs stay
where they are and meet a broadcast of those sources' shares. At most ``pairs /
threshold`` sources can exceed the threshold, which bounds the broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import packed_id, unpacked_id
from ledgerloom.operators.graph import distinct_pairs, weighted_pairs
from ledgerloom.session import cut_lineage, discard, materialize, scratch_path, store

MAX_HEAVY_SOURCES = 10_000
MIN_HEAVY_PAIRS = 100_000
CODEC = "zstd"


class EmptyGraph(ValueError):
    """There is no vertex to rank."""


class NotConverged(RuntimeError):
    """The tolerance was not met within the allowed rounds."""


@dataclass
class RankResult:
    ranks: DataFrame
    deltas: list[tuple[int, float]]
    vertex_count: int


def _heavy_threshold(pair_count: int, heavy_pairs: int | None) -> int:
    floor = MIN_HEAVY_PAIRS if heavy_pairs is None else heavy_pairs
    return max(floor, pair_count // MAX_HEAVY_SOURCES)


def rank_accounts(
    edge_table: DataFrame,
    damping: float = 0.85,
    max_rounds: int = 10,
    weighted: bool = True,
    tolerance: float | None = None,
    heavy_pairs: int | None = None,
) -> RankResult:
    """Rank every account that occurs in ``edge_table(src, dst)``.

    ``weighted`` counts parallel edges. Without a tolerance exactly ``max_rounds``
    rounds run; with one, rounds stop once the L1 change is below
    ``vertices * tolerance``, and running out of rounds is an error.
    """
    spark = edge_table.sparkSession
    # The aggregates of each round come out this wide, so the links never move again.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if weighted:
        pairs = weighted_pairs(edge_table)
    else:
        pairs = distinct_pairs(edge_table).withColumn("edge_weight", F.lit(1))
    pairs = materialize(pairs, "rank_pairs", CODEC)
    held: list[DataFrame] = []
    rounds = scratch_path(spark, "rank_rounds")
    try:
        ends = F.array(
            F.struct(F.col("src").alias("id"), "edge_weight", F.lit(1).alias("pairs")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("edge_weight"), F.lit(0).alias("pairs")),
        )
        accounts = pairs.select(F.inline(ends)).groupBy("id")
        accounts = accounts.agg(F.sum("edge_weight").alias("out_weight"), F.sum("pairs").alias("out_pairs"))
        accounts = materialize(accounts, "rank_accounts", CODEC)
        size = accounts.agg(
            F.count(F.lit(1)).alias("vertices"),
            F.sum("out_pairs").alias("pairs"),
            F.max("out_pairs").alias("widest"),
            F.count_if(F.col("out_weight") == 0).alias("silent"),
        ).first()
        if not size.vertices:
            raise EmptyGraph("no vertex to rank: the edge table is empty")
        limit = _heavy_threshold(size.pairs, heavy_pairs)
        spread, heavy = pairs, None
        if size.widest > limit:
            # Fewer than pairs / limit rows: bounded by MAX_HEAVY_SOURCES.
            heavy_ids = F.broadcast(accounts.filter(F.col("out_pairs") > limit).select(F.col("id").alias("src")))
            heavy = pairs.join(heavy_ids, "src", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
            held.append(heavy)
            spread = pairs.join(heavy_ids, "src", "left_anti")
        identity = accounts.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("edge_weight"))
        links = (
            spread.unionByName(identity)
            .repartition(width, "src")
            .sortWithinPartitions("src")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        held.append(links)
        links.count()

        total = float(size.vertices)
        state = accounts.withColumn("pagerank", F.lit(1.0 / total))
        mass = size.silent / total
        deltas: list[tuple[int, float]] = []
        for number in range(1, max_rounds + 1):
            base = (1.0 - damping) / total + damping * mass / total
            state = store(_next_round(state, links, heavy, limit, base, damping), f"{rounds}/{number}", CODEC)
            if number > 1:
                discard(spark, f"{rounds}/{number - 1}")
            row = state.selectExpr(
                "sum(change) AS delta", "sum(pagerank) FILTER (WHERE out_weight = 0) AS mass"
            ).first()
            mass = row.mass or 0.0
            deltas.append((number, row.delta))
            if tolerance is not None and row.delta < total * tolerance:
                break
        else:
            if tolerance is not None:
                raise NotConverged(f"no convergence within {max_rounds} rounds")
        return RankResult(state.select("id", "pagerank"), deltas, size.vertices)
    finally:
        for frame in held:
            frame.unpersist()


# What an account's identity row (weight 0) carries of its own state.
CARRIED = ["out_weight", "out_pairs", "pagerank"]


def _next_round(
    state: DataFrame, links: DataFrame, heavy: DataFrame | None, limit: int, base: float, damping: float
) -> DataFrame:
    known = state.selectExpr("id AS src", *CARRIED)
    sent = links.join(known.hint("merge"), "src").selectExpr(
        "dst AS id",
        "IF(edge_weight = 0, 0.0D, edge_weight * pagerank / out_weight) AS part",
        *[f"IF(edge_weight = 0, {c}, NULL) AS {c}" for c in CARRIED],
    )
    if heavy is not None:
        # At most MAX_HEAVY_SOURCES rows; cut so that the plan reads the state once.
        few = cut_lineage(known.filter(f"out_pairs > {limit}").selectExpr("src", "pagerank / out_weight AS per_weight"))
        from_heavy = heavy.join(F.broadcast(few), "src").selectExpr("dst AS id", "edge_weight * per_weight AS part")
        sent = sent.unionByName(from_heavy, allowMissingColumns=True)
    totals = [F.expr(f"max({c}) AS {c}") for c in CARRIED]
    rank = f"{base!r}D + {damping!r}D * received"
    return (
        sent.groupBy("id")
        .agg(F.expr("sum(part) AS received"), *totals)
        .selectExpr("id", "out_weight", "out_pairs", f"{rank} AS pagerank", f"abs({rank} - pagerank) AS change")
    )


def weighted_rank(edge_table: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    return rank_accounts(edge_table, damping, rounds).ranks


def unweighted_rank(
    edge_table: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 100
) -> DataFrame:
    return rank_accounts(edge_table, damping, max_rounds, weighted=False, tolerance=tolerance).ranks


def training_edges(edge_table: DataFrame, last_step: int) -> DataFrame:
    return edge_table.filter(F.col("step") <= last_step).select("src", "dst")


def convergence_trace(edge_table: DataFrame, result: RankResult) -> DataFrame:
    """Per-round L1 change: one row per round."""
    return edge_table.sparkSession.createDataFrame(result.deltas, "round INT, l1_delta DOUBLE")


def ranks_on_transactions(tx: DataFrame, ranks: DataFrame) -> DataFrame:
    """Sender and receiver rank per transaction; unranked accounts get 0.0.

    The rows behind the first join are stored, so its shuffles are gone before the second.
    """
    named = tx.select(packed_id("txn_id"), "nameOrig", "nameDest")
    for account, column in (("nameOrig", "src_pagerank"), ("nameDest", "dst_pagerank")):
        side = ranks.select(F.col("id").alias(account), F.col("pagerank").alias(column))
        named = named.join(side, account, "left").drop(account)
        if account == "nameOrig":
            named = materialize(named, "sender_ranks", CODEC)
    return named.select(unpacked_id("txn_id"), "src_pagerank", "dst_pagerank").fillna(0.0)
