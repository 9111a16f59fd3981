"""Stored sketches of distinct accounts per day, merged for any range of days without its transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.writers import day_of

#: Log2 of a sketch's registers: standard error 1.04 / sqrt(2 ^ 14), 0.8 %.
REGISTERS = 14
SIDES = {"senders": "nameOrig", "receivers": "nameDest"}


def daily_sketches(tx: DataFrame) -> DataFrame:
    """One row per day: row, fraud and step figures, and a mergeable sketch of each side's accounts."""
    return tx.groupBy(day_of().alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("isFraud").alias("fraud_rows"),
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        *[F.hll_sketch_agg(account, REGISTERS).alias(f"sketch_{side}") for side, account in SIDES.items()],
    )


def summary_of_days(sketches: DataFrame, low: int, high: int) -> DataFrame:
    """``ingest_summary`` of days ``low`` to ``high``, from their sketches only."""
    return sketches.filter(F.col("day").between(low, high)).agg(
        F.ifnull(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.sum("fraud_rows").alias("fraud_rows"),
        F.min("min_step").alias("min_step"),
        F.max("max_step").alias("max_step"),
        *[
            F.ifnull(F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{side}")), F.lit(0)).alias(f"approx_distinct_{side}")
            for side in SIDES
        ],
    )
