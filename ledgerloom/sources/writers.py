"""Sinks: partitioned parquet layers, CSV and JSON reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import shuffles_freed

HOURS_PER_DAY = 24


def day_of(step: str = "step"):
    """Day number of an hourly step; steps count from 1."""
    return F.expr(f"({step} - 1) div {HOURS_PER_DAY}").cast("int")


def day_number(step: int) -> int:
    """``day_of`` of a known step: division rounds towards zero, as in SQL."""
    whole = abs(step - 1) // HOURS_PER_DAY
    return whole if step >= 1 else -whole


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_day(
    df: DataFrame,
    path: str,
    rebalance: bool = True,
    finish: Callable[[DataFrame], DataFrame] | None = None,
    codec: str | None = None,
) -> None:
    """Parquet partitioned by day and sorted by step inside each file.

    The rebalance hint lets adaptive execution merge thin days and split heavy
    ones into files of the advisory size. Turn it off for input that already
    arrives in time order, or where a file per task and day costs less than moving
    all rows: it then needs no shuffle. ``finish`` may add columns to the dated rows
    where they are written, so that these are not shuffled.
    """
    dated = df.withColumn("day", day_of())
    if rebalance:
        dated = dated.hint("rebalance", "day")
    dated = dated.sortWithinPartitions("day", "step")
    if finish:
        dated = finish(dated)
    with shuffles_freed(df.sparkSession):
        dated.write.mode("overwrite").partitionBy("day").parquet(path, compression=codec)


def write_counted(df: DataFrame, path: str, by_day: bool = False, rebalance: bool = True) -> dict[str, int]:
    """Write, then count rows and fraud rows from the sink.

    The plan runs once; the count reads one column of the new table. (Observed
    metrics would save even that, but a session that has used them can no longer
    serialize fitted classifiers.)
    """
    if by_day:
        write_by_day(df, path, rebalance)
    else:
        write_table(df, path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return stored.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("isFraud") == 1).alias("fraud_rows")
    ).first().asDict()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, codec: str | None = None) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path, compression=codec)


def write_ragged_csv(df: DataFrame, path: str) -> None:
    """CSV whose header is the sorted list of all columns; absent cells stay empty."""
    write_csv(df.select(sorted(df.columns)), path)
