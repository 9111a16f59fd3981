"""Global order without a single-task window: dense positions, running totals,
exact percentiles.

A range shuffle spreads the sorted rows evenly over tasks, whatever their
distribution, and per-slice totals (one row per task and group) give each slice
its starting value. The sorted rows are checkpointed first: range bounds come
from a sample, so the slices must not be laid out twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

SLICE, PLACE = "_slice", "_place"
LOW_33_BITS = (1 << 33) - 1


def lay_out(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Sort globally; record each row's slice and its place in the slice."""
    return cut_lineage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(SLICE, F.spark_partition_id())
        .withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_33_BITS)))
    )


def _before(totals: DataFrame, within: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per slice of a group: the sum over its earlier slices, and over all of them.

    The input has at most one row per slice and group.
    """
    group = Window.partitionBy(*(within or [F.lit(0)]))
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.ifnull(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names]
    return totals.select(*within, SLICE, *sums, *[F.sum(n).over(group).alias(f"_total_{n}") for n in names])


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Dense 0-based position of every row in ``order``."""
    placed = lay_out(df, order)
    sizes = placed.groupBy(SLICE).agg(F.count(F.lit(1)).alias("size"))
    # One row per slice, that is per task of the range shuffle: always small.
    return (
        placed.join(F.broadcast(_before(sizes, [], ["size"])), SLICE)
        .withColumn(name, F.col("_before_size") + F.col(PLACE))
        .drop(SLICE, PLACE, "_before_size", "_total_size")
    )


def running_totals(
    df: DataFrame,
    order: Sequence[Column | str],
    values: Sequence[str],
    within: Sequence[str] = (),
) -> DataFrame:
    """Running totals in ``order``, per ``within`` group.

    Adds ``<value>_so_far`` (inclusive) and the group's ``<value>_total``.
    """
    placed = lay_out(df, [*within, *order])
    slices = placed.groupBy(*within, SLICE).agg(*[F.sum(v).alias(v) for v in values])
    here = (
        Window.partitionBy(*within, SLICE)
        .orderBy(PLACE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    started = placed.join(_before(slices, within, values), [*within, SLICE])
    return started.select(
        *df.columns,
        *[(F.col(f"_before_{v}") + F.sum(v).over(here)).alias(f"{v}_so_far") for v in values],
        *[F.col(f"_total_{v}").alias(f"{v}_total") for v in values],
    )


def percentiles(
    df: DataFrame,
    value: str,
    fractions: dict[str, float],
    within: Sequence[str] = (),
    approximate: bool = False,
) -> DataFrame:
    """Linearly interpolated percentiles per group, one column per fraction.

    Exact by default: equal values are counted first, then ranked by running
    totals, so neither a hot value nor a hot group ends in one task.
    """
    known = df.filter(F.col(value).isNotNull())
    if approximate:
        return known.groupBy(*within).agg(
            *[F.percentile_approx(value, q, 100_000).alias(n) for n, q in fractions.items()]
        )
    counted = known.groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    if not within:
        counted = counted.withColumn("_all", F.lit(0))
    keys = list(within) or ["_all"]
    ranked = running_totals(counted, [value], ["n"], keys)
    last = F.col("n_total") - 1

    def at(rank: Column) -> Column:
        holds = (F.col("n_so_far") > rank) & (F.col("n_so_far") - F.col("n") <= rank)
        return F.max(F.when(holds, F.col(value)))

    columns = []
    for name, fraction in fractions.items():
        spot = last * F.lit(float(fraction))
        low = F.floor(spot)
        columns += [
            at(low).alias(f"_{name}_low"),
            at(F.least(low + 1, last)).alias(f"_{name}_high"),
            F.max(spot - low).alias(f"_{name}_part"),
        ]
    found = ranked.groupBy(*keys).agg(*columns)
    return found.select(
        *within,
        *[
            (
                F.col(f"_{n}_low")
                + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")
            ).alias(n)
            for n in fractions
        ],
    )
