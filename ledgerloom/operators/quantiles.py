"""Exact percentiles of many columns without sorting them: bracket by sketch, count, refine.

1. One aggregation keeps a quantile sketch per column. It says where a percentile lies to
   within a known share of the rows, which gives a low and a high value around it.
2. A second one counts the rows below each bracket and at its low end.
3. Only values strictly inside a bracket, a few in ``ACCURACY`` of all however common single
   values are, are laid out by value, counted and ranked.

All three read the columns as they are stored: nothing is unpivoted but bracketed values, and
nothing else is shuffled. Everything is one lazy plan; what a later step needs of an earlier
one is a one-row subquery. Groups, if any, are few (labels); for many groups there is
``ordering.percentiles``.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is at most one part in this many of the rows.
ACCURACY = 20_000


def group_map(states: DataFrame, key: str, value: Column) -> Column:
    """A one-row subquery: ``value`` by ``key`` of all rows of ``states``; the groups are few."""
    return states.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def exact_percentiles(
    df: DataFrame, values: Mapping[str, Column], fractions: Mapping[str, float], within: str | None = None, accuracy: int = ACCURACY
) -> DataFrame:
    """(within, column, one column per fraction): linearly interpolated percentiles of ``values``.

    ``within`` names a column with few distinct values; rows where it is null are left out,
    and so are null values. A column without values has nulls.
    """
    names, spots = list(values), list(fractions.values())
    group = F.col(within) if within else F.lit(0)
    cells = df.select(group.alias("_g"), *[v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())])
    if within:
        cells = cells.filter(F.col("_g").isNotNull())
    margin = 3.0 / accuracy
    around = [min(max(q + side, 0.0), 1.0) for q in spots for side in (-margin, margin)]
    sketches = cells.groupBy("_g").agg(
        *[
            F.struct(
                F.count(f"_v{i}").alias("n"),
                F.min(f"_v{i}").alias("least"),
                F.max(f"_v{i}").alias("most"),
                F.percentile_approx(f"_v{i}", around, accuracy).alias("at"),
            ).alias(f"_s{i}")
            for i in range(len(names))
        ]
    )

    def edge(i: int, place: int, end: str) -> Column:
        """So few rows that a rank is more than the margin are all inside."""
        if around[place] in (0.0, 1.0):
            return F.col(f"_s{i}.{end}")
        return F.when(F.col(f"_s{i}.n") <= accuracy, F.col(f"_s{i}.{end}")).otherwise(F.col(f"_s{i}.at")[place])

    places = [(i, j) for i in range(len(names)) for j in range(len(spots))]
    edges = F.struct(
        *[edge(i, 2 * j, "least").alias(f"lo{i}_{j}") for i, j in places], *[edge(i, 2 * j + 1, "most").alias(f"hi{i}_{j}") for i, j in places]
    )
    state = group_map(sketches, "_g", edges)
    # A generator, so that the subquery and the look-up stand in the plan once and not in every comparison.
    row = F.struct("_g", *[f"_v{i}" for i in range(len(names))], F.try_element_at(state, F.col("_g")).alias("_s"))
    marked = cells.select(F.inline(F.array(row)))
    brackets = [(i, j, F.col(f"_v{i}"), F.col(f"_s.lo{i}_{j}"), F.col(f"_s.hi{i}_{j}")) for i, j in places]
    counts = marked.groupBy("_g").agg(
        *[F.count_if(v < low).alias(f"_b{i}_{j}") for i, j, v, low, _ in brackets],
        *[F.count_if(v == low).alias(f"_l{i}_{j}") for i, j, v, low, _ in brackets],
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(names))],
        F.first("_s").alias("_s"),
    )
    fields = {"below": "_b{0}_{1}", "at_low": "_l{0}_{1}", "n": "_n{0}", "low": "_s.lo{0}_{1}", "high": "_s.hi{0}_{1}"}
    bracket = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.col(name.format(i, j)).alias(f) for f, name in fields.items()]) for i, j in places
    ]
    known = counts.select("_g", F.inline(F.array(*bracket)))
    # The ends of a bracket are counted above: however common they are, their rows stay where they are.
    within_bracket = [(v > low) & (v < high) for _, _, v, low, high in brackets]
    found = F.array(
        *[F.when(held, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("v"))) for held, (i, j, v, _, _) in zip(within_bracket, brackets)]
    )
    inside = marked.filter(functools.reduce(Column.__or__, within_bracket)).select("_g", F.inline(F.filter(found, lambda x: x.isNotNull())))
    counted = inside.groupBy("_g", "i", "j", "v").agg(F.count(F.lit(1)).alias("c"))
    so_far = Window.partitionBy("_g", "i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = known.join(counted.withColumn("upto", F.sum("c").over(so_far)), ["_g", "i", "j"], "left")
    fraction = F.element_at(F.array(*map(F.lit, map(float, spots))), F.col("j") + 1)
    spot = (F.col("n") - 1) * fraction

    def at(rank: Column) -> Column:
        place = rank - F.col("below") - F.col("at_low")
        middle = F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("v")))
        return F.coalesce(F.max(F.when(place < 0, F.col("low"))), middle, F.max("high"))

    low = F.floor(spot)
    found = ranked.groupBy("_g", "i", "j").agg(
        at(low).alias("lower"), at(F.least(low + 1, F.col("n") - 1)).alias("upper"), F.first(spot - low).alias("part")
    )
    exact = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("part")
    wide = found.groupBy("_g", "i").agg(*[F.max(F.when(F.col("j") == j, exact)).alias(q) for j, q in enumerate(fractions)])
    column = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return wide.select(*([F.col("_g").alias(within)] if within else []), column.alias("column"), *fractions)
