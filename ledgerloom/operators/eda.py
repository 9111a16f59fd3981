"""Exploratory tables: profiles, distributions, contingency, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.comoments import correlations
from ledgerloom.operators.quantiles import exact_percentiles, group_map
from ledgerloom.sources.schema import numeric_columns

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def _rows(**arrays: list[Column]) -> Column:
    """Turn parallel lists of one-row columns into rows."""
    names = list(arrays)
    cells = zip(*arrays.values(), strict=True)
    return F.inline(F.array(*[F.struct(*[c.alias(n) for c, n in zip(row, names, strict=True)]) for row in cells]))


def schema_profile(df: DataFrame) -> DataFrame:
    """Column, type, row count and non-null count from one aggregate row."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    return counts.select(
        _rows(
            column=[F.lit(c) for c in df.columns],
            dtype=[F.lit(df.schema[c].dataType.simpleString()) for c in df.columns],
            rows=[F.col("_rows")] * len(df.columns),
            non_null=[F.col(c) for c in df.columns],
        )
    )


def missing_values(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(
        _rows(column=[F.lit(c) for c in df.columns], n_missing=[F.col(c) for c in df.columns])
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    value = {c: F.col(c).cast("double") for c in columns}
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(value[c]).alias("std"),
                F.min(value[c]).alias("min"),
                F.max(value[c]).alias("max"),
                F.percentile_approx(value[c], list(QUARTILES.values()), 100_000).alias("near"),
            ).alias(c)
            if approximate
            else F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(value[c]).alias("std"),
                F.min(value[c]).alias("min"),
                F.max(value[c]).alias("max"),
            ).alias(c)
            for c in columns
        ]
    ).select(_rows(column=[F.lit(c) for c in columns], m=[F.col(c) for c in columns]))
    if approximate:
        quartiles = [F.col("m.near")[k].alias(q) for k, q in enumerate(QUARTILES)]
    else:
        moments, quartiles = moments.join(exact_percentiles(df, value, QUARTILES), "column", "left"), list(QUARTILES)
    return moments.select("column", "m.count", "m.mean", "m.std", "m.min", *quartiles, "m.max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def top_fraud(df: DataFrame, account: str, n: int = 20) -> DataFrame:
    """Accounts with the most fraud rows; ties by name."""
    frauds = df.filter(F.col("isFraud") == 1).groupBy(F.col(account).alias("account"))
    return frauds.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "account").limit(n)


def fraud_ratio(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("isFraud").alias("fraud_ratio"))


def crosstab(df: DataFrame) -> DataFrame:
    """Rows per type and label; absent combinations are 0."""
    return df.groupBy("type").agg(
        F.count_if(F.col("isFraud") == 0).alias("n0"), F.count_if(F.col("isFraud") == 1).alias("n1")
    )


def crosstab_rate(df: DataFrame) -> DataFrame:
    whole = F.col("n0") + F.col("n1")
    return crosstab(df).select("type", (F.col("n0") / whole).alias("r0"), (F.col("n1") / whole).alias("r1"))


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last one is closed.

    The range is a one-row scalar subquery; empty bins appear with 0. A single
    distinct value gets a unit-wide range around it.
    """
    values = df.select(value.cast("double").alias("x")).filter(F.col("x").isNotNull())
    low, high = F.min("x"), F.max("x")
    spans = high > low
    span = F.struct(
        F.when(spans, low).otherwise(low - 0.5).alias("lo"),
        F.when(spans, (high - low) / bins).otherwise(1.0 / bins).alias("width"),
    )
    # Held in a column, so that the subquery appears once however often it is used.
    span = values.agg(span.alias("span")).scalar()
    place = F.least(F.floor((F.col("x") - F.col("span.lo")) / F.col("span.width")), F.lit(bins - 1)).cast("int")
    filled = values.withColumn("span", span).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), span.alias("span"))
    edge = F.col("span.lo") + F.col("bin") * F.col("span.width")
    next_edge = F.col("span.lo") + (F.col("bin") + 1) * F.col("span.width")
    return every.join(filled, "bin", "left").select(
        "bin", edge.alias("lo"), next_edge.alias("hi"), F.ifnull(F.col("n"), F.lit(0)).alias("n")
    )


def box_statistics(df: DataFrame, value: Column, within: str = "isFraud", approximate: bool = False) -> DataFrame:
    """Quartiles, whiskers (last datum within 1.5 IQR) and outlier count per group; the groups are few."""
    rows = df.select(F.col(within), value.cast("double").alias("x")).filter(F.col("x").isNotNull() & F.col(within).isNotNull())
    if approximate:
        near = F.percentile_approx("x", list(QUARTILES.values()), 100_000)
        quartiles = rows.groupBy(within).agg(near.alias("near"))
        quartiles = quartiles.select(within, *[F.col("near")[k].alias(q) for k, q in enumerate(QUARTILES)])
    else:
        quartiles = exact_percentiles(rows, {"x": F.col("x")}, QUARTILES, within)
    # One small row: the rows themselves are neither joined nor moved.
    boxes = group_map(quartiles, within, F.struct(*QUARTILES))
    rows = rows.select(F.inline(F.array(F.struct(within, "x", F.try_element_at(boxes, F.col(within)).alias("box")))))
    reach = (F.col("box.q75") - F.col("box.q25")) * 1.5
    inside = F.col("x").between(F.col("box.q25") - reach, F.col("box.q75") + reach)
    boxed = rows.groupBy(within).agg(
        F.first("box").alias("box"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return boxed.select(within, "box.*", "whisker_low", "whisker_high", "n_outliers")


def volume_by_step(df: DataFrame) -> DataFrame:
    return df.groupBy("step").agg(F.count(F.lit(1)).alias("n"))


def fraud_by_step(df: DataFrame) -> DataFrame:
    return df.groupBy("step").agg(F.sum("isFraud").alias("n"))


def with_eda_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "log_amount": F.log1p("amount"),
            "orig_balance_diff": F.col("oldbalanceOrg") - F.col("newbalanceOrig"),
            "dest_balance_diff": F.col("newbalanceDest") - F.col("oldbalanceDest"),
        }
    )


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r for all ordered pairs, over the rows where both are present; NULL for a constant column."""
    return correlations(df, list(columns or numeric_columns(df)))


def degrees(df: DataFrame, account: str) -> DataFrame:
    return df.groupBy(account).agg(F.count(F.lit(1)).alias("degree"))


def degree_profile(df: DataFrame, account: str, approximate: bool = False) -> DataFrame:
    return describe(degrees(df, account), ["degree"], approximate)


def degree_histogram(df: DataFrame, account: str, bins: int = 50) -> DataFrame:
    return histogram(degrees(df, account), F.log1p("degree"), bins)


def summary(df: DataFrame) -> DataFrame:
    """Rows, fraud ratio, distinct accounts per side, and the types seen."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.avg("isFraud").alias("fraud_ratio"),
        F.count_distinct("nameOrig").alias("unique_senders"),
        F.count_distinct("nameDest").alias("unique_receivers"),
        F.array_sort(F.collect_set("type")).alias("types"),
    )


def distinct_types(df: DataFrame) -> DataFrame:
    return df.select("type").distinct()
