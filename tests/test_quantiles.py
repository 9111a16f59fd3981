from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.comoments import CoMoments, correlations
from ledgerloom.operators.quantiles import exact_percentiles

WANTED = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def columns(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = 4000
    return {
        "normal": rng.normal(size=n), "heavy": np.exp(rng.normal(scale=4, size=n)), "steps": rng.integers(0, 5, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)), "same": np.full(n, 3.5), "few": np.where(np.arange(n) < 2, rng.normal(size=n), np.nan),
        "none": np.full(n, np.nan),
    }


@pytest.mark.parametrize("accuracy", [40, 1000, 20_000])
def test_percentiles_of_many_columns(spark, accuracy):
    """Also from a sketch so rough that brackets hold many rows and overlap."""
    data = columns(1)
    label = [i % 3 if i % 50 else None for i in range(4000)]
    rows = [(g, *[None if np.isnan(v) else float(v) for v in row]) for g, row in zip(label, np.stack(list(data.values()), axis=1))]
    frame = spark.createDataFrame(rows, "g INT, " + ", ".join(f"{c} DOUBLE" for c in data)).repartition(7)
    whole = exact_percentiles(frame, {c: F.col(c) for c in data}, WANTED, accuracy=accuracy)
    grouped = exact_percentiles(frame, {c: F.col(c) for c in data}, WANTED, "g", accuracy)
    seen = 0
    for row in [*whole.withColumn("g", F.lit(-1)).collect(), *grouped.collect()]:
        values = data[row.column]
        if row.g >= 0:
            values = values[[g == row.g for g in label]]
        values = values[~np.isnan(values)]
        got = [row[q] for q in WANTED]
        assert got == (pytest.approx([np.percentile(values, 100 * q) for q in WANTED.values()]) if len(values) else [None] * 5), row
        seen += 1
    assert seen == 4 * len(data)
    assert exact_percentiles(frame.limit(0), {"normal": F.col("normal")}, WANTED).count() == 0


def test_only_bracketed_values_are_shuffled(spark, tmp_path):
    """Half a million rows; what the plan lays out by value is a few thousand of them."""
    path = str(tmp_path / "wide")
    spark.range(500_000).select(F.rand(3).alias("x"), F.randn(4).alias("y")).write.parquet(path)
    found = exact_percentiles(spark.read.parquet(path), {"x": F.col("x"), "y": F.col("y")}, {"q": 0.5})
    assert found.count() == 2
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "RangePartitioning" not in plan and "Expand" not in plan
    margin = 3.0 / 20_000
    expected = spark.read.parquet(path).stat.approxQuantile(["x"], [0.5 - margin, 0.5 + margin], 0.0)[0]
    held = spark.read.parquet(path).filter(F.col("x").between(*expected)).count()
    assert held < 500


def test_comoments_merge_like_the_whole():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(3000, 6)) * [1, 1e-3, 1e4, 1, 1, 1] + [1e9, 0, -5, 0, 0, 0]
    rows[:, 4] = 8.25
    rows[:, 5] = 2 * rows[:, 3] + 0.1 * rows[:, 5]
    rows[rng.random((3000, 6)) < 0.2] = np.nan
    rows[1500:, 1] = np.nan
    total = CoMoments.of(rows[:1] * np.nan)
    for part in np.array_split(rows, 17):
        total = total.merge(CoMoments.unpack(CoMoments.of(part).pack(), 6))
    got = total.correlations()
    for i in range(6):
        for j in range(6):
            both = ~np.isnan(rows[:, i]) & ~np.isnan(rows[:, j])
            a, b = rows[both, i], rows[both, j]
            assert total.n[i, j] == both.sum()
            if 4 in (i, j):
                assert got[i][j] is None
            else:
                assert got[i][j] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)


def test_correlations_in_one_scan(spark):
    frame = spark.range(10_000).select(F.col("id").cast("double").alias("a"), (F.lit(5.0) - F.col("id")).alias("b"), F.lit(1.5).alias("c"))
    found = correlations(frame.repartition(9), ["a", "b", "c"])
    rows = {(r.col_a, r.col_b): r.r for r in found.collect()}
    assert rows["a", "b"] == pytest.approx(-1) and rows["b", "b"] == 1.0 and rows["c", "a"] is None and rows["c", "c"] is None
    assert correlations(frame.limit(0), ["a", "b"]).collect()[0].r is None
