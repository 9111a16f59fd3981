from __future__ import annotations

import math

import pytest
from conftest import records
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import threshold_bin
from ledgerloom.operators import metrics

SCORES = [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORES, "p DOUBLE, isFraud INT")


def one(df):
    return df.first().asDict()


def test_confusion_and_rates(scored):
    counts = metrics.confusion(scored, F.col("p") >= 0.5)
    assert one(counts) == {"tp": 2, "fp": 1, "fn": 0, "tn": 1}
    rates = one(metrics.with_prf(counts))
    assert (rates["precision"], rates["recall"], rates["f1"]) == pytest.approx((2 / 3, 1.0, 0.8))


def test_average_precision_groups_ties(spark, scored):
    assert one(metrics.average_precision(scored))["average_precision"] == pytest.approx(0.8333333333)
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0), (0.1, 1)], "p DOUBLE, isFraud INT")
    expected = 0.5 * (1 / 3) + 0.5 * (2 / 4)
    assert one(metrics.average_precision(tied))["average_precision"] == pytest.approx(expected)


def test_sweep_and_best(scored):
    sweep = metrics.threshold_sweep(scored)
    assert sweep.count() == 99
    for row in sweep.collect():
        tp = sum(1 for p, y in SCORES if p > row.threshold and y)
        fp = sum(1 for p, y in SCORES if p > row.threshold and not y)
        assert row.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0.0)
        assert row.recall == pytest.approx(tp / 2)
    best = one(metrics.best_threshold(sweep))
    assert best["threshold"] == 0.2 and best["f1"] == pytest.approx(0.8) and best["recall"] == 1.0


def test_one_class(spark):
    negatives = spark.createDataFrame([(0.9, 0), (0.1, 0)], "p DOUBLE, isFraud INT")
    assert one(metrics.average_precision(negatives))["average_precision"] == 0.0
    assert one(metrics.best_threshold(metrics.threshold_sweep(negatives))) == {
        "threshold": 0.5, "f1": 0.0, "precision": 0.0, "recall": 0.0,
    }


def test_bins_equal_plain_comparisons(spark):
    """Every threshold and its neighbouring doubles, where rounding would show."""
    points = [i / 100 for i in range(101)]
    values = points + [math.nextafter(p, 2) for p in points] + [math.nextafter(p, -1) for p in points[1:]]
    frame = spark.createDataFrame([(v,) for v in values], "p DOUBLE")
    for row in frame.select("p", threshold_bin(F.col("p")).alias("bin")).collect():
        assert row.bin == sum(1 for i in range(1, 100) if i / 100 < row.p), row.p


def test_by_split(spark):
    rows = [(p, y, s) for s in ("val", "test") for p, y in SCORES]
    frame = spark.createDataFrame(rows, "p DOUBLE, isFraud INT, split STRING")
    for row in records(metrics.split_evaluation(frame, 0.5), "split"):
        assert row["f1"] == pytest.approx(0.8) and row["pr_auc"] == pytest.approx(0.8333333333)


def test_focal_loss(spark):
    cases = [(0.0, 1), (3.0, 0), (-800.0, 0), (-50.0, 1)]
    frame = spark.createDataFrame(cases, "z DOUBLE, isFraud INT")

    def loss(z, y):
        bce = max(z, 0) - z * y + math.log1p(math.exp(-abs(z)))
        return (0.75 if y else 0.25) * (1 - math.exp(-bce)) ** 2 * bce

    found = one(metrics.mean_focal_loss(frame))["focal_loss"]
    assert found == pytest.approx(sum(loss(z, y) for z, y in cases) / 4)
