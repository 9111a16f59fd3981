from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import records
from pyspark.sql import functions as F

from ledgerloom.operators import eda


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(x), None if i % 7 == 0 else float(x + y), 5, None if i % 5 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c INT, d DOUBLE").repartition(6)


def test_histogram_closes_the_last_bin(spark):
    rows = records(eda.histogram(spark.range(101), F.col("id")), "bin")
    counts = {r["bin"]: r["n"] for r in rows}
    assert counts == {**dict.fromkeys(range(49), 2), 49: 3}
    assert {round(r["hi"] - r["lo"], 9) for r in rows} == {2.0}
    constant = records(eda.histogram(spark.range(3).withColumn("x", F.lit(4.0)), F.col("x")))
    assert sum(r["n"] for r in constant) == 3 and len(constant) == 50


def test_correlation_matches_pairwise_complete(gaps):
    expected = gaps.toPandas().corr()
    for row in eda.correlation(gaps).collect():
        want = expected.loc[row.col_a, row.col_b]
        assert (row.r is None) == bool(pd.isna(want)), row
        if row.r is not None:
            assert row.r == pytest.approx(want)
    assert eda.correlation(gaps).count() == 16


def test_describe(gaps):
    expected = gaps.toPandas().describe()
    for row in records(eda.describe(gaps)):
        want = expected[row.pop("column")]
        assert list(row.values()) == pytest.approx(list(want))


def test_profile_and_missing(gaps):
    rows = {r["column"]: r for r in records(eda.schema_profile(gaps))}
    assert rows["b"] == {"column": "b", "dtype": "double", "rows": 200, "non_null": 171}
    assert {r["column"]: r["n_missing"] for r in records(eda.missing_values(gaps))} == {"a": 0, "b": 29, "c": 0, "d": 40}


def test_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    frame = spark.createDataFrame([(1, v) for v in values] + [(0, 1.0), (None, 3.0)], "isFraud INT, v DOUBLE")
    rows = {r["isFraud"]: r for r in records(eda.box_statistics(frame, F.col("v")))}
    assert rows[1] == {
        "isFraud": 1, "q25": 2.0, "q50": 3.0, "q75": 4.0, "whisker_low": 1.0, "whisker_high": 4.0, "n_outliers": 1,
    }
    assert set(rows) == {0, 1}


def test_counts_and_tops(make_tx):
    tx = make_tx(*[{"nameOrig": n, "isFraud": f, "type": t} for n, f, t in (("B", 1, "X"), ("A", 1, "Y"), ("B", 1, "Y"), ("C", 0, "Y"))])
    assert [(r.type, r.n) for r in eda.value_counts(tx, "type").collect()] == [("Y", 3), ("X", 1)]
    assert [(r.account, r.n) for r in eda.top_fraud(tx, "nameOrig").collect()] == [("B", 2), ("A", 1)]
    assert records(eda.crosstab(tx), "type") == [{"type": "X", "n0": 0, "n1": 1}, {"type": "Y", "n0": 1, "n1": 2}]
    rates = {r["type"]: r for r in records(eda.crosstab_rate(tx))}
    assert rates["Y"]["r1"] == pytest.approx(2 / 3)
    assert eda.fraud_ratio(tx).first().fraud_ratio == 0.75
    assert eda.summary(tx).first().types == ["X", "Y"]
    assert eda.head(tx, ["nameOrig"], 2).count() == 2
    profile = records(eda.degree_profile(tx, "nameOrig"))[0]
    assert (profile["count"], profile["mean"], profile["max"]) == (3, pytest.approx(4 / 3), 2.0)
