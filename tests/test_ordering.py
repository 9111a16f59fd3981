from __future__ import annotations

import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import number_rows, percentiles, running_totals


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_positions_are_dense(spark, parts):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(parts)
    found = number_rows(rows, ["k"], "n").collect()
    assert all(r.k == r.n for r in found) and len(found) == 500


def test_running_totals_restart_per_group(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    found = records(running_totals(rows.repartition(6), [F.desc("k")], ["v"], ["g"]))
    for row in found:
        assert row["v_so_far"] == sum(k % 5 for k in range(row["k"], 300) if k % 3 == row["g"])


def test_percentiles_match_brute_force(spark):
    """A third of the values are equal and one group holds most rows."""
    rng = np.random.default_rng(3)
    data = [("big", 7.5)] * 300 + [("big", float(x)) for x in rng.normal(size=600)] + [("one", 2.0), ("two", 1.0), ("two", 4.0)]
    frame = spark.createDataFrame([*data, ("big", None)], "g STRING, x DOUBLE").repartition(9)
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for row in percentiles(frame, "x", wanted, ["g"]).collect():
        values = [x for g, x in data if g == row.g]
        assert [row[n] for n in wanted] == pytest.approx([np.percentile(values, 100 * q) for q in wanted.values()])
    whole = percentiles(frame, "x", wanted).first()
    assert [whole[n] for n in wanted] == pytest.approx([np.percentile([x for _, x in data], 100 * q) for q in wanted.values()])
    rough = percentiles(frame, "x", {"p50": 0.5}, ["g"], approximate=True)
    assert {r.g for r in rough.collect()} == {"big", "one", "two"}
