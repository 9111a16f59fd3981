from __future__ import annotations

import pytest
from conftest import records
from pyspark.sql import functions as F

from ledgerloom.operators import accounts, ingest


def test_ids_follow_first_appearance(make_tx):
    tx = make_tx({"step": 1, "nameOrig": "A", "nameDest": "B"}, {"step": 2, "nameOrig": "C", "nameDest": "A"})
    ids = accounts.account_ids(tx, order=("step",))
    assert {r.account: r.node_id for r in ids.collect()} == {"A": 0, "C": 1, "B": 2}
    mapped = accounts.map_accounts(tx, ids)
    assert [(r["orig_id"], r["dest_id"]) for r in records(mapped, "step")] == [(0, 2), (1, 0)]


def test_ids_are_dense_and_repeatable(make_tx):
    rows = [{"step": i % 11, "nameOrig": f"s{i % 40}", "nameDest": f"d{i % 17}", "amount": float(i)} for i in range(200)]
    tx = ingest.with_row_id(make_tx(*rows))
    first = {r.account: r.node_id for r in accounts.account_ids(tx).collect()}
    again = {r.account: r.node_id for r in accounts.account_ids(tx.repartition(13)).collect()}
    assert first == again and sorted(first.values()) == list(range(57))


def test_edge_features(make_tx):
    tx = make_tx({"amount": 0.0, "type": "TRANSFER"}, {"amount": 1.0, "type": None})
    mapped = tx.withColumns({"orig_id": F.lit(0), "dest_id": F.lit(1)})
    rows = records(accounts.edge_features(mapped), "log_amount")
    assert [r["is_transfer"] for r in rows] == [1, 0]
    assert rows[0]["log_amount"] == 0.0 and rows[0]["errorBalanceOrig"] == -10.0 and rows[0]["errorBalanceDest"] == -10.0
    assert list(rows[0]) == ["orig_id", "dest_id", "step", *accounts.EDGE_ATTRIBUTES, "isFraud"]


def test_node_activity_covers_the_spine(spark):
    mapped = spark.createDataFrame([(0, 3, 5.0), (0, 3, 7.0), (3, 1, 1.0)], "orig_id LONG, dest_id LONG, amount DOUBLE")
    rows = records(accounts.node_activity(mapped), "node_id")
    assert [tuple(r.values()) for r in rows] == [
        (0, 2, 12.0, 0, 0.0), (1, 0, 0.0, 1, 1.0), (2, 0, 0.0, 0, 0.0), (3, 1, 1.0, 2, 12.0),
    ]
    with_rank = records(accounts.node_features(mapped), "node_id")
    assert with_rank[2]["pagerank"] == 0.0
    assert sum(r["pagerank"] for r in with_rank) == pytest.approx(1.0)


def test_scaling_uses_population_std_and_keeps_constants(spark):
    rows = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.1)], "x INT, c DOUBLE")
    scaled = records(accounts.standardize(rows, ["x", "c"]), "x")
    assert sorted(r["x"] for r in scaled) == pytest.approx([-1.2247448714, 0, 1.2247448714])
    assert [r["c"] for r in scaled] == pytest.approx([0, 0, 0], abs=1e-12)


def test_edge_normalization_uses_training_rows_only(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 3.0, 5.0), (9, 4.0, 5.0)], "step INT, a DOUBLE, b DOUBLE")
    stats = accounts.edge_statistics(rows, F.col("step") == 1, ["a", "b"])
    found = records(accounts.normalize_edges(rows, stats, ["a", "b"]), "step")
    assert found[-1] == {"step": 9, "a": 2.0, "b": 0.0}
    assert stats.first().b_std == 1e-6
