from __future__ import annotations

import pytest
from conftest import records

from pyspark.sql import functions as F

from ledgerloom.config import Split
from ledgerloom.functions.expressions import row_digest
from ledgerloom.functions.splits import proportional_bounds, split_flags, split_frames
from ledgerloom.operators import features, ingest, training
from ledgerloom.operators.pagerank import ranks_on_transactions


@pytest.fixture(scope="module")
def hub(make_tx):
    """One account at both ends of many rows, with equal steps and a gap."""
    rows = [{"nameOrig": "A", "nameDest": f"D{i % 3}", "step": s, "amount": float(i)} for i, s in enumerate((1, 1, 3, 7))]
    rows += [{"nameOrig": f"S{i}", "nameDest": "A", "step": 2 + i % 2, "amount": 50.0 + i} for i in range(9)]
    return ingest.with_row_id(make_tx(*rows))


def test_ratio_edges(make_tx):
    balances = [0.0, -5.0, None, 50.0]
    tx = ingest.with_row_id(make_tx(*[{"oldbalanceOrg": b, "amount": 100.0, "step": i} for i, b in enumerate(balances)]))
    rows = records(features.tabular_features(tx), "step")
    assert [r["amount_to_oldbalanceOrg_ratio"] for r in rows] == [0.0, 0.0, 0.0, 2.0]
    assert [r["orig_zero_before_txn"] for r in rows] == [1, 0, 0, 0]
    assert [r["deltaOrig"] for r in rows] == [-90.0, -95.0, None, -40.0]
    assert len(rows[0]) == 15


def test_history(hub):
    tx = hub.filter("nameOrig = 'A'")
    rows = records(features.degree_features(tx).join(tx, "txn_id"), "step")
    assert [r["src_prev_steps_out_count"] for r in rows] == [0, 0, 2, 3]
    assert [r["src_step_txn_count"] for r in rows] == [2, 2, 1, 1]
    assert {r["src_total_out_degree"] for r in rows} == {4}


def test_degree_sums(hub):
    assert features.degree_totals(hub, "nameOrig").agg(F.sum("degree")).first()[0] == 13
    assert features.degree_totals(hub, "nameDest").agg(F.sum("degree")).first()[0] == 13
    assert features.degree_features(hub).count() == hub.count()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_features_do_not_depend_on_partitions(hub, parts):
    expected = records(features.degree_features(hub), "txn_id")
    assert records(features.degree_features(hub.repartition(parts)), "txn_id") == expected


def test_training_rows_equal_the_joined_tables(spark, hub):
    ranks = spark.createDataFrame([("A", 0.5), ("D1", 0.1)], "id STRING, pagerank DOUBLE")
    joined = training.join_feature_tables(
        features.tabular_features(hub), features.degree_features(hub), ranks_on_transactions(hub, ranks)
    )
    direct = training.training_rows(hub, ranks)
    assert len(direct.columns) == 23 and direct.columns == joined.columns
    assert records(direct, "txn_id") == records(joined, "txn_id")


def test_copies_multiply_only_on_request(spark, make_tx):
    tx = ingest.with_row_id(make_tx({}, {}, {}))
    ranks = spark.createDataFrame([("A", 0.5)], "id STRING, pagerank DOUBLE")
    tables = features.tabular_features(tx), features.degree_features(tx), ranks_on_transactions(tx, ranks)
    with pytest.raises(training.DuplicateRows):
        training.join_feature_tables(*tables)
    assert training.join_feature_tables(*tables, allow_copies=True).count() == 27
    assert training.join_feature_tables(*tables, dedup=True).count() == 1
    assert training.training_rows(tx, ranks).count() == 3


def test_split_bounds(spark):
    ends = spark.createDataFrame([(24,), (3,), (2,), (1,)], "m INT").withColumns(proportional_bounds(F.col("m")))
    found = {r.m: (r.train_max, r.val_max, r.test_max) for r in ends.collect()}
    assert found == {24: (16, 19, 24), 3: (2, 2, 3), 2: (1, 2, 2), 1: (1, 1, 1)}


def test_splits(spark):
    steps = spark.createDataFrame([(480,), (481,), (600,), (601,), (None,)], "step INT")
    frames = split_frames(steps, Split())
    assert {n: sorted(str(r.step) for r in f.collect()) for n, f in frames.items()} == {
        "train": ["480"], "val": ["481", "600"], "test": ["601", "None"],
    }
    flags = steps.dropna().select(*[c.cast("int").alias(n) for n, c in split_flags(Split()).items()])
    assert all(sum(r) == 1 for r in flags.collect())


@pytest.mark.parametrize(("labels", "weight"), [([1, 1] + [0] * 6, 3.0), ([0] * 4, 4.0)])
def test_class_weight(make_tx, labels, weight):
    tx = make_tx(*[{"isFraud": y, "step": 1} for y in labels], {"isFraud": 1, "step": 700})
    assert training.positive_weight(tx.filter("step = 1")).first().pos_weight == weight
    rows = records(training.with_class_weight(tx, Split()))
    assert {r["class_weight"] for r in rows if r["isFraud"] == 1 and r["step"] == 1} == ({3.0} if 1 in labels else set())
    assert {r["class_weight"] for r in rows if r["isFraud"] == 0 or r["step"] == 700} == {1.0}
    counts = {r.isFraud: r.n for r in training.class_counts(tx).collect()}
    assert sum(counts.values()) == len(labels) + 1


@pytest.mark.parametrize("copies", [1, 2])
def test_training_rows_with_ids_worked_out_behind_the_joins(spark, hub, copies):
    tx = hub if copies == 1 else hub.unionByName(hub)
    ranks = spark.createDataFrame([("A", 0.4), ("D1", 0.1)], "id STRING, pagerank DOUBLE")
    moved, behind = training.training_rows(tx, ranks), training.training_rows(tx, ranks, row_digest())
    assert behind.columns == moved.columns and behind.count() == 13 * copies
    assert sorted(map(str, behind.collect())) == sorted(map(str, moved.collect()))
    # Nothing is left to be joined or moved when the rows are read.
    plan = behind._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("operator", ["degree", "rank"])
def test_each_side_is_joined_on_its_own(spark, hub, operator):
    """The rows behind the sender's join are stored, so reading the result joins one side only."""
    ranks = spark.createDataFrame([("A", 0.4), ("D1", 0.1)], "id STRING, pagerank DOUBLE")
    found = features.degree_features(hub) if operator == "degree" else ranks_on_transactions(hub, ranks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and found.count() == 13
