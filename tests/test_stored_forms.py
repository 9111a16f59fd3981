"""Day sketches and bucketed feature tables."""

from __future__ import annotations

import time

import pytest
from conftest import records
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import accounts, features, ingest, sketches, training
from ledgerloom.plans import queries
from ledgerloom.session import FREE_KEY, materialize
from ledgerloom.sources import sample
from ledgerloom.sources.schema import TRANSACTION_COLUMNS
from ledgerloom.sources.writers import day_of, write_by_day


def test_sketches_of_any_days(spark, small_dir):
    tx = sample.silver_transactions(spark, small_dir)
    stored = sketches.daily_sketches(tx).persist()
    for low, high in ((0, 10_000), (3, 3), (5, 20)):
        inside = tx.filter(f"(step - 1) div 24 between {low} and {high}")
        got, exact = sketches.summary_of_days(stored, low, high).first(), ingest.ingest_summary(inside).first()
        assert [got[c] for c in exact.__fields__[:4]] == [exact[c] for c in exact.__fields__[:4]]
        for side, account in sketches.SIDES.items():
            distinct = inside.select(account).distinct().count()
            assert got[f"approx_distinct_{side}"] == pytest.approx(distinct, rel=0.03)
    nothing = sketches.summary_of_days(stored, -9, -5).first()
    assert (nothing.total_rows, nothing.min_step, nothing.approx_distinct_senders) == (0, None, 0)
    stored.unpersist()


def test_bucketed_tables_join_where_they_lie(spark, make_tx, tmp_path):
    tx = ingest.ingest(make_tx(*[{"step": i % 9, "amount": float(i), "nameOrig": f"a{i % 5}"} for i in range(1, 200)]))
    ranks = tx.select("txn_id", F.lit(0.5).alias("src_pagerank"), F.lit(0.25).alias("dst_pagerank"))
    parts = {"t": features.tabular_features(tx), "d": features.degree_features(tx).filter("src_step_txn_count > 4"), "r": ranks}
    tables = [training.write_bucketed(part, f"bucketed_{name}", str(tmp_path / name), 4) for name, part in parts.items()]
    joined = training.join_bucketed(*tables)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert records(joined, "txn_id") == records(training.join_feature_tables(*parts.values()).select(*joined.columns), "txn_id")
    for name in parts:
        spark.sql(f"DROP TABLE bucketed_{name}")


def test_packed_ids_come_back_as_they_were(spark):
    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest + "\n", digest[:-1], "", "a", "ä" * 16, "x" * 32, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "place INT, txn_id STRING")
    packed = training.with_packed_id(rows)
    assert packed.agg(F.count_distinct("txn_id"), F.min(F.octet_length("txn_id"))).first()[:] == (8, 32)
    assert [r.txn_id for r in training.with_text_id(packed).orderBy("place").collect()] == texts


def test_buckets_grow_with_the_rows():
    assert training.bucket_count(60_000, 16) == 16
    assert training.bucket_count(216_000_000, 16) == 216


def test_row_ids_do_not_move(spark, small_dir):
    """Neither to the day folders nor into the learning queries."""
    tx = sample.silver_transactions(spark, small_dir)
    plain = ingest.ingest(sample.raw_transactions(spark, small_dir), canonical="cents")
    assert tx.columns == plain.columns
    assert tx.exceptAll(plain).isEmpty() and plain.exceptAll(tx).isEmpty()
    assert "txn_id" not in queries.training_layer(spark, small_dir).columns


def test_unique_ids_are_told_by_their_hashes(spark):
    for ids, unique in ((["a", "b", None], True), (["a", "b", "a"], False), ([None, None], False)):
        rows = spark.createDataFrame([(i,) for i in ids], "txn_id STRING")
        if unique:
            training.require_unique_ids(rows)
        else:
            with pytest.raises(training.DuplicateRows):
                training.require_unique_ids(rows)


def test_stored_transactions_hold_no_derived_id(spark, small_dir):
    """The id is worked out on reading, the second balances behind the shuffle by day: the files hold neither twice."""
    tx = sample.silver_by_day(spark, small_dir)
    held = spark.read.parquet(tx.inputFiles()[0].rsplit("/day=", 1)[0])
    assert held.columns == [*TRANSACTION_COLUMNS, "day"]
    assert "sha2" not in tx.groupBy("day").count()._jdf.queryExecution().optimizedPlan().toString()


def test_stored_transactions_are_not_dealt_by_day(spark, small_dir, monkeypatch):
    """They are written where orders and lines met: the last shuffle behind the files is the one by order."""
    plans = []

    def write(df, path, rebalance=True, finish=None, codec=None):
        dated = finish(df.withColumn("day", day_of()))
        plans.append((dated.hint("rebalance", "day") if rebalance else dated)._jdf.queryExecution().optimizedPlan().toString())
        write_by_day(df, path, rebalance, finish, codec)

    monkeypatch.setattr(sample, "write_by_day", write)
    monkeypatch.setattr(sample, "_stored", {})
    tx = sample.silver_by_day(spark, small_dir)
    assert len(plans) == 1 and "Rebalance" not in plans[0]
    held = spark.read.parquet(tx.inputFiles()[0].rsplit("/day=", 1)[0])
    one = held.withColumns({"file": F.input_file_name(), "place": F.monotonically_increasing_id()})
    before = F.lag("step").over(Window.partitionBy("file").orderBy("place"))
    assert one.withColumn("before", before).filter("step < before").isEmpty()
    assert held.count() == sample.raw_transactions(spark, small_dir).count()


def _below_joins(df) -> str:
    """The part of the plan under its topmost join."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    return plan.split("Join", 1)[1]


def test_row_ids_do_not_travel_with_mapped_rows(spark, small_dir):
    """They are worked out behind the joins with the account ids, also where stored edges are read."""
    tx = sample.silver_transactions(spark, small_dir)
    mapped = queries._mapped(tx)
    assert "sha2" not in _below_joins(mapped)
    plain = accounts.map_accounts(ingest.high_risk(tx), accounts.account_ids(ingest.high_risk(tx)))
    assert mapped.columns == plain.columns
    assert mapped.exceptAll(plain).isEmpty() and plain.exceptAll(mapped).isEmpty()
    edges = queries.edges_layer(spark, small_dir)
    assert "txn_id" not in spark.read.parquet(*edges.inputFiles()).columns
    keep = ["txn_id", "nameOrig", "nameDest", "amount"]
    fresh = accounts.edge_features(plain, keep)
    assert edges.columns == fresh.columns
    assert edges.exceptAll(fresh).isEmpty() and fresh.exceptAll(edges).isEmpty()


def test_derived_rows_with_gaps(spark, tmp_path):
    """Cells of order lines, orders, customers and parts may be null; the columns follow the plain formulas."""
    day = "TIMESTAMP '1997-03-05 00:00:00'"
    cells = {
        "lineitem": [
            ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_returnflag STRING"),
            [(1, 5, 7, 3.0, 60000.0, "R"), (1, 5, 7, 3.0, 60000.0, None), (1, 5, None, None, None, "R"), (2, 5, 7, None, 10.5, "N"),
             (3, 6, 8, 2.0, -4.25, "A"), (3, 6, 8, 2.0, None, "A"), (4, 6, 8, 2.0, 9.0, "R"), (2, None, 7, 1.0, 1.0, "N")],
        ],
        "orders": [
            "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderpriority STRING",
            [(1, 1, 50000.5, "1-URGENT"), (2, 2, 20.25, None), (3, 3, None, "2-HIGH"), (4, 1, 9.0, "2-HIGH")],
        ],
        "customer": ["c_custkey BIGINT, c_acctbal DOUBLE", [(1, 0.0), (2, -1.0), (3, None)]],
        "part": ["p_partkey BIGINT, p_retailprice DOUBLE", [(5, 10.335), (6, None)]],
    }
    for name, (schema, rows) in cells.items():
        table = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            table = table.withColumn("l_shipdate", F.expr(day))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        table.createOrReplaceTempView(f"gap_{name}")
    plain = spark.sql("""
      SELECT CAST(1 + (datediff(CAST(l_shipdate AS DATE), DATE '1995-01-01') * 744) div 2500 AS INT) AS step,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT'
             WHEN '3-MEDIUM' THEN 'PAYMENT' WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' ELSE 'DEBIT' END AS type,
        l_extendedprice AS amount, 'C' || CAST(o_custkey AS STRING) AS nameOrig,
        CASE WHEN c_acctbal < 0 THEN 0.0D ELSE o_totalprice END AS oldbalanceOrg,
        CASE WHEN c_acctbal < 0 THEN 0.0D ELSE round(greatest(o_totalprice - l_extendedprice, 0.0D), 2) END AS newbalanceOrig,
        CASE WHEN l_returnflag = 'R' THEN 'M' || CAST(l_suppkey AS STRING)
             ELSE 'C' || CAST(2 * (l_partkey div 2) AS STRING) END AS nameDest,
        CASE WHEN l_returnflag = 'R' THEN 0.0D ELSE round(p_retailprice * l_quantity, 2) END AS oldbalanceDest,
        CASE WHEN l_returnflag = 'R' THEN 0.0D
             ELSE round(round(p_retailprice * l_quantity, 2) + l_extendedprice, 2) END AS newbalanceDest,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_acctbal >= 0
              AND l_extendedprice >= o_totalprice THEN 1 ELSE 0 END AS isFraud,
        CASE WHEN o_orderpriority = '1-URGENT' AND c_acctbal >= 0
              AND l_extendedprice >= o_totalprice AND l_extendedprice > 50000 THEN 1 ELSE 0 END AS isFlaggedFraud
      FROM gap_lineitem JOIN gap_orders ON l_orderkey = o_orderkey JOIN gap_customer ON o_custkey = c_custkey
      JOIN gap_part ON l_partkey = p_partkey""")
    got = sample.raw_transactions(spark, str(tmp_path))
    assert got.columns == plain.columns and plain.count() == 7
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    kept = ingest.ingest(plain, canonical="cents")
    stored = sample.silver_transactions(spark, str(tmp_path))
    assert kept.count() == 6 and stored.exceptAll(kept).isEmpty() and kept.exceptAll(stored).isEmpty()


def test_stored_layers_leave_no_shuffle_files(spark):
    def files() -> int:
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle" in local.apply(k).getName() for k in range(local.size()))

    before = files()
    rows = spark.range(10_000).selectExpr("id % 97 AS k", "id").repartition(4, "k").groupBy("k").agg(F.max("id").alias("top"))
    layer = materialize(rows, "freed")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert layer.count() == 97 and rows.count() == 97
    assert spark.conf.get(FREE_KEY) == "false"
