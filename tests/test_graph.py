from __future__ import annotations

import os

import pytest
from conftest import pairs, records
from pyspark.sql import functions as F

from ledgerloom.operators import graph, ingest, pagerank

EXAMPLE = [("A", "B"), ("A", "B"), ("A", "C"), ("B", "C"), ("C", "C"), ("D", "A"), ("B", "E")]


@pytest.fixture(scope="module")
def example(spark):
    return pairs(spark, *EXAMPLE)


def ranks_of(df):
    return {r.id: r.pagerank for r in df.collect()}


def test_roles(make_tx):
    tx = ingest.with_row_id(make_tx(*[{"nameOrig": a, "nameDest": b} for a, b in ("AB", "BC", "DD")]))
    rows = {r["id"]: r for r in records(graph.vertices(tx))}
    assert {k: v["vertex_role"] for k, v in rows.items()} == {
        "A": "sender_only", "B": "both", "C": "receiver_only", "D": "both",
    }
    assert (rows["A"]["is_sender"], rows["A"]["is_receiver"]) == (1, 0)
    edges = graph.edges(tx)
    assert edges.columns[:3] == ["txn_id", "src", "dst"] and len(edges.columns) == 12
    assert graph.self_loops(edges).count() == 1
    assert records(graph.graph_summary(graph.vertices(tx), edges)) == [
        {"vertex_count": 4, "edge_count": 3, "self_loops": 1, "distinct_pairs": 3}
    ]


def test_edges_drop_missing_ends(make_tx):
    tx = ingest.with_row_id(make_tx({}, {"nameDest": None}))
    assert graph.edges(tx).count() == 1


def test_transition_and_dangling(example):
    shares = graph.transition_probabilities(example)
    assert {(r.src, r.dst): round(r.transition_prob, 6) for r in shares.collect()} == {
        ("A", "B"): 0.666667, ("A", "C"): 0.333333, ("B", "C"): 0.5, ("B", "E"): 0.5, ("C", "C"): 1.0, ("D", "A"): 1.0,
    }
    assert [r.id for r in graph.dangling(example).collect()] == ["E"]
    assert sorted(r.id for r in graph.vertex_ids(example).collect()) == list("ABCDE")


def test_one_weighted_round(example):
    result = pagerank.rank_accounts(example, max_rounds=1)
    assert ranks_of(result.ranks) == pytest.approx(
        {"A": 0.234, "B": 0.1773333333, "C": 0.3756666667, "D": 0.064, "E": 0.149}, abs=1e-9
    )
    assert result.deltas[0][1] == pytest.approx(0.4193333333, abs=1e-9)


TEN_ROUNDS = {"A": 0.0819584783, "B": 0.0909359128, "C": 0.6997631483, "D": 0.044225692, "E": 0.0831167687}


@pytest.mark.parametrize("heavy_pairs", [None, 1])
def test_ten_weighted_rounds_with_and_without_heavy_sources(example, heavy_pairs):
    result = pagerank.rank_accounts(example, heavy_pairs=heavy_pairs)
    assert ranks_of(result.ranks) == pytest.approx(TEN_ROUNDS, abs=1e-9)
    assert len(result.deltas) == 10 and result.vertex_count == 5
    assert sum(ranks_of(result.ranks).values()) == pytest.approx(1.0, abs=1e-9)


def test_unweighted_stops_at_tolerance(example):
    result = pagerank.rank_accounts(example, max_rounds=100, weighted=False, tolerance=1e-6)
    assert len(result.deltas) == 21
    assert ranks_of(result.ranks) == pytest.approx(
        {"A": 0.0791795684, "B": 0.0764511949, "C": 0.7262778855, "D": 0.0427996836, "E": 0.0752916676}, abs=1e-9
    )


def test_rank_errors(spark, example):
    with pytest.raises(pagerank.EmptyGraph):
        pagerank.weighted_rank(pairs(spark, ("A", "B")).limit(0))
    with pytest.raises(pagerank.NotConverged):
        pagerank.unweighted_rank(example, max_rounds=2)


def test_hot_sender_and_receiver(spark):
    """A third of all pairs leave one account and a third reach one; the split path
    must give the plain path's ranks."""
    out = [("hub", f"a{i}") for i in range(300)]
    into = [(f"b{i}", "sink") for i in range(300)]
    rest = [(f"a{i}", f"b{i}") for i in range(300)]
    edges = pairs(spark, *out, *into, *rest)
    split = ranks_of(pagerank.rank_accounts(edges, max_rounds=4, heavy_pairs=50).ranks)
    plain = ranks_of(pagerank.rank_accounts(edges.repartition(7), max_rounds=4).ranks)
    assert split == pytest.approx(plain, abs=1e-12) and len(split) == 602


def test_ranks_reach_transactions(make_tx, spark):
    tx = ingest.with_row_id(make_tx({"nameOrig": "A", "nameDest": "Z"}))
    ranks = spark.createDataFrame([("A", 0.4)], "id STRING, pagerank DOUBLE")
    row = pagerank.ranks_on_transactions(tx, ranks).first()
    assert (row.src_pagerank, row.dst_pagerank) == (0.4, 0.0)


def test_training_edges_stop_at_the_bound(spark):
    edges = spark.createDataFrame([("A", "B", 480), ("A", "C", 481)], "src STRING, dst STRING, step INT")
    assert [r.dst for r in pagerank.training_edges(edges, 480).collect()] == ["B"]
    trace = pagerank.convergence_trace(edges, pagerank.RankResult(edges, [(1, 0.5)], 2))
    assert trace.select(F.round("l1_delta", 2)).first()[0] == 0.5


def test_only_the_last_round_stays(spark, example, monkeypatch):
    """Every round is a table of its own, and the one before is gone once it is written."""
    written, store = [], pagerank.store
    monkeypatch.setattr(pagerank, "store", lambda df, path, codec: written.append(path) or store(df, path, codec))
    result = pagerank.rank_accounts(example, max_rounds=4)
    folders = [path.removeprefix("file:") for path in written]
    assert [os.path.isdir(f) for f in folders] == [False, False, False, True] and result.ranks.count() == 5
