from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import graph


def least_reachable(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return {x: top(x) for x in parent}


@pytest.mark.parametrize(
    "edges",
    [
        [(1, 2), (2, 3), (5, 4), (9, 9)],
        [(i, i + 1) for i in range(40)],
        [(100, i) for i in range(50)] + [(-5, 100)],
        [tuple(map(int, p)) for p in np.random.default_rng(3).integers(0, 120, (90, 2))],
    ],
    ids=["small", "path", "star", "random"],
)
def test_components(spark, edges):
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = least_reachable([(a, b) for a, b in edges if a != b])
    assert sorted((r.node, r.root) for r in rows) == sorted(expected.items())


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [8192, 3])
def test_bucket_links_join_what_all_pairs_join(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 9, 60)).tolist()
    rows = [(p % 4, p) for p in prints]
    members = spark.createDataFrame(rows, "bucket long, print long")
    links = graph.bucket_links(members, "bucket", "print", ["print"], graph.near_prints(2)).collect()
    pairs = [(p, q) for b, p in rows for c, q in rows if b == c and p < q and bin(p ^ q).count("1") <= 2]
    assert all(r.b < r.a for r in links)
    assert least_reachable([(r.a, r.b) for r in links]) == least_reachable(pairs)


def test_bucket_links_of_a_hot_bucket_stay_a_forest(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK", 1024)
    members = spark.range(1500).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("print"))
    links = graph.bucket_links(members, "bucket", "print", ["print"], graph.near_prints(2))
    # Three groups of chunks, each with at most two chunks' nodes less one.
    assert links.count() < 2 * 1500
    assert graph.components(links).select("root").distinct().count() == 1


def test_joined_trees_lose_no_part():
    """Many pairs of one step join trees of several levels; all rows stay with what they were joined to."""
    rng = np.random.default_rng(7)
    nodes, met = rng.permutation(400), np.zeros((400, 400), bool)
    for step in (80, 81):
        rows = np.flatnonzero(rng.random(400 - step) < 0.9)
        met[rows, rows + step] = True
    rows, roots = graph._linked({}, np.zeros(400, int), lambda i, j: np.ones(len(i), bool), lambda _, i, j: met[i, j], nodes)
    assert least_reachable(zip(nodes[rows], nodes[roots])) == least_reachable([(nodes[i], nodes[j]) for i, j in zip(*np.nonzero(met))])
