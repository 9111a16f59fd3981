from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph_learning as gl
from ledgerloom.operators.learning import fit_edge_model
from ledgerloom.operators.metrics import average_precision
from ledgerloom.operators.neighbors import EdgeScorer, edge_rows, score_edges

NODES, EDGES = ["x0", "x1", "x2"], ["e0", "e1"]


def toy(seed: int, n: int = 14, m: int = 40):
    """Node features, edges (with parallel ones and a loop) and labels; the last nodes hear nobody, one is alone."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NODES)))
    src, dst = rng.integers(0, n - 1, m), rng.integers(0, n - 4, m)
    src[1], dst[1] = src[0], dst[0]
    src[2] = dst[2]
    return x, src, dst, rng.normal(size=(m, len(EDGES))), rng.integers(0, 2, m).astype(float)


def frames(spark, x, src, dst, e, y, splits=None):
    nodes = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id LONG, " + ", ".join(f"{c} DOUBLE" for c in NODES))
    rows = [(int(s), int(t), *map(float, a), int(label), splits[i] if splits else "train") for i, (s, t, a, label) in enumerate(zip(src, dst, e, y))]
    edges = spark.createDataFrame(rows, "src LONG, dst LONG, " + ", ".join(f"{c} DOUBLE" for c in EDGES) + ", isFraud INT, split STRING")
    return nodes, edges.repartition(3)


def plain_logits(scorer: EdgeScorer, x, src, dst, e):
    """The forward pass with a dense table of who hears whom."""
    heard = np.zeros((len(x), len(x)))
    np.add.at(heard, (dst, src), 1.0)
    mean = heard / np.maximum(heard.sum(axis=1, keepdims=True), 1.0)
    first = np.maximum(mean @ x @ scorer.neighbor_1.T + scorer.bias_1 + x @ scorer.own_1.T, 0)
    second = np.maximum(mean @ first @ scorer.neighbor_2.T + scorer.bias_2 + first @ scorer.own_2.T, 0)
    inputs = np.concatenate([second[src], second[dst], e], axis=1)
    return (np.maximum(inputs @ scorer.dense_1.T + scorer.dense_bias_1, 0) @ scorer.dense_2.T + scorer.dense_bias_2)[:, 0]


def plain_loss(scorer, x, src, dst, e, y):
    p = 1 / (1 + np.exp(-plain_logits(scorer, x, src, dst, e)))
    right = np.where(y > 0, p, 1 - p)
    return float(np.mean(np.where(y > 0, 0.75, 0.25) * (1 - right) ** 2 * -np.log(right)))


def test_gradient_equals_finite_differences(spark):
    data = toy(3)
    nodes, edges = frames(spark, *data)
    graph = gl.TrainingGraph.store(nodes, edges, NODES, EDGES)
    scorer = gl.initial_scorer(len(NODES), len(EDGES), 4, seed=2)
    loss, gradient = gl.loss_and_gradient(graph, scorer)
    assert loss == pytest.approx(plain_loss(scorer, *data))
    weights = gl.flat(gl.weights_of(scorer))
    step = 1e-5
    for i in range(len(weights)):
        moved = [plain_loss(gl.unflat(weights + s * step * (np.arange(len(weights)) == i), scorer), *data) for s in (1, -1)]
        assert gradient[i] == pytest.approx((moved[0] - moved[1]) / (2 * step), abs=1e-7), i
    assert np.abs(gradient).max() > 1e-3


def test_training_equals_plain_training(spark):
    """Three epochs of the fit and of the same steps in one process."""
    data = toy(5)
    nodes, edges = frames(spark, *data)
    model = gl.fit_sage(edges, nodes, NODES, EDGES, hidden=3, epochs=3, every=3, rate=0.01, seed=4)
    scorer = gl.initial_scorer(len(NODES), len(EDGES), 3, seed=4)
    weights, adam, losses = gl.flat(gl.weights_of(scorer)), gl.Adam(0.01), []
    for _ in range(3):
        losses.append(plain_loss(gl.unflat(weights, scorer), *data))
        unit = np.eye(len(weights)) * 1e-6
        slope = [(plain_loss(gl.unflat(weights + u, scorer), *data) - plain_loss(gl.unflat(weights - u, scorer), *data)) / 2e-6 for u in unit]
        weights = adam.move(weights, np.array(slope))
    assert model.losses == pytest.approx(losses, abs=1e-6) and losses[2] < losses[0]
    scored = score_edges(edges, nodes, NODES, EDGES, model.scorer, ["src", "dst"])
    x, src, dst, e, _ = data
    expected = sorted(zip(src.tolist(), dst.tolist(), plain_logits(model.scorer, x, src, dst, e).tolist()))
    for got, want in zip(sorted(map(tuple, scored.collect())), expected):
        assert got == pytest.approx(want)


def chains(seed: int):
    """A hears nobody, B hears A, C hears B, and an edge from C to D is fraud by the sign of C's senders' senders."""
    rng = np.random.default_rng(seed)
    a, b, c, d = range(0, 40), range(40, 80), range(80, 160), range(160, 170)
    sign = np.where(rng.random(170) < 0.35, 1, -1)
    x = np.zeros((170, len(NODES)))
    x[:, 1], x[:40, 0] = 1, sign[:40]
    rows = []
    for layer, before in ((b, a), (c, b)):
        for v in layer:
            rows += [(int(u), v, 0, "train") for u in rng.choice([u for u in before if sign[u] == sign[v]], 4)]
    for v in c:
        rows += [(v, int(rng.choice(list(d))), int(sign[v] > 0), part) for part in ["train"] * 4 + ["val", "test"]]
    src, dst, y, splits = map(list, zip(*rows))
    return x, np.array(src), np.array(dst), rng.normal(size=(len(rows), len(EDGES))), np.array(y, float), splits


def test_learned_layers_beat_fixed_means(spark):
    """Fraud depends on accounts two hops away; held-out area above that of a perceptron on one-hop means."""
    nodes, edges = frames(spark, *chains(9))
    model = gl.fit_sage(edges, nodes, NODES, EDGES, hidden=8, epochs=14, every=7, rate=0.05)
    assert model.losses[-1] < 0.2 * model.losses[0]
    tested = gl.sage_report(model, edges, nodes, NODES, EDGES)
    learned = average_precision(tested).first().average_precision
    rows, columns = edge_rows(edges, nodes, NODES)
    fixed = fit_edge_model(rows, [*EDGES, *columns]).probabilities(rows.filter("split = 'test'"), ["isFraud"], "p")
    assert learned > 0.95 and learned > 1.5 * average_precision(fixed).first().average_precision


def test_no_training_edges(spark):
    nodes, edges = frames(spark, *toy(1))
    model = gl.fit_sage(edges.withColumn("split", F.lit("test")), nodes, NODES, EDGES, hidden=2, epochs=1)
    assert model.losses == (0.0,) and gl.sage_report(model, edges, nodes, NODES, EDGES).count() == 0


def test_an_epoch_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """What the steps of an epoch hand on is stored, not kept by the session, and goes with the epoch."""
    nodes, edges = frames(spark, *toy(5))
    graph = gl.TrainingGraph.store(nodes, edges, NODES, EDGES)
    monkeypatch.setattr(gl, "scratch_path", lambda *_: str(tmp_path / "epoch"))
    written, store = [], gl.store
    monkeypatch.setattr(gl, "store", lambda df, path, codec: written.append(path) or store(df, path, codec))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    gl.loss_and_gradient(graph, gl.initial_scorer(len(NODES), len(EDGES), 4, seed=2))
    assert len(written) == 3 and not (tmp_path / "epoch").exists()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_only_the_asked_split_is_scored(spark):
    x, src, dst, e, y = toy(6)
    nodes, edges = frames(spark, x, src, dst, e, y, [("train", "val", "test")[i % 3] for i in range(len(y))])
    model = gl.SageModel(gl.initial_scorer(len(NODES), len(EDGES), 4, seed=3), 0.5, ())
    some = model.probabilities(edges, nodes, NODES, EDGES, ["split", "isFraud"], "val").collect()
    every = model.probabilities(edges, nodes, NODES, EDGES, ["split", "isFraud"]).filter("split = 'val'").collect()
    assert len(some) == 13 and sorted(r.p for r in some) == pytest.approx(sorted(r.p for r in every), abs=1e-12)
