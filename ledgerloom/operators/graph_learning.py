"""Training of the two-layer edge scorer: full-graph gradients as joins and aggregations.

An epoch is a pass over the whole graph, in a few jobs. Forward, a layer is the mean over incoming edges
and a matrix product per Arrow batch. Backward, what a node's mean contributed to the loss is sent
back along the reversed edges and summed per sender. The weights' gradients are sums over rows:
each task adds up its own, ``MERGERS`` tasks add up the tasks', and the driver reads those few rows
(their size depends on the layer widths only). The first layer hears node features, which do
not change, so its means are stored once. Sums are combined before every shuffle; joins are plain,
so adaptive execution splits an account with very many edges.

The objective is the mean focal loss of the training edges, heard along training edges only;
epochs are judged on validation edges along all edges, and the best weights are kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import sigmoid
from ledgerloom.operators.metrics import best_threshold, threshold_sweep
from ledgerloom.operators.neighbors import EdgeScorer, neighbor_mean, score_edges
from ledgerloom.session import discard, materialize, scratch_path, shuffles_freed, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Weight of fraud and focus of the loss; the optimizer's rate and decay.
ALPHA, GAMMA = 0.75, 2.0
RATE, DECAY = 0.005, 1e-4
MERGERS = 16
CODEC = "zstd"


def shapes(node_width: int, edge_width: int, hidden: int) -> list[tuple[int, ...]]:
    """Of an ``EdgeScorer``'s weights, in the order of its fields."""
    layer = [(hidden, node_width), (hidden,), (hidden, node_width), (hidden, hidden), (hidden,), (hidden, hidden)]
    return [*layer, (hidden, 2 * hidden + edge_width), (hidden,), (1, hidden), (1,)]


def initial_scorer(node_width: int, edge_width: int, hidden: int, seed: int = 7) -> EdgeScorer:
    """Uniform weights within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    inputs = [node_width] * 3 + [hidden] * 3 + [2 * hidden + edge_width] * 2 + [hidden] * 2
    bounds = [1 / np.sqrt(n) for n in inputs]
    return EdgeScorer(*[rng.uniform(-b, b, s) for b, s in zip(bounds, shapes(node_width, edge_width, hidden))])


def weights_of(scorer: EdgeScorer) -> list[np.ndarray]:
    return [getattr(scorer, f.name) for f in fields(scorer)]


def flat(weights: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.reshape(-1) for w in weights])


def unflat(vector: np.ndarray, like: EdgeScorer) -> EdgeScorer:
    parts, start = [], 0
    for w in weights_of(like):
        parts.append(vector[start : start + w.size].reshape(w.shape))
        start += w.size
    return EdgeScorer(*parts)


def focal(logit: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, its derivative by the logit) per row."""
    sign = np.where(label > 0, 1.0, -1.0)
    entropy = np.logaddexp(0.0, -sign * logit)
    right = np.exp(-entropy)
    weight = np.where(label > 0, ALPHA, 1 - ALPHA) * (1 - right) ** GAMMA
    return weight * entropy, -sign * weight * (GAMMA * right * entropy + 1 - right)


@dataclass(frozen=True)
class TrainingGraph:
    """Stored once: nodes with their features, the means they hear and the number of edges they hear;
    training edges with attributes and label; the messages (src, dst)."""

    nodes: DataFrame
    edges: DataFrame
    messages: DataFrame
    node_columns: tuple[str, ...]
    edge_columns: tuple[str, ...]
    count: int

    @staticmethod
    def store(nodes: DataFrame, edges: DataFrame, node_columns: Sequence[str], edge_columns: Sequence[str], label: str = "isFraud") -> TrainingGraph:
        kept = edges.select("src", "dst", *[F.col(c).cast("double").alias(c) for c in edge_columns], F.col(label).cast("double").alias("label"))
        kept = materialize(kept, "training_edges")
        heard = neighbor_mean(nodes.select("id", *node_columns), kept.select("src", "dst"), node_columns)
        degree = kept.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("heard"))
        heard = materialize(heard.join(degree, "id", "left").fillna(1.0, subset=["heard"]), "training_nodes")
        return TrainingGraph(heard, kept, kept.select("src", "dst"), tuple(node_columns), tuple(edge_columns), kept.count())


def _names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) if names else np.zeros((batch.num_rows, 0))


def _rows_and_sums(df: DataFrame, fn, outputs: Sequence[str]) -> DataFrame:
    """``fn(batch)`` gives rows (id and ``outputs``) and a gradient. Rows come out as they are; the
    task's summed gradient comes out last, as one row without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, values, gradient = fn(batch)
            total = gradient if total is None else total + gradient
            columns = {c: pa.array(values[:, k]) for k, c in enumerate(outputs)}
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), **columns, "gradient": pa.array([None] * len(ids), pa.binary())})
        if total is not None:
            columns = {c: pa.array([None], pa.float64()) for c in outputs}
            yield pa.record_batch({"id": pa.array([None], pa.int64()), **columns, "gradient": pa.array([total.tobytes()], pa.binary())})

    return df.mapInArrow(run, ", ".join(["id long", *[f"{c} double" for c in outputs], "gradient binary"]))


def _layer(df: DataFrame, fn, mean: Sequence[str], own: Sequence[str], outputs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(_matrix(batch, mean), _matrix(batch, own))
            yield pa.record_batch({**{c: batch.column(c) for c in ["id", *keep]}, **{c: pa.array(out[:, k]) for k, c in enumerate(outputs)}})

    wanted = list(dict.fromkeys(["id", *keep, *mean, *own]))
    return df.select(*wanted).mapInArrow(run, ", ".join(["id long", *[f"{c} double" for c in [*keep, *outputs]]]))


def loss_and_gradient(graph: TrainingGraph, scorer: EdgeScorer) -> tuple[float, np.ndarray]:
    """Mean focal loss of the training edges and its gradient by all weights.

    What a step hands to the next is stored and goes with the epoch, so no epoch leaves files behind.
    """
    spark = graph.nodes.sparkSession
    path = scratch_path(spark, "epoch")
    width, columns = scorer.hidden, list(graph.node_columns)
    g, m, h, d, back = (_names(p, width) for p in "gmhdb")
    sizes = np.cumsum([w.size for w in weights_of(scorer)])
    layer_1, layer_2, total = int(sizes[2]), int(sizes[5]), int(sizes[-1])
    count, attributes = graph.count, list(graph.edge_columns)

    # Forward: both layers.
    first = _layer(graph.nodes, scorer.layer_1, [f"mean_{c}" for c in columns], columns, g, ["heard"])
    heard = neighbor_mean(first, graph.messages, g, "m_").withColumnsRenamed({f"m_{c}": k for c, k in zip(g, m)})
    second = _layer(heard, scorer.layer_2, m, g, h, ["heard", *g, *m])
    second = store(second, f"{path}/second", CODEC)
    joined = graph.edges
    for end in ("src", "dst"):
        joined = joined.join(second.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in h]), end)

    def edge_step(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inputs = _matrix(batch, [*[f"src_{c}" for c in h], *[f"dst_{c}" for c in h], *attributes])
        inner = np.maximum(inputs @ scorer.dense_1.T + scorer.dense_bias_1, 0.0)
        loss, slope = focal((inner @ scorer.dense_2.T + scorer.dense_bias_2)[:, 0], batch.column("label").to_numpy())
        slope = slope[:, None] / count
        below = (slope @ scorer.dense_2) * (inner > 0)
        ends = below @ scorer.dense_1
        gradient = np.zeros(total + 1)
        gradient[layer_2:total] = flat([below.T @ inputs, below.sum(axis=0), slope.T @ inner, slope.sum(axis=0)])
        gradient[total] = loss.sum() / count
        ids = np.concatenate([batch.column("src").to_numpy(), batch.column("dst").to_numpy()])
        # One row per account of the batch.
        known, place = np.unique(ids, return_inverse=True)
        sums = np.zeros((len(known), width))
        np.add.at(sums, place, np.concatenate([ends[:, :width], ends[:, width : 2 * width]]))
        return known, sums, gradient

    edge_rows = store(_rows_and_sums(joined, edge_step, d), f"{path}/edge_rows", CODEC)
    arrived = edge_rows.filter("id is not null").groupBy("id").agg(*[F.sum(c).alias(c) for c in d])

    def node_step(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, own = _matrix(batch, m), _matrix(batch, g)
        below = _matrix(batch, d) * (_matrix(batch, h) > 0)
        gradient = np.zeros(total + 1)
        gradient[layer_1:layer_2] = flat([below.T @ mean, below.sum(axis=0), below.T @ own])
        # What one edge brought to the mean, and what the node itself brought.
        sent = (below @ scorer.neighbor_2) / _matrix(batch, ["heard"])
        return batch.column("id").to_numpy(), np.concatenate([sent, below @ scorer.own_2], axis=1), gradient

    node_rows = store(_rows_and_sums(second.join(arrived, "id"), node_step, [*back, *d]), f"{path}/node_rows", CODEC)
    # Along the reversed edges: every sender gets its share of what its hearers got.
    known = node_rows.filter("id is not null")
    returned = graph.messages.join(known.select(F.col("id").alias("dst"), *back), "dst").groupBy(F.col("src").alias("id"))
    returned = returned.agg(*[F.sum(b).alias(c) for b, c in zip(back, d)])
    both = returned.unionByName(known.select("id", *d)).groupBy("id").agg(*[F.sum(c).alias(c) for c in d])

    def first_step(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, own = _matrix(batch, [f"mean_{c}" for c in columns]), _matrix(batch, columns)
        below = _matrix(batch, d) * (scorer.layer_1(mean, own) > 0)
        gradient = np.zeros(total + 1)
        gradient[:layer_1] = flat([below.T @ mean, below.sum(axis=0), below.T @ own])
        return np.zeros(0, np.int64), np.zeros((0, 0)), gradient

    first_rows = _rows_and_sums(graph.nodes.join(both, "id"), first_step, [])
    parts = [rows.filter("gradient is not null").select("gradient") for rows in (edge_rows, node_rows, first_rows)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros(total + 1)
        for batch in batches:
            for part in batch.column("gradient").to_pylist():
                summed += np.frombuffer(part)
        yield pa.record_batch({"gradient": pa.array([summed.tobytes()], pa.binary())})

    gathered = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(MERGERS)
    with shuffles_freed(spark):
        rows = gathered.mapInArrow(add, "gradient binary").collect()
    discard(spark, path)
    summed = np.sum([np.frombuffer(r["gradient"]) for r in rows], axis=0)
    return float(summed[total]), summed[:total]


@dataclass
class Adam:
    """Adam with decoupled weight decay."""

    rate: float = RATE
    decay: float = DECAY
    step: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def move(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        toward = (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        return weights * (1 - self.rate * self.decay) - self.rate * toward


@dataclass(frozen=True)
class SageModel:
    """Trained weights, the threshold chosen on validation edges, and the loss of every epoch."""

    scorer: EdgeScorer
    threshold: float
    losses: tuple[float, ...]

    def probabilities(self, edges: DataFrame, nodes: DataFrame, node_columns: Sequence[str], edge_columns: Sequence[str], keep: Sequence[str], split: str | None = None) -> DataFrame:
        """``keep`` and the probability ``p`` of every edge, or of those of ``split``; all ``edges`` are heard."""
        asked = edges if split is None else edges.filter(F.col("split") == split)
        scored = score_edges(asked, nodes, node_columns, edge_columns, self.scorer, keep, messages=edges)
        return scored.withColumn("p", sigmoid(F.col("logit")))


def fit_sage(
    edges: DataFrame,
    nodes: DataFrame,
    node_columns: Sequence[str],
    edge_columns: Sequence[str],
    hidden: int = 64,
    epochs: int = 100,
    every: int = 5,
    patience: int = 15,
    rate: float = RATE,
    seed: int = 7,
) -> SageModel:
    """Train on the edges of split ``train``; every few epochs the validation F1 decides which weights stay
    and, after ``patience`` epochs without a better one, when to stop. ``edges`` has src, dst, split and isFraud."""
    graph = TrainingGraph.store(nodes, edges.filter(F.col("split") == "train"), node_columns, edge_columns)
    scorer = initial_scorer(len(node_columns), len(edge_columns), hidden, seed)
    weights, adam, losses = flat(weights_of(scorer)), Adam(rate), []
    best, waited = None, 0
    for epoch in range(1, epochs + 1):
        loss, gradient = loss_and_gradient(graph, unflat(weights, scorer))
        losses.append(loss)
        weights = adam.move(weights, gradient)
        if epoch % every and epoch < epochs:
            continue
        model = SageModel(unflat(weights, scorer), 0.5, tuple(losses))
        scored = model.probabilities(edges, nodes, node_columns, edge_columns, ["split", "isFraud"], "val")
        with shuffles_freed(edges.sparkSession):
            chosen = best_threshold(threshold_sweep(scored)).first()
        f1, threshold = (chosen["f1"], chosen["threshold"]) if chosen else (0.0, 0.5)
        if best is None or f1 > best[0]:
            best, waited = (f1, SageModel(model.scorer, threshold, tuple(losses))), 0
        else:
            waited += every
            if waited >= patience:
                break
    return SageModel(best[1].scorer, best[1].threshold, tuple(losses)) if best else SageModel(scorer, 0.5, ())


def sage_report(model: SageModel, edges: DataFrame, nodes: DataFrame, node_columns: Sequence[str], edge_columns: Sequence[str]) -> DataFrame:
    """(split, isFraud, p) of the test edges."""
    scored = model.probabilities(edges, nodes, node_columns, edge_columns, ["split", "isFraud"], "test")
    return scored.select("split", "isFraud", "p")
