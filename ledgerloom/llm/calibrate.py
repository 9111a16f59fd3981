"""Logistic calibration of a few features, fitted on a bounded collected sample."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Calibration:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def __call__(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        return 1.0 / (1.0 + np.exp(-np.clip(((features - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)))


def constant(width: int, probability: float) -> Calibration:
    p = min(max(probability, 1e-6), 1 - 1e-6)
    return Calibration(np.zeros(width), np.ones(width), np.zeros(width), float(np.log(p / (1 - p))))


def fit(features: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, ridge: float = 0.01) -> Calibration:
    """Ridge logistic regression by Newton's method; a constant where only one label occurs."""
    weights = np.ones(len(labels)) if weights is None else weights
    if not len(labels):
        return constant(features.shape[1], 0.5)
    if labels.min() == labels.max():
        return constant(features.shape[1], float(labels[0]))
    mean, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
    x = np.column_stack([(features - mean) / scale, np.ones(len(labels))])
    penalty = np.full(x.shape[1], ridge * weights.sum() / len(labels))
    penalty[-1] = 0.0
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - penalty * beta
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(beta)), gradient)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return Calibration(mean, scale, beta[:-1], float(beta[-1]))
