"""FTRL-proximal logistic regression: per-coordinate rates, L1 sparsity, L2 shrinkage."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tabulon.llm.training import train_rounds


@dataclass(frozen=True)
class Rates:
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 0.1
    rounds: int = 3


def weights(z: np.ndarray, n: np.ndarray, l1, rates: Rates) -> np.ndarray:
    """The sparse weights that the sums stand for; 0 wherever |z| <= l1."""
    kept = np.abs(z) > l1
    w = -(z - np.sign(z) * l1) / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2)
    return np.where(kept, w, 0.0)


def learner(classes: int, rates: Rates):
    """One pass over rows; the last row of the state is the bias, which has no L1 penalty.

    The state holds z and n side by side, one column per class (one class: logistic).
    """
    def step(state, indices, values, targets):
        bias = len(state) - 1
        for index, value, target in zip(indices, values, targets):
            at = np.append(np.asarray(index, np.int64), bias)
            x = np.append(np.asarray(value, np.float64), 1.0)[:, None]
            z, n = state[at, :classes], state[at, classes:]
            l1 = np.full((len(at), 1), rates.l1)
            l1[-1] = 0.0
            w = weights(z, n, l1, rates)
            margin = (w * x).sum(0)
            if classes == 1:
                error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - target
            else:
                error = np.exp(margin - margin.max())
                error /= error.sum()
                error[int(target)] -= 1
            g = x * error
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / rates.alpha
            state[at, :classes] = z + g - sigma * w
            state[at, classes:] = n + g * g
    return step


def fit(rows: DataFrame, size: int, classes: int, rates: Rates) -> np.ndarray:
    """Weights (size + 1, classes), float32, bias last; ``rows`` as of ``feature_rows``."""
    state = train_rounds(rows, np.zeros((size + 1, 2 * classes)), learner(classes, rates), rates.rounds)
    l1 = np.full((size + 1, 1), rates.l1)
    l1[-1] = 0.0
    return weights(state[:, :classes], state[:, classes:], l1, rates).astype(np.float32)
