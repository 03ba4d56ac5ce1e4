"""Small models fitted on the driver from bounded samples: softmax regression and its calibration."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def biased(x: np.ndarray) -> np.ndarray:
    """The rows with a last column of ones, in 32 bits or more; the one copy that a fit makes of them."""
    out = np.empty((len(x), x.shape[1] + 1), np.promote_types(x.dtype, np.float32))
    out[:, :-1], out[:, -1] = x, 1
    return out


def linear(x: np.ndarray, w: np.ndarray, block: int = 2048) -> np.ndarray:
    """x @ w with the bias last, in blocks of rows."""
    return np.concatenate([np.empty(0, w.dtype), *(x[k : k + block].astype(w.dtype, copy=False) @ w[:-1] + w[-1] for k in range(0, len(x), block))])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights with the bias last, by accelerated gradient steps of a length set by the data."""
    x = biased(x)
    weight = np.ones(len(x), x.dtype) if weight is None else weight.astype(x.dtype)
    weight = weight / weight.sum()
    rate = 1 / (0.25 * float(weight @ np.einsum("ij,ij->i", x, x)) + l2)
    w = np.zeros(x.shape[1], x.dtype)
    ahead, t = w, 1.0
    for _ in range(steps):
        g = x.T @ (weight * (sigmoid(x @ ahead) - y)).astype(x.dtype) + l2 * ahead
        new = ahead - rate * g
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, weight: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """(features + 1, classes)."""
    x = biased(x)
    weight = (weight / weight.sum()).astype(x.dtype)[:, None]
    hot = np.eye(classes, dtype=x.dtype)[y]
    rate = 1 / (0.5 * float(weight[:, 0] @ np.einsum("ij,ij->i", x, x)) + l2)
    w = np.zeros((x.shape[1], classes), x.dtype)
    ahead, t = w, 1.0
    for _ in range(steps):
        g = x.T @ (weight * (softmax(x @ ahead) - hot)) + l2 * ahead
        new = ahead - rate * g
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a z + b) is calibrated on held-out scores; a is not negative."""
    up, down = float((y == 1).sum()), float((y == 0).sum())
    aim = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = float(np.abs(z).max(initial=0)) or 1.0
    a, b = fit_logistic((z / scale)[:, None].astype(np.float64), aim, l2=1e-6, steps=500)
    return max(0.0, float(a) / scale), float(b)
