"""Numeric kernels on the driver, for the few rows that a search has left: LASSO by FISTA, greedy DPP, NMF."""

from __future__ import annotations

import math

import numpy as np


def fista(basis: np.ndarray, target: np.ndarray, lam: float, steps: int = 80) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, residual, its norm) of ``min 1/2 |target - basis.T a|^2 + lam |a|_1``."""
    basis, target = np.atleast_2d(np.asarray(basis, float)), np.asarray(target, float)
    if not basis.size:
        return np.zeros(0), target, float(np.linalg.norm(target))
    gram, aim = basis @ basis.T, basis @ target
    bound = np.abs(gram).sum(axis=1).max()
    if bound < 1e-10:
        return np.zeros(len(basis)), target, float(np.linalg.norm(target))
    a = ahead = np.zeros(len(basis))
    t = 1.0
    for _ in range(steps):
        z = ahead - (gram @ ahead - aim) / bound
        new = np.sign(z) * np.maximum(np.abs(z) - lam / bound, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, a, t = new + (t - 1) / t_new * (new - a), new, t_new
    rest = target - basis.T @ a
    return a, rest, float(np.linalg.norm(rest))


def dpp_greedy(vectors: np.ndarray, scores: np.ndarray, k: int, quality_weight: float = 1.0) -> list[int]:
    """Indexes of a diverse choice, in the order chosen; all of them if there are at most ``k``."""
    v, n = np.asarray(vectors, float), len(scores)
    if n <= k:
        return list(range(n))
    q = np.maximum(np.asarray(scores, float), 1e-10) ** quality_weight
    norms = np.linalg.norm(v, axis=1)
    unit = np.divide(v, norms[:, None], out=np.zeros_like(v), where=norms[:, None] > 0)
    kernel = q[:, None] * (unit @ unit.T) * q[None, :]
    left = q * q + 1e-8
    factors, chosen = np.zeros((0, n)), []
    for _ in range(k):
        best = int(np.argmax(left))
        chosen.append(best)
        if left[best] < 1e-10:
            break
        row = (kernel[best] - factors[:, best] @ factors) / math.sqrt(left[best])
        factors = np.vstack([factors, row])
        left = np.maximum(left - row * row, 0)
        left[chosen] = -np.inf
    return chosen


def _generator(seed: int = 42):
    """A 64-bit linear congruential generator (fixed values), as shares of 2**32 - 1."""
    while True:
        seed = (seed * 6364136223846793005 + 1) % (1 << 64)
        yield (seed >> 33) / ((1 << 32) - 1)


def nmf(matrix: np.ndarray, k: int, max_iter: int = 100, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(w, h) with ``abs(matrix)`` about ``w @ h``, by multiplicative updates; stops early by the relative residual."""
    v = np.abs(np.atleast_2d(np.asarray(matrix, float)))
    mean = max(math.sqrt(v.mean() / k), 0.01)
    draw = _generator()
    start = lambda *shape: np.array([abs(mean + mean * 0.5 * (next(draw) - 0.5)) + 1e-10 for _ in range(shape[0] * shape[1])]).reshape(shape)
    w = start(v.shape[0], k)
    h = start(k, v.shape[1])
    size = np.linalg.norm(v)
    for i in range(1, max_iter + 1):
        h *= (w.T @ v) / (w.T @ w @ h + 1e-10)
        w *= (v @ h.T) / (w @ h @ h.T + 1e-10)
        if i % 10 == 0 and size > 0 and np.linalg.norm(v - w @ h) / size < tol:
            break
    return w, h


def nmf_topics(query: np.ndarray, h: np.ndarray) -> dict:
    """Shares of topics of a query, how deep and wide it is, and how new."""
    q = np.abs(np.asarray(query, float))
    raw = h @ q
    p = np.exp(raw - raw.max())
    p /= p.sum()
    k, norm = len(h), float(np.linalg.norm(q))
    entropy = -float((p[p > 0] * np.log(p[p > 0])).sum())
    return {
        "topics": p, "depth": 1 - entropy / math.log(k) if k > 1 else 1.0, "coverage": int((p > 0.5 / k).sum()),
        "novelty": min(float(np.linalg.norm(q - p @ h)) / norm, 1.0) if norm > 0 else 0.0,
    }
