"""Linear classifiers on bounded samples, and the hashed text features that they read."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_counts(text: str, dims: int, orders: tuple[int, ...] = (1, 2, 3), case: bool = False) -> np.ndarray:
    """Counts of the byte n-grams of a whole text, hashed to dims buckets."""
    data = np.frombuffer((text if case else text.lower()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    total = np.zeros(dims)
    for n in orders:
        if len(data) < n:
            break
        for at in range(0, len(data) - n + 1, 1 << 20):  # a bounded part of a long text at a time
            part = data[at : at + (1 << 20) + n - 1]
            code = np.full(len(part) - n + 1, n, np.uint64)
            for i in range(n):
                code = (code << np.uint64(8)) | part[i : len(part) - n + 1 + i]
            total += np.bincount(((code * ODD) >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    return total


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts on a log scale and of unit length."""
    total = np.log1p(counts.astype(np.float64))
    return (total / max(np.linalg.norm(total), 1e-12)).astype(np.float32)


def byte_grams(text: str, dims: int, orders: tuple[int, ...] = (1, 2, 3), case: bool = False) -> np.ndarray:
    """Counts of the byte n-grams of a whole text, hashed to dims buckets, on a log scale and of unit length."""
    return scaled(gram_counts(text, dims, orders, case))


def packed_grams(text: str, dims: int) -> bytes:
    """What expanded() makes byte_grams() of: the counts as whole numbers of the fewest bytes, compressed."""
    counts = gram_counts(text, dims).astype(np.uint64)
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes(), 1)


def expanded(packed: Sequence[bytes], dims: int) -> np.ndarray:
    """The byte_grams() of texts, a row each, from their packed_grams()."""
    out = np.empty((len(packed), dims), np.float32)
    for i, p in enumerate(packed):
        raw = zlib.decompress(p)
        out[i] = scaled(np.frombuffer(raw, f"u{len(raw) // dims}"))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights, bias last, of a linear support vector machine: squared hinge loss, by Newton's method with conjugate gradients.

    y is -1 or 1; each class has equal total weight.
    """
    y = np.where(np.asarray(y) > 0, 1.0, -1.0)
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y) * cost
    w = np.zeros(x.shape[1] + 1)

    # the rows stay as they are, single precision and without a column of ones: the sample is in memory once
    def times(v: np.ndarray) -> np.ndarray:
        return (x @ v[:-1].astype(x.dtype)).astype(np.float64) + v[-1]

    def back(c: np.ndarray) -> np.ndarray:
        return np.append((c.astype(x.dtype) @ x).astype(np.float64), c.sum())

    def loss(v: np.ndarray) -> float:
        return 0.5 * v @ v + (each * np.maximum(1 - y * times(v), 0) ** 2).sum()

    for _ in range(rounds):
        gap = 1 - y * times(w)
        cs = each * (gap > 0)
        grad = w - 2 * back(cs * y * gap)
        if np.linalg.norm(grad) < 1e-3 * max(1.0, np.sqrt(len(y))):
            break
        step, r = np.zeros_like(w), -grad
        p, rr = r.copy(), r @ r
        for _ in range(40):
            hp = p + 2 * back(cs * times(p))
            alpha = rr / (p @ hp)
            step, r = step + alpha * p, r - alpha * hp
            new = r @ r
            if new < 1e-6 * (grad @ grad):
                break
            p, rr = r + new / rr * p, new
        size, now = 1.0, loss(w)
        while loss(w + size * step) > now + 1e-4 * size * (grad @ step) and size > 1e-6:
            size /= 2
        w = w + size * step
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights, bias last, of a ridge logistic regression by Newton's method; y in [0, 1]."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    c = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge * c.sum())
    penalty[-1] = 1e-6 * max(c.sum(), 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (c * (p - y)) + penalty * w
        hess = (x.T * (c * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def decide(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
