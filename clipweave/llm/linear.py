"""Small linear models on hashed byte features, trained on bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from clipweave.llm.common import text_slices

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigram_counts(texts: pa.Array, dim: int, letters_only: bool) -> Iterator[np.ndarray]:
    """For each text, counts of its byte trigrams hashed to ``dim`` places; whole text, null is empty.

    ``letters_only``: ASCII letters are lower-cased and every other ASCII byte counts as a space;
    a run of spaces counts once.
    """
    for _, data, offsets in text_slices(texts):
        if letters_only:
            data = _LETTERS[data]
        wide = data.astype(np.uint32)
        n = max(0, len(wide) - 2)
        code = (wide[:n] * np.uint32(0x9E3779B1)) ^ (wide[1 : n + 1] * np.uint32(0x85EBCA77)) ^ (wide[2 : n + 2] * np.uint32(0xC2B2AE3D))
        code = ((code ^ (code >> np.uint32(15))) % np.uint32(dim)).astype(np.int32)
        skip = (data[:n] == 32) & (data[1 : n + 1] == 32) if letters_only else None
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            part = code[a : max(a, b - 2)]
            if skip is not None:
                part = part[~skip[a : max(a, b - 2)]]
            yield np.bincount(part, minlength=dim)


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row scaled to length one (empty rows stay zero)."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), np.float32(1e-12))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) for labels -1 and 1, classes weighted alike.

    Accelerated gradient steps with a fixed bound on the curvature, so training is deterministic.
    """
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    step = 1.0 / (1.0 + 2.0 * c * 2.0)
    w = np.zeros(x1.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x1 @ v))
        grad = v - 2 * (x1.T @ (weight * gap * y))
        grad[-1] -= v[-1]  # the offset is not shrunk
        new = v - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def train_logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 300
) -> tuple[np.ndarray, float]:
    """Logistic regression for labels 0 and 1 by accelerated gradient steps; rows weigh ``weight``."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    weight = np.ones(len(x)) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-12)
    curve = 0.25 * float(weight @ (x1.astype(np.float64) ** 2).sum(1)) + l2
    w = np.zeros(x1.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -30, 30)))
        grad = x1.T @ (weight * (p - y)) + l2 * v
        grad[-1] -= l2 * v[-1]
        new = v - grad / curve
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities of label 1 (Platt scaling)."""
    scale = max(float(np.abs(margin).mean()), 1e-9)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w, b = train_logistic((margin / scale)[:, None], target, l2=1e-4, rounds=500)
    return float(w[0]) / scale, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
