"""Hashed n-gram features of a batch of texts, and a logistic regression over them.

A feature is a word or a character n-gram, hashed into ``2**bits`` places and weighted by how often it occurs in the
text, each family of n-grams summing to one. Scores are therefore weighted means and do not depend on the length.
"""

from __future__ import annotations

import numpy as np

from folioflow.llm import kernel

GRAMS = (2, 4)
#: Bytes of text whose n-grams are held at once; they take about a hundred times as much.
SLICE = 500_000


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, weight) of every n-gram occurrence: words, character 2-grams and 4-grams of the bytes."""
    n = len(offsets) - 1
    shift = np.uint64(64 - bits)
    starts, ends, owner = kernel.words(raw, offsets)
    place = [(kernel.span_hashes(raw, starts, ends) >> shift).astype(np.int64)]
    text = [owner]
    weight = [1.0 / np.maximum(kernel.count_by(owner, n), 1)[owner]]
    of = np.repeat(np.arange(n), np.diff(offsets))
    for k, width in enumerate(GRAMS, 1):
        m = len(raw) - width + 1
        if m <= 0:
            continue
        with np.errstate(over="ignore"):
            code = np.full(m, k, np.uint64)
            for j in range(width):
                code = code * np.uint64(0x100000001B3) + raw[j : j + m]
            code = (code * np.uint64(0x9E3779B97F4A7C15)) >> shift
        at = np.flatnonzero(of[:m] == of[width - 1 : width - 1 + m])
        t = of[at]
        place.append(code[at].astype(np.int64))
        text.append(t)
        weight.append(1.0 / np.maximum(kernel.count_by(t, n), 1)[t])
    return np.concatenate(text), np.concatenate(place), np.concatenate(weight)


def margins(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The linear score of each text, computed in slices."""
    bits = int(len(weights)).bit_length() - 1
    out = np.full(len(offsets) - 1, bias)
    for lo, hi in kernel.slices(offsets, SLICE):
        at = offsets[lo : hi + 1]
        text, place, weight = features(raw[at[0] : at[-1]], at - at[0], bits)
        out[lo:hi] += np.bincount(text, weights[place] * weight, minlength=hi - lo)
    return out


def fit(raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray, bits: int, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch AdaGrad on the class-balanced logistic loss; deterministic.

    Distinct features of each slice of texts stay as they are counted, 12 bytes each, and are never put together.
    """
    parts = []
    for lo, hi in kernel.slices(offsets, SLICE):
        at = offsets[lo : hi + 1]
        text, place, weight = features(raw[at[0] : at[-1]], at - at[0], bits)
        key, inverse = np.unique((text << bits) | place, return_inverse=True)
        parts.append((lo, hi, (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32), np.bincount(inverse, weight).astype(np.float32)))
    n = len(offsets) - 1
    y = labels.astype(float)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))
    w, grown, bias, bias_grown = np.zeros(1 << bits), np.full(1 << bits, 1e-8), 0.0, 1e-8
    for _ in range(rounds):
        error, gradient = np.empty(n), penalty * w
        for lo, hi, text, place, weight in parts:
            z = np.bincount(text, w[place] * weight, minlength=hi - lo) + bias
            error[lo:hi] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo:hi]) * share[lo:hi]
            gradient += np.bincount(place, error[lo:hi][text] * weight, minlength=1 << bits)
        grown += gradient**2
        w -= gradient / np.sqrt(grown)
        bias_grown += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(bias_grown)
    return w, bias


def calibrate(z: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Platt scaling: (a, b) so that 1 / (1 + exp(-(a z + b))) is the probability of label 1, by Newton steps."""
    y = labels.astype(float)
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
