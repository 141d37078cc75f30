"""Deterministic per-unit draws that do not depend on how units are spread over tasks."""

from __future__ import annotations

import numpy as np

_POISSON_STEPS = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


def uniforms(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """keys x draws uniforms in [0, 1) from 64-bit mixing of (key, draw)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)[:, None] + draws.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def unit_counts(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each unit enters each bootstrap sample: Poisson(1), and exactly once in draw 0 (the data)."""
    counts = np.searchsorted(_POISSON_STEPS, uniforms(keys, draws), side="right").astype(float)
    counts[:, draws == 0] = 1.0
    return counts


def multipliers(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Two-point multipliers with mean 0, variance 1 and third moment 1."""
    root = np.sqrt(5.0)
    return np.where(uniforms(keys, draws) < (root + 1) / (2 * root), (1 - root) / 2, (1 + root) / 2)
