"""A plain solver on one machine, which the tests hold the distributed one against."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np

from clickloom.operators.priors import Prior


def digamma(x: np.ndarray | float) -> np.ndarray:
    """Recurrence up to x + 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    shift = sum(1.0 / (x + k) for k in range(6))
    z = x + 6.0
    w = 1.0 / (z * z)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return np.log(z) - 0.5 / z - series - shift


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = sum(1.0 / (x + k) ** 2 for k in range(6))
    z = x + 6.0
    w = 1.0 / (z * z)
    return 1 / z + w / 2 + (w / z) * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w * (1 / 30 - w * 5 / 66)))) + shift


def _gain(values: np.ndarray, keys: np.ndarray, at: float) -> float:
    """Sum over keys of digamma(value + at) - digamma(at)."""
    return float(np.sum(keys * (digamma(values + at) - digamma(at))))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _log_gain(values: np.ndarray, keys: np.ndarray, at: float) -> float:
    """Sum over keys of log-gamma(value + at) - log-gamma(at)."""
    return float(np.sum(keys * (_lgamma(values + at) - math.lgamma(at))))


def _bend(values: np.ndarray, keys: np.ndarray, at: float) -> float:
    return float(np.sum(keys * (trigamma(values + at) - trigamma(at))))


def solve_prior(histogram: Mapping[str, tuple[np.ndarray, np.ndarray]], max_steps: int = 200, epsilon: float = 1e-8, compat: bool = False, start: tuple[float, float] | None = None) -> Prior:
    """Maximum-likelihood beta prior from the histograms of I, C and M.

    Newton steps where the likelihood is concave; a step that leaves the positive quadrant or does
    not raise the likelihood is replaced by the fixed-point step, which always raises it. ``compat`` uses fixed-point steps
    only, from (1, 1), as capped by ``max_steps``. Without a finite maximum ``alpha`` and ``beta`` are none, and ``pooled`` is
    the rate over all impressions, if there are any.
    """
    empty = (np.zeros(0), np.zeros(0))
    (iv, ik), (cv, ck), (mv, mk) = (histogram.get(kind, empty) for kind in "ICM")
    shown = float(np.sum(iv * ik))
    pooled = float(np.sum(cv * ck)) / shown if shown else None
    if float(np.sum(iv * ik)) == 0 or float(np.sum(cv * ck)) == 0 or float(np.sum(mv * mk)) == 0:
        # no impressions, no conversions or no misses: the likelihood has no finite maximum
        return Prior(None, None, 0, False, pooled)

    def residual(a: float, b: float) -> tuple[float, float, float, float, float]:
        whole = _gain(iv, ik, a + b)
        up, down = _gain(cv, ck, a), _gain(mv, mk, b)
        return up - whole, down - whole, up, down, whole

    def likelihood(a: float, b: float) -> float:
        return _log_gain(cv, ck, a) + _log_gain(mv, mk, b) - _log_gain(iv, ik, a + b)

    alpha, beta = start or ((1.0, 1.0) if compat else _rough_start(iv, ik, cv, ck))
    for step in range(1, max_steps + 1):
        f, g, up, down, whole = residual(alpha, beta)
        fixed = (alpha * up / whole, beta * down / whole)
        new = fixed
        if not compat:
            wb = _bend(iv, ik, alpha + beta)
            faa, fbb, fab = _bend(cv, ck, alpha) - wb, _bend(mv, mk, beta) - wb, -wb
            det = faa * fbb - fab * fab
            if faa < 0 and det > 0:
                tried = (alpha - (f * fbb - g * fab) / det, beta - (g * faa - f * fab) / det)
                if min(tried) > 0 and all(map(np.isfinite, tried)):
                    if likelihood(*tried) >= likelihood(alpha, beta):
                        new = tried
        moved = max(abs(new[0] - alpha), abs(new[1] - beta))
        if moved < epsilon:
            return Prior(float(alpha), float(beta), step, True)
        alpha, beta = new
        if not np.isfinite(alpha + beta) or alpha + beta > 1e12:
            return Prior(None, None, step, False, pooled)
    return Prior(float(alpha), float(beta), max_steps, False)


def _rough_start(iv: np.ndarray, ik: np.ndarray, cv: np.ndarray, ck: np.ndarray) -> tuple[float, float]:
    """Moments: the mean rate, and its mean square from pairs of impressions of one key."""
    mean = float(np.sum(cv * ck) / np.sum(iv * ik))
    pairs = float(np.sum(iv * (iv - 1) * ik))
    spread = float(np.sum(cv * (cv - 1) * ck)) / pairs - mean * mean if pairs else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else 0.0
    if strength <= 0:
        strength = max(float(np.sum(iv * ik) / max(np.sum(ik), 1.0)), 2.0)
    return max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)
