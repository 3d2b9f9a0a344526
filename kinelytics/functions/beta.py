"""Binomial tails through the regularized incomplete beta function, over whole arrays (Spark has no such function).

P(X <= k) of n trials with chance p is I(1 - p; n - k, k + 1), so tails cost the terms of a continued fraction (some square
root of n) and not a sum over all counts.
"""

from __future__ import annotations

import math

import numpy as np

_log_gamma = np.frompyfunc(math.lgamma, 1, 1)
TINY, SETTLED = 1e-300, 1e-15


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.asarray(_log_gamma(a) + _log_gamma(b) - _log_gamma(a + b), float)


def _term(step: int, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    m = step // 2
    if step % 2:
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 + d1 / (1 + d2 / (1 + ...)) by modified Lentz; an element that has settled does not depend on its neighbours."""
    value, above, below = np.ones_like(x), np.ones_like(x), np.zeros_like(x)
    moving = np.ones(x.shape, bool)
    for step in range(1, 200_000):
        d = _term(step, a, b, x)
        below = 1 + d * below
        below = 1 / np.where(np.abs(below) < TINY, TINY, below)
        above = 1 + d / above
        above = np.where(np.abs(above) < TINY, TINY, above)
        change = above * below
        value = np.where(moving, value * change, value)
        moving &= np.abs(change - 1) > SETTLED
        if not moving.any():
            break
    return value


def incomplete_beta(a, b, x) -> np.ndarray:
    """I(x; a, b) for positive a and b, elementwise; 0 and 1 at and beyond the ends of [0, 1]."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    inside = (x > 0) & (x < 1)
    out = np.where(x >= 1, 1.0, 0.0)
    if inside.any():
        a, b, x = a[inside], b[inside], x[inside]
        turn = x > (a + 1) / (a + b + 2)  # the fraction settles fast on one side of the mean only
        p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta(p, q)) / p
        part = front / _fraction(p, q, y)
        out[inside] = np.clip(np.where(turn, 1 - part, part), 0.0, 1.0)
    return out


def inverse_beta(a, b, share) -> np.ndarray:
    """x with I(x; a, b) = ``share`` in (0, 1): Newton steps that fall back to halving where they leave the bracket."""
    a, b, share = (np.array(v, float) for v in np.broadcast_arrays(a, b, share))
    low, high, x, norm = np.zeros_like(a), np.ones_like(a), a / (a + b), log_beta(a, b)
    for _ in range(80):
        over = incomplete_beta(a, b, x) - share
        high, low = np.where(over >= 0, x, high), np.where(over < 0, x, low)
        with np.errstate(all="ignore"):
            step = x - over / np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - norm)
        good = np.isfinite(step) & (step > low) & (step < high)
        x = np.where(good, step, (low + high) / 2)
    return x


def binomial_tail(k, n, p) -> np.ndarray:
    """P(X <= k) of ``n`` trials with chance ``p``, elementwise; 0 below 0 and 1 from n on."""
    k, n, p = (np.array(v, float) for v in np.broadcast_arrays(k, n, p))
    out = np.where(k >= n, 1.0, 0.0)
    part = (k >= 0) & (k < n)
    out[part] = incomplete_beta(n[part] - k[part], k[part] + 1, 1 - p[part])
    return out


def binomial_share(k, n, p) -> np.ndarray:
    """P(X = k) of ``n`` trials with chance ``p``, elementwise."""
    k, n, p = (np.array(v, float) for v in np.broadcast_arrays(k, n, p))
    out = np.where(p <= 0, k == 0, (p >= 1) & (k == n)).astype(float)
    part = (p > 0) & (p < 1) & (k >= 0) & (k <= n)
    k, n, p = k[part], n[part], p[part]
    out[part] = np.exp(k * np.log(p) + (n - k) * np.log1p(-p) - log_beta(k + 1, n - k + 1)) / (n + 1)
    return out
