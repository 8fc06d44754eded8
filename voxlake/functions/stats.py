"""Distribution functions and small numeric helpers, without further libraries."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Evaluated from the inside out; the fraction converges fast on this side of the mean.
    f = 1.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = 1 + even / (1 + odd / f)
    first = -(a + b) * x / (a + 1)
    return front / (1 + first / f)


def t_cdf(t: float, df: float) -> float:
    if math.isnan(t):
        return math.nan
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_to_p(t: float, df: float) -> float:
    """Signed tail: the upper tail for t >= 0, the negated lower tail below."""
    return -t_cdf(t, df) if t < 0 else 1 - t_cdf(t, df)


def p_to_t(p: float, df: float) -> float:
    """Inverse of :func:`t_to_p` by bisection."""
    want = -p if p < 0 else 1 - p
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_cdf(mid, df) < want:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def erf_inv(x: float) -> float:
    """Inverse error function by Newton steps from a rational start."""
    if abs(x) >= 1:
        return math.copysign(math.inf, x) if abs(x) == 1 else math.nan
    a = 0.147
    ln = math.log(1 - x * x)
    y = math.copysign(math.sqrt(math.sqrt((2 / (math.pi * a) + ln / 2) ** 2 - ln / a) - (2 / (math.pi * a) + ln / 2)), x)
    for _ in range(4):
        y -= (math.erf(y) - x) * math.sqrt(math.pi) / 2 * math.exp(y * y)
    return y


def sine_wave(t: np.ndarray, frequency: float, tr: float) -> np.ndarray:
    return np.sin(2 * math.pi * frequency * tr * t)


def power_iteration(a: np.ndarray, steps: int = 1000, tol: float = 1e-12) -> np.ndarray:
    """Dominant eigenvector of a square matrix, largest entry positive."""
    v = np.ones(len(a)) / math.sqrt(len(a))
    for _ in range(steps):
        w = a @ v
        n = np.linalg.norm(w)
        if n == 0:
            return v
        w /= n
        if np.abs(w - v).max() < tol:
            v = w
            break
        v = w
    return v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
