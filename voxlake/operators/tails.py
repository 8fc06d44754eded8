"""Peaks over threshold: the cutoff of a tail that is exceeded with a fixed risk, and nothing but it.

A tail is the readings beyond the threshold ``u``, the 85 % quantile of a source's residuals. A generalised
Pareto distribution is fitted to their excesses by probability-weighted moments; its quantile at ``RISK`` is the
cutoff. Two things keep a few hundred readings from spoiling it:

* what is to be found must not take part in the fit. The first cutoff comes from the median excess (exponential
  tail; half of the peaks may be foreign), then peaks beyond the last cutoff are set aside and the rest is
  fitted again, ``ROUNDS`` times;
* the risk lies far beyond what a source has shown, so its shape is shrunk towards the exponential tail (shape 0)
  as if ``PRIOR`` more peaks had been seen there, or as many as it has if that is more; the scale follows, so that
  the mean excess stays the source's own.

Residuals are rounded to ``STEPS`` steps per factor e before the fit. So a tail can also be fitted from counts
per step, which add up over the pieces of a long source: the cutoff is the same, in one piece or in many.
"""

from __future__ import annotations

import numpy as np

LEVEL = 0.85
RISK = 1e-7
PRIOR = 60
ROUNDS = 5
STEPS = 200
#: Readings below which a source has no tail.
LEAST = 8


def steps(v: np.ndarray) -> np.ndarray:
    """Residuals on the grid of the fit; what is not above zero is 0, NaN stays NaN."""
    with np.errstate(all="ignore"):
        return np.where(np.isnan(v), np.nan, np.where(v > 0, np.exp(np.round(np.log(np.where(v > 0, v, 1.0)) * STEPS) / STEPS), 0.0))


def cutoff(v: np.ndarray, weight: np.ndarray | None = None, risk: float = RISK) -> np.ndarray:
    """Cutoff per row of ``v`` (sources x residuals on the grid, NaN = none), each counted ``weight`` times."""
    w = np.isfinite(v).astype(float) if weight is None else np.where(np.isfinite(v), weight, 0.0)
    if weight is None:
        s = np.sort(v, axis=1)  # NaN last
        w = np.isfinite(s).astype(float)
    else:
        by = np.argsort(v, axis=1)
        s, w = np.take_along_axis(v, by, 1), np.take_along_axis(w, by, 1)
    s = np.where(w > 0, s, np.inf)
    upto = np.cumsum(w, axis=1)
    n = upto[:, -1]
    below = np.floor(LEVEL * n)
    # The threshold is the value of rank below; peaks are what ranks after it.
    at = np.argmax(upto >= np.maximum(below, 1)[:, None], axis=1)
    u = np.where(n > 0, s[np.arange(len(s)), at], np.inf)
    peaks = np.clip(upto - below[:, None], 0, w)
    m = n - below
    with np.errstate(all="ignore"):
        ex = np.where(peaks > 0, s - u[:, None], 0.0)
        rank = np.cumsum(peaks, axis=1)
        half = np.argmax(rank >= (m / 2)[:, None], axis=1)
        scale = np.maximum(ex[np.arange(len(s)), half] / np.log(2), 0.1 * u)
        shape = np.zeros(len(s))
        ratio = m / np.maximum(n, 1) / risk
        for _ in range(ROUNDS):
            reach = _excess(scale, shape, ratio)
            kept = np.where(ex <= reach[:, None], peaks, 0.0)
            k = np.cumsum(kept, axis=1)
            mk = k[:, -1]
            x = np.where(kept > 0, ex, 0.0)
            b0 = (x * kept).sum(1) / np.maximum(mk, 1)
            # Of readings with one value the mean rank counts.
            b1 = (x * kept * (mk[:, None] - k + (kept - 1) / 2)).sum(1) / np.maximum(mk * (mk - 1), 1)
            own = 2 - b0 / np.where(b0 - 2 * b1 > 0, b0 - 2 * b1, np.nan)
            own = np.where(np.isfinite(own), np.clip(own, -1, 0.9), 0.0)
            shape = mk * own / (mk + np.maximum(mk, PRIOR))
            scale = np.maximum(b0 * (1 - shape), 0.1 * u)
        cut = u + _excess(scale, shape, ratio)
    return np.where((n >= LEAST) & (scale > 0), cut, np.inf)


def _excess(scale: np.ndarray, shape: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    flat = np.abs(shape) < 1e-9
    return np.where(flat, scale * np.log(ratio), scale / np.where(flat, 1, shape) * (ratio**shape - 1))
