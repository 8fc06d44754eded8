"""Frequency bins and their attenuation."""

from __future__ import annotations

import math

import numpy as np


def pass_bins(frames: int, tr: float, f1: float, f2: float) -> tuple[int, int]:
    """First and last bin that pass: one bin wider than the band on either side."""
    freq = np.arange(frames // 2 + 1) / (frames * tr)
    above = lambda f: next((k for k in range(1, len(freq)) if freq[k] > f), len(freq) - 1)
    return max(above(f1) - 1, 0), above(f2)


def attenuation(frames: int, tr: float, f1: float, f2: float, keep_mean: bool = False, rolloff: float | None = None) -> np.ndarray:
    """Weight per bin of the real transform: 1 in the band, outside 0 or a smooth roll-off."""
    first, last = pass_bins(frames, tr, f1, f2)
    k = np.arange(frames // 2 + 1)
    away = np.where(k < first, first - k, np.where(k > last, k - last, 0))
    if rolloff is None:
        w = (away == 0).astype(float)
    else:
        w = 1 - np.tanh(rolloff / len(k) * math.pi * away.astype(float) ** 2)
    if keep_mean:
        w[0] = 1.0
    return w


def kernel(weight: np.ndarray, frames: int) -> np.ndarray:
    """Circular kernel whose convolution equals the attenuation."""
    return np.fft.irfft(weight, n=frames)
