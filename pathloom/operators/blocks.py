"""Block-length selection for the stationary bootstrap: flat-top automatic lengths, support, gates."""

from __future__ import annotations

import math

import numpy as np


def autocovariances(x: np.ndarray, segments: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lag 0..most: covariances over all n (lag 0 is 1), correlations over the available pairs; pairs inside one segment only."""
    x = (x - x.mean()) / x.std()
    gamma, rho = np.zeros(most + 1), np.zeros(most + 1)
    for k in range(most + 1):
        a, b = x[k:], x[: len(x) - k]
        same = segments[k:] == segments[: len(x) - k]
        a, b = a[same], b[same]
        gamma[k] = (a * b).sum() / len(x)
        scale = math.sqrt((a * a).sum() * (b * b).sum())
        rho[k] = (a * b).sum() / scale if scale else 0.0
    return gamma, rho


def automatic_length(x: np.ndarray, segments: np.ndarray) -> float:
    """Flat-top selector with the finite-sample cap."""
    n = len(x)
    quiet = max(5, math.ceil(math.sqrt(math.log10(n))))
    longest = np.bincount(segments - segments.min()).max()
    most = min(longest - 1, math.ceil(math.sqrt(n)) + quiet)
    gamma, rho = autocovariances(x, segments, most)
    loud = np.flatnonzero(np.abs(rho[1:]) >= 2 * math.sqrt(math.log10(n) / n)) + 1
    if not len(loud):
        return 1.0
    # the first lag of the first run of quiet lags, else the last loud lag
    ends = np.concatenate([[0], loud, [most + 1]])
    before = np.flatnonzero(np.diff(ends) > quiet)
    m = int(ends[before[0]]) + 1 if len(before) else int(loud[-1])
    width = min(2 * m, most)
    k = np.arange(1, width + 1)
    w = np.where(k / width <= 0.5, 1.0, 2 * (1 - k / width))
    g, d = (2 * w * k * gamma[1 : width + 1]).sum(), 2 * (gamma[0] + 2 * (w * gamma[1 : width + 1]).sum()) ** 2
    return float(min((2 * g * g * n / d) ** (1 / 3), math.ceil(min(3 * math.sqrt(n), n / 3)))) if d else 1.0


def combine(lengths: list[float], frequency: str) -> int:
    """ceil of the largest, between 2 and 12 (monthly) or 126 (daily)."""
    return int(min(max(math.ceil(max(lengths)), 2), {"monthly": 12, "daily": 126}[frequency]))


def required_starts(length: int, frequency: str) -> int:
    return max(8, length) if frequency == "monthly" else max(50, 2 * length)


def fragmentation_gates(mean: float, median: float, singles: float, ideal_median: float, ideal_singles: float, length: int) -> dict[str, bool]:
    return {"mean": mean >= 0.5 * length, "median": median >= 0.5 * ideal_median, "relative_singletons": singles <= ideal_singles + 0.10, "singletons": singles <= 0.75}
