"""Places of rolling extremes, and rolling quantiles, of one batch of rows in order."""

from __future__ import annotations

import numpy as np


def figure(kind: str, q: float | None, v: np.ndarray, there: np.ndarray, t: np.ndarray, once) -> tuple[np.ndarray, np.ndarray]:
    """Values and where there are any; ``v`` and ``there`` have a row per window, oldest first. NaN counts as the greatest."""
    d, rows = v.shape[1], np.arange(len(v))
    some = there.any(axis=1)
    if kind in ("high", "low"):
        x = np.where(there, v if kind == "high" else -v, -np.inf)
        at = x.argmax(axis=1)
        at = np.where(x[rows, at] == -np.inf, there.argmax(axis=1), at)
        return at + 1.0 - np.maximum(d - t, 0), some

    def ordered():
        finite = there & np.isfinite(v)
        return np.sort(np.where(finite, v, np.nan), axis=1), finite.sum(axis=1)

    s, n = once(ordered)
    at = q * (n - 1)
    low = np.maximum(np.floor(at), 0).astype(int)
    a, b = s[rows, low], s[rows, np.clip(low + 1, 0, np.maximum(n - 1, 0))]
    return a + (at - low) * (b - a), n > 0
