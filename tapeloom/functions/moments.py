"""Rolling means, deviations, sums, lines, correlations, ranks and extremes of many windows, from arrays of rows in order.

A window's sum is added up row by row back in time, for all rows of a batch at once; one pass over the longest window gives the sums
of all shorter ones. Values enter less their instrument's first known one (no later row is looked at). Of the about 15
digits, those are lost by which the square of the distance from it exceeds the window's variance. Whether a window moves at all is not
read off a rounded variance but off its greatest and least value.

A value that is not finite counts as unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

Serie = tuple[np.ndarray, np.ndarray]


class Moments:
    """Figures of one batch: ``rows`` are its series, each with the ``lead`` rows before the batch in front.

    ``t`` is the row's number in its instrument, ``before`` the first known values of the instrument that the batch before ended in;
    ``after`` becomes the same for the next batch.
    """

    def __init__(self, rows: dict[str, Serie], t: np.ndarray, lead: int, windows: Iterable[int], before: dict[str, float]) -> None:
        self.rows, self.t, self.lead, self.windows = rows, t, lead, set(windows)
        self.short = [np.flatnonzero(t <= k) for k in range(max(self.windows))]
        self.before, self.after = before, {}
        self.made: dict = {}

    def once(self, key: tuple, make: Callable):
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    # --- series -------------------------------------------------------------------
    def known(self, x: str, y: str | None = None) -> np.ndarray:
        """Where ``x`` is finite, and ``y`` too where there is one."""
        if y:
            return self.known(x) & self.known(y)
        return self.once(("known", x), lambda: self.rows[x][1] & np.isfinite(self.rows[x][0]))

    def centre(self, x: str, y: str | None) -> np.ndarray:
        """First known value of each row's instrument, 0 before there is one."""
        def make():
            new = self.t == 1
            part = np.cumsum(new)
            firsts = np.full(part[-1] + 1, np.nan)
            at = np.flatnonzero(self.known(x, y)[self.lead :])
            parts, i = np.unique(part[at], return_index=True)
            firsts[parts] = self.rows[x][0][self.lead :][at[i]]
            if not np.isnan(self.before.get((x, y), np.nan)):
                firsts[0] = self.before[x, y]
            self.after[x, y] = firsts[-1]
            # rows of other instruments are never looked at
            return np.nan_to_num(np.concatenate([np.full(self.lead, firsts[0]), firsts[part]]))
        return self.once(("centre", x, y), make)

    def value(self, x: str, y: str | None = None) -> np.ndarray:
        """Values less their centre, 0 where unknown."""
        return self.once(("value", x, y), lambda: np.where(self.known(x, y), self.rows[x][0] - self.centre(x, y), 0.0))

    def raw(self, x: str) -> np.ndarray:
        return self.once(("raw", x), lambda: np.where(self.known(x), self.rows[x][0], 0.0))

    # --- windows ------------------------------------------------------------------
    def walk(self, key: tuple, series: Callable[[], np.ndarray], step: Callable, start: float = 0.0) -> dict[int, np.ndarray]:
        """Per window length what ``step(total, part, k)`` makes of the rows ``k`` back, from the row itself to the oldest."""
        def make():
            a, n, out = series(), len(self.t), {}
            total = np.full(n, start)
            for k in range(max(self.windows)):
                kept = total[self.short[k]]
                step(total, a[self.lead - k : self.lead - k + n], k)
                total[self.short[k]] = kept
                if k + 1 in self.windows:
                    out[k + 1] = total.copy()
            return out
        return self.once(key, make)

    def sum(self, key: tuple, series: Callable[[], np.ndarray], d: int) -> np.ndarray:
        return self.walk(("sum", *key), series, lambda total, part, k: np.add(total, part, out=total))[d]

    def count(self, x: str, y: str | None, d: int) -> np.ndarray:
        def make():
            upto = np.concatenate([[0], np.cumsum(self.known(x, y))])
            end = np.arange(self.lead, self.lead + len(self.t)) + 1
            return {e: (upto[end] - upto[end - np.minimum(e, self.t).astype(int)]).astype(float) for e in self.windows}
        return self.once(("count", x, y), make)[d]

    def total_of(self, x: str, y: str | None, d: int) -> np.ndarray:
        return self.sum(("value", x, y), lambda: self.value(x, y), d)

    def still(self, x: str, y: str | None, d: int) -> np.ndarray:
        """True where the window's known values are all the same."""
        def side(name, empty, pick):
            return self.walk((name, x, y), lambda: np.where(self.known(x, y), self.rows[x][0], empty), lambda total, part, k: pick(total, part, out=total), empty)[d]
        return ~(side("max", -np.inf, np.maximum) > side("min", np.inf, np.minimum))

    def spread(self, x: str, y: str | None, d: int) -> np.ndarray:
        """Sum of squared deviations from the window's mean."""
        s, n = self.total_of(x, y, d), self.count(x, y, d)
        squares = self.sum(("squares", x, y), lambda: self.value(x, y) ** 2, d)
        return np.where(self.still(x, y, d), 0.0, np.maximum(squares - s * s / n, 0.0))

    # --- figures: values, and where there are any ------------------------------------
    def mean(self, x: str, d: int) -> Serie:
        n = self.count(x, None, d)
        return self.centre(x, None)[self.lead :] + self.total_of(x, None, d) / n, n > 0

    def total(self, x: str, d: int) -> Serie:
        """Sum of the window; exactly 0 where all its values are."""
        return self.sum(("raw", x), lambda: self.raw(x), d), self.count(x, None, d) > 0

    def share(self, x: str, d: int) -> Serie:
        """Mean of flags or small whole numbers, whose sums are exact."""
        n = self.count(x, None, d)
        return self.sum(("raw", x), lambda: self.raw(x), d) / n, n > 0

    def std(self, x: str, d: int) -> Serie:
        n = self.count(x, None, d)
        return np.sqrt(self.spread(x, None, d) / (n - 1)), n >= 2

    def corr(self, x: str, y: str, d: int) -> Serie:
        """Of the pairs with both sides known; none where a side does not move."""
        n, s, z = self.count(x, y, d), self.total_of(x, y, d), self.total_of(y, x, d)
        both = self.sum(("product", x, y), lambda: self.value(x, y) * self.value(y, x), d)
        scale = np.sqrt(self.spread(x, y, d)) * np.sqrt(self.spread(y, x, d))
        return (both - s * z / n) / scale, (n > 0) & (scale != 0)

    def _line(self, x: str, d: int) -> dict[str, Serie]:
        n, s, spread, still = self.count(x, None, d), self.total_of(x, None, d), self.spread(x, None, d), self.still(x, None, d)
        there = lambda: self.known(x).astype(float)
        # a row's place is how far it lies back
        u = self.walk(("u", x), there, lambda total, part, k: np.subtract(total, part * k, out=total))[d]
        uu = self.walk(("uu", x), there, lambda total, part, k: np.add(total, part * (k * k), out=total))[d]
        ux = self.walk(("ux", x), lambda: self.value(x), lambda total, part, k: np.subtract(total, part * k, out=total))[d]
        var_u, cov = uu - u * u / n, np.where(still, 0.0, ux - u * s / n)
        enough, product = n >= 2, spread * var_u
        slope = cov / var_u
        rest = self.value(x)[self.lead :] - (s / n - slope * u / n)
        r2 = np.where(spread == 0, 1.0, np.fmin(cov * cov / product, 1.0))
        moved = enough & (var_u != 0)
        return {"slope": (slope, moved), "rsquare": (r2, enough & ((spread == 0) | (product > 0))), "resi": (rest, moved & self.known(x)[self.lead :])}

    def line(self, x: str, d: int, which: str) -> Serie:
        """Slope, R2 or last residual of the least-squares line over the row's place."""
        return self.once(("line", x, d), lambda: self._line(x, d))[which]

    def rank(self, x: str, d: int) -> Serie:
        """(values below + (values equal + 1) / 2) / values."""
        now, known = self.rows[x][0][self.lead :], self.known(x)
        seen = lambda: np.where(known, self.rows[x][0], np.nan)
        below = self.walk(("below", x), seen, lambda total, part, k: np.add(total, part < now, out=total))[d]
        equal = self.walk(("equal", x), seen, lambda total, part, k: np.add(total, part == now, out=total))[d]
        return (below + (equal + 1) / 2.0) / self.count(x, None, d), known[self.lead :]

    def _some(self, x: str, d: int) -> np.ndarray:
        return self.walk(("some", x), lambda: self.rows[x][1], lambda total, part, k: np.add(total, part, out=total))[d] > 0

    def max(self, x: str, d: int) -> Serie:
        """NaN counts as the greatest."""
        value = lambda: np.where(self.rows[x][1], self.rows[x][0], -np.inf)
        return self.walk(("highest", x), value, lambda total, part, k: np.maximum(total, part, out=total), -np.inf)[d], self._some(x, d)

    def min(self, x: str, d: int) -> Serie:
        """NaN counts as the greatest."""
        value = lambda: np.where(self.rows[x][1], self.rows[x][0], np.nan)
        return self.walk(("lowest", x), value, lambda total, part, k: np.fmin(total, part, out=total), np.nan)[d], self._some(x, d)

    def lag(self, x: str, d: int) -> Serie:
        """The value ``d`` rows before, as it is."""
        v, there = self.rows[x]
        at = slice(self.lead - d, self.lead - d + len(self.t))
        return v[at], there[at] & (self.t > d)
