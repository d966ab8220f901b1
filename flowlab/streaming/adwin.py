"""Adaptive windowing (Bifet and Gavalda, 2007) over a stream of values in [0, 1]."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from flowlab import fixed

CHECK_EVERY = 32
GRACE = 10
SHORTEST = 5


def cut_bound(n_old: float, n_new: float, variance: float, delta: float) -> float:
    """How far two sub-window means may differ by chance, at confidence ``delta``."""
    inverse_m = 1.0 / n_old + 1.0 / n_new
    log_term = math.log(2.0 * math.log(n_old + n_new) / delta)
    return math.sqrt(2.0 * inverse_m * variance * log_term) + 2.0 / 3.0 * inverse_m * log_term


@dataclass
class AdaptiveWindow:
    """An exponential histogram: blocks of 2^level values, oldest first.

    At most ``fixed.DRIFT_BUCKETS`` blocks share a level, so a window of n values needs
    O(log n) blocks.
    """

    levels: list[int] = field(default_factory=list)
    sums: list[float] = field(default_factory=list)
    squares: list[float] = field(default_factory=list)
    seen: int = 0

    def add(self, value: float, delta: float = fixed.DRIFT_DELTA) -> tuple[float, float, int] | None:
        """Take one value. On drift: old mean, new mean, and the length of the new window."""
        self.levels.append(0)
        self.sums.append(value)
        self.squares.append(value * value)
        self.seen += 1
        self._compact()
        if self.seen % CHECK_EVERY:
            return None
        return self._shrink(delta)

    def width(self) -> int:
        return sum(1 << level for level in self.levels)

    def _compact(self) -> None:
        """Merge the two oldest blocks of any level that holds too many."""
        level, end = 0, len(self.levels)
        while True:
            start = end
            while start and self.levels[start - 1] == level:
                start -= 1
            if end - start <= fixed.DRIFT_BUCKETS:
                return
            self.levels[start : start + 2] = [level + 1]
            for part in (self.sums, self.squares):
                part[start : start + 2] = [part[start] + part[start + 1]]
            level, end = level + 1, start + 1

    def _shrink(self, delta: float) -> tuple[float, float, int] | None:
        """Drop oldest blocks while some cut separates two different means."""
        drift = None
        while len(self.levels) > 1:
            n = self.width()
            if n <= GRACE:
                break
            whole = sum(self.sums)
            variance = max(sum(self.squares) / n - (whole / n) ** 2, 0.0)
            found, n_old, old = None, 0, 0.0
            for level, part in zip(self.levels[:-1], self.sums[:-1]):
                n_old += 1 << level
                old += part
                n_new = n - n_old
                if n_old < SHORTEST or n_new < SHORTEST:
                    continue
                means = old / n_old, (whole - old) / n_new
                if abs(means[0] - means[1]) > cut_bound(n_old, n_new, variance, delta):
                    found = (*means, n_new)
                    break
            if found is None:
                break
            drift = drift or found
            del self.levels[0], self.sums[0], self.squares[0]
        return drift
