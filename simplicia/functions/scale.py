"""Scale selectors: from the heights of a dendrogram to the height at which it is cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Selector = Callable[[np.ndarray], float]


def _trivial(h: np.ndarray) -> float | None:
    return 0.0 if len(h) == 0 else float(h[0]) if len(h) == 1 else None


@dataclass(frozen=True)
class Histogram:
    """Lower edge of the first empty of n equal bins between the least and largest height; the largest if none is empty."""

    n: int = 10

    def __call__(self, h: np.ndarray) -> float:
        if (t := _trivial(h)) is not None:
            return t
        low, high = float(np.min(h)), float(np.max(h))
        width = (high - low) / self.n
        if width == 0:
            return high
        taken = set(np.floor((np.asarray(h) - low) / width).astype(int).tolist())
        empty = next((k for k in range(self.n) if k not in taken), None)
        return high if empty is None else low + empty * width

    resolution = property(lambda self: self.n)


@dataclass(frozen=True)
class Danifold:
    """Upper edge of the first empty of n equal bins from 0 to the largest height; the largest if none is empty."""

    n: int = 10

    def __call__(self, h: np.ndarray) -> float:
        if (t := _trivial(h)) is not None:
            return t
        high = float(np.max(h))
        width = high / self.n
        if width == 0:
            return high
        taken = set(np.floor(np.asarray(h) / width).astype(int).tolist())
        empty = next((k for k in range(self.n) if k not in taken), None)
        return high if empty is None else (empty + 1) * width

    resolution = property(lambda self: self.n)


@dataclass(frozen=True)
class FirstGap:
    """Middle of the first gap between neighbouring heights that exceeds a percentage of the largest; the largest if none does."""

    percent: int = 10

    def __call__(self, h: np.ndarray) -> float:
        if (t := _trivial(h)) is not None:
            return t
        s = np.sort(h)
        wide = np.flatnonzero(np.diff(s) > self.percent / 100 * s[-1])
        return float(s[wide[0]] + s[wide[0] + 1]) / 2 if len(wide) else float(s[-1])

    resolution = property(lambda self: self.percent)


@dataclass(frozen=True)
class BiggestGap:
    """Middle of the largest gap between neighbouring heights, the first of equals."""

    def __call__(self, h: np.ndarray) -> float:
        if (t := _trivial(h)) is not None:
            return t
        s = np.sort(h)
        k = int(np.diff(s).argmax())
        return float(s[k] + s[k + 1]) / 2

    resolution = property(lambda self: 0)


@dataclass(frozen=True)
class Fixed:
    """Always the same height."""

    height: float

    def __call__(self, h: np.ndarray) -> float:
        return self.height

    resolution = property(lambda self: 0)
