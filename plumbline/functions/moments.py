"""Central moments as mergeable state, and the bias-corrected figures read from it."""

from __future__ import annotations

import math
from dataclasses import dataclass

NAN = math.nan


@dataclass(frozen=True)
class Moments:
    """Count, mean, and sums of squared, cubed and fourth powers of deviations."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0

    @classmethod
    def of(cls, n: int, mean: float | None, variance: float | None, skew: float | None, kurt: float | None) -> Moments:
        """From population variance, skewness and excess kurtosis (null where the values are constant)."""
        if not n:
            return cls()
        v = variance or 0.0
        return cls(n, mean or 0.0, n * v, n * (skew or 0.0) * v**1.5, n * ((kurt if kurt is not None else -3.0) + 3) * v * v)

    def __add__(self, o: Moments) -> Moments:
        """What the values of both together have."""
        if not self.n or not o.n:
            return self if self.n else o
        n, d = self.n + o.n, o.mean - self.mean
        a, b = self.n, o.n
        m2 = self.m2 + o.m2 + d * d * a * b / n
        m3 = self.m3 + o.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * o.m2 - b * self.m2) / n
        m4 = self.m4 + o.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3
        m4 += 6 * d * d * (a * a * o.m2 + b * b * self.m2) / n**2 + 4 * d * (a * o.m3 - b * self.m3) / n
        return Moments(n, self.mean + d * b / n, m2, m3, m4)

    @property
    def constant(self) -> bool:
        return self.m2 < 1e-14

    def variance(self, corrected: bool = True) -> float:
        if corrected:
            return self.m2 / (self.n - 1) if self.n > 1 else NAN
        return self.m2 / self.n if self.n else NAN

    def stddev(self, corrected: bool = True) -> float:
        v = self.variance(corrected)
        return math.sqrt(v) if v == v else NAN

    def skewness(self, corrected: bool = True) -> float:
        n = self.n
        if not n or corrected and n < 3:
            return NAN
        g = 0.0 if self.constant else math.sqrt(n) * self.m3 / self.m2**1.5
        return g * math.sqrt(n * (n - 1)) / (n - 2) if corrected else g

    def kurtosis(self, corrected: bool = True) -> float:
        n = self.n
        if not n or corrected and n < 4:
            return NAN
        g = -3.0 if self.constant else n * self.m4 / self.m2**2 - 3
        return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g + 3) - 3 * (n - 1)) if corrected else g
