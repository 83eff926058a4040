"""Equal-width histograms on the driver: bin numbers, quantiles, mode, median deviation, re-binning, distances."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from plumbline.functions.moments import Moments

STORED_BINS, MOST_BINS = 1000, 100_000
METHODS = ("auto", "fd", "doane", "scott", "rice", "sturges", "sqrt")


def bin_width(method: str, n: int, low: float, high: float, stddev: float = 0.0, skew: float = 0.0, iqr: float = 0.0) -> float:
    """A method's width of bins, from what a profile knows of the values (population stddev and skewness)."""
    span = high - low
    if not n or not span:
        return 0.0
    if method == "sqrt":
        return span / math.sqrt(n)
    if method == "sturges":
        return span / (math.log2(n) + 1)
    if method == "rice":
        return span / (2 * n ** (1 / 3))
    if method == "scott":
        return (24 * math.sqrt(math.pi) / n) ** (1 / 3) * stddev
    if method == "fd":
        return 2 * iqr * n ** (-1 / 3)
    if method == "doane":
        if n <= 2:
            return 0.0
        error = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
        return span / (1 + math.log2(n) + math.log2(1 + abs(skew) / error))
    if method == "auto":
        fd, sturges = bin_width("fd", n, low, high, iqr=iqr), bin_width("sturges", n, low, high)
        return min(fd, sturges) if fd else sturges
    raise ValueError(f"no such method: {method}")


def bin_count(method: str, n: int, low: float, high: float, **known: float) -> int:
    width = bin_width(method, n, low, high, **known)
    return max(1, math.ceil((high - low) / width)) if width else 1


@dataclass
class Histogram:
    """Counts between equal edges (one bin without width where there is one value)."""

    counts: np.ndarray
    edges: np.ndarray

    @classmethod
    def empty(cls) -> Histogram:
        return cls(np.zeros(0, np.int64), np.zeros(0))

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    def quantile(self, p: float | np.ndarray) -> np.ndarray:
        """Values below which a share p lies, by linear interpolation; on a flat stretch its middle."""
        p = np.atleast_1d(np.asarray(p, float))
        if not self.total:
            return np.full(len(p), np.nan)
        up = np.concatenate([[0.0], np.cumsum(self.counts) / self.total])
        left = np.interp(p, up, self.edges)
        first, last = np.searchsorted(up, p - 1e-12), np.searchsorted(up, p + 1e-12, "right") - 1
        flat = (last > first) & (first < len(up)) & (np.abs(up[np.minimum(first, len(up) - 1)] - p) < 1e-12)
        left[flat] = (self.edges[first[flat]] + self.edges[last[flat]]) / 2
        return left

    def quantiles(self, groups: int = 1000) -> list[float]:
        return self.quantile(np.arange(1, groups) / groups).tolist()

    def median(self) -> float:
        return float(self.quantile(0.5)[0])

    def modes(self, k: int = 5) -> list[float]:
        """Middles of the fullest bins, at most k of those that tie."""
        if not self.total:
            return [math.nan]
        at = np.flatnonzero(self.counts == self.counts.max())[:k]
        return ((self.edges[at] + self.edges[at + 1]) / 2).tolist()

    def deviation(self) -> float:
        """The median absolute deviation: the histogram folded at its median, and the middle of that."""
        if not self.total:
            return math.nan
        middle = self.median()
        if self.edges[-1] == self.edges[0]:
            return 0.0
        share = np.concatenate([[0.0], np.cumsum(self.counts) / self.total])
        below = lambda x: np.interp(x, self.edges, share)
        points = np.unique(np.concatenate([[0.0], np.abs(self.edges - middle)]))
        within = below(middle + points) - np.where(points > 0, below(middle - points), below(middle))
        return float(np.interp(0.5, within, points))

    def rebin(self, edges: np.ndarray) -> tuple[Histogram, float]:
        """The counts in other equal bins, a bin that straddles edges split in proportion; and the squared shift of it."""
        counts = np.zeros(len(edges) - 1)
        loss, k = 0.0, len(edges) - 1
        width = edges[-1] - edges[0]
        for n, a, b in zip(self.counts, self.edges, self.edges[1:], strict=False):
            if not n:
                continue
            lo = min(k - 1, max(0, int((a - edges[0]) / width * k))) if width else 0
            hi = min(k - 1, max(0, int((b - edges[0]) / width * k))) if width else 0
            if hi > lo and edges[hi] >= b:
                hi -= 1
            left = n
            for j in range(lo, hi + 1):
                part = left if j == hi else min(left, round(n * (min(b, edges[j + 1]) - max(a, edges[j])) / (b - a)))
                counts[j] += part
                left -= part
                loss += ((a + b) / 2 - (edges[j] + edges[j + 1]) / 2) ** 2 * part
        return Histogram(counts.astype(np.int64), edges), loss

    def __add__(self, o: Histogram) -> Histogram:
        """Both in STORED_BINS bins over the range of both."""
        if not self.total or not o.total:
            return self if self.total else o
        low, high = min(self.edges[0], o.edges[0]), max(self.edges[-1], o.edges[-1])
        if low == high:
            return Histogram(np.array([self.total + o.total]), np.array([low, high]))
        if len(self.edges) == len(o.edges) and np.array_equal(self.edges, o.edges):
            return Histogram(self.counts + o.counts, self.edges)
        edges = np.linspace(low, high, STORED_BINS + 1)
        return Histogram(self.rebin(edges)[0].counts + o.rebin(edges)[0].counts, edges)

    def suggested(self, bins: int) -> Histogram:
        if not self.total or self.edges[0] == self.edges[-1]:
            return self
        return self.rebin(np.linspace(self.edges[0], self.edges[-1], bins + 1))[0]


def expanded(h: Histogram) -> np.ndarray:
    """Values that stand for a histogram's: each bin's left edge as often as it counts, half of the last bin's its right."""
    if not h.total:
        return np.zeros(0)
    half = int(h.counts[-1]) // 2
    return np.concatenate([np.repeat(h.edges[:-1], [*h.counts[:-1], h.counts[-1] - half]), np.repeat(h.edges[-1:], half)])


def of_values(values: np.ndarray, bins: int = STORED_BINS) -> Histogram:
    """Equal bins over finite values."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if not len(x):
        return Histogram.empty()
    if x.min() == x.max():
        return Histogram(np.array([len(x)]), np.array([x.min(), x.max()]))
    return Histogram(*np.histogram(x, bins))


def updated(h: Histogram, values: np.ndarray) -> Histogram:
    """With a further batch of values, over the range of both."""
    return h + of_values(values)


def view(h: Histogram, method: str, m: Moments) -> tuple[Histogram, float]:
    """The histogram in as many bins as the method suggests from what is known of the values, and the loss of that."""
    q = h.quantile(np.array([0.25, 0.75]))
    n = bin_count(method, h.total, float(h.edges[0]), float(h.edges[-1]), stddev=m.stddev(False), skew=m.skewness(False), iqr=float(q[1] - q[0]))
    if h.edges[0] == h.edges[-1]:
        return h, 0.0
    return h.rebin(np.linspace(h.edges[0], h.edges[-1], min(n, MOST_BINS) + 1))


def losses(views: dict[str, tuple[Histogram, float]], m: Moments) -> dict[str, float]:
    """Of each view, how far its variance is from the true one, and its squared shifts, each over the mean of all views."""
    def variance(h: Histogram) -> float:
        x = (h.edges[:-1] + h.edges[1:]) / 2
        mean = (x * h.counts).sum() / h.total
        return float(((x - mean) ** 2 * h.counts).sum() / h.total)

    off = {k: abs(variance(h) - m.variance(False)) for k, (h, _) in views.items()}
    shift = {k: loss for k, (_, loss) in views.items()}
    share = lambda x, all_: x / (sum(all_.values()) / len(all_)) if sum(all_.values()) else 0.0
    return {k: share(off[k], off) + share(shift[k], shift) for k in views}


def best_histogram(h: Histogram, method: str | int | tuple, m: Moments) -> Histogram:
    """The histogram to show: in a given number of bins, or by the method with the least loss (of those that tie, more bins)."""
    if not h.total:
        return h
    own = method if isinstance(method, (tuple, list)) else (method,)
    if isinstance(own[0], int):
        return h.suggested(own[0])
    views = {k: view(h, k, m) for k in own}
    loss = losses(views, m)
    return views[min(views, key=lambda k: (round(loss[k], 12), -len(views[k][0].counts), k))][0]


def cut_points(quantiles: list[float], groups: int) -> list[float]:
    """The groups - 1 cuts among stored ones that part them evenly."""
    n = len(quantiles) + 1
    if not 1 < groups <= n:
        raise ValueError(f"groups lie between 2 and {n}")
    return [quantiles[math.ceil((i + 1) * n / groups) - 1] for i in range(groups - 1)]


def psi(one: Histogram, two: Histogram, bins: int = 10) -> float:
    """The population stability index over bins of the common range; terms without a limit are left out."""
    if not one.total or not two.total:
        return math.nan
    low, high = min(one.edges[0], two.edges[0]), max(one.edges[-1], two.edges[-1])
    if low == high:
        return 0.0
    edges = np.linspace(low, high, bins + 1)
    p, q = (h.rebin(edges)[0].counts / h.total for h in (one, two))
    ok = (p > 0) & (q > 0)
    return float(((q[ok] - p[ok]) * np.log(q[ok] / p[ok])).sum())
