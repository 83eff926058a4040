"""One column's state in a profile: it adds up, is compared with another's, kept as a dictionary, and reported.

Cells that are missing are counted by their token; of the others, counts by kind, moments of numbers (and of texts'
lengths), a histogram, significant digits, the range of dates as written, the order of the rows, characters, and value
counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np

from plumbline.functions.histograms import Histogram, best_histogram
from plumbline.functions.histograms import psi as histogram_psi
from plumbline.functions.moments import Moments
from plumbline.functions.texts import significant, union
from plumbline.operators import compare, matrices
from plumbline.operators.order import Run
from plumbline.plans.options import NUMERIC, Structured, plugins


def either(f: Callable, a: object, b: object) -> object:
    """f of the two, or the one that isn't None."""
    there = [x for x in (a, b) if x is not None]
    return f(there) if there else None


def summed(a: dict, b: dict) -> dict:
    return {k: a.get(k, 0) + b.get(k, 0) for k in [*a, *(k for k in b if k not in a)]}


@dataclass
class Numbers:
    """What is known of numbers: moments, range, zeros and negatives, and a histogram."""

    moments: Moments = field(default_factory=Moments)
    low: float | None = None
    high: float | None = None
    zeros: int = 0
    negatives: int = 0
    histogram: Histogram = field(default_factory=Histogram.empty)

    def __add__(self, o: Numbers) -> Numbers:
        return Numbers(self.moments + o.moments, either(min, self.low, o.low), either(max, self.high, o.high), self.zeros + o.zeros, self.negatives + o.negatives, self.histogram + o.histogram)

    def report(self, o: Structured, with_signs: bool = True) -> dict[str, object]:
        m, h, c = self.moments, self.histogram, o.numeric.bias_correction
        if not m.n or not o.numeric.enabled:
            out: dict[str, object] = {}
        else:
            out = {"min": self.low, "max": self.high, "sum": m.mean * m.n, "mean": m.mean, "variance": m.variance(c), "stddev": m.stddev(c), "skewness": m.skewness(c), "kurtosis": m.kurtosis(c)}
            if with_signs:
                out |= {"num_zeros": self.zeros, "num_negatives": self.negatives}
        if h.total:
            q = h.quantile(np.array([0.25, 0.5, 0.75])).tolist()
            if o.histogram.enabled:
                shown = best_histogram(h, o.histogram.method, m)
                out |= {"histogram": {"bin_counts": shown.counts.tolist(), "bin_edges": shown.edges.tolist()}, "quantiles": dict(enumerate(q))}
            if o.mode.enabled:
                out["mode"] = h.modes(o.mode.top_k)
            if o.numeric.enabled:
                out |= {"median": q[1], "median_abs_deviation": h.deviation()}
        return {k: v for k, v in out.items() if k not in NUMERIC or k not in o.numeric.off}

    def diff(self, o: Numbers, psi: bool = True) -> dict[str, object]:
        a, b = self.moments, o.moments
        out = {k: compare.numbers(x, y) for k, x, y in (("min", self.low, o.low), ("max", self.high, o.high), ("sum", a.mean * a.n, b.mean * b.n), ("mean", a.mean, b.mean), ("variance", a.variance(), b.variance()), ("stddev", a.stddev(), b.stddev()))}
        if self.histogram.total and o.histogram.total:
            out |= {"median": compare.numbers(self.histogram.median(), o.histogram.median()), "mode": compare.lists(self.histogram.modes(), o.histogram.modes()), "median_absolute_deviation": compare.numbers(self.histogram.deviation(), o.histogram.deviation())}
        out["t-test"] = compare.t_test(a.mean, a.variance(), a.n, b.mean, b.variance(), b.n)
        return out | ({"psi": histogram_psi(self.histogram, o.histogram)} if psi else {})

    def plain(self) -> dict:
        return {"moments": vars(self.moments), "low": self.low, "high": self.high, "zeros": self.zeros, "negatives": self.negatives, "histogram": {"counts": self.histogram.counts.tolist(), "edges": self.histogram.edges.tolist()}}

    @classmethod
    def of(cls, d: dict) -> Numbers:
        h = d["histogram"]
        return cls(Moments(**d["moments"]), d["low"], d["high"], d["zeros"], d["negatives"], Histogram(np.array(h["counts"], np.int64), np.array(h["edges"], float)))


@dataclass
class Precision:
    """Significant digits of numbers as they are written."""

    moments: Moments = field(default_factory=Moments)
    low: int | None = None
    high: int | None = None

    def __add__(self, o: Precision) -> Precision:
        return Precision(self.moments + o.moments, either(min, self.low, o.low), either(max, self.high, o.high))

    def report(self) -> dict[str, object]:
        m = self.moments
        if not m.n:
            return {"min": None, "max": None, "mean": None, "var": None, "std": None, "sample_size": 0, "margin_of_error": None, "confidence_level": None}
        digits = max(1, self.high or 1)
        figures = {"mean": m.mean, "var": m.variance(), "std": m.stddev(), "margin_of_error": 3.291 * m.stddev() / math.sqrt(m.n)}
        rounded = {k: significant(v, digits) for k, v in figures.items()}
        return {"min": self.low, "max": self.high, "mean": rounded["mean"], "var": rounded["var"], "std": rounded["std"], "sample_size": m.n, "margin_of_error": rounded["margin_of_error"], "confidence_level": 0.999}


@dataclass
class Dates:
    """Least and greatest date as written, with their times, and the formats in use."""

    n: int = 0
    low: tuple[str, str] | None = None
    high: tuple[str, str] | None = None
    formats: list[str] = field(default_factory=list)

    def __add__(self, o: Dates) -> Dates:
        return Dates(self.n + o.n, either(min, self.low, o.low), either(max, self.high, o.high), sorted(union(self.formats, o.formats)))

    def report(self) -> dict[str, object]:
        return {"min": self.low and self.low[1], "max": self.high and self.high[1], "format": self.formats} if self.n else {}

    def diff(self, o: Dates) -> dict[str, object]:
        time = lambda x: None if x is None else datetime.fromisoformat(x[0])
        return {"min": compare.dates(time(self.low), time(o.low)), "max": compare.dates(time(self.high), time(o.high)), "format": compare.lists(self.formats, o.formats)}


@dataclass
class Counts:
    """Value counts: all of them, or (values None) what is known of them."""

    n: int = 0
    unique: int = 0
    squares: float = 0.0
    values: dict[str, int] | None = None
    estimated: bool = False

    def __add__(self, o: Counts) -> Counts:
        if self.values is not None and o.values is not None:
            return Counts.over(summed(self.values, o.values))
        if not self.n or not o.n:
            return self if self.n else o
        return Counts(self.n + o.n, max(self.unique, o.unique), math.nan, None, True)  # how many both share isn't known

    @classmethod
    def over(cls, values: dict[str, int]) -> Counts:
        return cls(sum(values.values()), len(values), float(sum(x * x for x in values.values())), values)

    @property
    def ratio(self) -> float:
        return self.unique / self.n if self.n else 0.0

    @property
    def categorical(self) -> bool:
        return bool(self.n) and (self.unique <= 10 or self.ratio <= 0.2)

    @property
    def gini(self) -> float | None:
        return None if not self.n or math.isnan(self.squares) else 1 - self.squares / self.n**2

    @property
    def unalikeability(self) -> float | None:
        return None if math.isnan(self.squares) else (self.n**2 - self.squares) / (self.n**2 - self.n) if self.n > 1 else 0.0

    def report(self, top_k: int | None = None) -> dict[str, object]:
        out: dict[str, object] = {"categorical": self.categorical, "unique_count": self.unique, "unique_ratio": self.ratio}
        if self.values is not None and self.categorical:
            top = sorted(self.values.items(), key=lambda v: (-v[1], v[0]))[:top_k]
            out |= {"categories": [k for k, _ in top], "categorical_count": dict(top)}
        return out | ({} if self.estimated else {"gini_impurity": self.gini, "unalikeability": self.unalikeability})

    def diff(self, o: Counts) -> dict[str, object]:
        out = {"categorical": compare.values(self.categorical, o.categorical), "statistics": {"unique_count": compare.numbers(self.unique, o.unique), "unique_ratio": compare.numbers(self.ratio, o.ratio)}}
        if self.values is not None and o.values is not None and self.categorical and o.categorical:
            out["statistics"] |= {
                "chi2-test": matrices.chi2_test(self.values, self.n, o.values, o.n), "categories": compare.lists(list(self.values), list(o.values)), "gini_impurity": compare.numbers(self.gini, o.gini),
                "unalikeability": compare.numbers(self.unalikeability, o.unalikeability), "psi": self.psi(o), "categorical_count": compare.dicts(self.values, o.values),
            }
        return out

    def psi(self, o: Counts) -> float:
        """Over all values of both; a value that one side lacks counts as 0 there and has no term."""
        terms = ((self.values.get(v, 0) / max(1, self.n), o.values.get(v, 0) / max(1, o.n)) for v in self.values.keys() | o.values.keys())
        return sum((q - p) * math.log(q / p) for p, q in terms if p and q)


KINDS = ("datetime", "int", "float")


@dataclass
class Column:
    """The whole state; + gives that of both parts' cells together."""

    n_rows: int = 0
    null_types: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)
    longest: int = 0
    samples: list[str] = field(default_factory=list)
    numbers: Numbers = field(default_factory=Numbers)
    lengths: Numbers = field(default_factory=Numbers)
    precision: Precision = field(default_factory=Precision)
    dates: Dates = field(default_factory=Dates)
    order: Run = field(default_factory=Run)
    characters: list[str] | None = None
    counts: Counts | None = None
    labels: dict[str, int] | None = None
    custom: dict[str, object] = field(default_factory=dict)

    def __add__(self, o: Column) -> Column:
        own = plugins("column")
        custom = {k: either(lambda x, k=k: own[k]().merge(*x) if len(x) == 2 else x[0], v, o.custom[k]) for k, v in self.custom.items() if k in o.custom}
        counts = self.counts + o.counts if self.counts is not None and o.counts is not None else None
        return Column(
            self.n_rows + o.n_rows, summed(self.null_types, o.null_types), summed(self.kinds, o.kinds), max(self.longest, o.longest), (self.samples or o.samples)[:5], self.numbers + o.numbers, self.lengths + o.lengths,
            self.precision + o.precision, self.dates + o.dates, self.order.merged(o.order), None if self.characters is None or o.characters is None else sorted(union(self.characters, o.characters)), counts,
            None if self.labels is None or o.labels is None else summed(self.labels, o.labels), custom,
        )

    @property
    def null_count(self) -> int:
        return sum(self.null_types.values())

    @property
    def cells(self) -> int:
        return self.n_rows - self.null_count

    @property
    def moments(self) -> Moments:
        return self.numbers.moments

    @property
    def values(self) -> dict[str, int] | None:
        return self.counts and self.counts.values

    @property
    def ratios(self) -> dict[str, float]:
        return {k: self.kinds.get(k, 0) / self.cells if self.cells else 0.0 for k in KINDS} | {"text": 1.0 if self.cells else 0.0}

    @property
    def data_type(self) -> str | None:
        """The first kind that all cells are of."""
        if not self.cells:
            return None
        return next((k for k in KINDS if self.kinds.get(k) == self.cells), "text" if self.longest > 255 else "string")

    def typed(self, o: Structured) -> dict[str, object]:
        """The report of the column's type: dates, numbers, or texts by their lengths."""
        kind = self.data_type
        if kind == "datetime":
            return self.dates.report()
        if kind in ("int", "float"):
            return self.numbers.report(o) | ({"precision": self.precision.report()} if kind == "float" and o.precision.enabled else {})
        out = self.lengths.report(o, False) if o.text.enabled else {}
        return out | ({"vocab": self.characters} if self.characters is not None else {})

    @property
    def data_label(self) -> str | None:
        """Labels within 0.2 of the best, of those with a share of 0.35 at least."""
        if not self.labels:
            return None
        n = sum(self.labels.values())
        top = sorted(self.labels.items(), key=lambda x: (-x[1], x[0]))[:3]
        best = top[0][1] / n
        return "|".join(k for k, x in top if best - x / n < 0.2) if best >= 0.35 else "could not determine"

    def report(self, o: Structured | None = None, top_k: int | None = None) -> dict[str, object]:
        o = o or Structured()
        out: dict[str, object] = {"data_type": self.data_type, "categorical": self.counts.categorical if self.counts else None, "order": self.order.order, "samples": self.samples}
        if self.labels is not None:
            n = max(1, sum(self.labels.values()))
            out |= {"data_label": self.data_label, "data_label_representation": {k: v / n for k, v in sorted(self.labels.items())}}
        out["statistics"] = self.typed(o) | (self.counts.report(top_k or o.category.top_k) if self.counts is not None else {})
        out["statistics"] |= {k: plugins("column")[k]().finish(v) for k, v in self.custom.items()}
        out["statistics"] |= {"sample_size": self.n_rows, "null_count": self.null_count, "null_ratio": self.null_count / self.n_rows if self.n_rows else 0.0, "null_types": sorted(self.null_types), "null_types_count": dict(sorted(self.null_types.items())), "data_type_representation": self.ratios}
        return out

    def diff(self, o: Column) -> dict[str, object]:
        one, two = self.data_type, o.data_type
        out: dict[str, object] = {"data_type": compare.values(one, two), "order": compare.values(self.order.order, o.order.order), "data_type_representation": compare.dicts(self.ratios, o.ratios)}
        if self.labels is not None and o.labels is not None:
            out |= {"data_label": compare.lists((self.data_label or "").split("|"), (o.data_label or "").split("|")), "data_label_representation": compare.dicts(self.labels, o.labels)}
        own: dict[str, object] = {"sample_size": compare.numbers(self.n_rows, o.n_rows), "null_count": compare.numbers(self.null_count, o.null_count), "null_types": compare.lists(sorted(self.null_types), sorted(o.null_types)), "null_types_count": compare.dicts(self.null_types, o.null_types)}
        if one == two:
            if one == "datetime":
                own |= self.dates.diff(o.dates)
            elif one in ("int", "float"):
                own |= self.numbers.diff(o.numbers)
                if one == "float":
                    own["precision"] = compare.dicts(self.precision.report(), o.precision.report())
            elif one:
                own |= self.lengths.diff(o.lengths, psi=False) | {"vocab": compare.lists(self.characters, o.characters)}
        if self.counts is not None and o.counts is not None:
            more = self.counts.diff(o.counts)
            own |= more.pop("statistics")
            out |= more
        return out | {"statistics": own}

    def plain(self) -> dict:
        own = {k: v for k, v in vars(self).items() if k in ("n_rows", "null_types", "kinds", "longest", "samples", "characters", "labels", "custom")}
        return own | {"numbers": self.numbers.plain(), "lengths": self.lengths.plain(), "precision": {"moments": vars(self.precision.moments), "low": self.precision.low, "high": self.precision.high}, "dates": vars(self.dates), "order": vars(self.order), "counts": self.counts and vars(self.counts)}

    @classmethod
    def of(cls, d: dict) -> Column:
        p, t = d["precision"], d["dates"]
        dates = Dates(t["n"], t["low"] and tuple(t["low"]), t["high"] and tuple(t["high"]), t["formats"])
        parts = {"numbers": Numbers.of(d["numbers"]), "lengths": Numbers.of(d["lengths"]), "precision": Precision(Moments(**p["moments"]), p["low"], p["high"]), "dates": dates, "order": Run(**d["order"]), "counts": d["counts"] and Counts(**d["counts"])}
        return cls(**(d | parts))
