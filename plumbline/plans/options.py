"""What a profile computes: options for each statistic, set by dotted paths with wildcards, checked, and presets.

A path such as `numeric.min`, `category.top_k` or `*.enabled` names options; of a whole set, `structured.` and
`unstructured.` tell the table's from the text's, and a name that both have has to say which it means.
"""

from __future__ import annotations

import fnmatch
import json
import warnings
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from pyspark.sql import Column

from plumbline.functions.exprs import NULL_TOKENS
from plumbline.functions.histograms import METHODS


class Settable:
    """set() by paths, check() of all values, and dictionaries there and back."""

    def paths(self, before: str = "") -> list[str]:
        out = []
        for f in fields(self):
            x = getattr(self, f.name)
            out += x.paths(f"{before}{f.name}.") if isinstance(x, Settable) else [before + f.name]
        return out

    def set(self, changes: dict[str, object]) -> Settable:
        for pattern, value in changes.items():
            found = self.matching(pattern)
            if not found:
                raise AttributeError(f"no option is called {pattern}")
            for path in found:
                *above, last = path.split(".")
                at = self
                for p in above:
                    at = getattr(at, p)
                setattr(at, last, value)
        self.check()
        return self

    def matching(self, pattern: str) -> list[str]:
        every = self.paths()
        return [p for p in every if p == pattern or fnmatch.fnmatchcase(p, pattern) or "*" in pattern and pattern.startswith("*.") and p == pattern[2:]]

    def errors(self, before: str = "") -> list[str]:
        out = []
        for f in fields(self):
            x, name = getattr(self, f.name), before + f.name
            if isinstance(x, Settable):
                out += x.errors(name + ".")
                continue
            if f.type == "bool" and not isinstance(x, bool):
                out.append(f"{name} is true or false")
            if f.type in ("int", "int | None") and not (x is None and f.type != "int") and (not isinstance(x, int) or isinstance(x, bool) or x < 1):
                out.append(f"{name} is a number above 0")
            if f.type == "float" and not (isinstance(x, (int, float)) and 0 <= x <= 1):
                out.append(f"{name} lies between 0 and 1")
        return out + [before + e for e in self.own_errors()]

    def own_errors(self) -> list[str]:
        return []

    def check(self, strict: bool = True) -> list[str]:
        found = self.errors()
        if found and strict:
            raise ValueError("; ".join(found))
        return found

    def to_dict(self) -> dict:
        return json.loads(json.dumps(asdict(self)))

    @classmethod
    def of(cls, d: dict) -> Settable:
        out = cls()
        for k, v in d.items():
            old = getattr(out, k)
            setattr(out, k, type(old).of(v) if is_dataclass(old) else tuple(v) if isinstance(v, list) else v)
        return out


@dataclass
class Switch(Settable):
    enabled: bool = True


@dataclass
class Histogram(Settable):
    """method is an estimator of the number of bins, several of which the one with least loss counts, or the number."""

    enabled: bool = True
    method: str | int | tuple = "auto"
    quantiles: int = 1000

    def own_errors(self) -> list[str]:
        own = self.method if isinstance(self.method, (tuple, list)) else (self.method,)
        good = own and all(m in METHODS or isinstance(m, int) and len(own) == 1 and m > 0 for m in own)
        return [] if good else [f"method is a number of bins, or of {', '.join(METHODS)}"]


@dataclass
class Mode(Settable):
    enabled: bool = True
    top_k: int = 5


NUMERIC = ("min", "max", "sum", "mean", "variance", "stddev", "skewness", "kurtosis", "median", "median_abs_deviation", "num_zeros", "num_negatives")


@dataclass
class Numeric(Settable):
    enabled: bool = True
    min: bool = True
    max: bool = True
    sum: bool = True
    mean: bool = True
    variance: bool = True
    stddev: bool = True
    skewness: bool = True
    kurtosis: bool = True
    median: bool = True
    median_abs_deviation: bool = True
    num_zeros: bool = True
    num_negatives: bool = True
    bias_correction: bool = True

    def own_errors(self) -> list[str]:
        out = [f"{a} needs {b}" for a, b in (("variance", "sum"), ("stddev", "variance"), ("skewness", "variance"), ("kurtosis", "variance")) if getattr(self, a) and not getattr(self, b)]
        return out if self.enabled else []

    @property
    def off(self) -> set[str]:
        return {k for k in NUMERIC if not getattr(self, k)} if self.enabled else set(NUMERIC)


@dataclass
class Text(Settable):
    """Statistics of texts' lengths, and their characters."""

    enabled: bool = True
    vocabulary: bool = True


@dataclass
class Category(Settable):
    """Counts are exact; of columns with over most_values values they stay in Spark and only figures of them are kept.

    With stop_at and stop_ratio, columns whose values are mostly different are known by a sketch alone, as all are if
    sketched is set.
    """

    enabled: bool = True
    top_k: int | None = None
    most_values: int = 1000
    stop_at: int | None = None
    stop_ratio: float = 1.0
    sketched: bool = False
    sketch_confidence: float = 0.95
    sketch_error: float = 0.01
    heavy_hitters: int = 5000


@dataclass
class Correlation(Settable):
    enabled: bool = False
    columns: tuple | None = None


@dataclass
class Rows(Settable):
    """unique: `full` counts hashes, `hll` estimates from 2 ** registers."""

    enabled: bool = True
    unique: str = "full"
    registers: int = 15
    nulls: bool = True

    def own_errors(self) -> list[str]:
        return ([] if self.unique in ("full", "hll") else ["unique is full or hll"]) + ([] if 4 <= self.registers <= 21 else ["registers lie between 4 and 21"])


@dataclass
class LabelerOptions(Settable):
    enabled: bool = False
    name: str = "structured_regex"
    folder: str | None = None
    cells: int = 1000


@dataclass
class Structured(Settable):
    columns: tuple | None = None
    null_values: tuple = NULL_TOKENS
    histogram: Histogram = field(default_factory=Histogram)
    mode: Mode = field(default_factory=Mode)
    numeric: Numeric = field(default_factory=Numeric)
    precision: Switch = field(default_factory=Switch)
    text: Text = field(default_factory=Text)
    datetime: Switch = field(default_factory=Switch)
    order: Switch = field(default_factory=Switch)
    category: Category = field(default_factory=Category)
    rows: Rows = field(default_factory=Rows)
    chi2: Switch = field(default_factory=Switch)
    correlation: Correlation = field(default_factory=Correlation)
    null_replication: Switch = field(default_factory=lambda: Switch(False))
    labeler: LabelerOptions = field(default_factory=LabelerOptions)
    #: Names of statistics of one's own, plugins of kind `column`.
    custom: tuple = ()

    def own_errors(self) -> list[str]:
        out = ["chi2 needs category"] if self.chi2.enabled and not self.category.enabled else []
        return out + [f"no plugin of kind column is called {n}" for n in self.custom if n not in PLUGINS.get("column", {})]

    def common(self, o: Structured) -> Structured:
        """What both compute; warns of statistics that only one of them does."""
        out, mine, other = type(self).of(self.to_dict()), self.to_dict(), o.to_dict()

        def both(a: dict, b: dict, at: Settable, path: str) -> None:
            for k, v in a.items():
                if isinstance(v, dict):
                    both(v, b[k], getattr(at, k), f"{path}{k}.")
                elif isinstance(v, bool) and v != b[k]:
                    warnings.warn(f"{path}{k} is on in one profile only and isn't merged", RuntimeWarning, stacklevel=4)
                    setattr(at, k, False)

        both(mine, other, out, "")
        out.custom = tuple(n for n in self.custom if n in o.custom)
        if not out.category.enabled:
            out.chi2.enabled = False
        return out

    def enabled(self) -> list[str]:
        """The statistics that are asked for."""
        return [f.name for f in fields(self) if getattr(getattr(self, f.name), "enabled", False)]


@dataclass
class Words(Settable):
    enabled: bool = True
    case_sensitive: bool = True
    stop_words: tuple | None = None
    words: bool = True
    vocabulary: bool = True
    top_k_words: int | None = None
    top_k_chars: int | None = None


@dataclass
class Unstructured(Settable):
    text: Words = field(default_factory=Words)
    labeler: LabelerOptions = field(default_factory=lambda: LabelerOptions(name="regex"))


PLUGINS: dict[str, dict[str, Callable]] = {}


class ColumnStatistic(ABC):
    """A statistic of one's own, as a plugin of kind `column`: an aggregation whose results add up.

    A profile takes it from an instance of the class; aggregate() gives Spark's aggregation of a column of texts (nulls
    where cells are missing), merge() puts two results together, and finish() makes of a result what reports show.
    """

    @abstractmethod
    def aggregate(self, column: Column) -> Column: ...

    @abstractmethod
    def merge(self, a: object, b: object) -> object: ...

    def finish(self, x: object) -> object:
        return x


def plugin(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Registers a function of a kind; those of kind `preset` change an options object."""

    def register(f: Callable) -> Callable:
        PLUGINS.setdefault(kind, {})[name] = f
        return f

    return register


def plugins(kind: str) -> dict[str, Callable]:
    return dict(PLUGINS.get(kind, {}))


def load_plugins(group: str = "plumbline.plugins") -> list[str]:
    """Imports what installed packages offer under an entry point, and tells their names."""
    from importlib.metadata import entry_points

    found = [e for e in entry_points(group=group)]
    for e in found:
        e.load()
    return [e.name for e in found]


@plugin("preset", "complete")
def _complete(o: Options) -> None:
    o.structured.set({"correlation.enabled": True, "null_replication.enabled": True})


@plugin("preset", "data_types")
def _data_types(o: Options) -> None:
    o.structured.set({"histogram.enabled": False, "chi2.enabled": False, "category.enabled": False, "rows.enabled": False, "numeric.enabled": False, "order.enabled": False, "text.vocabulary": False, "precision.enabled": False})


@plugin("preset", "numeric_stats_disabled")
def _no_numbers(o: Options) -> None:
    o.structured.set({"numeric.enabled": False, "histogram.enabled": False, "precision.enabled": False})


@plugin("preset", "lower_memory_sketching")
def _sketching(o: Options) -> None:
    o.structured.set({"rows.unique": "hll", "category.stop_at": 5000, "category.stop_ratio": 0.5})


@dataclass
class Options(Settable):
    structured: Structured = field(default_factory=Structured)
    unstructured: Unstructured = field(default_factory=Unstructured)

    @classmethod
    def preset(cls, name: str) -> Options:
        if name not in PLUGINS.get("preset", {}):
            raise ValueError(f"no such preset: {name}; there are {', '.join(sorted(PLUGINS.get('preset', {})))}")
        out = cls()
        PLUGINS["preset"][name](out)
        out.check()
        return out

    def matching(self, pattern: str) -> list[str]:
        found = super().matching(pattern)
        if found or "*" in pattern:
            return found
        found = [p for p in self.paths() if p.split(".", 1)[1] == pattern]
        if len(found) > 1:
            raise ValueError(f"{pattern} may be {' or '.join(found)}: say which")
        return found
