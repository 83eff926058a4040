"""Differences of two profiles, value by value, and tests of two samples."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs
from plumbline.functions.special import t_two_sided
from plumbline.operators.numeric import isinstance_string

UNCHANGED = "unchanged"


def numbers(a: float | None, b: float | None) -> object:
    """a - b; the pair if one is missing."""
    if a is None and b is None or a == b or _nan(a) and _nan(b):
        return UNCHANGED
    return [a, b] if a is None or b is None else a - b


def _nan(x: object) -> bool:
    return isinstance(x, float) and math.isnan(x)


def values(a: object, b: object) -> object:
    return UNCHANGED if a == b else [a, b]


def lists(a: list | set | None, b: list | set | None) -> object:
    """[only in a, in both, only in b], repeated values counted."""
    if a is None and b is None:
        return UNCHANGED
    if a is None or b is None:
        return [a, b]
    one, two = Counter(a), Counter(b)
    if one == two:
        return UNCHANGED
    return [list((one - two).elements()), list((one & two).elements()), list((two - one).elements())]


def dates(a: datetime | None, b: datetime | None) -> object:
    """The signed time between, as text; the pair of texts if one is missing."""
    if a == b:
        return UNCHANGED
    if a is None or b is None:
        return [None if x is None else x.strftime("%x %X") for x in (a, b)]
    return ("+" if a >= b else "-") + str(abs(a - b))


def any_of(a: object, b: object) -> object:
    """The difference by the kind of the values."""
    for x in (a, b):
        if isinstance(x, dict):
            return dicts(a, b)
        if isinstance(x, (list, set, tuple)):
            return lists(a, b)
        if isinstance(x, datetime):
            return dates(a, b)
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return numbers(a, b)
    return values(a, b)


def dicts(a: dict | None, b: dict | None) -> object:
    """Differences of the values of all keys; a key that one side lacks gives a pair with None."""
    if a is None and b is None or a == b:
        return UNCHANGED
    if a is None or b is None:
        return [a, b]
    out = {k: any_of(v, b[k]) if k in b else [v, None] for k, v in a.items()}
    return out | {k: [None, v] for k, v in b.items() if k not in a}


def dicts_by_keys(a: dict | None, b: dict | None) -> object:
    """[only in a, differences of what both have, only in b]."""
    if a is None and b is None or a == b:
        return UNCHANGED
    if a is None or b is None:
        return [a, b]
    return [{k: v for k, v in a.items() if k not in b}, {k: any_of(v, b[k]) for k, v in a.items() if k in b}, {k: v for k, v in b.items() if k not in a}]


def matrices(a: np.ndarray | None, b: np.ndarray | None) -> object:
    if a is None and b is None:
        return UNCHANGED
    if a is None or b is None or np.shape(a) != np.shape(b):
        return None
    return UNCHANGED if np.allclose(a, b, equal_nan=True) else np.asarray(a) - np.asarray(b)


def t_test(mean1: float, var1: float, n1: int, mean2: float, var2: float, n2: int) -> dict[str, object]:
    """Welch's test, and the same statistic with the smaller sample's freedom; nulls below two values or without variance."""
    out: dict[str, object] = {"t-statistic": None, "conservative": {"deg_of_free": None, "p-value": None}, "welch": {"deg_of_free": None, "p-value": None}}
    if min(n1, n2) < 2 or not var1 + var2 > 0:
        return out
    a, b = var1 / n1, var2 / n2
    t = (mean1 - mean2) / math.sqrt(a + b)
    welch = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    for name, freedom in (("conservative", min(n1, n2) - 1), ("welch", welch)):
        out[name] = {"deg_of_free": freedom, "p-value": t_two_sided(t, freedom)}
    return out | {"t-statistic": t}


def t_statistics(one: DataFrame, two: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, t, conservative_freedom, welch_freedom) for columns that both frames have."""
    sides = []
    for name, df in (("1", one), ("2", two)):
        x = df.select(*[(exprs.to_double(F.col(f"`{c}`")) if isinstance_string(df, c) else F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
        long = x.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "v")
        sides.append(long.groupBy("column_name").agg(F.count("v").cast("double").alias("n" + name), F.avg("v").alias("m" + name), F.var_samp("v").alias("s" + name)))
    both = sides[0].join(sides[1], "column_name")
    a, b = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    return both.select(
        "column_name", ((F.col("m1") - F.col("m2")) / F.sqrt(a + b)).alias("t"), (F.least("n1", "n2") - 1).alias("conservative_freedom"),
        (F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))).alias("welch_freedom"),
    )


def psi(one: DataFrame, two: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row, psi: the stability index of a numeric column over equal bins of the common range, from exact counts."""
    c = F.col(f"`{column}`").cast("double")
    both = one.select(exprs.finite(c).alias("x"), F.lit(0).alias("side")).unionByName(two.select(exprs.finite(c).alias("x"), F.lit(1).alias("side"))).filter("x is not null")
    edges = F.broadcast(both.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")))  # one row
    counted = both.crossJoin(edges).groupBy("n0", "n1", exprs.bin_index(F.col("x"), F.col("lo"), F.col("hi"), F.lit(bins)).alias("b")).agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    p, q = F.col("c0") / F.col("n0"), F.col("c1") / F.col("n1")
    return counted.filter("c0 > 0 and c1 > 0").agg(F.coalesce(F.sum((q - p) * F.ln(q / p)), F.lit(0.0)).alias("psi"))


def count_diff(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, n1, n2, diff) of two (key, n) frames, by a full join."""
    a, b = one.select(F.col(key), F.col("n").alias("n1")), two.select(F.col(key), F.col("n").alias("n2"))
    return a.join(b, key, "full").select(key, "n1", "n2", (F.coalesce("n1", F.lit(0)) - F.coalesce("n2", F.lit(0))).alias("diff"))
