"""Operators on small tables against plain Python."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest

from plumbline.functions import histograms
from plumbline.functions.moments import Moments
from plumbline.operators import categorical, numeric, order, rows
from plumbline.operators.order import Run


@pytest.mark.parametrize(("n", "few"), [(1, 100), (2, 1), (1000, 5), (1000, 100_000)])
def test_ranked(spark, monkeypatch, n: int, few: int) -> None:
    """Exact quantiles, however many rounds it takes; hot values, infinities and nulls."""
    monkeypatch.setattr(numeric, "FEW", few)
    monkeypatch.setattr(numeric, "BRACKET_BINS", 7)
    rng = random.Random(n)
    a = [rng.choice([0.5, rng.gauss(0, 100), rng.random() * 1e-6]) for _ in range(n)]
    df = spark.createDataFrame([(x, str(x)) for x in a] + [(None, "x"), (float("inf"), "nan")], "a double, b string").repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = np.quantile(a, shares).tolist()
    got = numeric.ranked(df, ["a", "b"], shares)
    assert got["a"] == pytest.approx(want) and got["b"] == pytest.approx(want)
    middle = statistics.median(a)
    assert numeric.median_deviation(df, ["a"]).first()["mad"] == pytest.approx(statistics.median(abs(x - middle) for x in a))
    assert numeric.ranked(df.filter("a is null"), ["a"], [0.5]) == {"a": [None]}


@pytest.mark.parametrize("block", [3, 10, 1_000_000])
def test_null_runs(spark, block: int) -> None:
    rng = random.Random(block)
    cells = [None if rng.random() < 0.6 else 1 for _ in range(200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i bigint, x int").repartition(4)
    want, at = [], 0
    while at < len(cells):
        end = at
        while end < len(cells) and cells[end] is None:
            end += 1
        if end > at:
            want.append((at, end - 1, end - at))
        at = max(end, at + 1)
    assert sorted(tuple(r) for r in rows.null_runs(df, "x", "i", block).collect()) == want


A, D, C, R = order.ASCENDING, order.DESCENDING, order.CONSTANT, order.RANDOM
MERGES = [
    (Run(A, 1, 3), Run(A, 4, 6), A, 1, 6, True), (Run(A, 1, 5), Run(A, 4, 6), R, 1, 6, False), (Run(A, 1, 5, True), Run(A, 4, 6, True), A, 1, 6, True), (Run(A, 1, 9, True), Run(A, 4, 6), A, 1, 9, True),
    (Run(A, 4, 6, True), Run(A, 1, 9), R, 1, 9, False), (Run(D, 3, 1), Run(D, 6, 4), D, 6, 1, True), (Run(A, 1, 3), Run(D, 9, 4), R, 1, 9, False), (Run(C, 2, 2), Run(C, 2, 2), C, 2, 2, False),
    (Run(C, 2, 2), Run(C, 3, 3), C, 2, 3, True), (Run(C, 0, 0), Run(A, 1, 3), A, 0, 3, True), (Run(C, 2, 2), Run(A, 1, 3), R, 1, 3, False), (Run(C, 2, 2), Run(A, 1, 3, True), A, 1, 3, True),
    (Run(D, 3, 1, True), Run(C, 2, 2), D, 3, 1, True), (Run(R, 1, 3), Run(A, 4, 6), R, 1, 6, False), (Run(), Run(A, 4, 6), A, 4, 6, False), (Run(A, 1, 3), Run(A, "4", "6"), A, "1", "6", True),
]


@pytest.mark.parametrize("case", MERGES)
def test_order_merge(case) -> None:
    a, b, kind, first, last, piecewise = case
    assert a.merged(b) == Run(kind, first, last, piecewise)
    assert a.merged(b).order == b.merged(a).order


def test_order_of_texts(spark) -> None:
    df = spark.createDataFrame([(i, str(i), f"w{i}", None if i % 2 else "5") for i in range(8, 30)], "i int, n string, t string, c string")
    assert {r[0]: r[1] for r in order.detect(df, ["i", "n", "t", "c"], "i").collect()} == {"i": A, "n": A, "t": R, "c": C}


def test_histograms() -> None:
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, 4000)
    h = histograms.of_values(x)
    m = Moments.of(len(x), x.mean(), x.var(), float(((x - x.mean()) ** 3).mean() / x.std() ** 3), float(((x - x.mean()) ** 4).mean() / x.var() ** 2 - 3))
    assert len(histograms.expanded(h)) == 4000 and abs(np.median(histograms.expanded(h)) - np.median(x)) < 0.05
    more = histograms.updated(h, rng.normal(9, 1, 1000))
    assert more.total == 5000 and more.edges[-1] >= h.edges[-1]
    for method in histograms.METHODS:
        assert histograms.best_histogram(h, method, m).total == 4000
    views = {k: histograms.view(h, k, m) for k in histograms.METHODS}
    loss = histograms.losses(views, m)
    best = histograms.best_histogram(h, histograms.METHODS, m)
    assert len(best.counts) == len(views[min(loss, key=loss.get)][0].counts) and len(histograms.best_histogram(h, 12, m).counts) == 12
    assert histograms.cut_points(list(range(999)), 4) == [249, 499, 749]
    assert histograms.of_values([]).total == 0 and histograms.of_values([3, 3, np.inf]).counts.tolist() == [2]
    with pytest.raises(ValueError):
        histograms.cut_points([1, 2], 9)


def test_sketches_merge(spark) -> None:
    df = spark.createDataFrame([(c,) for c in "aaabbc" * 50], "x string")
    both = categorical.merged_sketches(spark, categorical.sketch(df, "x"), categorical.sketch(df, "x"))
    assert categorical.sketched_count(spark, both, "a") >= 300
    assert not categorical.stopped(df, "x", 10, 0.5) and categorical.stopped(df.withColumn("x", df["x"]).limit(1), "x", 1, 0.5)


def test_dates_parsed_once(spark) -> None:
    """A text that is there often is parsed once, and counts as often as it is there."""
    from plumbline.operators import dates

    texts = ["03/01/2020"] * 5 + ["12/31/2019"] * 3 + ["Jan 3rd, 2021", "Jan 3, 2021", "nan", "02/30/2020", "strand", "x"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "d string").repartition(3)
    assert sorted((r["raw"], r["n"]) for r in dates.parsed(df, ["d"]).collect()) == [("03/01/2020", 5), ("12/31/2019", 3), ("Jan 3, 2021", 1), ("Jan 3rd, 2021", 1)]
    assert [tuple(r) for r in dates.profile(df, ["d"]).collect()] == [("d", 10, "12/31/2019", "Jan 3rd, 2021", "%b %d, %Y|%m/%d/%Y")]
