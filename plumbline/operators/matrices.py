"""Statistics of pairs of columns: correlation, homogeneity of categories, what goes with missing values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs
from plumbline.functions.special import chi2_survival
from plumbline.operators import categorical
from plumbline.operators.numeric import isinstance_string


def _number(df: DataFrame, c: str) -> Column:
    return exprs.to_double(F.col(f"`{c}`")) if isinstance_string(df, c) else F.col(f"`{c}`").cast("double")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_1, column_2, correlation) of all ordered pairs: Pearson's, missing values replaced by the mean.

    A missing value that is the mean has no deviation, so a batch's part is the product of its matrix of deviations with
    itself; parts are summed up cell by cell, whatever the number of columns.
    """
    k = len(columns)
    numbers = df.select(*[exprs.finite(_number(df, c)).alias(f"x{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(f"x{i}") for i in range(k)]).first()
    centre = np.array([0.0 if m is None else m for m in means])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre[:, None]
            x = np.where(np.isnan(x), 0.0, x)
            total += x @ x.T
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    cells = numbers.mapInArrow(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    own = cells.filter("i = j").select("i", F.col("s").alias("own"))
    both = cells.join(own, "i").join(own.select(F.col("i").alias("j"), F.col("own").alias("other")), "j")
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    r = F.when(F.col("i") == F.col("j"), 1.0).when((F.col("own") > 0) & (F.col("other") > 0), F.col("s") / F.sqrt("own") / F.sqrt("other"))
    return both.select(name("i").alias("column_1"), name("j").alias("column_2"), r.alias("correlation"))


def homogeneity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_1, column_2, statistic, freedom) for pairs of columns: chi-squared of their value counts as two samples.

    Pairs with fewer than two values between them have nulls.
    """
    n = categorical.counts(df, columns)
    sizes = n.groupBy("column_name").agg(F.sum("n").alias("size"))
    names = sizes.select("column_name", "size")
    pairs = names.select(F.col("column_name").alias("column_1"), F.col("size").alias("n1")).crossJoin(names.select(F.col("column_name").alias("column_2"), F.col("size").alias("n2"))).filter("column_1 < column_2")
    left = pairs.join(n.withColumnRenamed("column_name", "column_1").withColumnRenamed("n", "c1"), "column_1").select("column_1", "column_2", "n1", "n2", "value", "c1", F.lit(0).cast("bigint").alias("c2"))
    right = pairs.join(n.withColumnRenamed("column_name", "column_2").withColumnRenamed("n", "c2"), "column_2").select("column_1", "column_2", "n1", "n2", "value", F.lit(0).cast("bigint").alias("c1"), "c2")
    both = left.unionByName(right).groupBy("column_1", "column_2", "n1", "n2", "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    total, c = F.col("n1") + F.col("n2"), F.col("c1") + F.col("c2")
    e1, e2 = F.col("n1") * c / total, F.col("n2") * c / total
    term = F.pow(F.col("c1") - e1, 2) / e1 + F.pow(F.col("c2") - e2, 2) / e2
    got = both.groupBy("column_1", "column_2").agg(F.sum(term).alias("statistic"), (F.count(F.lit(1)) - 1).alias("freedom"))
    return got.select("column_1", "column_2", F.when(F.col("freedom") > 0, F.col("statistic")).alias("statistic"), F.when(F.col("freedom") > 0, F.col("freedom")).alias("freedom"))


def chi2_test(one: dict[str, int], n1: int, two: dict[str, int], n2: int) -> dict[str, float | None]:
    """Homogeneity of two value counts: statistic, degrees of freedom, p-value; nulls below two values."""
    values = one.keys() | two.keys()
    out: dict[str, float | None] = {"chi2-statistic": None, "deg_of_free": None, "p-value": None}
    if len(values) < 2:
        return out
    out["deg_of_free"] = len(values) - 1
    sums = {v: one.get(v, 0) + two.get(v, 0) for v in values}
    if not n1 or not n2 or 0 in sums.values():
        return out | {"chi2-statistic": float("inf"), "p-value": 0.0}
    x = 0.0
    for v, s in sums.items():
        for own, n in ((one, n1), (two, n2)):
            expected = n * s / (n1 + n2)
            x += (own.get(v, 0) - expected) ** 2 / expected
    return out | {"chi2-statistic": x, "p-value": chi2_survival(x, len(values) - 1)}


def chi2_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """homogeneity() with p_value; its rows, one for each pair of columns, go through the driver."""
    rows = homogeneity(df, columns).collect()
    out = [(r[0], r[1], r[2], r[3], None if r[2] is None else chi2_survival(r[2], r[3])) for r in rows]
    return df.sparkSession.createDataFrame(out, "column_1 string, column_2 string, statistic double, freedom bigint, p_value double")


def null_replication(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, other, null_prior, sum_null, sum_there, n_null, n_there, mean_null, mean_there).

    For each column with missing cells, sums and means of the other columns over the rows where it is missing and
    where it is there.
    """
    k = len(columns)
    numbers = df.select(*[exprs.finite(_number(df, c)).alias(f"x{i}") for i, c in enumerate(columns)], *[exprs.is_null_token(F.col(f"`{c}`").cast("string")).alias(f"z{i}") for i, c in enumerate(columns)])
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(f"z{i}").alias(f"n{i}") for i in range(k)]
    for i in range(k):
        for j in range(k):
            if i != j:
                for tag, test in (("a", F.col(f"z{i}")), ("b", ~F.col(f"z{i}"))):
                    x = F.when(test, F.col(f"x{j}"))
                    aggs += [F.sum(x).alias(f"s{tag}{i}_{j}"), F.count(x).alias(f"c{tag}{i}_{j}"), F.avg(x).alias(f"m{tag}{i}_{j}")]
    got = numbers.agg(*aggs)
    cells = [
        F.struct(
            F.lit(columns[i]).alias("column_name"), F.lit(columns[j]).alias("other"), (F.col(f"n{i}") / F.col("n")).alias("null_prior"),
            *[F.col(f"{s}{i}_{j}").alias(a) for s, a in (("sa", "sum_null"), ("sb", "sum_there"), ("ca", "n_null"), ("cb", "n_there"), ("ma", "mean_null"), ("mb", "mean_there"))],
        )
        for i in range(k) for j in range(k) if i != j
    ]
    return got.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("null_prior > 0")
