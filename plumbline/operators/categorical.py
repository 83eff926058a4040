"""Category counts and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import exprs


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) with texts that are no null tokens."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "value")
    return texts.filter(~exprs.is_null_token(F.col("value")))


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n), exact."""
    return cells(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, columns: list[str], most: int = 10, ratio: float = 0.2) -> DataFrame:
    """(column_name, sample_size, unique_count, unique_ratio, categorical, gini_impurity, unalikeability)."""
    s = counts(df, columns).groupBy("column_name").agg(F.sum("n").alias("sample_size"), F.count(F.lit(1)).alias("unique_count"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    n = F.col("sample_size").cast("double")
    return s.select(
        "column_name", "sample_size", "unique_count", (F.col("unique_count") / n).alias("unique_ratio"), ((F.col("unique_count") <= most) | (F.col("unique_count") / n <= ratio)).alias("categorical"),
        (1 - F.col("sq") / (n * n)).alias("gini_impurity"), F.when(n > 1, (n * n - F.col("sq")) / (n * n - n)).otherwise(0.0).alias("unalikeability"),
    )


def top(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k most frequent values of each column, ties by value: (column_name, value, n, place)."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counts(df, columns).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def sketch(df: DataFrame, column: str, confidence: float = 0.95, error: float = 0.01) -> bytes:
    """A count-min sketch of a column's cells; one pass, and a size that doesn't depend on them."""
    got = cells(df, [column]).agg(F.count_min_sketch("value", F.lit(error), F.lit(confidence), F.lit(1))).first()[0]
    return bytes(got or b"")


def heavy_hitters(df: DataFrame, column: str, k: int = 5000) -> DataFrame:
    """(value, n) of the values with at least a k-th of the cells, exact."""
    own = cells(df, [column]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(own.agg(F.sum("n").alias("total")))  # one row
    return own.crossJoin(total).filter(F.col("n") >= F.col("total") / k).select("value", "n")


def sketched_count(spark: SparkSession, one: bytes, value: str) -> int:
    """What a sketch says of a value: never less than its count."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(one)).estimateCount(value)


def merged_sketches(spark: SparkSession, one: bytes, two: bytes) -> bytes:
    """The sketch of both columns' cells; both have to be of one size."""
    jvm = spark.sparkContext._jvm
    read = jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom
    return bytes(read(bytearray(one)).mergeInPlace(read(bytearray(two))).toByteArray())


def merged_heavy_hitters(one: DataFrame, two: DataFrame, n: int, k: int = 5000) -> DataFrame:
    """(value, n) of two frames of exact counts together, of at least a k-th of n cells."""
    return merge_counts(one, two).filter(F.col("n") >= n / k)


def stopped(df: DataFrame, column: str, at_least: int, ratio: float) -> bool:
    """Whether a column has so many different values that its categories needn't be kept; from a sketch of it."""
    n, unique = cells(df, [column]).agg(F.count(F.lit(1)), F.approx_count_distinct("value")).first()
    return n >= at_least and unique / max(1, n) >= ratio


def merge_counts(one: DataFrame, two: DataFrame) -> DataFrame:
    """Sums of (value, n) frames."""
    return one.unionByName(two).groupBy("value").agg(F.sum("n").alias("n"))


def superset(one: DataFrame, two: DataFrame) -> DataFrame:
    """(value, n1, n2) of all values of either (value, n) frame, 0 where one lacks it."""
    both = one.select("value", F.col("n").alias("n1"), F.lit(0).cast("bigint").alias("n2")).unionByName(two.select("value", F.lit(0).cast("bigint").alias("n1"), F.col("n").alias("n2")))
    return both.groupBy("value").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))


def psi(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row, psi: the stability index of two (value, n) frames; a value that one side lacks has no term."""
    both = superset(one, two)
    total = F.broadcast(both.agg(F.sum("n1").alias("a"), F.sum("n2").alias("b")))  # one row
    shares = both.filter("n1 > 0 and n2 > 0").crossJoin(total).select((F.col("n1") / F.col("a")).alias("p"), (F.col("n2") / F.col("b")).alias("q"))
    return shares.agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
