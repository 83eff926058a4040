"""Date columns: range in the original spelling, and the formats in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs
from plumbline.runtime import spread


ABBREVIATED, FULL = "%b %d, %Y", "%B %d, %Y"


def parsed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, raw, n, time, format) of the different cells that are dates, in one pass over the table: however often a
    text is there, it is parsed once."""
    texts = spread(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "raw")
    each = texts.groupBy("column_name", "raw").agg(F.count(F.lit(1)).alias("n")).filter(~exprs.is_null_token(F.col("raw")))
    found = each.select("column_name", "raw", "n", F.explode(F.array(exprs.date_ladder(F.col("raw")))).alias("d")).filter("d is not null")
    return found.select("column_name", "raw", "n", "d.time", "d.format")


def shown_formats(formats: Column, only_may: Column) -> Column:
    """Sorted formats, joined. May is spelled alike in full and abbreviated: where all such dates are May, it is in full."""
    renamed = F.when(only_may, F.array_distinct(F.transform(formats, lambda f: F.when(f == ABBREVIATED, FULL).otherwise(f)))).otherwise(formats)
    return F.concat_ws("|", F.array_sort(renamed))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, min, max, formats): the least and greatest cell as written; formats are sorted."""
    may = F.min(F.when(F.col("format") == ABBREVIATED, (F.month("time") == 5).cast("int")))
    got = parsed(df, columns).groupBy("column_name").agg(F.sum("n").alias("n"), F.min_by("raw", F.struct("time", "raw")).alias("min"), F.max_by("raw", F.struct("time", "raw")).alias("max"), F.collect_set("format").alias("f"), may.alias("may"))
    return got.select("column_name", "n", "min", "max", shown_formats(F.col("f"), F.coalesce(F.col("may") == 1, F.lit(False))).alias("formats"))


def is_date_column(df: DataFrame, column: str, sample: int = 50, least: float = 0.1) -> bool:
    """A quick look at a few cells: whether enough of them are dates to look at all of them."""
    cells = df.select(F.col(f"`{column}`").cast("string").alias("raw")).filter(~exprs.is_null_token(F.col("raw"))).limit(sample)
    n, hits = cells.agg(F.count(F.lit(1)), F.count_if(exprs.date_ladder(F.col("raw")).isNotNull())).first()
    return n > 0 and hits / n >= least
