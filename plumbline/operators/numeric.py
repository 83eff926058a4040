"""Numeric statistics: one aggregation over an unpivoted frame, whatever the number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) with numbers; only the named columns are read."""
    typed = df.select(*[F.col(f"`{c}`").cast("double").alias(c) if not isinstance_string(df, c) else exprs.to_double(F.col(f"`{c}`")).alias(c) for c in columns])
    return typed.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "value")


def isinstance_string(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("string", "varchar", "char")


def skew_corrected(n: Column, g: Column) -> Column:
    """Null below three values; 0 for a constant."""
    return F.when(n >= 3, F.coalesce(g, F.lit(0.0)) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def kurtosis_corrected(n: Column, g: Column) -> Column:
    """Null below four values; a constant has a biased excess of -3."""
    g = F.coalesce(g, F.lit(-3.0))
    return F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (g + 3.0) - 3.0 * (n - 1.0)))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: counts, range, sum, mean and bias-corrected moments, zeros and negatives.

    Infinite values and NaN are left out of all but n_values.
    """
    v = exprs.finite(F.col("value"))
    g = long_form(df, columns).groupBy("column_name")
    n = F.count(v).cast("double")
    return g.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.count_if(F.col("value").isNull()).alias("null_count"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.sum(v).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("stddev"),
        skew_corrected(n, F.skewness(v)).alias("skewness"), kurtosis_corrected(n, F.kurtosis(v)).alias("kurtosis"),
        F.count_if(v == 0).alias("num_zeros"), F.count_if(v < 0).alias("num_negatives"),
    )


BRACKET_BINS, FEW = 4096, 100_000


def ranked(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, with linear interpolation between neighbours.

    The value of a rank lies in one bin of a histogram over the range; that bin is the next range, until few values are
    left in it or it has no width. Each round is one aggregation for all columns and ranks, of which only bins' counts
    reach the driver, so no task ever holds a column's values.
    """
    own = long_form(df, columns).select("column_name", exprs.finite(F.col("value")).alias("x")).filter("x is not null")
    sizes = {r[0]: (r[1], r[2], r[3]) for r in own.groupBy("column_name").agg(F.count("x"), F.min("x"), F.max("x")).collect()}
    wanted = {(c, k) for c, (n, _, _) in sizes.items() for p in shares for k in {int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1)}}
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, k): (sizes[c][1], sizes[c][2], 0, sizes[c][0]) for c, k in wanted}  # low, high, values below, values within
    while open_:
        found |= {key: low for key, (low, high, _, _) in open_.items() if low == high}
        open_ = {key: b for key, b in open_.items() if key not in found}
        ranges = sorted({(c, *b) for (c, _), b in open_.items()})
        few = [r for r in ranges if r[4] <= FEW]
        many = [r for r in ranges if r[4] > FEW]
        spark = df.sparkSession
        for group, small in ((few, True), (many, False)):
            if not group:
                continue
            table = F.broadcast(spark.createDataFrame([(i, r[0], r[1], r[2]) for i, r in enumerate(group)], "g int, column_name string, low double, high double"))  # one row for each rank at most
            inside = own.join(table, "column_name").filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
            key = F.col("x") if small else exprs.bin_index(F.col("x"), F.col("low"), F.col("high"), F.lit(BRACKET_BINS)).cast("double")
            rows: dict[int, list] = {}
            for r in inside.groupBy("g", key.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
                rows.setdefault(r["g"], []).append((r["low"], r["high"], r["n"]))
            for i, r in enumerate(group):
                for (c, k), b in list(open_.items()):
                    if (c, *b) != r:
                        continue
                    below = b[2]
                    for low, high, n in sorted(rows[i]):
                        if k < below + n:
                            open_[c, k] = (low, high, below, n)
                            break
                        below += n
    out = {}
    for c in columns:
        n = sizes.get(c, (0,))[0]
        at = [p * (n - 1) for p in shares]
        out[c] = [None if not n else found[c, int(x)] + (x - int(x)) * (found[c, min(int(x) + 1, n - 1)] - found[c, int(x)]) for x in at]
    return out


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (column_name, share, value)."""
    got = ranked(df, columns, shares)
    return df.sparkSession.createDataFrame([(c, float(p), v) for c in columns for p, v in zip(shares, got[c], strict=True)], "column_name string, share double, value double")


def quantiles_sketched(df: DataFrame, columns: list[str], shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """The same by a mergeable sketch, for columns too large to sort: the rank is right to within 1/accuracy."""
    got = long_form(df, columns).groupBy("column_name").agg(F.percentile_approx(exprs.finite(F.col("value")), [*shares], accuracy).alias("q"))
    return got.select("column_name", F.posexplode("q").alias("i", "value")).select("column_name", F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1).alias("share"), "value")


def median_deviation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, median, mad), exact: the median of the distances from the median."""
    middle = {c: q[0] for c, q in ranked(df, columns, [0.5]).items()}
    typed = [(exprs.to_double(F.col(f"`{c}`")) if isinstance_string(df, c) else F.col(f"`{c}`").cast("double")) for c in columns]
    away = df.select(*[F.abs(x - F.lit(middle[c])).alias(c) for c, x in zip(columns, typed, strict=True)])
    far = ranked(away, columns, [0.5])
    return df.sparkSession.createDataFrame([(c, middle[c], far[c][0]) for c in columns], "column_name string, median double, mad double")


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    v = exprs.finite(F.col("value"))
    return long_form(df, columns).groupBy("column_name").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(column_name, bin, low_edge, high_edge, n) of the bins that hold a value; the last bin is closed."""
    edges = F.broadcast(ranges(df, columns))  # a row for each column
    placed = long_form(df, columns).filter(exprs.finite(F.col("value")).isNotNull()).join(edges, "column_name")
    counted = placed.groupBy("column_name", "low", "high", exprs.bin_index(F.col("value"), F.col("low"), F.col("high"), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("high") - F.col("low")) / bins
    return counted.select("column_name", "bin", (F.col("low") + F.col("bin") * width).alias("low_edge"), (F.col("low") + (F.col("bin") + 1) * width).alias("high_edge"), "n")


def mode_bins(df: DataFrame, columns: list[str], bins: int, k: int = 5) -> DataFrame:
    """Middles of the fullest bins, up to k that tie: (column_name, mode, n)."""
    from pyspark.sql import Window

    h = histogram(df, columns, bins)
    top = h.withColumn("r", F.rank().over(Window.partitionBy("column_name").orderBy(F.desc("n")))).filter("r = 1")
    first = top.withColumn("i", F.row_number().over(Window.partitionBy("column_name").orderBy("bin"))).filter(F.col("i") <= k)
    return first.select("column_name", ((F.col("low_edge") + F.col("high_edge")) / 2).alias("mode"), "n")


def bin_errors(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(column_name, bin_error, bin_variance): squared distances from bins' middles, and the sum of bins' variances."""
    edges = F.broadcast(ranges(df, columns))
    v = F.col("value")
    placed = long_form(df, columns).filter(exprs.finite(v).isNotNull()).join(edges, "column_name")
    placed = placed.withColumn("bin", exprs.bin_index(v, F.col("low"), F.col("high"), F.lit(bins)))
    middle = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    each = placed.groupBy("column_name", "bin").agg(F.sum(F.pow(v - middle, 2)).alias("e"), F.var_pop("value").alias("v"))
    return each.groupBy("column_name").agg(F.sum("e").alias("bin_error"), F.sum("v").alias("bin_variance"))


def histogram_estimates(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(column_name, mean, variance) as the bins' middles and counts give them."""
    h = histogram(df, columns, bins).withColumn("x", (F.col("low_edge") + F.col("high_edge")) / 2)
    mean = F.sum(F.col("x") * F.col("n")) / F.sum("n")
    return h.groupBy("column_name").agg(mean.alias("mean"), (F.sum(F.col("x") * F.col("x") * F.col("n")) / F.sum("n") - mean * mean).alias("variance"))


def bin_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, method, bins): what each estimator suggests."""
    v = exprs.finite(F.col("value"))
    s = long_form(df, columns).groupBy("column_name").agg(
        F.count(v).cast("double").alias("n"), (F.max(v) - F.min(v)).alias("span"), F.stddev_pop(v).alias("sd"), F.coalesce(F.skewness(v), F.lit(0.0)).alias("g")
    )
    quarters = [(c, q[1] - q[0] if q[0] is not None else None) for c, q in ranked(df, columns, [0.25, 0.75]).items()]
    s = s.join(F.broadcast(df.sparkSession.createDataFrame(quarters, "column_name string, iqr double")), "column_name")  # a row for each column
    n, span = F.col("n"), F.col("span")
    error = F.sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3)))
    fd = 2.0 * F.col("iqr") * F.pow(n, F.lit(-1 / 3))
    sturges = span / (F.log2(n) + 1)
    widths = {
        "sqrt": span / F.sqrt(n), "sturges": sturges, "rice": span / (2 * F.pow(n, F.lit(1 / 3))), "scott": F.pow(F.lit(24 * 3.141592653589793**0.5) / n, F.lit(1 / 3)) * F.col("sd"),
        "fd": fd, "doane": F.when(n > 2, span / (1 + F.log2(n) + F.log2(1 + F.abs(F.col("g")) / error))).otherwise(0.0), "auto": F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), w.alias("width")) for k, w in widths.items()]))
    out = s.select("column_name", "span", each.alias("e")).select("column_name", "e.method", "span", "e.width")
    return out.select("column_name", "method", F.when(F.col("width") > 0, F.greatest(F.ceil(F.col("span") / F.col("width")), F.lit(1))).otherwise(1).cast("bigint").alias("bins"))


def precision(df: DataFrame, columns: list[str]) -> DataFrame:
    """Significant digits of numbers as they are written: range, mean, variance, deviation, margin at 99.9 %."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "text")
    d = F.when(exprs.to_double(F.col("text")).isNotNull(), exprs.significant_digits(F.trim("text")))
    got = texts.select("column_name", d.alias("d")).groupBy("column_name").agg(
        F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"), F.var_samp("d").alias("var"), F.stddev_samp("d").alias("std"), F.count("d").alias("sample_size")
    )
    return got.withColumn("margin_of_error", 3.291 * F.col("std") / F.sqrt("sample_size")).withColumn("confidence_level", F.lit(0.999))


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """moments() of the columns' text lengths."""
    return moments(df.select(*[F.length(F.col(f"`{c}`").cast("string")).alias(c) for c in columns]), columns).drop("num_zeros", "num_negatives")


def type_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, datetime, int, float, text): shares of the cells that are no null tokens, and the type they make.

    Cells of columns that are numbers by their type are not looked at as texts.
    """
    typed = [not isinstance_string(df, c) and df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") for c in columns]
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("text"), (F.col(f"`{c}`").cast("double") if t else F.lit(None).cast("double")).alias("number"), F.lit(t).alias("typed")) for c, t in zip(columns, typed, strict=True)]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(~F.when(F.col("typed"), F.col("number").isNull() | F.col("number").isNaN()).otherwise(exprs.is_null_token(F.col("text"))))
    parsed = long.select("column_name", "text", F.when(F.col("typed"), F.col("number")).otherwise(exprs.to_double(F.col("text"))).alias("d"), F.when(~F.col("typed"), exprs.date_ladder(F.col("text"))).isNotNull().alias("t"))
    n = F.count(F.lit(1))
    got = parsed.groupBy("column_name").agg(n.alias("n"), (F.count_if("t") / n).alias("datetime"), (F.count_if(exprs.is_int(F.col("d"))) / n).alias("int"), (F.count("d") / n).alias("float"), F.lit(1.0).alias("text"), F.max(F.length("text")).alias("longest"))
    kind = F.when(F.col("datetime") == 1, "datetime").when(F.col("int") == 1, "int").when(F.col("float") == 1, "float").when(F.col("longest") > 255, "text").otherwise("string")
    return got.withColumn("data_type", kind).drop("longest")
