"""Missing values, row uniqueness, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import exprs


def _text(df: DataFrame, c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def null_counts(df: DataFrame, columns: list[str], tokens: tuple[str, ...] = exprs.NULL_TOKENS) -> DataFrame:
    """(column_name, n_rows, null_count, null_ratio)."""
    flags = df.select(*[exprs.is_null_token(_text(df, c), tokens).cast("int").alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "flag")
    return flags.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("flag").alias("null_count"), F.avg("flag").alias("null_ratio"))


def null_types(df: DataFrame, columns: list[str], tokens: tuple[str, ...] = exprs.NULL_TOKENS) -> DataFrame:
    """(column_name, token, n) of the missing cells, SQL's null as "NULL"."""
    cells = df.select(*[F.when(exprs.is_null_token(_text(df, c), tokens), F.coalesce(_text(df, c), F.lit("NULL"))).alias(c) for c in columns])
    long = cells.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "token").filter("token is not null")
    return long.groupBy("column_name", "token").agg(F.count(F.lit(1)).alias("n"))


def null_rows(df: DataFrame, columns: list[str], row_id: str, tokens: tuple[str, ...] = exprs.NULL_TOKENS) -> DataFrame:
    """(column_name, token, row_id): where the missing cells are, a row for each, so that no list of them is ever put together."""
    texts = [F.when(exprs.is_null_token(_text(df, c), tokens), F.struct(F.lit(c).alias("column_name"), F.coalesce(_text(df, c), F.lit("NULL")).alias("token"))) for c in columns]
    return df.select(F.col(f"`{row_id}`").alias("row_id"), F.explode(F.array_compact(F.array(*texts))).alias("c")).select("c.column_name", "c.token", "row_id")


def row_nulls(df: DataFrame, columns: list[str] | None = None, tokens: tuple[str, ...] = exprs.NULL_TOKENS) -> DataFrame:
    """One row: n_rows, and the shares of rows with any and with only missing cells."""
    flags = [exprs.is_null_token(_text(df, c), tokens) for c in columns or df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(exprs.either(flags).cast("int")).alias("row_has_null_ratio"), F.avg(exprs.every(flags).cast("int")).alias("row_is_null_ratio"))


def unique_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n_rows, unique_rows, unique_row_ratio, duplicate_rows, from 64-bit hashes of the rows."""
    h = F.xxhash64(*[F.struct(F.coalesce(_text(df, c), F.lit("\0null"))) for c in columns or df.columns])
    per = df.select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))  # partial sums before the shuffle
    n, u = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return per.agg(n.alias("n_rows"), u.alias("unique_rows"), F.try_divide(u, n).alias("unique_row_ratio"), (n - u).alias("duplicate_rows"))


TYPED = ("byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz", "boolean")


def row_figures(df: DataFrame, columns: list[str] | None = None, tokens: tuple[str, ...] = exprs.NULL_TOKENS) -> DataFrame:
    """row_nulls() and unique_rows() in one pass: one row of both.

    Cells of types that no usual token is written in, but nan, are hashed and looked at as they are, others as texts.
    """
    names = columns or df.columns
    kinds = {c: df.schema[c].dataType.typeName() for c in names}
    typed = [c for c in names if kinds[c] in TYPED and tuple(tokens) == exprs.NULL_TOKENS]
    texts = [c for c in names if c not in typed]
    cells = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(typed)], *[_text(df, c).alias(f"t{i}") for i, c in enumerate(texts)])
    marked = cells.select("*", *[exprs.is_null_token(F.col(f"t{i}"), tokens).alias(f"z{i}") for i in range(len(texts))])
    flags = [F.col(f"z{i}") for i in range(len(texts))]
    flags += [F.col(f"c{i}").isNull() | F.isnan(f"c{i}") if kinds[c] in ("float", "double") else F.col(f"c{i}").isNull() for i, c in enumerate(typed)]
    parts = [x for i in range(len(typed)) for x in (F.col(f"c{i}").isNull(), F.col(f"c{i}"))] + [F.coalesce(f"t{i}", F.lit("\0null")) for i in range(len(texts))]
    own = marked.select(F.xxhash64(*parts).alias("h"), exprs.either(flags).cast("int").alias("some"), exprs.every(flags).cast("int").alias("all"))
    per = own.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("some").alias("some"), F.sum("all").alias("all"))
    n, u = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return per.agg(n.alias("n_rows"), F.try_divide(F.sum("some"), n).alias("row_has_null_ratio"), F.try_divide(F.sum("all"), n).alias("row_is_null_ratio"), u.alias("unique_rows"), F.try_divide(u, n).alias("unique_row_ratio"), (n - u).alias("duplicate_rows"))


def unique_rows_sketched(df: DataFrame, columns: list[str] | None = None, lg_k: int = 15) -> DataFrame:
    """The same by a HyperLogLog sketch of 2**lg_k registers; no shuffle of rows."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]))
    n, u = F.count(F.lit(1)), F.least(F.hll_sketch_estimate(F.hll_sketch_agg(row, lg_k)), F.count(F.lit(1)))
    return df.agg(n.alias("n_rows"), u.alias("unique_rows"), F.try_divide(u, n).alias("unique_row_ratio"), (n - u).alias("duplicate_rows"))


def null_runs(df: DataFrame, column: str, row_id: str, block: int = 1_000_000) -> DataFrame:
    """(start, stop, n): runs of neighbouring rows whose cell is missing, from the ids of missing rows alone.

    Runs are found block by block; only those that touch a block's end, two for each block at most, are then put in one
    order and joined with their neighbours.
    """
    ids = df.filter(exprs.is_null_token(_text(df, column))).select(F.col(f"`{row_id}`").cast("bigint").alias("r")).withColumn("block", F.floor(F.col("r") / block))
    w = Window.partitionBy("block").orderBy("r")
    parts = ids.withColumn("g", F.col("r") - F.row_number().over(w)).groupBy("block", "g").agg(F.min("r").alias("a"), F.max("r").alias("b"))
    touching = (F.pmod("a", F.lit(block)) == 0) | (F.pmod("b", F.lit(block)) == block - 1)
    every = Window.orderBy("a")
    ends = parts.filter(touching).withColumn("new", (F.coalesce(F.lag("b").over(every), F.col("a") - 2) + 1 < F.col("a")).cast("int")).withColumn("k", F.sum("new").over(every))
    joined = ends.groupBy("k").agg(F.min("a").alias("start"), F.max("b").alias("stop")).select("start", "stop")
    runs = parts.filter(~touching).select(F.col("a").alias("start"), F.col("b").alias("stop")).unionByName(joined)
    return runs.select("start", "stop", (F.col("stop") - F.col("start") + 1).alias("n"))


def sample_size(n: int, ratio: float = 0.2, least: int = 5000) -> int:
    """How many of n rows a sampled profile looks at: all of few, else a share of them, `least` at the least."""
    return n if n <= least else max(int(ratio * n), least)


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    """The rows in random order, the same for the same seed and partitions."""
    return df.orderBy(F.rand(seed))


def sampled(df: DataFrame, ratio: float = 0.2, least: int = 5000, seed: int = 0) -> DataFrame:
    """About sample_size() of the rows, for profiles that needn't be exact."""
    n = df.count()
    return df if n <= least else df.sample(min(1.0, sample_size(n, ratio, least) / n), seed)


def reservoir(df: DataFrame, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """n random rows, the same for the same seed: by the hash of `key`, or by a seeded random number for each row."""
    order = F.md5(F.concat(F.col(f"`{key}`").cast("string"), F.lit(f":{seed}"))) if key else F.rand(seed)
    return df.orderBy(order, *([F.col(f"`{key}`")] if key else [])).limit(n)


def flatten_json(df: DataFrame, column: str, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """Fields of a JSON text as columns named by their dotted paths; malformed texts have nulls."""
    got = [F.get_json_object(F.col(f"`{column}`"), "$." + path).try_cast(kind).alias(path) for path, kind in fields.items()]
    return df.select(*[F.col(f"`{c}`") for c in keep], *got)
