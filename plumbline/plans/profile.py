"""A table's profile: what every column holds, as state that adds up, can be compared, saved and shown.

A profile takes a fixed number of passes over the table, whatever the number of columns: one that counts each column's
different cells, which are kept until all figures, histograms, value counts and characters in use are read from them; one
for the rows as a whole, and one for their order. State that reaches the driver is bounded:
figures, STORED_BINS histogram bins, and value counts only of columns with few values.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from plumbline.functions import exprs
from plumbline.functions.histograms import METHODS, STORED_BINS, Histogram, bin_count
from plumbline.functions.moments import Moments
from plumbline.operators import compare, dates, matrices, order, rows
from plumbline.plans.column import Column, Counts, Dates, Numbers, Precision
from plumbline.plans.options import Options, Structured, plugins
from plumbline.runtime import spread

GUESS = 200
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def presets() -> dict[str, Options]:
    return {k: Options.preset(k) for k in ("complete", "data_types", "numeric_stats_disabled", "lower_memory_sketching")}


@dataclass
class Profile:
    columns: dict[str, Column] = field(default_factory=dict)
    rows: dict[str, float] = field(default_factory=dict)
    correlation: dict[tuple[str, str], float] | None = None
    replication: dict[tuple[str, str], dict[str, float]] | None = None
    options: Structured = field(default_factory=Structured)
    encoding: str | None = None
    file_type: str | None = None

    def __add__(self, o: Profile) -> Profile:
        """The profile of both tables' rows. How many rows are unique, and what is imputed, doesn't follow from the parts."""
        if not self.columns or not o.columns:
            return self if self.columns else o
        if sorted(self.columns) != sorted(o.columns):
            raise ValueError("profiles have different columns")
        if self.options.rows.unique != o.options.rows.unique or self.options.null_values != o.options.null_values:
            raise ValueError("profiles were made with different options for rows or nulls")
        if self.options.labeler != o.options.labeler:
            raise ValueError("profiles were made with different labelers")
        common = self.options.common(o.options)
        n = self.rows.get("n_rows", 0) + o.rows.get("n_rows", 0)
        share = lambda k: (self.rows[k] * self.rows["n_rows"] + o.rows[k] * o.rows["n_rows"]) / n if n and None not in (self.rows.get(k), o.rows.get(k)) else None
        merged = {k: share(k) for k in ("row_has_null_ratio", "row_is_null_ratio")}
        both = {c: self.columns[c] + o.columns[c] for c in self.columns}
        same = lambda a, b: a if a == b else "multiple files"
        return Profile(
            both, {"n_rows": n} | {k: v for k, v in merged.items() if v is not None}, self._correlated(o, both), _replicated(self, o), common, same(self.encoding, o.encoding), same(self.file_type, o.file_type)
        )

    def _correlated(self, o: Profile, both: dict[str, Column]) -> dict[tuple[str, str], float] | None:
        """Correlations of both parts together, from co-moments; only of pairs that both have, without missing cells."""
        if self.correlation is None or o.correlation is None or self.correlation.keys() != o.correlation.keys():
            return None
        out = {}
        for (a, b), r in self.correlation.items():
            x, y, u, v = self.columns[a].moments, self.columns[b].moments, o.columns[a].moments, o.columns[b].moments
            if a == b:
                out[a, b] = 1.0
            elif not (x.n == y.n and u.n == v.n) or None in (r, o.correlation[a, b]):
                out[a, b] = None
            else:
                co = r * math.sqrt(x.m2 * y.m2) + o.correlation[a, b] * math.sqrt(u.m2 * v.m2) + (x.mean - u.mean) * (y.mean - v.mean) * x.n * u.n / (x.n + u.n)
                whole = both[a].moments.m2 * both[b].moments.m2
                out[a, b] = co / math.sqrt(whole) if whole > 0 else None
        return out

    def chi2(self) -> dict[tuple[str, str], float | None]:
        """p-values of homogeneity for pairs of categorical columns whose counts are known."""
        own = {c: s.counts for c, s in self.columns.items() if s.counts is not None and s.counts.values is not None and s.counts.categorical}
        names = list(own)
        return {(a, b): matrices.chi2_test(own[a].values, own[a].n, own[b].values, own[b].n)["p-value"] for i, a in enumerate(names) for b in names[i + 1 :]}

    def report(self, output_format: str | None = None, omit_keys: tuple[str, ...] = (), top_k: int | None = None, quantile_groups: int = 4) -> dict[str, object]:
        """None and "serializable" as it is, "pretty" rounded to 4 digits with short lists, "compact" without histograms
        and null types, "flat" with joined keys."""
        top: dict[str, object] = dict(self.rows) | {"column_count": len(self.columns), "encoding": self.encoding, "file_type": self.file_type, "profile_schema": {c: [i] for i, c in enumerate(self.columns)}}
        if self.correlation is not None:
            top["correlation_matrix"] = _square(self.correlation, list(self.columns))
        if self.options.chi2.enabled:
            top["chi2_matrix"] = _square({**{(c, c): 1.0 for c in self.columns}, **(p := self.chi2()), **{(b, a): v for (a, b), v in p.items()}}, list(self.columns))
        out = {"global_stats": top, "data_stats": {c: s.report(self.options, top_k) for c, s in self.columns.items()}}
        for (c, other), figures in (self.replication or {}).items():
            out["data_stats"][c]["statistics"].setdefault("null_replication_metrics", {})[other] = figures
        for c, s in self.columns.items():
            h = (s.numbers if s.data_type in ("int", "float") else s.lengths).histogram
            if "quantiles" in out["data_stats"][c]["statistics"] and h.total and quantile_groups != 4:
                out["data_stats"][c]["statistics"]["quantiles"] = dict(enumerate(h.quantile(np.arange(1, quantile_groups) / quantile_groups).tolist()))
        return formatted(out, output_format, omit_keys)

    def diff(self, o: Profile) -> dict[str, object]:
        """Differences of both profiles; of columns, where both have the same ones."""
        same = sorted(self.columns) == sorted(o.columns)
        matrix = lambda p: None if p.correlation is None else np.array(_square(p.correlation, list(self.columns)), float)
        top = {k: compare.numbers(self.rows.get(k), o.rows.get(k)) for k in sorted(self.rows.keys() | o.rows.keys())}
        top |= {"column_count": compare.numbers(len(self.columns), len(o.columns)), "file_type": compare.values(self.file_type, o.file_type), "encoding": compare.values(self.encoding, o.encoding), "profile_schema": compare.dicts_by_keys({c: i for i, c in enumerate(self.columns)}, {c: i for i, c in enumerate(o.columns)})}
        if same:
            top |= {"correlation_matrix": compare.matrices(matrix(self), matrix(o)), "chi2_matrix": compare.dicts({f"{a}|{b}": v for (a, b), v in self.chi2().items()}, {f"{a}|{b}": v for (a, b), v in o.chi2().items()})}
        return {"global_stats": top, "data_stats": {c: self.columns[c].diff(o.columns[c]) for c in self.columns} if same else {}}

    def to_json(self) -> str:
        pairs = lambda d: d and [[*k, v] for k, v in d.items()]
        return json.dumps({"class": "Profile", "columns": {c: s.plain() for c, s in self.columns.items()}, "rows": self.rows, "correlation": pairs(self.correlation), "replication": pairs(self.replication), "options": self.options.to_dict(), "encoding": self.encoding, "file_type": self.file_type})

    @classmethod
    def from_json(cls, text: str) -> Profile:
        d = json.loads(text)
        pairs = lambda x: x and {(a, b): v for a, b, v in x}
        return cls({c: Column.of(s) for c, s in d["columns"].items()}, d["rows"], pairs(d["correlation"]), pairs(d["replication"]), Structured.of(d["options"]), d["encoding"], d["file_type"])

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """As JSON, through Hadoop's file systems."""
        put(spark or SparkSession.active(), path, self.to_json())

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Profile:
        return cls.from_json(get(spark or SparkSession.active(), path))

    def update(self, df: DataFrame) -> Profile:
        """With a further batch of rows."""
        return self + of(df, self.options)

    @property
    def most_samples(self) -> int:
        return max((c.cells for c in self.columns.values()), default=0)

    @property
    def least_samples(self) -> int:
        return min((c.cells for c in self.columns.values()), default=0)


def put(spark: SparkSession, path: str, text: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0]


def _square(pairs: dict[tuple[str, str], float | None], names: list[str]) -> list[list[float | None]]:
    return [[pairs.get((a, b)) for b in names] for a in names]


def _replicated(one: Profile, two: Profile) -> dict[tuple[str, str], dict[str, float]] | None:
    """Sums add; priors and means follow from them and the counts."""
    if one.replication is None or two.replication is None:
        return None
    out = {}
    for key in [*one.replication, *(k for k in two.replication if k not in one.replication)]:
        c, other = key
        parts = []
        for p in (one, two):
            s = p.columns[c]
            r = p.replication.get(key)
            total = p.columns[other].moments.mean * p.columns[other].moments.n
            parts.append(r or {"sum_null": 0.0, "sum_there": total, "n_null": 0, "n_there": p.columns[other].moments.n} | {"rows": s.n_rows})
        sums = {k: sum(x.get(k) or 0 for x in parts) for k in ("sum_null", "sum_there", "n_null", "n_there")}
        n, nulls = one.columns[c].n_rows + two.columns[c].n_rows, one.columns[c].null_count + two.columns[c].null_count
        out[key] = sums | {"null_prior": nulls / n, "mean_null": sums["sum_null"] / sums["n_null"] if sums["n_null"] else None, "mean_there": sums["sum_there"] / sums["n_there"] if sums["n_there"] else None}
    return out


def formatted(report: dict[str, object], output_format: str | None = None, omit_keys: tuple[str, ...] = ()) -> dict[str, object]:
    """omit_keys are dotted paths, in which * stands for any one key."""
    if output_format not in (None, "serializable", "pretty", "compact", "flat"):
        raise ValueError(f"no such format: {output_format}")

    def omitted(path: list[str]) -> bool:
        return any(len(k) == len(path) and all(x in ("*", y) for x, y in zip(k, path, strict=True)) for k in (o.split(".") for o in omit_keys))

    def walk(x: object, path: list[str]) -> object:
        if isinstance(x, dict):
            gone = {"histogram", "null_types_count", "correlation_matrix", "chi2_matrix"} if output_format == "compact" else set()
            return {k: walk(v, [*path, str(k)]) for k, v in x.items() if k not in gone and not omitted([*path, str(k)])}
        if output_format == "pretty":
            if isinstance(x, float):
                return x if math.isnan(x) else round(x, 4)
            if isinstance(x, list):
                text = str([round(v, 4) if isinstance(v, float) else v for v in x])
                return text if len(text) <= 50 else text[:24] + ", ... , " + text[-18:]
        return x

    out = walk(report, [])
    return flat(out) if output_format == "flat" else out


def flat(x: dict[str, object], separator: str = "_", key: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in x.items():
        name = (key + separator if key else "") + str(k).replace(" ", separator)
        out |= flat(v, separator, name) if isinstance(v, dict) and v else {name: v}
    return out


NUMBER, TIME, TEXT, DATED = range(4)
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _kinds(df: DataFrame, names: list[str], o: Structured) -> list[int]:
    """Whether a column's type tells its cells' kind, or they are texts; dates are looked for in those of which some of the
    first cells are dates."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [NUMBER if types[c].startswith(NUMBERS) else TIME if types[c].startswith(("timestamp", "date")) else TEXT for c in names]
    texts = [c for c, k in zip(names, out, strict=True) if k == TEXT]
    if o.datetime.enabled and texts:
        head = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in texts]).limit(GUESS).unpivot([], [F.col(f"`{c}`") for c in texts], "c", "x")
        dated = {r["c"] for r in head.filter(exprs.date_ladder(F.col("x")).isNotNull()).select("c").distinct().collect()}
        out = [DATED if c in dated else k for c, k in zip(names, out, strict=True)]
    return out


def _cells(df: DataFrame, names: list[str], kinds: list[int], o: Structured) -> DataFrame:
    """(i, text, number, time, fmt, token, n) of each column's different cells, n being how often they are there, and token
    what a missing one has.

    Cells are counted as they are typed, before anything is worked out: all that follows is done once for each value.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    structs = []
    for i, (c, k) in enumerate(zip(names, kinds, strict=True)):
        own, whole, typed = F.col(f"`{c}`"), types[c] in WHOLE, types[c] == "double" or k == TIME
        number = own.cast("double") if k == NUMBER and not whole else F.lit(None).cast("double")
        time = own.cast("timestamp_ntz") if k == TIME else F.lit(None).cast("timestamp_ntz")
        text = F.lit(None).cast("string") if whole or typed else own.cast("string")
        structs.append(F.struct(F.lit(i).alias("i"), text.alias("text"), number.alias("number"), (own.cast("bigint") if whole else F.lit(None).cast("bigint")).alias("whole"), time.alias("time")))
    each = df.select(F.explode(F.array(*structs)).alias("c")).select("c.*").groupBy("i", "text", "number", "whole", "time").agg(F.count(F.lit(1)).alias("n"))
    of_kind = lambda *k: F.col("i").isin([i for i, x in enumerate(kinds) if x in k])
    days = [i for i, c in enumerate(names) if types[c] == "date"]
    long = each.withColumns({
        "text": F.coalesce("text", F.col("whole").cast("string"), F.col("number").cast("string"), F.when(F.col("i").isin(days), F.col("time").cast("date").cast("string")).otherwise(F.col("time").cast("string"))),
        "number": F.coalesce("number", F.col("whole").cast("double")),
    })
    null = F.col("text").isNull() | F.when(of_kind(NUMBER), F.coalesce(F.col("number").isNaN(), F.lit(False)) & F.lit("nan" in o.null_values)).when(of_kind(TEXT, DATED), F.col("text").rlike(exprs.null_pattern(tuple(o.null_values)))).otherwise(F.lit(False))
    long = long.withColumn("token", F.when(null, F.coalesce("text", F.lit("NULL"))))
    there = F.col("token").isNull()
    long = long.withColumn("number", F.when(there & of_kind(TEXT, DATED), exprs.to_double(F.col("text"))).when(there, F.col("number")))
    if DATED in kinds:
        long = long.withColumn("date", F.explode(F.array(F.when(there & of_kind(DATED), exprs.date_ladder(F.col("text"))))))
        long = long.withColumns({"time": F.coalesce("date.time", "time"), "fmt": F.col("date.format")}).drop("date")
    else:
        long = long.withColumn("fmt", F.lit(None).cast("string"))
    if TIME in kinds:  # a timestamp is written in whole seconds, or it has no format that is known
        split = F.date_format("time", "SSSSSS") == "000000"
        typed = F.when(F.col("i").isin(days), "%Y-%m-%d").when(of_kind(TIME) & split, "%Y-%m-%d %H:%M:%S")
        long = long.withColumn("fmt", F.when(F.col("time").isNotNull(), F.coalesce("fmt", typed)))
    long = long.withColumn("text", F.when(there, F.col("text")))
    fractional = F.col("number").isNotNull() & ~F.col("i").isin([i for i, c in enumerate(names) if types[c] in WHOLE])  # whole numbers' types are no floats
    digits = F.when(fractional, exprs.significant_digits(F.trim("text"))).cast("double") if o.precision.enabled else F.lit(None).cast("double")
    return long.select("i", "text", "number", "whole", "time", "fmt", "token", "n", digits.alias("p"), exprs.finite(F.col("number")).alias("x"), F.when(of_kind(TEXT, DATED), F.length("text")).cast("double").alias("l"))


def _figures(cells: DataFrame) -> list[dict]:
    """For each column (i) all that is known of its cells: two aggregations, as deviations are those from the mean."""
    n = F.col("n")
    times = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    there = lambda c: times(F.col(c).isNotNull())
    dated = F.col("fmt").isNotNull()
    when = F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), F.col("text").alias("raw"))
    first = cells.groupBy("i").agg(
        F.sum(n).alias("n_rows"), there("token").alias("nulls"), there("fmt").alias("datetime"), times(exprs.is_int(F.col("number"))).alias("int"), there("number").alias("float"), F.max(F.length("text")).alias("longest"),
        *[f for k in "xlp" for f in (there(k).alias(f"{k}n"), F.sum(F.col(k) * n).alias(f"{k}sum"), F.min(k).alias(f"{k}low"), F.max(k).alias(f"{k}high"))], F.sum(F.col("whole").cast("decimal(38,0)") * n.cast("decimal(19,0)")).alias("whole"),
        times(F.col("x") == 0).alias("zeros"), times(F.col("x") < 0).alias("negatives"), F.min(F.when(dated, when)).alias("first_date"), F.max(F.when(dated, when)).alias("last_date"), F.collect_set("fmt").alias("formats"),
        F.min(F.when(F.col("fmt") == dates.ABBREVIATED, (F.month("time") == 5).cast("int"))).alias("may"), F.count("text").alias("values"),
    )
    found = [r.asDict() for r in first.orderBy("i").collect()]
    if not found:
        return found
    for f in found:
        for k in "xlp":
            total = float(f["whole"]) if k == "x" and f["whole"] is not None else f[f"{k}sum"]
            f[f"{k}mean"] = total / f[f"{k}n"] if f[f"{k}n"] else None
    means = {k: F.element_at(F.array(*[F.lit(f[f"{k}mean"] or 0.0) for f in found]), F.col("i") + 1) for k in "xlp"}  # all columns have cells where one has
    away = cells.select("i", "n", *[(F.col(k) - means[k]).alias(k) for k in "xlp"])
    powers = {2: lambda x: x * x, 3: lambda x: x * x * x, 4: lambda x: x * x * x * x}
    second = away.groupBy("i").agg(*[F.coalesce(F.sum(power(F.col(k)) * n), F.lit(0.0)).alias(f"{k}{e}") for k in "xlp" for e, power in powers.items()])
    for r in second.collect():
        found[r["i"]] |= r.asDict()
    return found


def _counted(cells: DataFrame, found: dict[int, dict], o: Structured, numeric: set[int], counted: list[int], stored: dict[int, int]) -> tuple[dict[int, dict[int, int]], dict[int, Counts], dict[int, dict[str, int]]]:
    """Histogram bins, value counts and null tokens of all columns, from one pass over the different cells.

    What reaches the driver are the bins, the tokens, and values of columns with few; of the others, their number and squares.
    """
    bins: dict[int, dict[int, int]] = {}
    values: dict[int, dict[str, int]] = {}
    tokens: dict[int, dict[str, int]] = {}
    if not any(i in counted or stored.get(i) or found[i]["nulls"] for i in found):
        return bins, {}, tokens
    at = lambda f: F.element_at(F.array(*[F.lit(f(i)) for i in range(len(found))]), F.col("i") + 1)
    low = at(lambda i: float((found[i]["xlow"] if i in numeric else found[i]["llow"]) or 0.0))
    high = at(lambda i: float((found[i]["xhigh"] if i in numeric else found[i]["lhigh"]) or 0.0))
    many = {i for i in counted if found[i]["values"] > o.category.most_values}
    long = cells.select("i", "text", "token", "n", F.when(F.col("i").isin(list(numeric)), F.col("x")).otherwise(F.length("text").cast("double")).alias("x"), low.alias("low"), high.alias("high"), at(lambda i: stored.get(i, 0)).alias("bins"))
    key = lambda what, k: F.struct(F.lit(what).alias("what"), k.alias("key"))
    place = exprs.bin_index(F.col("x"), F.col("low"), F.col("high"), F.col("bins")).cast("string")
    value = F.when(~F.col("i").isin(list(many)), F.col("text"))
    keys = [F.when(F.col("token").isNotNull(), key("t", F.col("token"))), F.when(F.col("text").isNotNull() & F.col("i").isin(counted), key("v", value)), F.when((F.col("bins") > 0) & F.col("x").isNotNull(), key("b", place))]
    n = F.col("n").cast("double")
    each = long.select("i", "n", F.explode(F.array(*keys)).alias("c")).filter("c is not null").groupBy("i", "c.what", "c.key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("unique"), F.sum(n * n).alias("squares"))
    out: dict[int, Counts] = {}
    for r in each.collect():
        i = r["i"]
        if r["what"] == "b":
            bins.setdefault(i, {})[int(r["key"])] = r["n"]
        elif r["what"] == "t":
            tokens.setdefault(i, {})[r["key"]] = r["n"]
        elif i in many:
            out[i] = Counts(r["n"], r["unique"], r["squares"])
        else:
            values.setdefault(i, {})[r["key"]] = r["n"]
    return bins, out | {i: Counts.over(v) for i, v in values.items()}, tokens


def _characters(cells: DataFrame, columns: dict[int, str]) -> dict[str, list[str]]:
    """The characters that columns' different cells have: worked out batch by batch, and put together."""
    if not columns:
        return {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {i: np.zeros(0, np.uint32) for i in columns}
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.unique(own).tolist():
                data = "".join(batch.column(1).filter(pa.array(own == i)).to_pylist()).encode("utf-32-le", "surrogatepass")
                seen[i] = np.union1d(seen[i], np.frombuffer(data, np.uint32))
        i = np.repeat(np.array(list(seen), np.int32), [len(x) for x in seen.values()])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.concatenate(list(seen.values())).astype(np.int32))], names=["i", "c"])

    out: dict[str, list[str]] = {c: [] for c in columns.values()}
    own = cells.filter(F.col("i").isin(list(columns)) & F.col("text").isNotNull()).select("i", "text")
    for i, c in own.mapInArrow(work, "i int, c int").distinct().orderBy("i", "c").collect():  # at most as many as there are characters
        out[columns[i]].append(chr(c))
    return out


def of(df: DataFrame, options: Options | Structured | None = None, encoding: str | None = None, file_type: str | None = None) -> Profile:
    """The profile of a table, exact, over all rows. An empty table has columns without cells."""
    o = options.structured if isinstance(options, Options) else options or Structured()
    o.check()
    names = [*(o.columns or df.columns)]
    kinds = _kinds(df, names, o)
    rows_in_order, df = df, spread(df.select(*[F.col(f"`{c}`") for c in names]))
    cells = _cells(df, names, kinds, o).persist(StorageLevel.DISK_ONLY)
    try:
        return _of(df, rows_in_order, cells, names, kinds, o, encoding, file_type)
    finally:
        cells.unpersist()


def _of(df: DataFrame, rows_in_order: DataFrame, cells: DataFrame, names: list[str], kinds: list[int], o: Structured, encoding: str | None, file_type: str | None) -> Profile:
    found = {f["i"]: f for f in _figures(cells)}
    out = {c: Column() for c in names}
    if not found:
        return Profile(out, {"n_rows": 0}, None, None, o, encoding, file_type)
    for i, f in found.items():
        c = out[names[i]]
        c.n_rows, c.longest = f["n_rows"], f["longest"] or 0
        c.kinds = {k: f[k] for k in ("datetime", "int", "float")}
        c.null_types = {"": f["nulls"]} if f["nulls"] else {}
    numeric = {i for i in found if out[names[i]].data_type in ("int", "float")}
    textual = {i for i in found if kinds[i] in (TEXT, DATED) and out[names[i]].data_type in ("string", "text")}
    stored: dict[int, int] = {}
    for i, f in found.items():
        c = out[names[i]]
        moments = lambda k, f=f: Moments(f[f"{k}n"], f[f"{k}mean"], f[f"{k}2"], f[f"{k}3"], f[f"{k}4"]) if f[f"{k}n"] else Moments()
        if i in numeric:
            c.numbers = Numbers(moments("x"), f["xlow"], f["xhigh"], f["zeros"], f["negatives"])
            if c.data_type == "float" and o.precision.enabled:
                c.precision = Precision(moments("p"), f["plow"] and int(f["plow"]), f["phigh"] and int(f["phigh"]))
        if i in textual and o.text.enabled:
            c.lengths = Numbers(moments("l"), f["llow"], f["lhigh"])
        own = c.numbers if i in numeric else c.lengths
        if own.moments.n and (o.histogram.enabled or o.mode.enabled or not {"median", "median_abs_deviation"} <= o.numeric.off):
            methods = [m for m in (o.histogram.method if isinstance(o.histogram.method, (tuple, list)) else (o.histogram.method,)) if m in METHODS and m not in ("fd", "auto")]
            most = max([STORED_BINS, *[bin_count(m, own.moments.n, own.low, own.high, stddev=own.moments.stddev(False), skew=own.moments.skewness(False)) for m in methods]])
            stored[i] = o.histogram.method if isinstance(o.histogram.method, int) else min(most, 100_000)
        if c.data_type == "datetime" and o.datetime.enabled:
            formats = f["formats"]
            if f["may"] == 1:
                formats = list({dates.FULL if x == dates.ABBREVIATED else x for x in formats})
            c.dates = Dates(f["datetime"], tuple(f["first_date"]), tuple(f["last_date"]), sorted(formats))
    counted = [i for i in found if o.category.enabled and not _stopped(found[i], o)]
    bins, values, tokens = _counted(cells, found, o, numeric, counted, stored)
    for i, f in found.items():
        c = out[names[i]]
        c.null_types = tokens.get(i, {})
        if o.category.enabled:
            c.counts = values.get(i) or Counts(c.cells, min(f["values"], c.cells), math.nan, None, True)
        if i in bins:
            own = c.numbers if i in numeric else c.lengths
            n = 1 if own.low == own.high else stored[i]
            edges = np.array([own.low, own.high]) if n == 1 and own.low == own.high else np.linspace(own.low, own.high, n + 1)
            own.histogram = Histogram(np.array([bins[i].get(k, 0) for k in range(n)], np.int64), edges)
    if o.order.enabled:
        for c, run in order.runs(rows_in_order, names).items():
            out[c].order = order.Run(run.order, _plain(run.first), _plain(run.last))
    if o.text.enabled and o.text.vocabulary:
        for c, chars in _characters(cells, {i: names[i] for i in sorted(textual)}).items():
            out[c].characters = chars
    if o.labeler.enabled:
        _labelled(df, out, o)
    if o.custom:
        own = [(c, k) for c in names for k in o.custom]
        cell = lambda c: F.when(~exprs.is_null_token(F.col(f"`{c}`").cast("string"), tuple(o.null_values)), F.col(f"`{c}`").cast("string"))
        for (c, k), x in zip(own, df.agg(*[plugins("column")[k]().aggregate(cell(c)).alias(str(i)) for i, (c, k) in enumerate(own)]).first(), strict=True):
            out[c].custom[k] = x
    for r in rows_in_order.select(*[F.col(f"`{c}`").cast("string").alias(str(i)) for i, c in enumerate(names)]).limit(5).collect():
        for i, c in enumerate(names):
            out[c].samples += [] if r[i] is None else [r[i]]
    return Profile(out, _row_figures(df, names, o, next(iter(found.values()))["n_rows"]), _correlations(df, out, o), _replications(df, out, names, o), o, encoding, file_type)


def _plain(x: object) -> object:
    return x if x is None or isinstance(x, (int, float, str, bool)) else str(x)


def _stopped(f: dict, o: Structured) -> bool:
    """Whether a column's values are mostly different, so that a sketch of them is enough."""
    n = f["n_rows"] - f["nulls"]
    return o.category.sketched or o.category.stop_at is not None and n >= o.category.stop_at and f["values"] >= o.category.stop_ratio * n


def _row_figures(df: DataFrame, names: list[str], o: Structured, n_rows: int) -> dict[str, float]:
    out: dict[str, float] = {"n_rows": n_rows}
    if not o.rows.enabled:
        return out
    if o.rows.unique == "full":
        return out | rows.row_figures(df, names, tuple(o.null_values)).first().asDict()
    if o.rows.nulls:
        out |= rows.row_nulls(df, names, tuple(o.null_values)).first().asDict()
    return out | rows.unique_rows_sketched(df, names, o.rows.registers).first().asDict()


def _correlations(df: DataFrame, out: dict[str, Column], o: Structured) -> dict[tuple[str, str], float] | None:
    numbers = [c for c, s in out.items() if s.data_type in ("int", "float") and (o.correlation.columns is None or c in o.correlation.columns)]
    if not o.correlation.enabled or not numbers:
        return None
    return {(a, b): r for a, b, r in matrices.correlation(df, numbers).collect()}


def _replications(df: DataFrame, out: dict[str, Column], names: list[str], o: Structured) -> dict[tuple[str, str], dict[str, float]] | None:
    if not o.null_replication.enabled:
        return None
    numbers = [c for c in names if out[c].data_type in ("int", "float")]
    return {(r["column_name"], r["other"]): {k: r[k] for k in ("null_prior", "sum_null", "sum_there", "n_null", "n_there", "mean_null", "mean_there")} for r in matrices.null_replication(df, numbers).collect()} if len(numbers) > 1 else {}


def _labelled(df: DataFrame, out: dict[str, Column], o: Structured) -> None:
    """Labels of at most o.labeler.cells cells of each column, those of the least hashes."""
    from plumbline.labelers.labeler import Labeler

    labeler = Labeler.from_disk(o.labeler.folder) if o.labeler.folder else Labeler.from_library(o.labeler.name)
    texts = [c for c in out if out[c].data_type in ("string", "text")]
    if not texts:
        return
    few = df.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in texts])).limit(o.labeler.cells)
    for c, label, n in labeler.cells(few, texts).groupBy("column_name", "label").agg(F.count(F.lit(1))).collect():
        out[c].labels = (out[c].labels or {}) | {label: n}


def merged(profiles: list[Profile]) -> Profile:
    """All of them together, by pairs, so that rounding doesn't pile up on one side."""
    while len(profiles) > 1:
        profiles = [a + b for a, b in zip(profiles[::2], profiles[1::2], strict=False)] + profiles[len(profiles) // 2 * 2 :]
    return profiles[0] if profiles else Profile()


def grouped(df: DataFrame, by: str, numbers: list[str]) -> DataFrame:
    """(group, column_name, n, mean, stddev, min, max) of numeric columns for each value of a column, in one aggregation."""
    own = df.select(F.col(f"`{by}`").alias("group"), *[F.col(f"`{c}`").cast("double").alias(c) for c in numbers])
    long = own.unpivot(["group"], [F.col(f"`{c}`") for c in numbers], "column_name", "v")
    return long.groupBy("group", "column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stddev"), F.min("v").alias("min"), F.max("v").alias("max"))
