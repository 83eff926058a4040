"""Undirected simple graphs given by their edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.histograms import bin_count
from plumbline.functions.special import digamma, trigamma
from plumbline.operators.numeric import ranked


def edges(df: DataFrame, source: str, target: str, attributes: list[str] | None = None, by: str | None = None) -> DataFrame:
    """(u, v, attributes…) with u <= v, one row for each pair; of repeated pairs the last, by `by`, gives the attributes."""
    u, v = F.col(f"`{source}`"), F.col(f"`{target}`")
    attributes = attributes or []
    order = F.col(f"`{by}`") if by else F.monotonically_increasing_id()
    own = df.filter(u.isNotNull() & v.isNotNull()).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), order.alias("__by"), *[F.col(f"`{a}`").cast("double").alias(a) for a in attributes])
    if not attributes:
        return own.select("u", "v").distinct()
    last = own.groupBy("u", "v").agg(F.max_by(F.struct(*[F.col(f"`{a}`") for a in attributes]), "__by").alias("a"))
    return last.select("u", "v", "a.*")


def degrees(e: DataFrame) -> DataFrame:
    """(node, degree); a loop counts twice."""
    return e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def summary(e: DataFrame) -> DataFrame:
    """One row: num_nodes, num_edges, avg_node_degree."""
    d = degrees(e).agg(F.count(F.lit(1)).alias("num_nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("num_edges"))
    return d.select("num_nodes", "num_edges", F.try_divide(2 * F.col("num_edges"), F.col("num_nodes")).alias("avg_node_degree"))


CHUNK = 1_000_000


def _least_ends(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one it is connected with by the edges (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def contracted(e: DataFrame) -> DataFrame:
    """Edges (u, v), v being less, that connect the same nodes: in place of up to CHUNK edges of a partition, one from each
    node to the least that these connect it with. Nodes that are neither whole numbers nor texts are left alone."""
    if e.schema["u"].dataType != e.schema["v"].dataType or e.schema["u"].dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
        return e

    def least(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = np.concatenate([c.to_numpy() for c in table.columns])
        nodes, codes = np.unique(ends, return_inverse=True)
        label = _least_ends(codes[: len(table)], codes[len(table) :], len(nodes))
        own = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((nodes[own], nodes[label[own]]), table.schema, strict=True)], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield least(held)
                held = []
        if held:
            yield least(held)

    return e.select("u", "v").mapInArrow(work, e.select("u", "v").schema)


def components(e: DataFrame) -> DataFrame:
    """(node, component): the least node that a node is connected with. Edges may be there twice, either way round.

    What a partition's edges connect is put together first. Then large and small stars in turn, each round written by
    checkpoint(), until nothing changes; the number of rounds grows with the logarithm of the longest path that is left. Least neighbours are summed up before they are moved, so that a hub's star is
    no task of its own.
    """
    stars = contracted(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v")).distinct().checkpoint()
    mark = lambda s: s.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        stars = low.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct().checkpoint()
        after = mark(stars)
        if after == before:
            break
        before = after
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_component(e: DataFrame) -> DataFrame:
    """One row: nodes and edges of the component with most nodes (of those, the one of the least node)."""
    c = components(e)
    nodes = c.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))
    inner = e.join(c, F.col("u") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    return nodes.join(inner, "component").orderBy(F.desc("n_nodes"), "component").limit(1).select("n_nodes", "n_edges")


def attribute_kinds(e: DataFrame, attributes: list[str]) -> tuple[list[str], list[str]]:
    """Categorical and continuous attributes: those whose first edge has a whole number, and the others."""
    first = e.orderBy("u", "v").select(*[F.col(f"`{a}`") for a in attributes]).first()
    whole = [a for a in attributes if first is not None and first[a] is not None and float(first[a]).is_integer()]
    return whole, [a for a in attributes if a not in whole]


def fit_distribution(e: DataFrame, attribute: str) -> dict[str, object] | None:
    """The best of six families by log likelihood, fitted from sums that Spark takes; mean, variance, skewness, kurtosis."""
    x = F.col(f"`{attribute}`")
    s = e.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.coalesce(F.skewness(x), F.lit(0.0)).alias("skew"),
        F.coalesce(F.kurtosis(x), F.lit(-3.0)).alias("kurt"), F.avg(F.ln(F.when(x > 0, x))).alias("ml"), F.var_pop(F.ln(F.when(x > 0, x))).alias("vl"),
    ).first()
    n = s["n"]
    if not n or not s["var"]:
        return None
    sd, fits = math.sqrt(s["var"]), {}
    fits["norm"] = (sd, n * (math.log(sd * math.sqrt(2 * math.pi)) + 0.5))
    fits["uniform"] = (s["hi"] - s["lo"], n * math.log(s["hi"] - s["lo"]))
    if s["mean"] > s["lo"]:
        fits["expon"] = (s["mean"] - s["lo"], n * (math.log(s["mean"] - s["lo"]) + 1))
    scale = sd * math.sqrt(3) / math.pi
    z = (x - s["mean"]) / scale
    fits["logistic"] = (scale, n * math.log(scale) + e.agg(F.sum(z + 2 * F.log1p(F.exp(-z)))).first()[0])
    if s["lo"] > 0 and s["vl"]:
        fits["lognorm"] = (math.exp(s["ml"]), n * (math.log(math.sqrt(s["vl"] * 2 * math.pi)) + s["ml"] + 0.5))
        gap = math.log(s["mean"]) - s["ml"]
        k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
        for _ in range(50):
            k -= (math.log(k) - digamma(k) - gap) / (1 / k - trigamma(k))
        theta = s["mean"] / k
        fits["gamma"] = (theta, n * (math.lgamma(k) + k * math.log(theta) + k - (k - 1) * s["ml"]))
    name = min(fits, key=lambda f: (fits[f][1], f))
    return {"name": name, "scale": fits[name][0], "properties": [s["mean"], s["var"], s["skew"], s["kurt"]]}


def categorical_distribution(e: DataFrame, attribute: str) -> dict[str, list[float]]:
    """An equal-width histogram with the number of bins that `auto` suggests."""
    x = F.col(f"`{attribute}`").cast("double")
    n, lo, hi = e.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return {"bin_counts": [], "bin_edges": []}
    if lo == hi:
        return {"bin_counts": [n], "bin_edges": [lo - 0.5, lo + 0.5]}
    q = ranked(e, [attribute], [0.25, 0.75])[attribute]
    bins = bin_count("auto", n, lo, hi, iqr=q[1] - q[0])
    counts = dict(e.filter(x.isNotNull()).groupBy(F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).alias("b")).count().collect())
    return {"bin_counts": [counts.get(i, 0) for i in range(bins)], "bin_edges": np.linspace(lo, hi, bins + 1).tolist()}
