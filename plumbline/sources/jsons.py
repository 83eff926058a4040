"""JSON documents as tables: trees walked to dotted paths, the payload told from what surrounds it, and back again.

JSON lines are read and flattened by Spark, whatever their number. A single document over many lines (of bounded size,
since one task has to parse it) is walked on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.texts import nested

PAYLOAD_KEYS = ("data", "payload", "response")
#: Bytes of a document that the driver walks, at most.
MOST_BYTES = 256 << 20
CORRUPT = "_corrupt_record"


def walk(tree: object, path: str = "", separator: str = ".") -> Iterator[dict[str, object]]:
    """One-key dictionaries of dotted paths and leaves, in order; lists of dictionaries are walked, others are leaves."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            yield from walk(v, f"{path}{separator}{k}" if path else str(k), separator)
    elif isinstance(tree, list) and tree and all(isinstance(x, dict) for x in tree):
        for x in tree:
            yield from walk(x, path, separator)
    elif path:
        yield {path: tree}


def coalesced(leaves: Iterator[dict[str, object]]) -> list[dict[str, object]]:
    """One-key dictionaries packed into rows: the n-th leaf of a path goes to row n."""
    rows: list[dict[str, object]] = []
    seen: dict[str, int] = {}
    for leaf in leaves:
        for k, v in leaf.items():
            n = seen.get(k, 0)
            seen[k] = n + 1
            if n == len(rows):
                rows.append({})
            rows[n][k] = v
    return rows


def payload(document: dict, keys: tuple[str, ...] = PAYLOAD_KEYS, separator: str = ".") -> tuple[list[dict], list[dict]]:
    """The rows of the longest payload, their paths beginning with its key, and rows of all that surrounds it."""
    found: dict[str, list[dict]] = {}
    for k in keys:
        if isinstance(document.get(k), (dict, list)):
            own = document[k]
            rows = [dict(y for leaf in walk(x, "", separator) for y in leaf.items()) for x in own] if isinstance(own, list) and all(isinstance(x, dict) for x in own) else coalesced(walk(own, "", separator))
            if rows:
                found[k] = [{f"{k}{separator}{c}": v for c, v in r.items()} for r in rows]
    best = max(found, key=lambda k: len(found[k]), default=None)
    rest = coalesced(walk({k: v for k, v in document.items() if k != best}, "", separator))
    return (found[best], rest) if best is not None else (rest, [])


def text(x: object) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x)


def frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows as text columns, in order of appearance."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(text(r.get(n)) for n in names) for r in rows], schema)


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested fields as text columns with dotted names; arrays and maps stay single columns, as JSON."""

    def fields(schema: T.StructType, path: list[str]) -> list:
        out = []
        for f in schema:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += fields(f.dataType, at)
                continue
            c = F.col(".".join(f"`{p}`" for p in at))
            out.append((F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else c.cast("string")).alias(separator.join(at)))
        return out

    return df.select(*fields(df.schema, []))


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines as text columns, and (value) of the lines that are none: bad lines are told, not lost."""
    raw = spark.read.option("encoding", encoding).option("lineSep", "\n").option("primitivesAsString", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    df = raw.json(path)
    if CORRUPT not in df.columns:
        return flattened(df), spark.createDataFrame([], "value string")
    named = T.StructType([f for f in df.schema if f.name != CORRUPT] + [T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(named).option("encoding", encoding).option("lineSep", "\n").option("primitivesAsString", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    others = [F.col(f"`{c}`") for c in good.columns]  # Spark wants one of them to be read too
    bad = df.filter(F.col(CORRUPT).isNotNull() & (F.hash(*others) % 2 < 2)).select(F.col(CORRUPT).alias("value"))
    return flattened(good), bad


def document(spark: SparkSession, path: str, encoding: str, keys: tuple[str, ...] = PAYLOAD_KEYS, separator: str = ".") -> tuple[DataFrame, DataFrame | None]:
    """A whole document's rows, and what surrounds its payload (None if there is no payload)."""
    rows = spark.read.format("binaryFile").load(path).select("length", "content").limit(2).collect()
    if len(rows) > 1 or not rows:
        raise ValueError("a folder of JSON documents is read as JSON lines")
    if rows[0]["length"] > MOST_BYTES:
        raise ValueError(f"a JSON document of over {MOST_BYTES >> 20} MB has to be split into lines")
    tree = json.loads(bytes(rows[0]["content"]).decode(encoding).removeprefix("﻿"))
    if isinstance(tree, list):
        return frame(spark, [dict(y for leaf in walk(x, "", separator) for y in leaf.items()) if isinstance(x, dict) else {"value": x} for x in tree]), None
    own, rest = payload(tree, keys, separator)
    return frame(spark, own), frame(spark, rest) if rest else None


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Both frames' columns side by side, by the number of the row (the frames are those of one document)."""
    a, b = (x.select(F.monotonically_increasing_id().alias("__at"), *[F.col(f"`{c}`") for c in x.columns]) for x in (one.coalesce(1), other.coalesce(1)))
    return a.join(b, "__at", "full").orderBy("__at").drop("__at")


def records(df: DataFrame, separator: str = ".") -> DataFrame:
    """(value): each row as JSON, dotted columns nested again; nulls are left out."""
    tree = nested({c: c for c in df.columns}, separator)

    def build(node: dict) -> list:
        return [F.struct(*build(v)).alias(k) if isinstance(v, dict) else F.col(f"`{v}`").alias(k) for k, v in node.items()]

    return df.select(F.to_json(F.struct(*build(tree))).alias("value"))
