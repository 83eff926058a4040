"""Sensitive entities: by patterns inside texts, and by columns' names.

Texts in which no entity can be (they lack the signs that all patterns have) are told apart in the JVM; the others go
through compiled patterns in Arrow batches, kind after kind, each over what earlier kinds left. Column names are few, so
their fuzzy match is made on the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In order of priority: where matches of two kinds overlap, the earlier kind has the characters.
PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "URL": r"https?://[^\s<>\"']+",
    "IPV4": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)",
    "MAC_ADDRESS": r"(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}",
    "UUID": r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
    "SSN": r"\d{3}-\d{2}-\d{4}",
    "CREDIT_CARD": r"\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}",
    "PHONE_NUMBER": r"\+\d{1,3}[ \-]\d{1,4}(?:[ \-]\d{2,8})+",
    "DATETIME": r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?",
}
#: What may stand directly before and after an entity.
EDGE = "A-Za-z0-9_"
#: A column's name is labelled if it is at least so similar to a listed one, in hundredths, and less to all innocent ones.
POSITIVE, NEGATIVE = 85, 50
NAMES = {
    "ssn": "SSN", "social security number": "SSN", "email": "EMAIL_ADDRESS", "email address": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "phone number": "PHONE_NUMBER", "credit card": "CREDIT_CARD",
    "ip": "IPV4", "ip address": "IPV4", "url": "URL", "address": "ADDRESS", "birth date": "DATETIME", "first name": "PERSON", "last name": "PERSON", "full name": "PERSON", "password": "SECRET",
}
INNOCENT = ("file name", "host name", "country name", "product name")


def bounded(pattern: str) -> str:
    return rf"(?<![{EDGE}])(?:{pattern})(?![{EDGE}])"


#: What a text must have for a kind's entities to be in it; kinds that aren't listed are always tried.
SIGNS = {"EMAIL_ADDRESS": "@", "URL": "://", "UUID": "-", "SSN": "-", "PHONE_NUMBER": "+", "DATETIME": "-", "IPV4": "."}
ANY_SIGN = "[0-9@:]"


def found(text: str, rules: list[tuple[str, str, re.Pattern]]) -> list[tuple[str, str]]:
    """(label, entity) of a text in order of priority; what one kind took, later ones don't see."""
    out = []
    for label, sign, rule in rules:
        if sign in text and (hits := rule.findall(text)):
            out += [(label, h) for h in hits]
            text = rule.sub("\u0001", text)
    return out


def _rules(patterns: dict[str, str] | None) -> list[tuple[str, str, re.Pattern]]:
    own = PATTERNS if patterns is None else patterns
    return [(k, SIGNS.get(k, "") if patterns is None else "", re.compile(bounded(p), re.ASCII)) for k, p in own.items()]


def _likely(df: DataFrame, text_col: str, patterns: dict[str, str] | None) -> DataFrame:
    c = F.col(f"`{text_col}`").cast("string")
    return df.filter(c.rlike(ANY_SIGN) if patterns is None else c.isNotNull())


def entities(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(id_col, label, entity), a row for each occurrence. Null texts have none."""
    kind, rules = df.schema[id_col].dataType.simpleString(), _rules(patterns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(k, *h) for k, t in enumerate(batch.column(1).to_pylist()) for h in found(t, rules)]
            columns = [pa.array([h[c] for h in hits], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=[id_col, "label", "entity"])

    own = _likely(df, text_col, patterns).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return own.mapInArrow(work, f"`{id_col}` {kind}, label string, entity string")


def entity_counts(df: DataFrame, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(label, n, n_chars): occurrences and the characters they cover, over all texts; summed up before they are moved."""
    rules = _rules(patterns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        chars: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for label, e in found(t, rules):
                    n[label] += 1
                    chars[label] += len(e)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([chars[k] for k in n], pa.int64())], names=["label", "n", "c"])

    own = _likely(df, text_col, patterns).select(F.col(f"`{text_col}`").cast("string").alias("t"))
    return own.mapInArrow(work, "label string, n bigint, c bigint").groupBy("label").agg(F.sum("n").alias("n"), F.sum("c").alias("n_chars"))


def cell_label(patterns: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A function of cells: the kind of entity that covers most of a cell's characters, UNKNOWN where none covers half."""
    rules = _rules(patterns)

    @F.arrow_udf("string")
    def label(cells: pa.Array) -> pa.Array:
        out = []
        for t in cells.to_pylist():
            size: Counter = Counter()
            for k, e in found(t or "", rules):
                size[k] += len(e)
            best = max(size, key=size.get, default=None)
            out.append(best if best is not None and size[best] * 2 >= len(t) else "UNKNOWN")
        return pa.array(out, pa.string())

    return label


def column_labels(df: DataFrame, columns: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """(column_name, label, n, share, place): votes of the cells that aren't null, place 1 being the column's label."""
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "value").filter("value is not null")
    votes = long.groupBy("column_name", cell_label(patterns)(F.col("value")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("column_name")
    share = F.col("n") / F.sum("n").over(by)
    return votes.select("column_name", "label", "n", share.alias("share"), F.row_number().over(by.orderBy(F.desc("n"), "label")).alias("place"))


def _distance(a: str, b: str) -> int:
    """The fewest insertions and deletions that make b of a."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def similarity(a: str, b: str) -> float:
    """0 to 100, of the two names' words in alphabetical order."""
    a, b = (" ".join(sorted(re.split(r"[\s_\-.]+", x.lower().strip()))) for x in (a, b))
    total = len(a) + len(b)
    return 100.0 * (1 - _distance(a, b) / total) if total else 100.0


def name_labels(columns: list[str], names: dict[str, str] | None = None, innocent: tuple[str, ...] = INNOCENT, positive: float = POSITIVE, negative: float = NEGATIVE) -> dict[str, tuple[str, float]]:
    """(label, similarity) of the columns whose names are close enough to a listed name."""
    out: dict[str, tuple[str, float]] = {}
    for c in columns:
        if any(similarity(c, x) >= negative for x in innocent):
            continue
        score, label = max(((similarity(c, n), k) for n, k in (NAMES if names is None else names).items()), default=(0.0, ""))
        if score > positive:
            out[c] = (label, round(score, 2))
    return out
