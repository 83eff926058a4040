"""Files whose format is found out from their head; every cell is read as text, by Spark.

Source is a file, or data that is there already, with its format: frames, records, batches, and what the head told.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.texts import chunks
from plumbline.operators import rows as row_operators
from plumbline.sources import avro, heads, jsons, remote
from plumbline.sources.heads import encoding, graph_columns  # noqa: F401
from plumbline.sources.jsons import flattened  # noqa: F401

KINDS = ("json", "graph", "csv", "parquet", "avro", "text")


@dataclass(frozen=True)
class ReadOptions:
    """How a file is read; what is None is found out from its head. header is the number of the row with the names, or -1."""

    kind: str | None = None
    encoding: str | None = None
    delimiter: str | None = None
    quote: str | None = None
    header: int | None = None
    columns: tuple[str, ...] | None = None
    sample_rows: int | None = None
    seed: int = 0
    payload_keys: tuple[str, ...] = jsons.PAYLOAD_KEYS
    separator: str = "."
    samples_per_line: int = 5_000_000_000

    def check(self) -> None:
        if self.kind is not None and self.kind not in KINDS:
            raise ValueError(f"no such kind of file: {self.kind}")
        for name in ("delimiter", "quote"):
            x = getattr(self, name)
            if x is not None and (not isinstance(x, str) or len(x) != 1):
                raise ValueError(f"{name} is one character")
        if self.header is not None and (not isinstance(self.header, int) or self.header < -1):
            raise ValueError("header is a row's number, or -1")
        if self.sample_rows is not None and self.sample_rows < 1 or self.samples_per_line < 1:
            raise ValueError("numbers of rows and characters are above 0")
        if self.columns is not None and not all(isinstance(c, str) for c in self.columns):
            raise ValueError("columns are names")
        if self.encoding is not None:
            "".encode(self.encoding)


def kind(path: str, spark: SparkSession | None = None) -> str:
    """parquet, avro, json, graph, csv or text."""
    return heads.kind(heads.head(spark or SparkSession.active(), path))


def _csv(spark: SparkSession, path: str, o: ReadOptions, head: bytes) -> DataFrame:
    rows = heads.lines(head)
    quote = o.quote or heads.quote(rows)
    delimiter = o.delimiter or heads.delimiter(rows, quote) or ","
    java = heads.java_name(o.encoding or heads.encoding(head))
    parsed = [*csv.reader(io.StringIO(heads.text(head)), delimiter=delimiter, quotechar=quote)]
    parsed = [r for r in (parsed[:-1] if len(head) >= heads.HEAD_BYTES else parsed) if r]
    header = heads.header_row(parsed) if o.header is None else None if o.header < 0 else o.header
    if heads.trailing_only(rows, delimiter):
        names = [rows[header].rstrip()[:-1]] if header is not None else ["_c0"]
        lines = spark.read.option("encoding", java).text(path).select(F.regexp_replace("value", f"\\{delimiter}\\s*$", "").alias(names[0]))
        return lines.filter(F.col(f"`{names[0]}`") != names[0]) if header is not None else lines
    over_lines = heads.open_quote(rows, quote)
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("encoding", java).option("multiLine", over_lines or java.startswith(("UTF-16", "UTF-32"))).option("nullValue", "\0").option("emptyValue", "")
    if not header:
        return reader.option("header", header == 0).csv(path).na.fill("")
    names = parsed[header]
    out = reader.option("header", False).schema(", ".join(f"`{i}` string" for i in range(len(names)))).csv(path).na.fill("")
    title = {tuple((r + [""] * len(names))[: len(names)]) for r in parsed[: header + 1]}  # lines down to the header
    is_title = [F.array(*[F.col(f"`{i}`") for i in range(len(names))]) == F.array(*map(F.lit, t)) for t in title]
    keep = ~is_title[0]
    for t in is_title[1:]:
        keep &= ~t
    return out.filter(keep).toDF(*names)


def read(spark: SparkSession, path: str, as_kind: str | None = None, columns: list[str] | None = None, delimited_by: str | None = None, header: bool | None = None, options: ReadOptions | None = None) -> DataFrame:
    """The file as text columns; a text file has one, value. columns are pushed down to the scan."""
    o = options or ReadOptions(as_kind, delimiter=delimited_by, header=None if header is None else 0 if header else -1, columns=tuple(columns) if columns else None)
    o.check()
    head = heads.head(spark, path)
    as_kind = o.kind or heads.kind(head)
    code = o.encoding or heads.encoding(head)
    if as_kind == "parquet":
        out = jsons.flattened(spark.read.parquet(path), o.separator)
    elif as_kind == "avro":
        out = avro.read(spark, path, head, o.separator)
    elif as_kind == "json":
        out = json_source(spark, path, o)[0]
    elif as_kind in ("csv", "graph"):
        out = _csv(spark, path, o, head)
    else:
        out = spark.read.text(path) if code in ("utf-8", "ascii") else _decoded(spark, path, code)
    if code.lower() == "windows-1252" and as_kind in ("csv", "graph", "json", "text"):
        out = out.select(*[F.translate(F.col(f"`{c}`"), heads.CONTROLS, heads.SIGNS).alias(c.translate(str.maketrans(heads.CONTROLS, heads.SIGNS))) for c in out.columns])
    if o.columns:
        out = out.select(*[F.col(f"`{c}`") for c in o.columns])
    return row_operators.reservoir(out, o.sample_rows, o.seed) if o.sample_rows else out


def _decoded(spark: SparkSession, path: str, code: str) -> DataFrame:
    """Lines of a text in another encoding than UTF-8: one task for each file."""
    lines = F.split(F.regexp_replace(F.decode("content", heads.java_name(code)), "^\ufeff", ""), "\r\n|\n|\r")
    whole = spark.read.format("binaryFile").load(path).select(lines.alias("l"))
    return whole.select(F.explode(F.when(F.element_at("l", -1) == "", F.slice("l", 1, F.size("l") - 1)).otherwise(F.col("l"))).alias("value"))


def json_source(spark: SparkSession, path: str, o: ReadOptions) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Rows, what surrounds the payload of a document, and the lines of JSON lines that couldn't be read."""
    head = heads.head(spark, path)
    rows = heads.lines(head)
    code = o.encoding or heads.encoding(head)
    import json

    def whole(x: str) -> bool:
        try:
            return isinstance(json.loads(x), (dict, list))
        except ValueError:
            return False

    if len(rows) > 1 and sum(map(whole, rows)) * 2 >= len(rows) or len(rows) == 1 and isinstance(json.loads(rows[0]) if whole(rows[0]) else None, dict) and not any(k in json.loads(rows[0]) for k in o.payload_keys):
        good, bad = jsons.lines(spark, path, heads.java_name(code))
        return good, None, bad
    data, around = jsons.document(spark, path, code, o.payload_keys, o.separator)
    return data, around, None


@dataclass
class Source:
    """A file or a frame, read when it is asked for. What it doesn't have itself is that of its frame."""

    spark: SparkSession
    path: str | None = None
    frame: DataFrame | None = None
    options: ReadOptions = field(default_factory=ReadOptions)

    def __post_init__(self) -> None:
        if (self.path is None) == (self.frame is None):
            raise ValueError("a source has either a path or a frame")
        self.options.check()
        if self.path is not None and remote.is_s3(self.path):
            self.path = remote.s3_path(self.spark, self.path)
        self._data = self.frame

    @property
    def kind(self) -> str:
        return self.options.kind or (kind(self.path, self.spark) if self.path is not None else "frame")

    @property
    def encoding(self) -> str | None:
        """None for formats that have none."""
        if self.path is None or self.kind in ("parquet", "avro"):
            return None
        return self.options.encoding or heads.encoding(heads.head(self.spark, self.path))

    @encoding.setter
    def encoding(self, name: str) -> None:
        if name.lower().replace("_", "-") not in ("ascii", "utf-8", "utf-16", "utf-32", "latin-1", "windows-1252"):
            raise ValueError(f"{name} can't be set")
        self.options, self._data = replace(self.options, encoding=name), self.frame

    @property
    def data(self) -> DataFrame:
        if self._data is None:
            self._data = read(self.spark, self.path, options=self.options)
        return self._data

    @property
    def metadata(self) -> DataFrame | None:
        """What surrounds the payload of a JSON document."""
        return json_source(self.spark, self.path, self.options)[1] if self.path is not None and self.kind == "json" else None

    @property
    def bad_lines(self) -> DataFrame | None:
        """Lines of JSON lines that couldn't be read."""
        return json_source(self.spark, self.path, self.options)[2] if self.path is not None and self.kind == "json" else None

    @property
    def data_and_metadata(self) -> DataFrame:
        around = self.metadata
        return self.data if around is None else jsons.beside(around, self.data)

    def records(self, as_json: bool | None = None) -> DataFrame:
        """(value): rows as lines of the source's format: JSON, or delimited by commas (the first holds the names)."""
        if as_json or as_json is None and self.kind in ("json", "parquet", "avro"):
            return jsons.records(self.data, self.options.separator)
        if self.kind == "text":
            return self.text()
        names = io.StringIO()
        csv.writer(names, lineterminator="").writerow(self.data.columns)
        first = self.spark.createDataFrame([(names.getvalue(),)], "value string").coalesce(1)
        return first.unionByName(self.data.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in self.data.columns])).alias("value")))

    def text(self) -> DataFrame:
        """(value): each line in pieces of at most samples_per_line characters."""
        n = min(self.options.samples_per_line, 1 << 30)
        c = F.concat_ws("", *[F.col(f"`{c}`") for c in self.data.columns])
        return self.data.select(F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(c) - 1, F.lit(0)) / n)), lambda k: F.substr(c, (k * n + 1).cast("int"), F.lit(n)))).alias("value"))

    def tokenize(self) -> None:
        raise NotImplementedError("texts are cut into words by the text profile")

    def edges(self) -> DataFrame:
        """(u, v, attributes…) of a graph, of repeated edges the last."""
        from plumbline.operators import graph

        ends = graph_columns(self.data.columns)
        if ends is None:
            raise ValueError("no columns with a source and a target")
        return graph.edges(self.data, *ends, [c for c in self.data.columns if c not in ends])

    def batches(self, n: int, seed: int = 0) -> Iterator[DataFrame]:
        """The rows in random parts of about n, each row once."""
        parts = max(1, -(-len(self) // n))
        marked = self.data.withColumn("__part", F.floor(F.rand(seed) * parts).cast("int"))
        for k in range(parts):
            yield marked.filter(F.col("__part") == k).drop("__part")

    def lines(self, size: int = 1000) -> Iterator[list[str]]:
        """The records as lists of lines, for consumers on the driver; partition by partition."""
        at: list[str] = []
        for r in self.records().toLocalIterator():
            at.append(r["value"])
            if len(at) == size:
                yield at
                at = []
        yield from chunks(at, size)

    def reload(self, path: str | None = None, frame: DataFrame | None = None, options: ReadOptions | None = None) -> Source:
        return Source(self.spark, path, frame, options or self.options)

    def __len__(self) -> int:
        return self.data.count()

    def __getattr__(self, name: str) -> object:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.data, name)


def from_lines(spark: SparkSession, lines: Iterator[str]) -> DataFrame:
    """(value) from lines that are on the driver: a list, or an open file's."""
    return spark.createDataFrame([(x.rstrip("\r\n"),) for x in lines], "value string")


def from_dicts(spark: SparkSession, data: dict | list[dict], separator: str = ".") -> DataFrame:
    """Nested dictionaries as text columns."""
    rows = data if isinstance(data, list) else [data]
    return jsons.frame(spark, [dict(y for leaf in jsons.walk(x, "", separator) for y in leaf.items()) for x in rows])


def from_buffer(spark: SparkSession, buffer: io.StringIO | io.BytesIO, folder: str, options: ReadOptions | None = None) -> Source:
    """A source of what an open buffer holds, by way of a file in `folder`, which all nodes share."""
    import uuid

    data = buffer.read()
    path = f"{folder.rstrip('/')}/buffer-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
    finally:
        out.close()
    return Source(spark, path, None, options or ReadOptions())


def from_url(spark: SparkSession, url: str, folder: str, verify: bool = True, options: ReadOptions | None = None) -> Source:
    return Source(spark, remote.fetched(spark, url, folder, verify), None, options or ReadOptions())
