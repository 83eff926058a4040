"""The right profile for the data: tables, texts and graphs, given as sources, frames, lists or single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import graphs, profile, text
from plumbline.plans.options import Options
from plumbline.sources.files import Source

KINDS = ("structured", "unstructured", "graph")


def profiler(data: Source | DataFrame | list | str, options: Options | None = None, kind: str | None = None, spark: SparkSession | None = None) -> profile.Profile | text.TextProfile | graphs.GraphProfile:
    """Sources know what they are: graphs and texts have profiles of their own. Lists of dictionaries are tables, lists of
    texts and single texts are texts, frames are tables, unless `kind` says otherwise."""
    spark = spark or SparkSession.active()
    if kind is not None and kind not in KINDS:
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    encoding = file_type = None
    if isinstance(data, Source):
        file_type, encoding = data.kind, data.encoding
        kind = kind or {"graph": "graph", "text": "unstructured"}.get(file_type, "structured")
        frame = data.edges() if kind == "graph" else data.data
    elif isinstance(data, DataFrame):
        kind, frame = kind or "structured", data
    elif isinstance(data, str):
        kind, frame = kind or "unstructured", spark.createDataFrame([(data,)], "value string")
    elif isinstance(data, list) and all(isinstance(x, dict) for x in data):
        from plumbline.sources.files import from_dicts

        kind, frame = kind or "structured", from_dicts(spark, data)
    elif isinstance(data, list):
        kind, frame = kind or "unstructured", spark.createDataFrame([(None if x is None else str(x),) for x in data], "value string")
    else:
        raise TypeError(f"no profile of {type(data).__name__}")
    if kind == "graph":
        return graphs.of(frame)
    if kind == "unstructured":
        return text.of(frame, None, options)
    return profile.of(frame, options, encoding, file_type)
