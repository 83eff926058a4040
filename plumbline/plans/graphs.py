"""A profile of a graph: size, degrees, the largest component, and its edges' attributes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from plumbline.operators import compare, graph
from plumbline.plans.profile import formatted, get, put


@dataclass
class GraphProfile:
    num_nodes: int = 0
    num_edges: int = 0
    categorical_attributes: list[str] = field(default_factory=list)
    continuous_attributes: list[str] = field(default_factory=list)
    avg_node_degree: float | None = None
    global_max_component_size: int = 0
    continuous_distribution: dict[str, dict | None] = field(default_factory=dict)
    categorical_distribution: dict[str, dict] = field(default_factory=dict)

    def __add__(self, o: GraphProfile) -> GraphProfile:
        raise NotImplementedError("graphs' profiles don't add up: what both have in common isn't known")

    def update(self, edges: DataFrame) -> GraphProfile:
        """The profile of a new graph, which takes the old one's place."""
        return of(edges)

    def report(self, output_format: str | None = None, omit_keys: tuple[str, ...] = ()) -> dict[str, object]:
        return formatted(dict(vars(self)), output_format, omit_keys)

    def diff(self, o: GraphProfile) -> dict[str, object]:
        return {k: compare.any_of(v, getattr(o, k)) for k, v in vars(self).items()}

    def save(self, spark: SparkSession, path: str) -> None:
        put(spark, path, json.dumps(vars(self)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphProfile:
        return cls(**json.loads(get(spark, path)))


def attributes(edges: DataFrame) -> list[str]:
    """The names of the edges' attributes."""
    return [c for c in edges.columns if c not in ("u", "v")]


def attribute_values(edges: DataFrame, attribute: str) -> DataFrame:
    """(value) of an attribute over all edges that have it."""
    return edges.select(edges[f"`{attribute}`"].alias("value")).filter("value is not null")


def of(edges: DataFrame) -> GraphProfile:
    """The profile of a frame (u, v, attributes…) as graph.edges() gives it; the edges are worked out once and kept meanwhile."""
    kept = edges.persist(StorageLevel.DISK_ONLY)
    try:
        return _of(kept)
    finally:
        kept.unpersist()


def _of(edges: DataFrame) -> GraphProfile:
    names = attributes(edges)
    s = graph.summary(edges).first()
    categorical, continuous = graph.attribute_kinds(edges, names) if names else ([], [])
    largest = graph.largest_component(edges).first()
    return GraphProfile(
        s["num_nodes"], s["num_edges"], categorical, continuous, s["avg_node_degree"], largest["n_edges"] if largest else 0,
        {a: graph.fit_distribution(edges, a) for a in continuous}, {a: graph.categorical_distribution(edges, a) for a in categorical},
    )
