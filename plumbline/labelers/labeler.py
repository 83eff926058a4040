"""Labelers: a preprocessor, a model and a postprocessor that fit together, kept on disk, and run over Spark frames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.labelers import processors as P
from plumbline.labelers.models import CharModel, ColumnNameModel, Model, RegexModel, TrainableModel

LIBRARY = {
    "regex": lambda: Labeler(P.DirectPass(), RegexModel(), P.RegexPostprocessor()),
    "structured_regex": lambda: Labeler(P.DirectPass(), RegexModel(), P.StructRegexPostprocessor()),
    "column_name": lambda: Labeler(P.DirectPass(), ColumnNameModel(), P.ColumnNamePostprocessor()),
    "structured": lambda: Labeler(P.StructCharPreprocessor(), CharModel(), P.StructCharPostprocessor()),
    "unstructured": lambda: Labeler(P.CharPreprocessor(), CharModel(), P.CharPostprocessor()),
}
ENTITY = "array<struct<start:int,stop:int,label:string>>"


class Labeler:
    """predict() on lists, entities() and cells() on frames; fit() where the model can be trained."""

    def __init__(self, preprocessor: P.Processor, model: Model, postprocessor: P.Processor) -> None:
        self.preprocessor, self.model, self.postprocessor = preprocessor, model, postprocessor

    @classmethod
    def from_library(cls, name: str) -> Labeler:
        if name not in LIBRARY:
            raise ValueError(f"no such labeler: {name}; there are {', '.join(sorted(LIBRARY))}")
        return LIBRARY[name]()

    @classmethod
    def from_components(cls, preprocessor: P.Processor, model: Model, postprocessor: P.Processor, trainable: bool = False) -> Labeler:
        if trainable and not isinstance(model, TrainableModel):
            raise ValueError("the model can't be trained")
        out = cls(preprocessor, model, postprocessor)
        out.check(strict=True)
        return out

    @classmethod
    def from_disk(cls, folder: str) -> Labeler:
        state = json.loads((Path(folder) / "labeler.json").read_text())
        return cls(P.Processor.of(state["preprocessor"]), Model.of(state["model"]), P.Processor.of(state["postprocessor"]))

    def save(self, folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        state = {"preprocessor": self.preprocessor.state(), "model": self.model.state(), "postprocessor": self.postprocessor.state()}
        (Path(folder) / "labeler.json").write_text(json.dumps(state))

    def set_params(self, preprocessor: dict | None = None, model: dict | None = None, postprocessor: dict | None = None) -> None:
        for part, new in ((self.preprocessor, preprocessor), (self.model, model), (self.postprocessor, postprocessor)):
            part.set_params(**(new or {}))
        self.check(strict=True)

    def set_labels(self, labels: list[str] | dict[str, int]) -> None:
        self.model.set_labels(labels)

    def add_label(self, label: str, same_as: str | None = None) -> None:
        self.model.add_label(label, same_as)

    @property
    def labels(self) -> list[str]:
        """By number, padding aside."""
        return [k for k, _ in sorted(self.model.labels.items(), key=lambda x: x[1]) if k != P.PAD]

    def check(self, strict: bool = False) -> list[str]:
        """Parameters of one name that differ between the parts; raises if strict and there are some."""
        parts = [self.preprocessor.parameters, self.model.parameters, self.postprocessor.parameters]
        shared = {k for p in parts for k in p if sum(k in q for q in parts) > 1}
        wrong = sorted(k for k in shared if len({str(p[k]) for p in parts if k in p}) > 1)
        if wrong and strict:
            raise ValueError(f"the parts disagree about {', '.join(wrong)}")
        return wrong

    def predict(self, data: list[str | None]) -> list | dict:
        """The postprocessor's results for texts, cells or column names."""
        m, post = self.model, self.postprocessor
        if isinstance(m, ColumnNameModel):
            return post.process(m.predict([x or "" for x in data]))
        if isinstance(m, RegexModel):
            return post.process(m.predict(self.preprocessor.process(data)), m.labels)
        texts = [x or "" for x in data]
        samples = self.preprocessor.process(texts) if isinstance(self.preprocessor, P.CharPreprocessor) else [[t] for t in texts]
        found = P.aligned(texts, samples, m.predict([s for parts in samples for s in parts]))
        return post.process(texts, found, m.labels)

    def entities(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id_col, start, stop, label, entity): the spans of each text; null texts have none. Arrow batches, whole texts."""
        kind, names, background = df.schema[id_col].dataType.simpleString(), self.model.names, self._background()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                texts = batch.column(1).to_pylist()
                for k, found in enumerate(self.predict(texts)):
                    spans = found if not len(found) or isinstance(found[0], tuple) else P.ner_spans(list(np.asarray(found).tolist()), names, background)
                    rows += [(k, a, b, label, texts[k][a:b]) for a, b, label in spans]
                columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=[id_col, "start", "stop", "label", "entity"])

        own = df.filter(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
        return own.mapInArrow(work, f"`{id_col}` {kind}, start int, stop int, label string, entity string")

    def _background(self) -> set[int]:
        return {self.model.labels[k] for k in (P.UNKNOWN, P.PAD, self.model.parameters.get("default_label")) if k in self.model.labels}

    def cells(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """(column_name, value, label) of all cells that aren't null, for labelers of cells."""
        if not isinstance(self.postprocessor, (P.StructRegexPostprocessor, P.StructCharPostprocessor)):
            raise ValueError("this labeler has no labels for cells")
        long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "value").filter("value is not null")

        @F.arrow_udf("string")
        def label(values: pa.Array) -> pa.Array:
            return pa.array([x[0] if isinstance(x, tuple) else x for x in self.predict(values.to_pylist())], pa.string())

        return long.withColumn("label", label("value"))

    def fit(self, texts: list[str], spans: list[list[P.Span]], labels: list[str] | None = None, validation: float = 0.2, epochs: int = 1, seed: int = 0, reset: bool = False) -> list[dict[str, float]]:
        """Trains on a part of the texts and tells, for each epoch, how the rest is labelled."""
        if not isinstance(self.model, TrainableModel):
            raise ValueError("the model can't be trained")
        if labels is not None:
            self.set_labels(labels)
        if reset:
            self.model.reset_weights()
        order = np.random.default_rng(seed).permutation(len(texts)).tolist()
        held = order[: int(validation * len(texts))]
        rest, out = order[len(held) :], []
        for epoch in range(epochs):
            got = self.model.fit([texts[k] for k in rest], [spans[k] for k in rest], 1, seed + epoch)[0]
            found = self.model.predict([texts[k] for k in held])
            want = [P.CharPreprocessor(default_label=self.model.parameters["default_label"]).labelled(texts[k], spans[k], self.model.labels) for k in held]
            n = sum(map(len, want))
            out.append(got | {"validation": sum(a == b for x, y in zip(found, want, strict=True) for a, b in zip(x, y, strict=True)) / n if n else float("nan")})
        return out


def train_cells(cells: list[str], labels: list[str], default: str = P.UNKNOWN, epochs: int = 2, folder: str | None = None) -> Labeler:
    """A labeler of cells trained on labelled ones, and kept if a folder is given."""
    out = Labeler.from_library("structured")
    spans = [[] if k == default else [(0, len(c), k)] for c, k in zip(cells, labels, strict=True)]
    out.fit(cells, spans, [P.PAD, default, *sorted(set(labels) - {default})], epochs=epochs)
    if folder:
        out.save(folder)
    return out
