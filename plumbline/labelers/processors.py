"""What goes before and after a model: cutting and encoding texts, and turning characters' labels into spans and cells."""

from __future__ import annotations

import random
from abc import ABC, abstractmethod
from collections import Counter
from collections.abc import Iterator

import numpy as np

SEPARATORS = (" ", "\n", ",", "\t", "\r", "\x00", "\x01", ";")
PAD, UNKNOWN = "PAD", "UNKNOWN"
Span = tuple[int, int, str]
REGISTRY: dict[str, type] = {}


def nearest_break(text: str, start: int, least: int = 0, separators: tuple[str, ...] = SEPARATORS) -> int:
    """The last place at or before `start`, and after `least`, with a separator; `least` where there is none."""
    return next((i for i in range(start, least, -1) if text[i] in separators), least)


class Processor(ABC):
    """A step with parameters. Subclasses register themselves under their names, custom ones too."""

    defaults: dict[str, object] = {}

    def __init_subclass__(cls, **rest: object) -> None:
        super().__init_subclass__(**rest)
        REGISTRY[cls.__name__.lower()] = cls

    def __init__(self, **parameters: object) -> None:
        self.parameters = dict(self.defaults)
        self.set_params(**parameters)

    def set_params(self, **parameters: object) -> None:
        unknown = sorted(parameters.keys() - self.defaults.keys())
        if unknown:
            raise ValueError(f"{type(self).__name__} has no parameters {unknown}")
        self.parameters |= parameters
        self.check()

    def check(self) -> None:
        """Raises if parameters don't make sense."""

    @classmethod
    def get_class(cls, name: str) -> type[Processor]:
        return REGISTRY[name.lower()]

    @abstractmethod
    def process(self, *args: object, **named: object) -> object: ...

    def state(self) -> dict[str, object]:
        return {"class": type(self).__name__, "parameters": {k: list(v) if isinstance(v, tuple) else v for k, v in self.parameters.items()}}

    @classmethod
    def of(cls, state: dict) -> Processor:
        return cls.get_class(state["class"])(**{k: tuple(v) if isinstance(v, list) else v for k, v in state["parameters"].items()})


class DirectPass(Processor):
    """Gives the texts on as they are."""

    def process(self, texts: list[str | None]) -> list[str]:
        return [t or "" for t in texts]


class CharPreprocessor(Processor):
    """Cuts texts into samples of at most max_length characters, at separators where there are any."""

    defaults = {"max_length": 3400, "default_label": UNKNOWN, "pad_label": PAD, "flatten_split": 0.0, "flatten_separator": " "}

    def check(self) -> None:
        p = self.parameters
        if not isinstance(p["max_length"], int) or p["max_length"] < 1:
            raise ValueError("max_length is a number above 0")
        if not 0 <= p["flatten_split"] <= 1:
            raise ValueError("flatten_split lies between 0 and 1")

    def samples(self, text: str) -> Iterator[str]:
        most, at = self.parameters["max_length"], 0
        while len(text) - at > most:
            cut = nearest_break(text, at + most - 1, at)
            cut = at + most if cut == at else cut + 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def process(self, texts: list[str | None]) -> list[list[str]]:
        """For each text its samples; together they are the text."""
        return [list(self.samples(t or "")) for t in texts]

    def batches(self, texts: list[str | None], batch_size: int = 32) -> Iterator[list[str]]:
        """All samples, one after another, in batches."""
        flat = [s for parts in self.process(texts) for s in parts]
        for lo in range(0, len(flat), batch_size):
            yield flat[lo : lo + batch_size]

    def labelled(self, text: str, spans: list[Span], labels: dict[str, int]) -> list[int]:
        """The label number of each character of a text with known spans."""
        out = [labels[self.parameters["default_label"]]] * len(text)
        for a, b, label in spans:
            if label not in labels:
                raise ValueError(f"no such label: {label}")
            out[a:b] = [labels[label]] * (b - a)
        return out


class CharEncodedPreprocessor(CharPreprocessor):
    """Samples as numbers: code points, those beyond the map's end as its last."""

    defaults = CharPreprocessor.defaults | {"encoding_map_size": 150}

    def encoded(self, text: str) -> np.ndarray:
        return np.minimum(np.array([ord(c) for c in text], np.int32), self.parameters["encoding_map_size"])


class StructCharPreprocessor(CharPreprocessor):
    """Cells laid end to end with a separator between them."""

    defaults = CharPreprocessor.defaults | {"flatten_separator": "\x01" * 5, "is_separate_at_max_len": False}

    def unstructured(self, cells: list[str], labels: list[str] | None = None) -> tuple[str, list[Span] | None]:
        """The cells' text, and spans for labelled ones (background cells have none)."""
        between = self.parameters["flatten_separator"]
        spans, at = [], 0
        for k, c in enumerate(cells):
            if labels is not None and labels[k] != self.parameters["default_label"]:
                spans.append((at, at + len(c), labels[k]))
            at += len(c) + len(between)
        return between.join(cells), spans if labels is not None else None


def ner_spans(predictions: list[int], names: dict[int, str], background: set[int]) -> list[Span]:
    """Runs of one label, but for background and padding."""
    cuts = [0, *[i for i in range(1, len(predictions)) if predictions[i] != predictions[i - 1]], len(predictions)]
    return [(a, b, names[predictions[a]]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b and predictions[a] not in background]


def word_level(text: str, predictions: list[int], background: int, separators: tuple[str, ...] = SEPARATORS, least: float = 0.75) -> list[int]:
    """Labels by words: that which at least a share `least`, and more than one, of a word's characters have; else background.

    Separators between two words of one label keep it, others are background.
    """
    out, begin = list(predictions), 0
    breaks = [i for i, c in enumerate(text) if c in separators]
    for end in [*breaks, len(text)]:
        if end > begin:
            label, n = Counter(predictions[begin:end]).most_common(1)[0]
            out[begin:end] = [label if n > 1 and n >= least * (end - begin) else background] * (end - begin)
        begin = end + 1
    for i in breaks:
        beside = {out[i - 1] if i else background, out[i + 1] if i + 1 < len(text) else background, predictions[i]}
        out[i] = predictions[i] if len(beside) == 1 else background
    return out


def aligned(texts: list[str], samples: list[list[str]], results: list[list[int]]) -> list[list[int]]:
    """Results of samples put together again, one list for each text, as long as the text."""
    at, out = 0, []
    for text, parts in zip(texts, samples, strict=True):
        flat = [x for k, p in enumerate(parts) for x in results[at + k][: len(p)]]
        if len(flat) != len(text):
            raise ValueError("results don't cover their text")
        out.append(flat)
        at += len(parts)
    return out


class CharPostprocessor(Processor):
    """Characters' labels as spans, by words if that is asked for."""

    defaults = {"default_label": UNKNOWN, "pad_label": PAD, "use_word_level_argmax": False, "word_level_min_percent": 0.75, "separators": SEPARATORS, "output_format": "ner"}

    def check(self) -> None:
        if self.parameters["output_format"] not in ("ner", "character_argmax") or not 0 <= self.parameters["word_level_min_percent"] <= 1:
            raise ValueError("the format is ner or character_argmax, the share between 0 and 1")

    def process(self, texts: list[str], predictions: list[list[int]], labels: dict[str, int]) -> list:
        p = self.parameters
        background = labels[p["default_label"]]
        if p["use_word_level_argmax"]:
            predictions = [word_level(t, x, background, p["separators"], p["word_level_min_percent"]) for t, x in zip(texts, predictions, strict=True)]
        if p["output_format"] == "character_argmax":
            return predictions
        names = {i: k for k, i in labels.items()}
        return [ner_spans(x, names, {background, labels.get(p["pad_label"], -1)}) for x in predictions]


class StructCharPostprocessor(Processor):
    """A cell's label: that of most of its characters, padding aside; the background loses ties, others go to the first."""

    defaults = {"default_label": UNKNOWN, "pad_label": PAD}

    def process(self, cells: list[str], predictions: list[list[int]], labels: dict[str, int]) -> list[str | None]:
        names = {i: k for k, i in labels.items()}
        background, pad = labels[self.parameters["default_label"]], labels.get(self.parameters["pad_label"], -1)
        out = []
        for x in predictions:
            counts = Counter(v for v in x if v != pad)
            out.append(names[min(counts, key=lambda v: (-counts[v], v == background, v))] if counts else None)
        return out


class RegexPostprocessor(Processor):
    """One label for each character of several: the first in order of priority, a random one, or equal parts (split)."""

    defaults = {"aggregation": "priority", "priority_order": None, "seed": 0}

    def check(self) -> None:
        if self.parameters["aggregation"] not in ("split", "priority", "random"):
            raise ValueError("aggregations are split, priority and random")

    @staticmethod
    def split(marks: np.ndarray) -> np.ndarray:
        """Rows of marks as shares."""
        return marks / np.maximum(marks.sum(1, keepdims=True), 1)

    @staticmethod
    def priority(marks: np.ndarray, order: list[int]) -> np.ndarray:
        """The first marked label in this order."""
        return np.asarray(order)[(marks[:, order] > 0).argmax(1)]

    def process(self, marks: list[np.ndarray], labels: dict[str, int]) -> list[np.ndarray]:
        how = self.parameters["aggregation"]
        if how == "split":
            return [self.split(m) for m in marks]
        if how == "random":
            rng = random.Random(self.parameters["seed"])
            return [np.array([rng.choice(np.flatnonzero(r).tolist() or [0]) for r in m], np.int64) for m in marks]
        order = [labels[x] for x in self.parameters["priority_order"] or labels]
        return [self.priority(m, order) for m in marks]


class StructRegexPostprocessor(Processor):
    """A cell's label: that with the greatest mean share over its characters, and that share."""

    defaults = {"default_label": UNKNOWN}

    def process(self, marks: list[np.ndarray], labels: dict[str, int]) -> list[tuple[str | None, float]]:
        names = {i: k for k, i in labels.items()}
        out = []
        for m in marks:
            mean = RegexPostprocessor.split(m).mean(0) if len(m) else np.zeros(0)
            out.append((names[int(mean.argmax())], float(mean.max())) if len(mean) else (None, 0.0))
        return out


class ColumnNamePostprocessor(Processor):
    """Gives the model's labels on as they are."""

    def process(self, found: dict[str, tuple[str, float]]) -> dict[str, tuple[str, float]]:
        return found
