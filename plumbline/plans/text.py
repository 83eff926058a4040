"""A profile of free text: lines, memory, characters, words and entities; it adds up, is compared, saved and reported.

Characters and words are counted by Spark. Words are many: a profile keeps the frame of counts as a written table, which
sums of profiles and reports read; only what a report shows reaches the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.labelers import processors as P
from plumbline.labelers.labeler import Labeler
from plumbline.operators import compare, text
from plumbline.plans.column import summed
from plumbline.plans.options import Options, Unstructured
from plumbline.plans.profile import formatted, get, put

LEVELS = ("word_count", "true_char_count", "postprocess_char_count")
BREAKS = "".join(P.SEPARATORS)


def entity_levels(df: DataFrame, text_col: str, labeler: Labeler) -> DataFrame:
    """(level, label, n): labels by words, by the model's characters, and by characters after postprocessing.

    Each entity is a word of its label, each stretch between separators outside entities a word of the background.
    """
    names, background = labeler.model.names, labeler._background()
    unknown = next((names[b] for b in sorted(background) if names[b] != P.PAD), P.UNKNOWN)
    own = df.filter(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").cast("string").alias("t"))

    def work(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}

            def add(level: str, label: str, n: int) -> None:
                if n:
                    counts[level, label] = counts.get((level, label), 0) + n

            texts = batch.column(0).to_pylist()
            for t, found in zip(texts, labeler.predict(texts), strict=True):
                spans = found if len(found) and isinstance(found[0], tuple) else P.ner_spans([int(x) for x in found], names, background)
                at, covered = 0, 0
                for a, b, label in [*spans, (len(t), len(t), None)]:
                    between = t[at:a]
                    for c in BREAKS:
                        between = between.replace(c, " ")
                    add("word_count", unknown, len(between.split()))
                    if label is not None:
                        add("word_count", label, 1)
                        add("true_char_count", label, b - a)
                        add("postprocess_char_count", label, b - a)
                        covered += b - a
                    at = b
                add("true_char_count", unknown, len(t) - covered)
                add("postprocess_char_count", unknown, len(t) - covered)
            columns = list(zip(*[(k[0], k[1], n) for k, n in counts.items()], strict=True)) if counts else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["level", "label", "n"])

    return own.mapInArrow(work, "level string, label string, n bigint").groupBy("level", "label").agg(F.sum("n").alias("n"))


@dataclass
class TextProfile:
    n_lines: int = 0
    empty_lines: int = 0
    memory_mb: float = 0.0
    vocab_count: dict[str, int] | None = None
    words: DataFrame | None = None
    case_sensitive: bool = True
    stop_words: tuple[str, ...] = text.STOP_WORDS
    entities: dict[str, dict[str, int]] | None = None
    options: Unstructured = field(default_factory=Unstructured)

    @property
    def word_frame(self) -> DataFrame | None:
        """(word, n) without stop words, in lower case if that is how the profile counts."""
        if self.words is None:
            return None
        own = self.words if self.case_sensitive else self.words.withColumn("word", F.lower("word"))
        if self.stop_words:
            own = own.filter(~F.lower("word").isin(*self.stop_words))
        return own.groupBy("word").agg(F.sum("n").alias("n"))

    def __add__(self, o: TextProfile) -> TextProfile:
        """Both texts together. Stop words are those of either; case counts only if it does in both."""
        if (self.words is None) != (o.words is None) and self.n_lines and o.n_lines:
            raise ValueError("one of the profiles has no words")
        words = self.words if o.words is None else o.words if self.words is None else self.words.unionByName(o.words).groupBy("word").agg(F.sum("n").alias("n"))
        vocab = None if self.vocab_count is None or o.vocab_count is None else summed(self.vocab_count, o.vocab_count)
        entities = None if self.entities is None or o.entities is None else {k: summed(self.entities.get(k, {}), o.entities.get(k, {})) for k in LEVELS}
        stop = tuple(sorted({*self.stop_words, *o.stop_words}))
        return TextProfile(self.n_lines + o.n_lines, self.empty_lines + o.empty_lines, self.memory_mb + o.memory_mb, vocab, words, self.case_sensitive and o.case_sensitive, stop, entities, self.options)

    def top_words(self, k: int | None = None) -> dict[str, int]:
        """The k most frequent words, ties by the word."""
        own = self.word_frame
        return {} if own is None else {r["word"]: r["n"] for r in own.orderBy(F.desc("n"), "word").limit(k or 100).collect()}

    def top_chars(self, k: int | None = None) -> dict[str, int]:
        return dict(sorted((self.vocab_count or {}).items(), key=lambda x: (-x[1], x[0]))[:k])

    def percentages(self, level: str) -> dict[str, float]:
        own = (self.entities or {}).get(level, {})
        n = sum(own.values())
        return {k: v / n for k, v in own.items()} if n else {}

    def report(self, output_format: str | None = None, omit_keys: tuple[str, ...] = ()) -> dict[str, object]:
        t = self.options.text
        own: dict[str, object] = {}
        if self.vocab_count is not None:
            own |= {"vocab": sorted(self.vocab_count), "vocab_count": self.top_chars(t.top_k_chars)}
        if self.words is not None:
            shown = self.top_words(t.top_k_words)
            own |= {"words": list(shown), "word_count": shown}
        stats: dict[str, object] = {"text": {"statistics": own}}
        if self.entities is not None:
            stats["data_label"] = {"entity_counts": self.entities, "entity_percentages": {k: self.percentages(k) for k in LEVELS}}
        return formatted({"global_stats": {"samples_used": self.n_lines - self.empty_lines, "empty_line_count": self.empty_lines, "memory_size": self.memory_mb}, "data_stats": stats}, output_format, omit_keys)

    def word_diff(self, o: TextProfile) -> DataFrame:
        """(word, n1, n2, diff), by a full join; case doesn't count if it doesn't in one of them."""
        case = self.case_sensitive and o.case_sensitive
        one, two = (TextProfile(words=p.words, case_sensitive=case, stop_words=p.stop_words).word_frame for p in (self, o))
        return compare.count_diff(one, two, "word")

    def diff(self, o: TextProfile) -> dict[str, object]:
        """What the reports have and don't have in common; words as far as reports show them."""
        top = {"samples_used": compare.numbers(self.n_lines - self.empty_lines, o.n_lines - o.empty_lines), "empty_line_count": compare.numbers(self.empty_lines, o.empty_lines), "memory_size": compare.numbers(self.memory_mb, o.memory_mb)}
        own: dict[str, object] = {}
        if self.vocab_count is not None and o.vocab_count is not None:
            own |= {"vocab": compare.lists(sorted(self.vocab_count), sorted(o.vocab_count)), "vocab_count": compare.dicts_by_keys(self.vocab_count, o.vocab_count)}
        if self.words is not None and o.words is not None:
            a, b = self.top_words(self.options.text.top_k_words), o.top_words(o.options.text.top_k_words)
            own |= {"words": compare.lists(list(a), list(b)), "word_count": compare.dicts_by_keys(a, b)}
        stats: dict[str, object] = {"text": {"statistics": own}}
        if self.entities is not None and o.entities is not None:
            stats["data_label"] = {"entity_counts": compare.dicts(self.entities, o.entities), "entity_percentages": compare.dicts({k: self.percentages(k) for k in LEVELS}, {k: o.percentages(k) for k in LEVELS})}
        return {"global_stats": top, "data_stats": stats}

    def save(self, spark: SparkSession, folder: str) -> None:
        """The figures as JSON, the words as a table beside them."""
        if self.words is not None:
            self.words.write.mode("overwrite").parquet(f"{folder}/words")
        own = {k: v for k, v in vars(self).items() if k not in ("words", "options")}
        put(spark, f"{folder}/profile.json", json.dumps(own | {"has_words": self.words is not None, "options": self.options.to_dict()}))

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TextProfile:
        d = json.loads(get(spark, f"{folder}/profile.json"))
        words = spark.read.parquet(f"{folder}/words") if d.pop("has_words") else None
        return cls(**(d | {"words": words, "stop_words": tuple(d["stop_words"]), "options": Unstructured.of(d["options"])}))

    def update(self, df: DataFrame, column: str | None = None) -> TextProfile:
        return self + of(df, column, self.options)


def of(df: DataFrame, column: str | None = None, options: Options | Unstructured | None = None) -> TextProfile:
    """The profile of the one text column of a frame, or of `column`; blank lines are counted and left out."""
    o = options.unstructured if isinstance(options, Options) else options or Unstructured()
    o.check()
    if column is None and len(df.columns) != 1:
        raise ValueError("a text profile is of one column")
    column = column or df.columns[0]
    t = o.text
    s = text.summary(df, column).first()
    out = TextProfile(s["n_lines"], s["empty_lines"], s["memory_mb"], case_sensitive=t.case_sensitive, stop_words=text.STOP_WORDS if t.stop_words is None else tuple(w.lower() for w in t.stop_words), options=o)
    if t.enabled and t.vocabulary:
        out.vocab_count = {r["char"]: r["n"] for r in text.char_counts(df, column).collect()}  # at most as many as there are characters
    if t.enabled and t.words:
        out.words = text.word_counts(df, column, t.case_sensitive, out.stop_words)
    if o.labeler.enabled:
        labeler = Labeler.from_disk(o.labeler.folder) if o.labeler.folder else Labeler.from_library(o.labeler.name)
        out.entities = {k: {} for k in LEVELS}
        for level, label, n in entity_levels(text.filled(df, column), "text", labeler).collect():
            out.entities[level][label] = n
    return out
