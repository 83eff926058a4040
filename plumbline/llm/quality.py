"""Quality rules by the divergence of distributions.

A document's histograms, of character classes and of its language's common words (all other words in one bin), are
compared with those of its language by the Jensen-Shannon distance (the root of the divergence in bits, so 0 to 1).
The references come from all documents. Short texts have ragged histograms: each rule has a length below which it says
nothing, and a document that no rule speaks of stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounds, categories, codepoints, fresh_name, minor_categories, runs, settled, slices

#: Parts of a language's words that are ranked side by side.
PARTS = 256
CLASSES = ("lower", "upper", "letter", "number", "space", "punctuation", "symbol", "rest")


@dataclass(frozen=True)
class Rules:
    common: int = 100
    max_chars: float = 0.27
    min_chars: int = 200
    max_words: float = 0.5
    min_words: int = 60


_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of each code point."""
    if not _table:
        major, minor = categories(), minor_categories()
        out = np.full(len(major), 7, np.uint8)
        out[major == ord("L")] = 2
        out[(major == ord("L")) & (minor == ord("l"))] = 0
        out[(major == ord("L")) & (minor == ord("u"))] = 1
        for k, c in ((3, "N"), (5, "P"), (6, "S")):
            out[major == ord(c)] = k
        out[major == ord("Z")] = 4
        out[[9, 10, 11, 12, 13, 32]] = 4
        out[major == ord(" ")] = 4
        _table.append(out)
    return _table[0]


def char_counts(texts: list[str | None]) -> np.ndarray:
    """A row of class counts for each text."""
    out = np.zeros((len(texts), len(CLASSES)), np.int64)
    for lo, hi in runs(texts):
        part = [t or "" for t in texts[lo:hi]]
        ends = bounds(part)
        kind = class_table()[codepoints("".join(part))]
        key = np.repeat(np.arange(hi - lo) * len(CLASSES), np.diff(ends)) + kind
        out[lo:hi] = np.bincount(key, minlength=(hi - lo) * len(CLASSES)).reshape(hi - lo, -1)
    return out


def split(text: str | None) -> list[str]:
    """Lower-case runs of other characters than blanks, tabs and line ends."""
    return [w for w in (text or "").lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of rows of counts; 0 where either has none."""
    p, q = p.astype(float), q.astype(float)
    sums = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.maximum(sums[0], 1), q / np.maximum(sums[1], 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where((sums[0] * sums[1])[:, 0] > 0, np.sqrt(np.maximum(d / 2, 0)), 0.0)


def reference(df: DataFrame, common: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chars, words, counts, total): class counts, common words with their counts, and the count of all words.

    One row for each language, a null one as "", over all rows.
    """
    own = df.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                counts = char_counts(batch.column(1).to_pylist())
                names, at = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
                sums = np.zeros((len(names), counts.shape[1]), np.int64)
                np.add.at(sums, at, counts)
                for lang, n in zip(names, sums, strict=True):
                    total[lang] = total.get(lang, 0) + n
        for lang, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["lang", "k", "n"])

    chars = own.mapInArrow(classes, "lang string, k int, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    chars = chars.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias("chars"))
    words = own.select("lang", F.explode(F.split(F.lower("text"), r"[ \t\r\n]+")).alias("w")).filter("w != ''").groupBy("lang", "w").count()
    # the commonest of each part of a language's words, and of those the commonest: no task has all words of a language
    part, whole = Window.partitionBy("lang", "part"), Window.partitionBy("lang")
    words = words.select("lang", "w", F.col("count").alias("n"), F.pmod(F.xxhash64("w"), F.lit(PARTS)).alias("part"))
    words = words.select("lang", "w", "n", F.sum("n").over(part).alias("in_part"), F.row_number().over(part.orderBy(F.desc("n"), "w")).alias("place")).filter(F.col("place") <= common)
    total = F.sum(F.when(F.col("place") == 1, F.col("in_part"))).over(whole)
    words = words.select("lang", "w", "n", total.alias("total"), F.row_number().over(whole.orderBy(F.desc("n"), "w")).alias("r")).filter(F.col("r") <= common)
    listed = F.array_sort(F.collect_list(F.struct("r", "w", "n")))
    words = words.groupBy("lang").agg(listed.alias("l"), F.first("total").alias("total"))
    words = words.select("lang", F.transform("l", lambda x: x["w"]).alias("words"), F.transform("l", lambda x: x["n"]).alias("counts"), "total")
    return chars.join(words, "lang", "left")


RESULT = "n_chars bigint, n_words bigint, char_distance double, word_distance double"
#: References of up to so many languages are broadcast (each has `common` words); those of more are joined to the rows.
MOST = 1000


def _bins(ref: dict | None, common: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Of a language: the bin of each common word, and the counts of its classes and words."""
    if ref is None:
        return {}, np.zeros(len(CLASSES)), np.zeros(common + 1)
    words, counts = ref["words"] or [], ref["counts"] or []
    return {w: i for i, w in enumerate(words)}, np.array(ref["chars"]), np.array([*counts, *[0] * (common - len(counts)), (ref["total"] or 0) - sum(counts)])


def measure(lists: list[str | None], own: list[tuple[dict[str, int], np.ndarray, np.ndarray]], common: int) -> pa.Array:
    """Lengths and both distances of texts from their languages' bins; all null for a null text."""
    chars = char_counts(lists)
    words = np.zeros((len(lists), common + 1), np.int64)
    for i, (text, ref) in enumerate(zip(lists, own, strict=True)):
        if text:
            get = ref[0].get
            words[i] = np.bincount([get(w, common) for w in split(text)] or [0], minlength=common + 1) * bool(text.strip(" \t\r\n"))
    qc = np.array([r[1] for r in own]).reshape(-1, len(CLASSES))
    qw = np.array([r[2] for r in own]).reshape(-1, common + 1)
    null = np.array([t is None for t in lists], bool)
    figures = {"n_chars": chars.sum(1), "n_words": words.sum(1), "char_distance": distance(chars, qc), "word_distance": distance(words, qw)}
    return pa.StructArray.from_arrays([pa.array(x, mask=null) for x in figures.values()], [*figures])


def measured(df: DataFrame, refs: DataFrame, common: int, text_col: str, lang_col: str, name: str, most: int = MOST) -> DataFrame:
    """df with the struct `name` of lengths and distances.

    The languages are data, so there may be any number: up to `most` references are broadcast, more are joined.
    """
    refs = settled(refs, "quality-references")
    lang = F.coalesce(F.col(f"`{lang_col}`"), F.lit(""))
    if refs.limit(most + 1).count() <= most:
        shared = df.sparkSession.sparkContext.broadcast({r["lang"]: _bins(r.asDict(), common) for r in refs.collect()})

        @F.arrow_udf(RESULT)
        def known(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            refs, none = shared.value, _bins(None, common)
            for texts, langs in parts:
                cut = slices(pa.StructArray.from_arrays([texts, langs], ["t", "l"]), texts)
                out = [measure((f := part.flatten())[0].to_pylist(), [refs.get(x, none) for x in f[1].to_pylist()], common) for part in cut]
                yield pa.concat_arrays(out) if out else measure([], [], common)

        return df.withColumn(name, known(F.col(f"`{text_col}`"), lang))

    @F.arrow_udf(RESULT)
    def joined(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, refs in parts:
            cut = slices(pa.StructArray.from_arrays([texts, refs], ["t", "r"]), texts)
            out = []
            for part in cut:
                lists, rows = (x.to_pylist() for x in part.flatten())
                have = {lang: _bins(r, common) for lang, r in {r and r["lang"]: r for r in rows}.items()}
                out.append(measure(lists, [have[r and r["lang"]] for r in rows], common))
            yield pa.concat_arrays(out) if out else measure([], [], common)

    ref, key = fresh_name(df, name + "_ref"), fresh_name(df, name + "_lang")
    beside = refs.select(F.col("lang").alias(key), F.struct(*refs.columns).alias(ref))
    return df.join(beside, lang == F.col(key), "left").withColumn(name, joined(F.col(f"`{text_col}`"), F.col(ref)))


def rejected(m: Column, rules: Rules) -> Column:
    """Whether a measured row goes: a rule that speaks of texts so long finds it too far away."""
    chars = (m["n_chars"] >= rules.min_chars) & (m["char_distance"] > rules.max_chars)
    words = (m["n_words"] >= rules.min_words) & (m["word_distance"] > rules.max_words)
    return F.coalesce(chars | words, F.lit(False))


def judge(df: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_all: bool = False) -> DataFrame:
    """(id_col, n_chars, n_words, char_distance, word_distance, reject); with keep_all, df's columns of rows that stay.

    Null texts have null figures and, like empty ones, are not rejected (lengths guard the rules). A null language is a
    language of its own; null ids are kept. Very long texts are measured whole. Common words tie by their order. Rows
    correspond one to one, repeated ones included. An empty table gives an empty result. Other columns may have any name.
    Distances are rounded to 6 digits.
    """
    rules = rules or Rules()
    mark = fresh_name(df, "quality")
    out = measured(df, reference(df, rules.common, text_col, lang_col), rules.common, text_col, lang_col, mark)
    if keep_all:
        return out.filter(~rejected(F.col(mark), rules)).select(*[F.col(f"`{c}`") for c in df.columns])
    fields = [F.col(mark)[c].alias(c) for c in ("n_chars", "n_words")] + [F.round(F.col(mark)[c], 6).alias(c) for c in ("char_distance", "word_distance")]
    return out.select(F.col(f"`{id_col}`"), *fields, rejected(F.col(mark), rules).alias("reject"))


def judge_sql(rules: Rules | None = None) -> str:
    r = rules or Rules()
    patterns = {0: r"[^\p{Ll}]", 1: r"[^\p{Lu}]", 2: r"[^\p{Lt}\p{Lm}\p{Lo}]", 3: r"[^\p{N}]", 4: r"[^\s\p{Z}\x0b\x{85}]", 5: r"[^\p{P}]", 6: r"[^\p{S}]"}
    counts = ", ".join(f"length(regexp_replace(text, '{p}', '', 'g')) AS c{k}" for k, p in patterns.items())
    six = " + ".join(f"c{k}" for k in patterns)
    lists = "[" + ", ".join(f"c{k}" for k in range(8)) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, text, length(text) AS n_chars FROM documents),
c AS (SELECT *, n_chars - ({six}) AS c7 FROM (SELECT doc_id, lang, n_chars, {counts} FROM d)),
cl AS (SELECT doc_id, lang, n_chars, unnest({lists}) AS n, generate_subscripts({lists}, 1) AS k FROM c),
cr AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cl GROUP BY lang, k),
cd AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN n > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d
  FROM (SELECT doc_id, lang, k, n, n / n_chars AS p FROM cl WHERE n_chars > 0) JOIN cr USING (lang, k) GROUP BY doc_id),
w AS (SELECT doc_id, lang, w FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS w FROM d) WHERE w <> ''),
wr AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL),
top AS (SELECT lang, w, n FROM wr QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {r.common}),
tot AS (SELECT lang, sum(n) AS n FROM wr GROUP BY lang),
ref AS (SELECT lang, w, top.n / tot.n AS q FROM top JOIN tot USING (lang)
  UNION ALL SELECT lang, NULL, 1 - coalesce(sum(top.n), 0) / any_value(tot.n) FROM tot LEFT JOIN top USING (lang) GROUP BY lang),
own AS (SELECT doc_id, lang, top.w AS w, count(*) AS n FROM w LEFT JOIN top USING (lang, w) GROUP BY ALL),
len AS (SELECT doc_id, sum(n) AS n_words FROM own GROUP BY doc_id),
pq AS (SELECT doc_id, own.n / n_words AS p, q FROM own JOIN len USING (doc_id) JOIN ref ON own.lang = ref.lang AND own.w IS NOT DISTINCT FROM ref.w),
wd AS (SELECT doc_id, sqrt(greatest(0, (sum(p * log2(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) + (1 - sum(q))) / 2)) AS d FROM pq GROUP BY doc_id),
m AS (SELECT doc_id, n_chars, CASE WHEN text IS NOT NULL THEN coalesce(n_words, 0) END::BIGINT AS n_words,
  CASE WHEN text IS NOT NULL THEN coalesce(cd.d, 0) END AS char_distance, CASE WHEN text IS NOT NULL THEN coalesce(wd.d, 0) END AS word_distance
  FROM d LEFT JOIN len USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_chars, n_words, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
  coalesce(n_chars >= {r.min_chars} AND char_distance > {r.max_chars!r} OR n_words >= {r.min_words} AND word_distance > {r.max_words!r}, false) AS reject FROM m"""
