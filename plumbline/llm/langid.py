"""Language identification with segmentation-marginalised unigrams.

A word is a string of pieces of a fixed public vocabulary, in any of its segmentations; its probability under a
language's piece probabilities is the sum over all of them, which the forward algorithm takes in one pass over the
word's places, in logarithms, so that words of any length and of any script are scored alike. The probabilities are
fitted by expectation-maximisation (the same sums, forwards and backwards) on a bounded sample of rows that carry a
language. Words are independent, so a worker keeps what it has scored; new words of a batch go through the forward
algorithm side by side.

A text's evidence for a language is its log probability above that of uniform bytes. The sample also tells how much
evidence a byte of ordinary text of each language has; a text that has much less of it in its best language is in none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Spans64, Table64, bounds, codepoints, fresh_name, resident, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LANGUAGES = ("de", "en", "es", "fr")
#: Rows of each language, at most, on which its probabilities are fitted.
SAMPLE = 300
ROUNDS = 3
#: Nats by which uniform bytes have to fit a text better than its best language before it counts as none of them.
MARGIN = 12.0
#: A text of at least SURE bytes is in no language if it has less than TYPICAL of the evidence that as many bytes of the
#: language's sample have.
TYPICAL = 0.6
SURE = 200
#: Nats by which the best language has to beat the declared one before it replaces it.
RELABEL = 12.0
#: Words that a worker remembers, and cells (words times places) that go through the forward algorithm side by side.
CACHE = 200_000
CELLS = 40_000
#: Log probability of a character that is no piece, for each of its bytes.
BYTE = float(np.log(1e-6))


def pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces (no control or byte pieces); it has a fixed size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _sizes(words: list[str]) -> np.ndarray:
    """A column of the words' bytes without the mark that opens them."""
    return np.array([[len(w.encode("utf-8", "surrogatepass")) - 3] for w in words], float)


def parts_of(words: list[str]) -> Iterator[list[str]]:
    """The words by length, in parts of about CELLS places; a longer word is a part of its own."""
    part: list[str] = []
    for w in sorted(words, key=len):
        if part and (len(part) + 1) * (len(w) + 1) > CELLS:
            yield part
            part = []
        part.append(w)
    if part:
        yield part


class Model:
    """Piece probabilities of each language: a row for each piece, and a last one of the smoothing mass."""

    def __init__(self, vocabulary: list[str], languages: tuple[str, ...], probabilities: np.ndarray, typical: np.ndarray | None = None) -> None:
        self.languages, self.probabilities = languages, probabilities
        self.typical = np.zeros(len(languages)) if typical is None else typical
        self.index = {p: i for i, p in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)
        opens = {p[:k]: -1 for p in vocabulary for k in range(1, len(p))} | self.index
        ends = bounds([*opens])
        self.table = Table64(Spans64(codepoints("".join(opens))).of(ends[:-1], ends[1:]), np.fromiter(opens.values(), np.int32, len(opens)))
        self.cache: dict[str, int] = {}
        self.logs = np.zeros((1024, len(languages) + 1))  # the last column: bytes

    def weights(self, piece: np.ndarray) -> np.ndarray:
        """Log probabilities of edges, by language."""
        with np.errstate(divide="ignore"):
            out = np.log(self.probabilities)[np.maximum(piece, 0)]
        odd = piece < 0
        out[odd] = (BYTE * -piece[odd].astype(float))[:, None]
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Every piece in the words: word, start, length, piece; -b for a character of b bytes that is no piece.

        Spans are looked up by their hashes, length by length; a span grows only while it still begins some piece.
        """
        codes = codepoints("".join(words))
        ends = bounds(words)
        size = np.diff(ends)
        word = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(codes))
        room = np.repeat(ends[1:], size) - at
        spans = Spans64(codes)
        found = []
        for k in range(1, self.longest + 1):
            at = at[room[at] >= k]
            piece = self.table.find(spans.of(at, at + k), -2)
            real = piece >= 0
            rows = at[real]
            found.append((word[rows], rows - ends[word[rows]], np.full(len(rows), k), piece[real]))
            if k == 1:
                odd = at[~real]
                c = codes[odd]
                found.append((word[odd], odd - ends[word[odd]], np.ones(len(odd), np.int64), -(1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF))))
            at = at[piece >= -1]
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))

    def _grouped(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges in the order of their places, then lengths, and where a new place or length begins."""
        key = place * (self.longest + 1) + length
        if len(key) and key.max() < 1 << 16:
            key = key.astype(np.uint16)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        return order, np.concatenate([[0], cuts, [len(key)]]) if len(key) else np.zeros(0, np.int64)

    def forward(self, words: list[str], edges: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of alpha[word, place, language], and of the edges' probabilities."""
        word, start, length, piece = edges or self.lattice(words)
        most = max(map(len, words), default=0)
        alpha = np.full((len(words), most + 1, len(self.languages)), -np.inf)
        alpha[:, 0] = 0
        weight = self.weights(piece)
        end = start + length
        order, cuts = self._grouped(end, length)
        for lo, hi in zip(cuts, cuts[1:], strict=False):  # one length of edges into one place: no word occurs twice
            e = order[lo:hi]
            w, j = word[e], end[e[0]]
            alpha[w, j] = np.logaddexp(alpha[w, j], alpha[w, start[e[0]]] + weight[e])
        return alpha, weight

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Log probabilities of the words by language, from the cache or the forward algorithm, and their bytes."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        get = self.cache.get
        at = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            base = len(self.cache)
            while base + len(new) > len(self.logs):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            for part in parts_of(new):
                alpha, _ = self.forward(part)
                logs = alpha[np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part))]
                self.logs[base : base + len(part)] = np.hstack([logs, _sizes(part)])
                self.cache.update(zip(part, range(base, base + len(part)), strict=True))
                base += len(part)
            at[missing] = [get(words[i]) for i in missing.tolist()]
        return self.logs[at]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of whole texts by language, and the bytes of the words that were scored."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        out = np.zeros((len(texts), len(self.languages) + 1))
        lo = 0

        def flush(hi: int) -> None:
            nonlocal words, lo
            if words:
                logs = self.word_logs(words)
                some = np.flatnonzero(counts[lo:hi])
                first = np.cumsum(counts[lo:hi]) - counts[lo:hi]
                out[lo + some] = np.add.reduceat(logs, first[some])
            words, lo = [], hi

        for i, text in enumerate(texts):
            own = ["▁" + w for w in text.lower().split()] if text else []
            words += own
            counts[i] = len(own)
            if len(words) > 100_000:
                flush(i + 1)
        flush(len(texts))
        return out[:, :-1], out[:, -1]


def fit(vocabulary: list[str], samples: dict[str, list[str]], rounds: int = ROUNDS) -> Model:
    """Piece probabilities by EM over the sample's words, and the evidence that a byte of each language's sample has.

    Languages without a sample keep even probabilities.
    """
    languages = tuple(samples)
    model = Model(vocabulary, languages, np.full((len(vocabulary), len(languages)), 1 / max(1, len(vocabulary))))
    counts = [Counter("▁" + w for t in texts for w in (t or "").lower().split()) for texts in samples.values()]
    groups = [(part, model.lattice(part), np.array([[c[w] for c in counts] for w in part], float)) for part in parts_of([*set().union(*counts)])]
    for _ in range(rounds):
        expected = np.zeros_like(model.probabilities)
        for part, edges, n in groups:
            word, start, length, piece = edges
            alpha, weight = model.forward(part, edges)
            size = np.fromiter(map(len, part), np.int64, len(part))
            beta = np.full_like(alpha, -np.inf)
            beta[np.arange(len(part)), size] = 0
            order, cuts = model._grouped(alpha.shape[1] - start, length)
            for a, b in zip(cuts, cuts[1:], strict=False):
                e = order[a:b]
                w, i = word[e], start[e[0]]
                beta[w, i] = np.logaddexp(beta[w, i], beta[w, i + length[e[0]]] + weight[e])
            total = alpha[np.arange(len(part)), size]
            share = np.exp(alpha[word, start] + weight + beta[word, start + length] - total[word]) * n[word]
            real = piece >= 0
            for k in range(len(languages)):
                expected[:, k] += np.bincount(piece[real], share[real, k], len(expected))
        smooth = expected + 0.05
        model.probabilities = smooth / smooth.sum(0)
    for k, texts in enumerate(samples.values()):
        logs, size = model.score([*texts])
        model.typical[k] = logs[:, k].sum() / size.sum() + np.log(256) if size.sum() else 0.0
    model.cache.clear()
    return model


def sample(df: DataFrame, languages: tuple[str, ...] = LANGUAGES, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """At most `rows` texts of each language: those of the least hashes of id and text, whatever the partitions.

    Rows that are equal in both count once. A sketch of the number of hashes gives the bound below which the wanted ones
    lie (with room to spare), so that few texts are moved, and never more than `rows` of a language reach the driver.
    """
    own = df.filter(F.col(lang_col).isin(*languages) & F.col(text_col).isNotNull())
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("langid")), F.lit(1 << 30))
    there = dict(own.groupBy(lang_col).agg(F.approx_count_distinct(place, 0.02)).collect())
    wanted = F.lit(False)
    for k, n in there.items():
        wanted |= (F.col(lang_col) == k) & (place <= int(min(1.0, (1.3 * rows + 50) / max(1, n)) * (1 << 30)))
    few = own.filter(wanted).groupBy(F.col(lang_col).alias("k"), place.alias("p")).agg(F.min(text_col).alias("t"))
    out: dict[str, list[str]] = {k: [] for k in languages}
    turn = F.row_number().over(Window.partitionBy("k").orderBy("p", "t"))
    for lang, text in few.withColumn("r", turn).filter(F.col("r") <= rows).select("k", "t").collect():
        out[lang].append(text)
    return {k: sorted(v) for k, v in out.items()}


RESULT = "language string, evidence double, margin double, own_gap double, typical double, size bigint"


def scorer(model: Model, df: DataFrame) -> object:
    """A vectorised function of text and declared language: (language, evidence, margin, own_gap, typical, size).

    language is the best one, or null where nothing can be scored; evidence its nats above uniform bytes; margin
    the nats by which it beats the second; own_gap those by which it beats the declared one (null if that is unknown);
    typical the evidence that the language's sample has over as many bytes as the text's words have, size.
    """
    shared = df.sparkSession.sparkContext.broadcast((list(model.index), model.languages, model.probabilities, model.typical, id(model)))

    @F.arrow_udf(RESULT)
    def work(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vocabulary, languages, probabilities, typical, key = shared.value
        model = resident(("langid", key, hash(probabilities.tobytes())), lambda: Model(vocabulary, languages, probabilities, typical))
        for texts, declared in parts:
            out = [_scored(model, *part.flatten()) for part in slices(pa.StructArray.from_arrays([texts, declared], ["t", "d"]), texts)]
            yield pa.concat_arrays(out) if out else _scored(model, texts, declared)

    return work.asNondeterministic()  # so that a filter on its result doesn't score texts once more


def _scored(model: Model, texts: pa.Array, declared: pa.Array) -> pa.Array:
    languages = model.languages
    logs, size = model.score(texts.to_pylist())
    top = logs.argmax(1)
    row = np.arange(len(logs))
    best = logs[row, top]
    rest = np.sort(logs, 1)[:, -2] if len(languages) > 1 else best
    own = np.array([languages.index(x) if x in languages else -1 for x in declared.to_pylist()], np.int64)
    none = size == 0
    figures = [(best + size * np.log(256), none), (best - rest, none), (best - logs[row, own], none | (own < 0)), (model.typical[top] * size, none)]
    fields = [pa.array(np.array(languages, object)[top], pa.string(), mask=none), *[pa.array(x, pa.float64(), mask=m) for x, m in figures], pa.array(size.astype(np.int64))]
    return pa.StructArray.from_arrays(fields, ["language", "evidence", "margin", "own_gap", "typical", "size"])


def rejected(found: Column, margin: float = MARGIN, typical: float = TYPICAL, sure: int = SURE) -> Column:
    """Whether a scored row goes: no word to score, uniform bytes fit it better, or it is long and far from ordinary text."""
    return found["language"].isNull() | (found["evidence"] < -margin) | ((found["size"] >= sure) & (found["evidence"] < typical * found["typical"]))


def identify(df: DataFrame, languages: tuple[str, ...] = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str = VOCABULARY, rows: int = SAMPLE, keep_all: bool = False) -> DataFrame:
    """(id_col, language, evidence, margin, own_gap, reject) of each row; with keep_all, df's columns of the rows that stay.

    With keep_all lang_col holds the language found where that beats the declared one by RELABEL nats (or none of the
    known ones is declared), so that what follows works with it.

    Nulls: null texts, and those without a word (empty, only white space), have null figures and are rejected; a null or
    unknown declared language has a null own_gap; null ids are kept. Very long texts and words are scored whole.
    Ties between languages go to the first by name. Repeated rows correspond one to one. An empty table gives an empty
    result; if no row has a known language, all have even probabilities, nothing counts as untypical and ties decide.
    Extra columns may have any name.
    """
    vocabulary = pieces(path)
    if len(vocabulary) > 1 << 20:
        raise ValueError("a vocabulary of over a million pieces isn't broadcast")
    model = fit(vocabulary, sample(df, languages, rows, id_col, text_col, lang_col))
    found = scorer(model, df)(F.col(text_col), F.col(lang_col))
    mark = fresh_name(df, "langid")
    scored = df.withColumn(mark, found)
    reject = rejected(F.col(mark))
    if keep_all:
        sure = (F.col(mark)["own_gap"] > RELABEL) | (F.col(mark)["own_gap"].isNull() & (F.col(mark)["margin"] > RELABEL))
        lang = F.when(sure, F.col(mark)["language"]).otherwise(F.col(f"`{lang_col}`")).alias(lang_col)
        return scored.filter(~reject).select(*[lang if c == lang_col else F.col(f"`{c}`") for c in df.columns])
    fields = [F.col(mark)[c].alias(c) for c in ("language", "evidence", "margin", "own_gap")]
    return scored.select(F.col(id_col), *fields, reject.alias("reject"))
