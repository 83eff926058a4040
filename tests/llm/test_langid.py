"""The forward algorithm against the sum over all segmentations; held-out accuracy; odd rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import langid

PIECES = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb"]


def segmentations(word: str, table: dict[str, float]) -> float:
    """The sum of products over every way to cut the word into pieces, or characters that are no piece."""
    if not word:
        return 1.0
    total = sum(p * segmentations(word[len(s) :], table) for s, p in table.items() if word.startswith(s))
    if word[0] not in table:
        total += math.exp(langid.BYTE * len(word[0].encode())) * segmentations(word[1:], table)
    return total


@pytest.fixture(scope="module")
def model() -> langid.Model:
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES), 2))
    return langid.Model(PIECES, ("x", "y"), p / p.sum(0))


@pytest.mark.parametrize("word", ["▁a", "▁abab", "▁bbabba", "▁c", "▁aéb", "▁" + "ab" * 6, "▁日b"])
def test_forward_sums_segmentations(model, word: str) -> None:
    logs = model.word_logs([word])[0]
    for k in range(2):
        want = segmentations(word, dict(zip(PIECES, model.probabilities[:, k], strict=True)))
        assert logs[k] == pytest.approx(math.log(want))


def test_long_words(model) -> None:
    """Words of any length and script have finite scores, as chains of their parts would have."""
    far = model.word_logs(["▁" + "ab" * 5000, "▁" + "日" * 300])[:, :2]
    assert np.isfinite(far).all() and (far < -500).all()
    assert far[1] == pytest.approx(np.log(model.probabilities[0]) + 300 * 3 * langid.BYTE)


def test_text_is_the_sum_of_words(model) -> None:
    logs, size = model.score(["ab ba", "AB\nba", None, "", " ", "a1"])
    one = model.word_logs(["▁ab"])[0][:2] + model.word_logs(["▁ba"])[0][:2]
    assert logs[0] == pytest.approx(one) and logs[1] == pytest.approx(one)
    assert size.tolist() == [4, 4, 0, 0, 0, 2]


def test_fit_moves_towards_the_sample() -> None:
    m = langid.fit(PIECES, {"x": ["ab ab ab"], "y": ["ba bb"]})
    logs, _ = m.score(["ab ab", "ba bb"])
    assert logs[0].argmax() == 0 and logs[1].argmax() == 1
    assert m.probabilities.sum(0) == pytest.approx([1, 1])


def test_held_out_accuracy(documents) -> None:
    """Rows outside the fitted sample whose text is long enough to tell."""
    fitted = set().union(*langid.sample(documents, rows=20).values())
    got = langid.identify(documents, rows=20).join(documents, "doc_id").filter("n_chars > 100").collect()
    out = [r for r in got if r["text"] not in fitted and not r["reject"]]
    right = sum(r["language"] == r["lang"] for r in out)
    assert len(out) > 50 and right >= 0.9 * len(out)


def brute_logs(word: str, index: dict[str, int], logs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """alpha and beta of a word in plain probabilities, place by place, by every piece that fits."""
    n = len(word)
    edges = [(i, j, index[word[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if word[i:j] in index]
    edges += [(i, i + 1, -len(word[i].encode())) for i in range(n) if word[i] not in index]
    alpha, beta = np.full((n + 1, logs.shape[1]), -np.inf), np.full((n + 1, logs.shape[1]), -np.inf)
    alpha[0], beta[n] = 0, 0
    own = lambda p: logs[p] if p >= 0 else np.full(logs.shape[1], -p * langid.BYTE)
    for i, j, p in sorted(edges, key=lambda e: e[1]):
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + own(p))
    for i, j, p in sorted(edges, key=lambda e: -e[0]):
        beta[i] = np.logaddexp(beta[i], beta[j] + own(p))
    return edges, alpha, beta


def test_query_brute(documents) -> None:
    """The whole query: the fit by EM over the sample, then every text's figures, word by word."""
    rows = 12
    vocabulary = langid.pieces(langid.VOCABULARY)
    index, longest = {p: i for i, p in enumerate(vocabulary)}, max(map(len, vocabulary))
    samples = langid.sample(documents, rows=rows)
    assert all(0 < len(v) <= rows for v in samples.values())
    cut = lambda t: ["▁" + w for w in (t or "").lower().split()]
    languages = list(samples)
    p = np.full((len(vocabulary), 4), 1 / len(vocabulary))
    counts = [Counter(w for t in v for w in cut(t)) for v in samples.values()]
    for _ in range(langid.ROUNDS):
        expected, logs = np.zeros_like(p), np.log(p)
        for w in set().union(*counts):
            n = np.array([c[w] for c in counts])
            edges, alpha, beta = brute_logs(w, index, logs, longest)
            for i, j, k in edges:
                if k >= 0:
                    expected[k] += n * np.exp(alpha[i] + logs[k] + beta[j] - alpha[-1])
        p = (expected + 0.05) / (expected + 0.05).sum(0)
    logs, known = np.log(p), {}

    def total(text: str) -> tuple[np.ndarray, int]:
        words = cut(text)
        for w in words:
            if w not in known:
                known[w] = brute_logs(w, index, logs, longest)[1][-1]
        return sum((known[w] for w in words), np.zeros(4)), sum(len(w.encode()) - 3 for w in words)

    typical = []
    for k, v in enumerate(samples.values()):
        both = [total(t) for t in v]
        typical.append(sum(x[k] for x, _ in both) / sum(n for _, n in both) + math.log(256))
    got = {r["doc_id"]: r for r in langid.identify(documents, rows=rows).collect()}
    for r in documents.collect():
        x, n = total(r["text"])
        g, best = got[r["doc_id"]], int(x.argmax())
        if not n:
            assert g["language"] is None and g["reject"]
            continue
        evidence = x[best] + n * math.log(256)
        assert g["language"] == languages[best] and g["evidence"] == pytest.approx(evidence) and g["margin"] == pytest.approx(x[best] - sorted(x)[-2], abs=1e-5)
        assert g["own_gap"] == pytest.approx(x[best] - x[languages.index(r["lang"])], abs=1e-5)
        assert g["reject"] == (evidence < -langid.MARGIN or n >= langid.SURE and evidence < langid.TYPICAL * typical[best] * n)


def test_sample_goes_by_id_and_text(documents, spark) -> None:
    """One id, or none, for all rows doesn't empty the sample; equal rows count once; no more than asked for comes."""
    texts = [r["text"] for r in documents.filter("lang = 'en'").collect()]
    for i in (None, 7):
        df = spark.createDataFrame([(i, t, "en") for t in texts] + [(i, texts[0], "en")] * 500, "doc_id bigint, text string, lang string")
        got = langid.sample(df, rows=30)
        assert 25 <= len(got["en"]) <= 30 and len(set(got["en"])) == len(got["en"])


def test_decisions_take_effect(documents, spark) -> None:
    """A text declared in another language is relabelled, noise goes, prose stays."""
    german = [r for r in documents.filter("lang = 'de' and n_chars > 400").collect()][:5]
    noise = "".join(chr(0x16A0 + k * 7 % 60) + ("" if k % 5 else " ") for k in range(600))
    extra = spark.createDataFrame([(10_000 + k, r["text"], "en", "src1", 1) for k, r in enumerate(german)] + [(20_000, noise, "en", "src1", 1), (20_001, german[0]["text"], None, "src1", 1)], documents.schema)
    kept = {r["doc_id"]: r["lang"] for r in langid.identify(documents.unionByName(extra), keep_all=True).collect()}
    assert all(kept[10_000 + k] == "de" for k in range(len(german))) and kept[20_001] == "de" and 20_000 not in kept
    assert len(kept) >= 0.98 * documents.count()


def test_odd_rows(odd, empty) -> None:
    got = langid.identify(odd)
    assert got.count() == odd.count() and got.columns == ["doc_id", "language", "evidence", "margin", "own_gap", "reject"]
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert all(by[i]["reject"] and by[i]["language"] is None for i in (3, 4, 5))
    assert by[9]["language"] is not None
    kept = langid.identify(odd, keep_all=True)
    assert kept.columns == odd.columns
    assert {1, 2, 6} <= {r["doc_id"] for r in kept.collect()}
    assert langid.identify(empty).collect() == []


def test_no_known_language(odd) -> None:
    got = langid.identify(odd.filter("lang is null")).collect()
    assert {r["language"] for r in got} <= {"de", None}
