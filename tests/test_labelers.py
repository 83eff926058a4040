"""Labelers and their parts: cutting, spans, patterns, training, figures; whole pipelines kept on disk and run over frames."""

from __future__ import annotations

import numpy as np
import pytest

from plumbline.labelers import labeler, metrics, models
from plumbline.labelers import processors as P


def test_processors() -> None:
    assert P.nearest_break("ab cd", 4) == 2 and P.nearest_break("abcd", 3) == 0
    p = P.CharPreprocessor(max_length=6)
    for text in ("ab cd ef gh ij", "abcdefghijklmnop", "", "ab", "abcdef ghi"):
        parts = p.process([text])[0]
        assert "".join(parts) == text and all(len(x) <= 6 for x in parts)
    assert [len(b) for b in p.batches(["ab cd ef gh ij"] * 3, 4)] == [4, 4, 1]
    assert p.labelled("ab cd", [(3, 5, "X")], {"PAD": 0, "UNKNOWN": 1, "X": 2}) == [1, 1, 1, 2, 2]
    assert P.CharEncodedPreprocessor().encoded("aÿ日").tolist() == [97, 150, 150]
    text, spans = P.StructCharPreprocessor(flatten_separator="|").unstructured(["ab", "c"], ["UNKNOWN", "X"])
    assert text == "ab|c" and spans == [(3, 4, "X")]
    assert P.ner_spans([1, 2, 2, 3, 1], {2: "X", 3: "Y"}, {0, 1}) == [(1, 3, "X"), (3, 4, "Y")]
    assert P.word_level("abcd efgh ij", [2, 2, 2, 1, 1, 2, 1, 1, 1, 1, 2, 2], 1) == [2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 2, 2]
    assert P.aligned(["abc", "de"], [["ab", "c"], ["de"]], [[1, 2, 0], [3], [4, 5]]) == [[1, 2, 3], [4, 5]]
    labels = {"PAD": 0, "UNKNOWN": 1, "X": 2}
    assert P.StructCharPostprocessor().process(["abc", "ab", ""], [[2, 2, 1], [1, 2], []], labels) == ["X", "X", None]
    assert P.CharPostprocessor(use_word_level_argmax=True).process(["abcd"], [[2, 2, 2, 1]], labels) == [[(0, 4, "X")]]
    for bad in ({"max_length": 0}, {"flatten_split": 2}, {"nothing": 1}):
        with pytest.raises(ValueError):
            P.CharPreprocessor(**bad)
    marks = np.array([[0, 1, 1], [1, 0, 0]])
    assert P.RegexPostprocessor.split(marks).tolist() == [[0, 0.5, 0.5], [1, 0, 0]]
    assert P.RegexPostprocessor(priority_order=["c", "b", "a"]).process([marks], {"a": 0, "b": 1, "c": 2})[0].tolist() == [2, 0]
    assert P.RegexPostprocessor(aggregation="random").process([marks], {"a": 0, "b": 1, "c": 2})[0].tolist()[1] == 0
    assert P.StructRegexPostprocessor().process([marks, np.zeros((0, 3))], {"a": 0, "b": 1, "c": 2}) == [("a", 0.5), (None, 0.0)]
    assert P.Processor.of(P.CharPostprocessor(word_level_min_percent=0.5).state()).parameters["word_level_min_percent"] == 0.5


def test_models() -> None:
    assert models.label_numbers(["A", "PAD", "B"], True) == {"PAD": 0, "A": 1, "B": 2}
    with pytest.raises(ValueError):
        models.label_numbers({"A": 0}, True)
    m = models.RegexModel(None, {"patterns": {"N": [r"\d+"], "H": ["[0-9a-f]{3,}"]}})
    got = m.predict(["x 123 abc", None])
    assert got[0][2].tolist() == [0, 1, 1] and got[0][0].tolist() == [1, 0, 0] and got[0][6].tolist() == [0, 0, 1] and len(got[1]) == 0
    m.add_label("M", same_as="N")
    assert m.labels["M"] == m.labels["N"]
    m.add_label("Z")
    assert m.labels["Z"] == 3 and models.Model.of(m.state()).predict(["12"])[0].shape == (2, 4)
    with pytest.raises(ValueError):
        models.RegexModel(None, {"patterns": {"N": "x"}})

    class Upper(models.Model):
        def predict(self, data):
            return [[int(c.isupper()) for c in x] for x in data]

    assert models.Model.get_class("upper") is Upper and Upper(["UNKNOWN", "UP"]).predict(["aB"]) == [[0, 1]]


def test_training(tmp_path) -> None:
    rng = np.random.default_rng(1)
    texts, spans = [], []
    for _ in range(120):
        number = "".join(map(str, rng.integers(0, 10, 6)))
        words = "".join(chr(c) for c in rng.integers(97, 123, 8))
        texts.append(f"{words} {number} {words[:4]}")
        spans.append([(9, 15, "NUM")])
    own = labeler.Labeler.from_library("unstructured")
    figures = own.fit(texts, spans, [P.PAD, P.UNKNOWN, "NUM"], epochs=3)
    assert figures[-1]["validation"] > 0.95 and figures[-1]["loss"] < figures[0]["loss"]
    assert own.predict(["hello 482910 you"]) == [[(6, 12, "NUM")]]
    own.save(str(tmp_path))
    back = labeler.Labeler.from_disk(str(tmp_path))
    assert back.predict(texts[:5]) == own.predict(texts[:5]) and back.labels == ["UNKNOWN", "NUM"]
    own.set_params(model={"threshold": 0.999999})
    assert sum(len(x) for x in own.predict(texts)) <= len(texts)
    cells = labeler.train_cells(["123", "abc", "456", "def"] * 20, ["N", "UNKNOWN"] * 40, epochs=3, folder=f"{tmp_path}/c")
    assert cells.predict(["624", "fad", None]) == ["N", "UNKNOWN", None]
    with pytest.raises(ValueError):
        labeler.Labeler.from_components(P.DirectPass(), models.RegexModel(), P.RegexPostprocessor(), trainable=True)
    with pytest.raises(ValueError):
        labeler.Labeler.from_library("regex").fit([], [])
    with pytest.raises(ValueError):
        labeler.Labeler.from_components(P.CharPreprocessor(default_label="A"), models.CharModel(), P.CharPostprocessor())
    with pytest.raises(ValueError):
        labeler.Labeler.from_library("none")


def test_frames(spark) -> None:
    df = spark.createDataFrame([(1, "mail a@b.org at 12:30"), (2, None), (3, "nothing")], "id int, t string")
    got = labeler.Labeler.from_library("regex").entities(df, "id", "t").collect()
    assert sorted((r["id"], r["start"], r["stop"], r["label"], r["entity"]) for r in got) == [(1, 5, 12, "EMAIL_ADDRESS", "a@b.org"), (1, 16, 21, "TIME", "12:30")]
    cells = labeler.Labeler.from_library("structured_regex").cells(df, ["t"]).collect()
    assert {r["value"]: r["label"] for r in cells} == {"mail a@b.org at 12:30": "UNKNOWN", "nothing": "UNKNOWN"}
    with pytest.raises(ValueError):
        labeler.Labeler.from_library("regex").cells(df, ["t"])


def test_metrics(spark) -> None:
    truth, guess = [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 0, 2]
    df = spark.createDataFrame(list(zip(map(str, truth), map(str, guess), strict=True)), "t string, p string")
    m = metrics.matrix(metrics.confusion(df, "t", "p"), ["0", "1", "2"])
    assert m.tolist() == [[1, 1, 0], [0, 2, 0], [1, 0, 2]]
    assert metrics.one_against_rest(m)[0].tolist() == [[4, 1], [1, 1]]
    p, r, f, s = metrics.precision_recall(metrics.one_against_rest(m))
    assert p == pytest.approx([1 / 2, 2 / 3, 1]) and r == pytest.approx([1 / 2, 1, 2 / 3]) and s.tolist() == [2, 2, 3]
    assert metrics.f1(truth, guess, 3) == pytest.approx(5 / 7) and metrics.f_beta(truth, guess, 3, 2.0, "macro") == pytest.approx(np.mean([0.5, 5 * (2 / 3) / (4 * 2 / 3 + 1), 5 * (2 / 3) / (4 + 2 / 3)]))
    text = metrics.report_text(metrics.report(m, ["a", "b", "c"]))
    assert "weighted avg" in text and text.count("\n") == 6
    score, kept = metrics.accuracy(metrics.confusion(df, "t", "p"), ["0", "1", "2"], omitted=("0",))
    assert score == pytest.approx((0.8 + 0.8) / 2) and set(kept) == {"1", "2"}
    with pytest.raises(ValueError):
        metrics.precision_recall(metrics.one_against_rest(m), -1)
