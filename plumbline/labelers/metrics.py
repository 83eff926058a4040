"""How well labels agree with the truth: confusion counts by Spark, figures from them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n); partial sums before the shuffle."""
    return df.groupBy(F.col(f"`{truth}`").alias("truth"), F.col(f"`{predicted}`").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def matrix(counts: DataFrame, labels: list) -> np.ndarray:
    """Rows are true labels, columns predicted ones; labels outside the list are left out."""
    at = {x: i for i, x in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)), np.int64)
    for t, p, n in counts.select("truth", "predicted", "n").filter(F.col("truth").isin(*labels) & F.col("predicted").isin(*labels)).collect():
        out[at[t], at[p]] += n
    return out


def one_against_rest(m: np.ndarray) -> np.ndarray:
    """For each label [[true negatives, false positives], [false negatives, true positives]]."""
    right = np.diag(m)
    wrong_in, wrong_out = m.sum(0) - right, m.sum(1) - right
    return np.stack([m.sum() - right - wrong_in - wrong_out, wrong_in, wrong_out, right], 1).reshape(-1, 2, 2)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) > 0)


def precision_recall(each: np.ndarray, beta: float = 1.0, average: str | None = None) -> tuple:
    """Precision, recall, F-beta and support, of each label or averaged: micro, macro or weighted (no support then)."""
    if beta < 0 or average not in (None, "micro", "macro", "weighted"):
        raise ValueError("beta is at least 0; averages are micro, macro and weighted")
    if average == "micro":
        each = each.sum(0, keepdims=True)
    hit, made, there = each[:, 1, 1], each[:, :, 1].sum(1), each[:, 1].sum(1)
    p, r = _share(hit, made), _share(hit, there)
    f = _share((1 + beta**2) * p * r, beta**2 * p + r)
    if average is None:
        return p, r, f, there
    if average == "micro":
        return p[0], r[0], f[0], None
    weight = there if average == "weighted" else np.ones(len(there))
    return (*[float(_share((x * weight).sum(), weight.sum())) for x in (p, r, f)], None)


def f_beta(truth: np.ndarray, predicted: np.ndarray, n_labels: int, beta: float = 1.0, average: str | None = None) -> np.ndarray | float:
    """The score of label numbers against true ones."""
    m = np.zeros((n_labels, n_labels), np.int64)
    np.add.at(m, (np.asarray(truth), np.asarray(predicted)), 1)
    return precision_recall(one_against_rest(m), beta, average)[2]


def f1(truth: np.ndarray, predicted: np.ndarray, n_labels: int, average: str | None = "micro") -> np.ndarray | float:
    return f_beta(truth, predicted, n_labels, 1.0, average)


def report(m: np.ndarray, labels: list[str]) -> dict[str, dict[str, float]]:
    """Figures of each label, and the three averages."""
    each = one_against_rest(m)
    p, r, f, s = precision_recall(each)
    out = {x: {"precision": float(p[i]), "recall": float(r[i]), "f1-score": float(f[i]), "support": int(s[i])} for i, x in enumerate(labels)}
    for name in ("micro", "macro", "weighted"):
        a = precision_recall(each, average=name)
        out[f"{name} avg"] = {"precision": float(a[0]), "recall": float(a[1]), "f1-score": float(a[2]), "support": int(m.sum())}
    return out


def report_text(figures: dict[str, dict[str, float]], digits: int = 2) -> str:
    """The report as a table of text."""
    wide = max(map(len, figures), default=0)
    lines = [" " * wide + "".join(f"{k:>12}" for k in ("precision", "recall", "f1-score", "support"))]
    lines += [f"{k:>{wide}}" + "".join(f"{v[c]:>12.{digits}f}" for c in ("precision", "recall", "f1-score")) + f"{v['support']:>12}" for k, v in figures.items()]
    return "\n".join(lines)


def accuracy(counts: DataFrame, labels: list[str], omitted: tuple[str, ...] = ("PAD", "UNKNOWN")) -> tuple[float, dict[str, dict[str, float]]]:
    """The macro F1 of all labels but the omitted ones, and the report."""
    named = [x for x in labels if x not in omitted]
    full = report(matrix(counts, labels), labels)
    kept = {x: full[x] for x in named}
    return float(np.mean([v["f1-score"] for v in kept.values()])) if kept else 0.0, kept
