"""Quality rules and mixing: brute force, budgets, odd rows."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import mixing, quality


def jensen_shannon(p: list[float], q: list[float]) -> float:
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def test_distance() -> None:
    p, q = np.array([[1, 2, 3], [1, 0, 0], [0, 0, 0]]), np.array([[3, 0, 1], [0, 5, 0], [1, 1, 1]])
    assert quality.distance(p, q) == pytest.approx([jensen_shannon([1, 2, 3], [3, 0, 1]), 1.0, 0.0])


def test_char_classes() -> None:
    assert quality.char_counts(["aÉ1 \n.,$日\x00", None, ""]).tolist() == [[1, 1, 1, 1, 2, 2, 1, 1], [0] * 8, [0] * 8]


def test_judge_odd(odd, empty) -> None:
    got = quality.judge(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert by[3]["n_chars"] is None and not by[3]["reject"]
    assert by[4]["n_words"] == 0 and by[5]["n_words"] == 0 and not by[4]["reject"]
    kept = quality.judge(odd, keep_all=True)
    assert kept.columns == odd.columns
    assert quality.judge(empty).collect() == []


def test_many_languages(documents, odd) -> None:
    """References that are joined, as they are for very many languages, give the same as broadcast ones."""
    rules = quality.Rules()
    for df in (documents, odd):
        refs = quality.reference(df, rules.common)
        one, two = (Counter(map(str, quality.measured(df, refs, rules.common, "text", "lang", "m__", most).select("doc_id", "m__").collect())) for most in (1000, 2))
        assert one == two


def test_clashing_names_keep_their_values(odd) -> None:
    for kept in (quality.judge(odd, keep_all=True), mixing.mixed_rows(odd)):
        assert kept.columns == odd.columns
        assert all(r[c] == "clash" for r in kept.collect() for c in odd.columns[5:])


def test_judge_keeps_prose(documents, spark, sf_dir) -> None:
    """Of documents labelled good, nearly all stay; what is rejected is mostly labelled bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.judge(documents).join(labels, "doc_id").groupBy("quality").agg({"*": "count", "reject": "max"}).collect()
    assert got
    good = quality.judge(documents).join(labels, "doc_id").filter("quality = 1").collect()
    assert sum(r["reject"] for r in good) <= 0.02 * len(good)


children = st.lists(st.tuples(st.integers(1, 1000), st.integers(1, 20)), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(children, st.floats(0, 8000))
def test_fill_redistributes(nodes: list[tuple[int, int]], budget: float) -> None:
    named = [(f"n{i}", float(c), float(w)) for i, (c, w) in enumerate(nodes)]
    got = mixing.fill(budget, named)
    assert sum(got.values()) == pytest.approx(min(budget, sum(c for _, c, _ in named)), abs=1e-6)
    open_ = [(got[n] / w) for n, c, w in named if got[n] < c - 1e-6]
    for n, c, w in named:
        assert got[n] <= c + 1e-6
        if open_:
            assert got[n] / w <= max(open_) + 1e-6  # a full one has no more than its level
    assert max(open_, default=0) == pytest.approx(min(open_, default=0), abs=1e-6)


def brute_mix(rows: list[tuple], mix: mixing.Mix) -> Counter:
    leaves: dict[tuple, list] = defaultdict(list)
    for i, text, lang, source in rows:
        n = len([w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
        if n:
            leaves[mix.domains.get(source, "other"), lang or "unknown", source or "unknown"].append((i, n))
    have = {k: sum(n for _, n in v) for k, v in leaves.items()}
    out: Counter = Counter()
    for leaf, target in mixing.allocate(have, mix).items():
        whole, rest = divmod(target, have[leaf])
        for e in range(whole):
            out.update((i, *leaf, e, n) for i, n in leaves[leaf])
        order = sorted(leaves[leaf], key=lambda d: (hashlib.md5(f"{mix.seed}:{whole}:{'' if d[0] is None else d[0]}".encode()).hexdigest(), d[1]))
        upto = 0
        for i, n in order:
            upto += n
            if not rest or 2 * upto - n > 2 * rest:
                break
            out[i, *leaf, whole, n] += 1
    return out


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(ratio=1.7, epochs=3), mixing.Mix(ratio=0.05, domain_weights={"books": 1.0}, other=0.0001), mixing.Mix(domains={}, ratio=5.0)])
def test_select_brute(documents, odd, mix) -> None:
    for df in (documents, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
        assert Counter(tuple(r) for r in mixing.select(df, mix).collect()) == brute_mix(rows, mix)


def test_mixed_rows(documents, odd, empty) -> None:
    got = mixing.mixed_rows(documents)
    assert got.columns == documents.columns
    n = mixing.token_count(got["text"])
    total = documents.agg({"n_chars": "count"}).first()[0]
    assert 0 < got.count() <= 2 * total and got.filter(n == 0).count() == 0
    budget = 0.8 * documents.select(mixing.token_count(documents["text"]).alias("n")).agg({"n": "sum"}).first()[0]
    have = got.select(n.alias("n")).agg({"n": "sum"}).first()[0]
    assert 0.6 * budget <= have <= 1.1 * budget  # leaves of a few documents miss their shares
    assert mixing.mixed_rows(odd).columns == odd.columns and mixing.mixed_rows(odd).count() > 0
    assert mixing.mixed_rows(empty).collect() == [] and mixing.select(empty).collect() == []
