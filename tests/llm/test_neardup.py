"""Near duplicates: every pair under the distance, groups of any size, odd rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import neardup


def brute_pairs(rows: list[tuple]) -> set[tuple]:
    values, has = neardup.signatures([t for _, t in rows])
    ok = [i for i in range(len(rows)) if rows[i][0] is not None and has[i]]
    out = set()
    for i, j in combinations(ok, 2):
        if rows[i][0] != rows[j][0] and (values[i] != values[j]).sum() <= neardup.DISTANCE:
            out.add(tuple(sorted((rows[i][0], rows[j][0]))))
    return out


def brute_groups(pairs: set[tuple]) -> set[tuple]:
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, neardup.HASHES - 1), max_size=neardup.DISTANCE), st.integers(0, 2**32))
def test_pigeonhole(changed: list[int], seed: int) -> None:
    """Two signatures within the distance share a key, whichever values differ."""
    rng = np.random.default_rng(seed)
    one = rng.integers(0, 1 << 16, neardup.HASHES).astype(np.uint16)
    two = one.copy()
    two[changed] ^= 1
    plan = neardup.key_plan(neardup.HASHES, neardup.DISTANCE, neardup.CHUNKS)
    a, b = neardup.keys(np.stack([one, two]), plan)
    assert (a == b).any()


@pytest.mark.parametrize(("hashes", "distance", "chunks"), [(8, 3, 2), (6, 4, 3), (5, 0, 1), (9, 8, 4)])
def test_small_plans_are_complete(hashes: int, distance: int, chunks: int) -> None:
    plan = neardup.key_plan(hashes, distance, chunks)
    for n in range(distance + 1):
        for where in combinations(range(hashes), n):
            assert any(not set(kept) & set(where) for kept in plan)


def test_bad_plans() -> None:
    for bad in ((8, 8, 2), (8, -1, 2), (8, 2, 0), (8, 2, 9)):
        with pytest.raises(ValueError):
            neardup.key_plan(*bad)


def test_minhash_estimates() -> None:
    """The share of equal values is near the Jaccard similarity of the word pairs."""
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:200] + [f"v{i}" for i in range(200)])
    many, _ = neardup.signatures([a, b], hashes=1024)
    assert (many[0] == many[1]).mean() == pytest.approx(199 / 599, abs=0.06)


def test_all_pairs_and_groups(documents) -> None:
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = brute_pairs(rows)
    assert {tuple(r) for r in neardup.pairs(documents).collect()} == want
    assert {tuple(r) for r in neardup.groups(documents).collect()} == brute_groups(want)


def test_one_stays(documents) -> None:
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    gone = {i for i, k in brute_groups(brute_pairs(rows)) if i != k}
    got = neardup.one_of_each(documents)
    assert got.columns == documents.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, _ in rows if i not in gone)


def test_chain_is_one_group(spark) -> None:
    """a~b~c where a and c are far apart; and copies of one text by the hundred."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[k * 20 : k * 20 + 120]) for k in range(9)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "one and the same text of a few words") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in neardup.groups(df).collect()} == brute_groups(brute_pairs(rows))


def test_odd_rows(odd, empty) -> None:
    got = {tuple(r) for r in neardup.groups(odd).collect()}
    assert got == {(1, 1), (2, 1)}
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "None"])
    assert all(tuple(r) in set(map(tuple, odd.collect())) for r in kept.collect())
    assert neardup.groups(empty).collect() == [] and neardup.one_of_each(empty).collect() == []
    assert neardup.pairs(empty).collect() == []


def test_text_ids(spark) -> None:
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one  two three FOUR"), ("c", None)], "doc_id string, text string")
    assert {tuple(r) for r in neardup.groups(df).collect()} == {("a", "a"), ("b", "a")}


def test_one_id_two_texts(spark) -> None:
    """Only rows whose text is near go; rows equal in id and text count once; rows without a word all stay."""
    rows = [(1, "one two three four five"), (1, "quite another text of other words"), (1, "one two three four five"), (None, "one TWO three four five"), (None, "alone here with null"), (None, None), (None, None), (2, ""), (2, "")]
    got = sorted(map(str, neardup.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    df = spark.createDataFrame([rows[0], rows[1], rows[4], rows[5], rows[6], rows[7], rows[8]], "doc_id bigint, text string")
    assert got == sorted(map(str, df.collect()))


def far_and_near(n: int, seed: int) -> np.ndarray:
    """Signatures that share a chunk's values: some far from all others, some in tight groups, some in chains."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 16, (n, neardup.HASHES)).astype(np.uint16)
    for k in range(n // 2, n - 2):  # groups of copies of six originals, and chains between neighbours
        source = values[k % 6] if k % 3 else values[k - 1]
        values[k] = source
        values[k, rng.choice(neardup.HASHES, rng.integers(1, 27), replace=False)] = rng.integers(0, 1 << 16)
    values[:, :5] = 7
    return values


@pytest.mark.parametrize(("large", "seed"), [(4, 1), (10, 2), (64, 3), (10_000, 4)])
def test_large_buckets(spark, large: int, seed: int) -> None:
    """Whatever counts as a large bucket, groups and pairs are those of brute force."""
    values = far_and_near(150, seed)
    near = {(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] != values[j]).sum() <= neardup.DISTANCE}
    unique = spark.createDataFrame([(i, bytearray(v.astype("<u2").tobytes())) for i, v in enumerate(values)], "id bigint, signature binary").repartition(3)
    found = neardup.components(neardup.linked(unique, neardup.HASHES, neardup.DISTANCE, neardup.CHUNKS, large)).collect()
    assert {tuple(r) for r in found} == brute_groups(near)


def test_pairs_by_blocks(documents) -> None:
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert {tuple(r) for r in neardup.pairs(documents, large=2).collect()} == brute_pairs(rows)
