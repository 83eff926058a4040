"""Byte-level BPE against a public implementation, and exact round trips."""

from __future__ import annotations

import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def known() -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own() -> bpe.ByteBPE:
    return bpe.ByteBPE(bpe.vocabulary(bpe.VOCABULARY))


TRICKY = ["", " ", "  a", "a  ", "\n\n x\t\ty", "don't they'll we've I'm'd 's", "'", "''ll", " 'll", "x'l", "été ½ ² Ⅷ", "日本語 テキスト", "a" * 5000, "🙂🙂 👩‍👧", "\x00\x01", "1234567 89", "  x", "_ _a_1", " '", "'re're", "\r\n \r\n"]


def test_tricky(own, known) -> None:
    flat, done = own.encode(TRICKY)
    assert [flat[a:b].tolist() for a, b in zip(done, done[1:], strict=False)] == [known.encode_ordinary(t) for t in TRICKY]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aslltverdm1½é.,🙂"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any(own, known, texts: list[str]) -> None:
    flat, done = own.encode(texts)
    for t, a, b in zip(texts, done, done[1:], strict=False):
        assert flat[a:b].tolist() == known.encode_ordinary(t)
        assert own.decode(flat[a:b]) == t.encode()


def test_scan_is_the_automaton() -> None:
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 40_000):
        sym = rng.integers(0, bpe.SYMBOLS, n).astype(np.uint8)
        sym[0] += bpe.SYMBOLS
        state, want = bpe.START, []
        for s in sym.tolist():
            state, new = bpe._step(bpe.START if s >= bpe.SYMBOLS else state, s % bpe.SYMBOLS)
            want.append(new or s >= bpe.SYMBOLS)
        assert bpe.begins(sym).tolist() == want


def test_whole_table(documents, known) -> None:
    got = bpe.encode(documents).collect()
    texts = dict(documents.select("doc_id", "text").collect())
    assert len(got) == documents.count()
    for r in got:
        assert r["tokens"] == known.encode_ordinary(texts[r["doc_id"]]) and r["round_trip"]
        raw = texts[r["doc_id"]].encode()
        cut = [raw[a:b] for a, b in zip(r["offsets"], [*r["offsets"][1:], len(raw)], strict=True)]
        assert cut == [known.decode_single_token_bytes(t) for t in r["tokens"]]


def test_odd_rows(odd, empty, known) -> None:
    got = bpe.encode(odd)
    assert got.count() == odd.count() and got.columns == ["doc_id", "tokens", "offsets", "round_trip"]
    for r in got.collect():
        assert (r["tokens"] is None) == (r["round_trip"] is None)
        assert r["round_trip"] in (None, True)
    for offsets in (None, "offsets"):
        back = {(r["doc_id"], r["text"]) for r in bpe.decode(got, offsets_col=offsets).collect()}
        assert back == {(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()}
    spans = got.withColumn("b", F.lit(7)).withColumn("e", F.lit(25))
    for r in bpe.decode(spans, offsets_col="offsets", begin="b", end="e").join(odd.select("doc_id", F.col("text").alias("whole")), "doc_id").collect():
        assert r["text"] is None and r["whole"] is None or r["text"] == "" or r["whole"].encode()[7:25].decode("utf-8", "ignore") in r["text"]
    with pytest.raises(ValueError):
        bpe.decode(spans, begin="b", end="e")
    assert bpe.encode(empty).collect() == []
