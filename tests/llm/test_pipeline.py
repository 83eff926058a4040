"""The pipeline, stage by stage and as a whole, against what the operators say one by one."""

from __future__ import annotations

import base64
import importlib.util
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, langid, mixing, neardup, quality


def stage_mix(docs) -> Counter:
    """The mixture by the rows' own keys, as the stage tells them apart."""
    ids = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    keyed = docs.withColumn("k", ids)
    own = dict(keyed.select("k", "doc_id").collect())
    return Counter(own[r["k"]] for r in mixing.select(keyed, None, "k").collect())


def test_stages_take_effect(documents, spark, sf_dir) -> None:
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        out = stage(spark, docs, sf_dir)
        after = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        if name == "language_id":
            found = {r["doc_id"]: r for r in langid.identify(docs).filter("not reject").collect()}
            assert set(after) == set(found)
            assert all(r["lang"] == found[r["doc_id"]]["language"] or found[r["doc_id"]]["own_gap"] <= langid.RELABEL for r in out.collect())
        if name == "quality_rules":
            assert set(after) == {r["doc_id"] for r in quality.judge(docs).filter("not reject").collect()}
        if name == "near_duplicates":
            gone = {r["doc_id"] for r in neardup.groups(docs).filter("doc_id != keeper").collect()}
            assert set(after) == set(before) - gone
            assert neardup.groups(out).count() == 0
        if name == "mixing":
            assert after == stage_mix(docs)
        if name == "byte_bpe":
            assert after == before and out.filter("not round_trip").count() == 0
        else:
            assert out.columns == documents.columns
            docs = spark.createDataFrame(out.collect(), documents.schema)


def test_run(documents, spark, sf_dir) -> None:
    got = corpus_pipeline.run(spark, sf_dir)
    texts = dict(documents.select("doc_id", "text").collect())
    tok = bpe.ByteBPE(bpe.vocabulary(bpe.VOCABULARY))
    rows = got.collect()
    assert rows and got.columns == ["doc_id", "tokens", "offsets", "round_trip"]
    for r in rows[:50]:
        flat, _ = tok.encode([texts[r["doc_id"]]])
        assert r["tokens"] == flat.tolist()


def helper(name: str):
    spec = importlib.util.spec_from_file_location(f"helper_{name}", Path(__file__).parent / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_run_brute(documents, spark, sf_dir) -> None:
    """run() against a chain of brute force: SQL for quality rules, all pairs for near duplicates, plain loops for the
    mixture, a public BPE; language ID's own query has its brute force in test_langid."""
    found = {r["doc_id"]: r for r in langid.identify(documents).collect()}
    rows = []
    for r in documents.collect():
        f = found[r["doc_id"]]
        if not f["reject"]:
            sure = f["own_gap"] is None and f["margin"] > langid.RELABEL or f["own_gap"] is not None and f["own_gap"] > langid.RELABEL
            rows.append(tuple(r[c] if c != "lang" or not sure else f["language"] for c in documents.columns))
    con = duckdb.connect()
    kept = pa.Table.from_pylist([dict(zip(documents.columns, r, strict=True)) for r in rows])  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM kept")
    good = {i for i, reject in con.execute(f"SELECT doc_id, reject FROM ({quality.judge_sql()})").fetchall() if not reject}
    rows = [r for r in rows if r[0] in good]
    near = helper("test_neardup")
    gone = {i for i, k in near.brute_groups(near.brute_pairs([(r[0], r[1]) for r in rows])) if i != k}
    rows = [r for r in rows if r[0] not in gone]
    # the stage tells rows apart by a key of id and text, in whose order its epochs go
    keyed = spark.createDataFrame(rows, documents.schema).select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("k"), "doc_id", "text", "lang", "source").collect()
    own = {r["k"]: r for r in keyed}
    chosen = helper("test_quality_mixing").brute_mix([(r["k"], r["text"], r["lang"], r["source"]) for r in keyed], mixing.Mix())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    known = tiktoken.Encoding("own", pat_str=helper("test_bpe").PATTERN, mergeable_ranks=ranks, special_tokens={})
    want: Counter = Counter()
    for (k, *_), n in chosen.items():
        want[own[k]["doc_id"], tuple(known.encode_ordinary(own[k]["text"]))] += n
    got = Counter((r["doc_id"], tuple(r["tokens"])) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and sum(got.values()) > 50


def test_odd_rows(odd, empty, spark, sf_dir) -> None:
    """Which rows survive each stage; clashing columns keep their values."""
    want = {"language_id": ["1", "2", "2", "6", "7", "9", "None"], "quality_rules": ["1", "2", "2", "6", "7", "9", "None"], "near_duplicates": ["1", "6", "7", "9"]}
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((out := stage(spark, docs, sf_dir)).collect(), out.schema)
            rows = docs.collect()
            if start is empty:
                assert rows == []
            elif name in want:
                assert sorted(str(r["doc_id"]) for r in rows) == want[name]
            elif name == "byte_bpe":
                assert rows and all(r["round_trip"] for r in rows)
            if name != "byte_bpe":
                assert docs.columns == odd.columns and all(r[c] == "clash" for r in rows for c in odd.columns[5:])
        assert docs.columns == ["doc_id", "tokens", "offsets", "round_trip"]
