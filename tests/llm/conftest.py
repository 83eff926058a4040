"""Rows with everything that may be odd about them."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

LONG = "the very long text goes on and on, l'été dernier 12345 times 🙂 " * 4000
#: Columns that clash with names used inside operators or in their results.
EXTRA = ["tokens", "language", "id", "key", "signature", "n_tokens", "epoch", "count", "word", "slot", "shard", "block", "line", "reject", "keeper", "a", "n", "count2",
    "__langid", "langid", "Langid_", "__quality", "quality", "quality_ref", "quality_lang", "__out", "__gone", "__turn", "row_key", "row_again", "row_gone", "mix_key", "mix_turn", "mix_n", "mix_epoch", "__slot", "slot_", "salt_", "k", "t", "w", "own", "text2"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def rows() -> list[tuple]:
    prose = "Licensed under the Apache License, Version 2.0\nthis is what people say when they have the time to say it and don't mind"
    own = [
        (1, prose, "en", "src1", 10), (2, prose, "en", "src1", 10), (2, prose, "en", "src1", 10), (3, None, "en", "src1", None), (None, prose, None, None, None), (None, None, None, None, None),
        (4, "", "de", "src2", 0), (5, " \n\t ", "fr", "src2", 4), (6, LONG, "es", "src3", len(LONG)), (7, "x", "xx", None, 1), (8, "   ﷽ \U0001f469‍\U0001f467 'll 're'", "fr", "src12", 9), (9, "0 1 2 3", None, "src4", 7),
    ]
    return [(*r, *(["clash"] * len(EXTRA))) for r in own]


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
