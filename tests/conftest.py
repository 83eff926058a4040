"""A session of two threads, DuckDB over the same tables, and the comparison of both."""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF_DIR


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(x: object) -> object:
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.9g}" if abs(x) < 1 << 53 else str(x)
    return str(x)


@pytest.fixture(scope="session")
def same() -> Callable[[DataFrame, list[str], list[tuple]], None]:
    """Asserts that a frame has these rows, in any order, under these names."""

    def check(df: DataFrame, names: list[str], rows: list[tuple]) -> None:
        assert sorted(df.columns) == sorted(names)
        place = [names.index(c) for c in df.columns]
        got = sorted(tuple(map(cell, r)) for r in df.collect())
        want = sorted(tuple(cell(r[i]) for i in place) for r in rows)
        assert len(got) == len(want)
        wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        assert not wrong, f"{len(wrong)} of {len(want)} rows differ: {wrong[:3]}"

    return check
