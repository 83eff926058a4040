"""The corpus queries over whole tables against DuckDB's SQL, where there is any."""

from __future__ import annotations

import pytest

from plumbline.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name: str, spark, sf_dir, duck, same) -> None:
    got = duck.execute(SQL[name])
    same(queries.queries()[name](spark, sf_dir), [c[0] for c in got.description], got.fetchall())
