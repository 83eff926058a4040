"""Every registered query against DuckDB's SQL; those without SQL run and give rows."""

from __future__ import annotations

import pytest

from plumbline import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name: str, spark, sf_dir, duck, same) -> None:
    df = queries.queries()[name](spark, sf_dir)
    if name in SQL:
        got = duck.execute(SQL[name])
        same(df, [c[0] for c in got.description], got.fetchall())
    else:
        assert df.count() > 0


def test_sql_has_queries() -> None:
    assert set(SQL) <= set(queries.queries())
