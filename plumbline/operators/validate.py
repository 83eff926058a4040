"""Value rules that mark known anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs


def condition(df: DataFrame, column: str, rule: str, config: object) -> Column:
    """Whether a cell meets a rule: `range` with start and end, or `list` of numbers."""
    x = exprs.to_double(F.col(f"`{column}`").cast("string"))
    if rule == "range":
        return x.between(float(config["start"]), float(config["end"]))
    if rule == "list":
        return x.isin([float(v) for v in config])
    raise TypeError(f"no such rule: {rule}")


class Validator:
    """validate() finds, for each column and rule, the rows that meet it; get() gives their ids."""

    def __init__(self) -> None:
        self.found: DataFrame | None = None

    def validate(self, df: DataFrame, config: dict[str, dict[str, object]], row_id: str) -> DataFrame:
        """(column_name, rule, row_id). Every rule is tested in one pass over the table."""
        if not config:
            raise ValueError("no rules are given")
        missing = [c for c in config if c not in df.columns]
        if missing:
            raise KeyError(f"no such columns: {missing}")
        tests = [F.when(condition(df, c, r, v), F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"))) for c, rules in config.items() for r, v in rules.items()]
        hits = df.select(F.col(f"`{row_id}`").alias("row_id"), F.explode(F.array_compact(F.array(*tests))).alias("hit"))
        self.found = hits.select("hit.*", "row_id")
        return self.found

    def get(self, most: int = 1_000_000) -> dict[str, dict[str, list[int]]]:
        """The ids as lists; raises for over `most` of them, which belong in the frame that validate() gives."""
        if self.found is None:
            raise Warning("validate() comes before get()")
        rows = self.found.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} rows meet the rules")
        out: dict[str, dict[str, list[int]]] = {}
        for r in rows:
            out.setdefault(r["column_name"], {}).setdefault(r["rule"], []).append(r["row_id"])
        return {c: {k: sorted(v) for k, v in x.items()} for c, x in out.items()}
