"""Whether a column ascends, descends, stays or does neither, in row order.

Each partition of rows gives (order, first, last, low, high); the driver folds these states, as many as there are
partitions, in row order. So there is no window over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs

ASCENDING, DESCENDING, CONSTANT, RANDOM = "ascending", "descending", "constant value", "random"


def bounds(a: Run) -> tuple:
    """The lesser and the greater end of a run."""
    return min(a.first, a.last), max(a.first, a.last)


def intersects(a: Run, b: Run) -> bool:
    """Whether an end of one lies strictly within the other, or both ranges are the same."""
    (lo, hi), (low, high) = bounds(a), bounds(b)
    return low < lo < high or low < hi < high or lo < low < hi or lo < high < hi or (lo, hi) == (low, high)


def envelopes(a: Run, b: Run) -> bool:
    """Whether a's range strictly contains b's."""
    (lo, hi), (low, high) = bounds(a), bounds(b)
    return lo < low and hi > high


@dataclass(frozen=True)
class Run:
    """The order of a run of rows and its first and last values; None stands for no rows.

    piecewise runs were merged from parts whose order is unknown: their values needn't follow each other in the rows.
    """

    order: str | None = None
    first: object = None
    last: object = None
    piecewise: bool = False

    def __add__(self, o: Run) -> Run:
        """The run with o's rows after it."""
        if self.order is None or o.order is None:
            return self if o.order is None else o
        one, two = self._alike(o)
        kinds = {one.order, two.order} - {CONSTANT}
        step = CONSTANT if two.first == one.last else ASCENDING if two.first > one.last else DESCENDING
        kinds |= {step} - {CONSTANT}
        order = CONSTANT if not kinds else kinds.pop() if len(kinds) == 1 else RANDOM
        return Run(order, one.first, two.last, one.piecewise or two.piecewise)

    def _alike(self, o: Run) -> tuple[Run, Run]:
        """Both with values that compare: as texts, if one of them has texts."""
        if isinstance(self.first, str) != isinstance(o.first, str):
            return tuple(replace(x, first=str(x.first), last=str(x.last)) for x in (self, o))
        return self, o

    def merged(self, o: Run) -> Run:
        """Two batches of which nobody knows which came first: one order, if their ranges allow it.

        Batches of one order keep it if their ranges lie apart, if both are piecewise, or if a piecewise one contains the
        other. A constant goes with an ascending or descending batch that it lies beside, or that is piecewise.
        """
        if self.order is None or o.order is None:
            return self if o.order is None else o
        a, b = self._alike(o)
        apart, orders = not intersects(a, b), {a.order, b.order}
        if RANDOM in orders or {ASCENDING, DESCENDING} <= orders:
            order = RANDOM
        elif len(orders) == 1:
            fits = apart or a.piecewise and b.piecewise or a.piecewise and envelopes(a, b) or b.piecewise and envelopes(b, a) or orders == {CONSTANT}
            order = a.order if fits else RANDOM
        else:
            other = (orders - {CONSTANT}).pop()
            order = other if apart or (b if a.order == CONSTANT else a).piecewise else RANDOM
        low, high = min(bounds(a)[0], bounds(b)[0]), max(bounds(a)[1], bounds(b)[1])
        first, last = (high, low) if order == DESCENDING else (low, high)
        return Run(order, first, last, not (order == RANDOM or order == CONSTANT and low == high))


def runs(ordered: DataFrame, columns: list[str]) -> dict[str, Run]:
    """The run of each column over the frame's partitions in their order; null tokens and nulls are left out.

    Texts compare as numbers if all of a column's cells are numbers, else as texts; other values as they are.
    """
    texts = [c for c in columns if ordered.schema[c].dataType.typeName() == "string"]
    filled = {c: F.when(~exprs.is_null_token(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in texts}
    place = {c: f"{i}s" for i, c in enumerate(columns)}
    own = ordered.select(*[filled.get(c, F.col(f"`{c}`")).alias(place[c]) for c in columns])  # one after the other, so that each is worked out once
    own = own.select("*", *[exprs.to_double(F.col(place[c])).alias(f"{i}n") for i, c in enumerate(texts)])
    own = own.select("*", *[F.when(F.col(place[c]).isNotNull() & F.col(f"{i}n").isNull(), F.lit(1)).alias(f"{i}t") for i, c in enumerate(texts)])
    found = _runs(own, own.columns)
    out = {}
    for c in columns:
        k = texts.index(c) if c in filled else -1
        numeric = k >= 0 and found[f"{k}t"].order is None and found[f"{k}n"].order is not None
        out[c] = found[f"{k}n"] if numeric else found[place[c]]
    return out


def _runs(ordered: DataFrame, columns: list[str]) -> dict[str, Run]:
    """The run of each column, values compared as they are."""
    names = [f"c{i}" for i in range(len(columns))]
    own = ordered.select(F.spark_partition_id().alias("p"), *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    kinds = [ordered.schema[c].dataType.simpleString() for c in columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [Run() for _ in names]
        part = None
        schema = None
        for batch in batches:
            schema = batch.schema
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
            for i in range(len(names)):
                x = batch.column(i + 1).drop_null()
                if not len(x):
                    continue
                if states[i].order == RANDOM:  # it stays so, whatever follows
                    states[i] = replace(states[i], last=x[len(x) - 1].as_py())
                    continue
                a, b = x.slice(0, len(x) - 1), x.slice(1)
                up = pc.all(pc.greater_equal(b, a), min_count=0).as_py()
                down = pc.all(pc.less_equal(b, a), min_count=0).as_py()
                order = CONSTANT if up and down else ASCENDING if up else DESCENDING if down else RANDOM
                states[i] += Run(order, x[0].as_py(), x[len(x) - 1].as_py())
        if part is not None:
            for i, s in enumerate(states):
                if s.order:
                    cells = []
                    for k in range(len(names)):
                        for v in (s.first, s.last):
                            cells.append(pa.array([v if k == i else None], schema.field(k + 1).type))
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([s.order]), *cells], names=["p", "i", "o", *[f"{n}{e}" for n in names for e in "fl"]])

    out = ", ".join(["p int", "i int", "o string", *[f"{n}{e} {k}" for n, k in zip(names, kinds, strict=True) for e in "fl"]])
    found = {c: Run() for c in columns}
    for row in sorted(own.mapInArrow(work, out).collect(), key=lambda r: (r["p"], r["i"])):
        n = names[row["i"]]
        c = columns[row["i"]]
        found[c] += Run(row["o"], row[n + "f"], row[n + "l"])
    return found


def detect(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(column_name, data_order): in the order of `by`, or of the files if that is None."""
    ordered = df if by is None else df.repartitionByRange(F.col(f"`{by}`")).sortWithinPartitions(F.col(f"`{by}`"))
    found = runs(ordered, columns)
    return df.sparkSession.createDataFrame([(c, r.order) for c, r in found.items()], "column_name string, data_order string")
