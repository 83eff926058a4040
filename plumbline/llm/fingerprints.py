"""Document fingerprints by prefix polynomial hashes.

With H[i] = sum of c[j] * B**j over j < i, taken modulo two primes, the hash of the span a..b is (H[b] - H[a]) / B**a:
any two spans, of one text or of two, are compared in constant time, and the longest common extension of two places is
found by binary search over its length. The arrays are built by cumulated sums over a whole batch at once. A document's
fingerprint is the hash of its whole span; documents that open with the same span of ANCHOR characters make a family,
and of each member the longest common extension with the family's head, the member of the least id, is found.

Passages shared anywhere are found from chosen places: of any WINDOW spans of ANCHOR characters in a row, the one with
the least hash is chosen, so two texts that share ANCHOR + WINDOW - 1 characters have a chosen span in common, and the
first that they have in common lies less than WINDOW places after the start of what they share. Of each text the longest
match with any different text is found, without comparing all pairs: the places of one chosen span, of all texts, are
sorted by what follows them, so that the longest common extension of two is the least one between neighbours in that
order; and they are parted by what precedes them, a class for each depth at which some differ. Of a class the best
partner of a place is a neighbour. A span that every text has behind the same stretch, from the chosen span before it,
needs no look: what is shared there is found from that one.

Only hashes are moved for all documents. The texts that share spans are known before any is moved, and of them what lies
around spans to look at; a membership filter of fixed size keeps the others where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SLICE_BYTES, SLICE_ROWS, bounds, codepoints, filter_of, maybe_in, mixed, runs, settled, slices

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
ANCHOR = 64
WINDOW = 192

_tables: dict[int, list[np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo the prime."""
    p, base = PRIMES[k], BASES[k]
    if k not in _tables:
        _tables[k] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    while len(_tables[k][0]) < n:
        have = len(_tables[k][0])
        for i, b in enumerate((base, pow(base, -1, p))):
            _tables[k][i] = np.concatenate([_tables[k][i], _tables[k][i] * np.uint64(pow(b, have, p)) % np.uint64(p)])
    return _tables[k][0], _tables[k][1]


class Prefixes:
    """Prefix arrays of a text, or of several laid end to end, modulo both primes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        values = codes.astype(np.uint64) + np.uint64(1)
        self.arrays, self.down = [], []
        for k, p in enumerate(PRIMES):
            up, down = _powers(k, self.n + 1)
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * up[: self.n] % np.uint64(p), out=h[1:])  # fewer than 2**33 terms below 2**31
            self.arrays.append(h % np.uint64(p))
            self.down.append(down)

    def span(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """62 bits that stand for the span's characters, wherever it lies."""
        out = []
        for k, p in enumerate(PRIMES):
            q = np.uint64(p)
            out.append((self.arrays[k][b] + q - self.arrays[k][a]) % q * self.down[k][a] % q)
        return out[0] << np.uint64(31) | out[1]

    def equal(self, a: int, b: int, other: Prefixes, c: int, d: int) -> bool:
        return b - a == d - c and bool(self.span(a, b) == other.span(c, d))

    def extension(self, a: int, other: Prefixes, c: int) -> int:
        """The longest n for which self[a:a+n] equals other[c:c+n]."""
        low, high = 0, min(self.n - a, other.n - c)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(a, a + mid) == other.span(c, c + mid):
                low = mid
            else:
                high = mid - 1
        return low


def _extreme(x: np.ndarray, window: int, f: np.ufunc) -> np.ndarray:
    """f over each `window` values in a row."""
    have = 1
    while have < window:
        step = min(have, window - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def chosen(h: Prefixes, a: int, b: int, anchor: int = ANCHOR, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places, from a on, of the chosen spans of the text a..b."""
    n = b - a - anchor + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(a, a + n)
    x = mixed(h.span(at, at + anchor))
    least = _extreme(x, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(_extreme(np.concatenate([edge, least, edge]), window, np.maximum) == x)
    return x[at], at


IDENTITY = ["k", "n"]  # a text is told from others by 64 bits of a hash, and its length


def _hashed(df: DataFrame, id_col: str, text_col: str, anchor: int, window: int) -> DataFrame:
    """(i, r, k, n, f, a, spots) of the rows with a text: its fingerprint, that of its opening, and its chosen spans, each
    with the hash of the stretch from the one before up to its end (0 for the first)."""
    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(3)):
                texts = batch.column(3).to_pylist()
                sizes, prints, opens, spans, counts = [], [], [], [], []
                for lo, hi in runs(texts):
                    ends = bounds(texts[lo:hi])
                    h = Prefixes(codepoints("".join(texts[lo:hi])))
                    sizes.append(np.diff(ends))
                    prints.append(h.span(ends[:-1], ends[1:]))
                    opens.append(h.span(ends[:-1], np.minimum(ends[:-1] + anchor, ends[1:])))
                    for a, b in zip(ends[:-1], ends[1:], strict=True):
                        x, p = chosen(h, a, b, anchor, window)
                        before = np.zeros(len(p), np.uint64)
                        before[1:] = mixed(h.span(a + p[:-1], a + p[1:] + anchor))
                        spans.append((x.view(np.int64), p.astype(np.int32), before.view(np.int64)))
                        counts.append(len(p))
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*spans, strict=True)], ["h", "p", "b"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, prints, opens)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, lists], names=["i", "r", "k", "n", "f", "a", "spots"])

    i = F.col(f"`{id_col}`")
    own = df.filter(text.isNotNull()).select(i.alias("i"), F.xxhash64(i, text).alias("r"), F.xxhash64(text).alias("k"), text.alias("t"))
    return own.mapInArrow(work, f"i {kind}, r bigint, k bigint, n bigint, f bigint, a bigint, spots array<struct<h:bigint,p:int,b:bigint>>")


def _held(docs: DataFrame) -> DataFrame:
    """(k, n, spans) of the texts that share chosen spans with different texts: all of those, their places, and whether to
    look for matches from there."""
    spots = docs.select(*IDENTITY, F.explode("spots").alias("s")).select(*IDENTITY, "s.h", "s.p", "s.b")
    shared = spots.groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.min("b").alias("least"), F.max("b").alias("most"))
    shared = shared.filter("low != high").select("h", F.expr("least != most or least = 0").alias("look"))
    shared = settled(shared, "shared-spans")
    held = maybe_in(spots, "h", filter_of(shared, "h")).groupBy("h", *IDENTITY).agg(F.collect_set("p").alias("ps"))
    return held.join(shared, "h").groupBy(*IDENTITY).agg(F.collect_list(F.struct("h", "look", "ps")).alias("spans"))


def _packed(df: DataFrame, id_col: str, text_col: str, least: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, n, t) of the texts in wanted (k, n), compressed; of the rows that have a text only that with the least id."""
    text = F.col(f"`{text_col}`")
    row = F.xxhash64(F.col(f"`{id_col}`"), text)
    rows = wanted.join(least, [F.col("k") == F.col("ok"), F.col("n") == F.col("on")]).select(F.col("o.r").alias("r"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole, whole.column(2)):
                data = [small.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], names=["k", "n", "t"])

    here = df.filter(text.isNotNull()).select(row.alias("r"), F.xxhash64(text).alias("k"), F.length(text).cast("bigint").alias("n"), text.alias("t"))
    return maybe_in(here, "r", filter_of(rows, "r")).select(*IDENTITY, "t").mapInArrow(pack, "k bigint, n bigint, t binary")


def _unpacked(data: bytes) -> str:
    return zstandard.decompress(data).decode("utf-8", "surrogatepass")


class Packed(Sequence):
    """Compressed texts, each unpacked when it is asked for, so that the many of one span aren't held at once."""

    def __init__(self, data: list[bytes]) -> None:
        self.data = data

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, k: int) -> str:
        return _unpacked(self.data[k])


def common(x: str, y: str) -> int:
    """The length of the longest common opening."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n and x[at : at + step] == y[at : at + step]:
        at, step = at + step, step * 2
    low, high = min(at, n), min(at + step, n)
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _minima(x: np.ndarray) -> list[np.ndarray]:
    """Of each power of two, the least of so many values in a row."""
    out = [x]
    while len(out[-1]) > 1 << len(out) - 1:
        half = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _least(minima: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each range a..b, none of them empty."""
    out, level = np.zeros(len(a), np.int64), np.frexp(b - a)[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(minima[k][a[at]], minima[k][b[at] - (1 << int(k))])
    return out


def _of_runs(stretches: Sequence[str], places: list[list[int]], period: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each stretch the places of a span of such a period that can begin a longest match, and where the period ends.

    A match around two places that both have one a period before is found from these, so one of the two is the first of its
    run. With a first place whose period goes on for u characters to the left and v to the right, of another run's places the
    first with u or more to the left, the last with fewer, and one with exactly v to the right, are as good as any.
    """
    whole = []
    for text, at in zip(stretches, places, strict=True):
        p, codes = np.array(at), codepoints(text)
        breaks = np.concatenate([[period - 1], np.flatnonzero(codes[period:] != codes[:-period]) + period, [len(text)]])
        k = np.searchsorted(breaks, p + period)
        begins, ends = breaks[k - 1] + 1 - period, breaks[k]
        first = np.append(True, np.diff(p) != period)
        next_ = np.append(codes, 0xFFFFFFFF)[ends].astype(np.int64)
        whole.append((p, ends, p - begins, (ends - p) << 32 | next_, first))
    left = np.unique(np.concatenate([np.minimum(u[first], window - 1) for _, _, u, _, first in whole]))
    right = np.unique(np.concatenate([v[first] for *_, v, first in whole]))
    right = right[right & 0xFFFFFFFF != 0xFFFFFFFF]  # where the period ends the text nothing follows
    out = []
    for p, ends, u, v, first in whole:
        rise = np.diff(np.searchsorted(left, u, "right")) > 0
        keep = first | np.append(first[1:], True) | np.append(False, rise) | np.append(rise, False) | np.isin(v, right)
        out.append((p[keep], ends[keep]))
    return out


def longest(owners: list, stretches: Sequence[str], places: list[list[int]], anchor: int, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Of each owner: (stretch, start in it, other stretch, start in that, length) of the longest match, with another's
    stretch, around any two of the given places of one span, up to window - 1 characters to the left of them.

    Spans of a short period are sorted by how far it goes on, then by what follows; of the many places in one such run few
    are held (see _of_runs).
    """
    span = stretches[0][places[0][0] : places[0][0] + anchor]
    period = next((q for q in range(1, anchor // 2 + 1) if span.startswith(span[q:])), 0)
    rows: list[tuple[int, str, int, int, int]] = []
    lefts: dict[str, int] = {}
    held = _of_runs(stretches, places, period, window) if period else [(np.array(at), np.array(at) + anchor) for at in places]
    for e, (text, (at, ends)) in enumerate(zip(stretches, held, strict=True)):
        tails: dict[int, str] = {}
        for p, end in zip(at.tolist(), ends.tolist(), strict=True):
            if end not in tails:
                tails[end] = text[end:]
            rows.append((end - p, tails[end], e, p, lefts.setdefault(text[max(0, p - window + 1) : p][::-1], len(lefts))))
    rows.sort()
    after = [min(x[0], y[0]) if x[0] != y[0] else x[0] + (len(x[1]) if x[1] is y[1] else common(x[1], y[1])) for x, y in zip(rows, rows[1:], strict=False)]
    minima = _minima(np.array(after, np.int64))
    numbers: dict = {}
    number = np.array([numbers.setdefault(o, len(numbers)) for o in owners])
    owner = number[[r[2] for r in rows]]
    names = sorted(lefts)
    before = np.array([common(x, y) for x, y in zip(names, names[1:], strict=False)], np.int64)
    rank = np.zeros(len(names), np.int64)
    rank[[lefts[x] for x in names]] = np.arange(len(names))
    left = rank[[r[4] for r in rows]]
    size = np.array(list(map(len, names)))
    depths = np.union1d(np.append(before, 0), size[np.bincount(left, minlength=len(names)) > 1])
    best, partner, depth = np.full(len(rows), -1), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for d in depths:
        class_ = np.append(0, np.cumsum(before < d))[left]
        order = np.flatnonzero(size[left] >= d)
        order = order[np.argsort(class_[order], kind="stable")]
        c, w, k = class_[order], owner[order], np.arange(len(order))
        new = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))
        first = np.maximum.accumulate(np.where(new, k, 0))
        beyond = np.append(np.flatnonzero(new), len(order))[np.cumsum(new)]
        for other in (first - 1, beyond):  # the nearest places of other owners
            at = np.flatnonzero((other >= 0) & (other < len(order)))
            at = at[c[other[at]] == c[at]]
            x, y = order[at], order[other[at]]
            length = d + _least(minima, np.minimum(x, y), np.maximum(x, y))
            more = length > best[x]
            x = x[more]
            best[x], partner[x], depth[x] = length[more], y[more], d
    order = np.lexsort([-best, owner])
    for x in order[np.unique(owner[order], return_index=True)[1]].tolist():
        if best[x] >= 0:
            one, two, d = rows[x], rows[partner[x]], int(depth[x])
            yield one[2], one[3] - d, two[2], two[3] - d, int(best[x])


def _passages(df: DataFrame, id_col: str, text_col: str, docs: DataFrame, least: DataFrame, anchor: int, window: int) -> DataFrame:
    """(k, n, ok, on, start, other_start, passage): of each text that shares a chosen span, its longest match with any
    different text."""
    held = settled(_held(docs), "shared-spots")
    texts = _packed(df, id_col, text_col, least, held.select(*IDENTITY)).groupBy(*IDENTITY).agg(F.first("t").alias("t"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies around the spans to look at, as far as shared spans follow each other without a gap."""
        small = zstandard.ZstdCompressor(level=3)
        names = ["h", "k", "n", "begin", "ps", "t"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        for whole in batches:
            for batch in slices(whole, whole.column(3)):
                out: list[tuple] = []
                held = 0
                for k, n, spans, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text = _unpacked(data)
                    every = np.unique(np.concatenate([s["ps"] for s in spans]))
                    gaps = np.append(np.flatnonzero(np.diff(every) > window), len(every) - 1)
                    lasts = every[gaps]
                    for s in spans:
                        if not s["look"]:
                            continue
                        ps = np.sort(np.array(s["ps"], np.int64))
                        for stretch in np.split(ps, np.flatnonzero(np.diff(np.searchsorted(lasts, ps))) + 1):
                            begin = max(0, int(stretch[0]) - window + 1)
                            end = int(lasts[np.searchsorted(lasts, stretch[0])]) + anchor + window
                            body = small.compress(text[begin:end].encode("utf-8", "surrogatepass"))
                            out.append((s["h"], k, n, begin, stretch - begin, body))
                            held += len(body) + 8 * len(stretch)
                    if held > SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "n", "ok", "on", "start", "other_start", "passage"]

        def rows() -> Iterator[tuple]:
            for whole in batches:
                for batch in slices(whole, whole.column(5)):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def found(group: list[tuple]) -> Iterator[tuple]:
            owners = [r[1:3] for r in group]
            for x, a, y, b, n in longest(owners, Packed([r[5] for r in group]), [r[4] for r in group], anchor, window):
                yield (*owners[x], *owners[y], group[x][3] + a, group[y][3] + b, n)

        out: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            out += found(sorted(group, key=lambda r: r[1:4]))
            if len(out) >= SLICE_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    parts = held.join(texts, IDENTITY).select(*IDENTITY, "spans", "t").mapInArrow(part, "h bigint, k bigint, n bigint, begin bigint, ps array<bigint>, t binary")
    matches = parts.repartition("h").sortWithinPartitions("h").mapInArrow(work, "k bigint, n bigint, ok bigint, on bigint, start bigint, other_start bigint, passage bigint")
    best = F.struct("passage", "ok", "on", "start", "other_start")
    return matches.groupBy(*IDENTITY).agg(F.max(best).alias("b")).select(*IDENTITY, "b.ok", "b.on", "b.start", "b.other_start", "b.passage")


def _compared(df: DataFrame, id_col: str, text_col: str, least: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (k, n, ok, on) with opening, the longest common extension of both texts' beginnings."""
    sides = wanted.select(*IDENTITY).unionByName(wanted.select(F.col("ok").alias("k"), F.col("on").alias("n"))).distinct()
    texts = _packed(df, id_col, text_col, least, sides)
    one = texts.join(wanted, IDENTITY).withColumnRenamed("t", "x")
    two = texts.select(F.col("k").alias("ok"), F.col("n").alias("on"), F.col("t").alias("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]  # a packed text, and it
        for whole in batches:
            for batch in slices(whole, whole.column(4)):
                out = []
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                    if y != last[0]:  # texts compared with one other come one after another
                        last = [y, _unpacked(y)]
                    out.append(common(_unpacked(x), last[1]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], names=["k", "n", "ok", "on", "opening"])

    both = one.join(two, ["ok", "on"]).select("k", "n", "ok", "on", "x", "y")
    found = both.mapInArrow(work, "k bigint, n bigint, ok bigint, on bigint, opening bigint")
    return found.groupBy("k", "n", "ok", "on").agg(F.first("opening").alias("opening"))  # rows that repeat id and text


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR, window: int = WINDOW) -> DataFrame:
    """(id_col, length, fingerprint, head, shared, other, start, other_start, passage) of each row.

    length is in characters, fingerprint the hash of the whole text (equal texts have equal ones; different texts
    differ but for a chance of about 2**-61), head the least id among the rows whose texts open with the same `anchor`
    characters, and shared the length of the longest common opening with the head's text (the whole length for the head
    itself and for its copies). Texts shorter than `anchor` are families by their whole texts.
    passage is the length of the longest match with any different text (see above), start and other_start its places in
    this text and in that of the least id that has the other, `other`; of several that are as long, one. No match of
    anchor + window - 1 characters or more is missed; shorter ones are found around chosen spans that both texts have.
    All four are null where no chosen span is shared with a different text.

    Rows of null text have null values in all but id_col; empty texts are a family of their own. Very long texts are
    hashed whole. Rows with a null id take part, and come last in a family's order; of a family's texts with one id the
    least hash is the head's. Repeated rows are kept, and are the same text. An empty table gives an empty result. Other
    columns are left out, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = settled(_hashed(df, id_col, text_col, anchor, window), "fingerprints")
    keys = docs.select("i", "r", *IDENTITY, "f", "a", F.least("n", F.lit(anchor)).alias("m"))
    head = F.struct(F.col("i").isNull().alias("z"), "i", "f", "k", "n")
    heads = keys.groupBy("a", "m").agg(F.min(head).alias("head"))
    kept = keys.join(heads, ["a", "m"]).select("i", *IDENTITY, "f", F.col("head.i").alias("head"), F.col("head.k").alias("hk"), F.col("head.n").alias("hn"))
    least = keys.groupBy(F.col("k").alias("ok"), F.col("n").alias("on")).agg(F.min(F.struct(F.col("i").isNull().alias("z"), "i", "r")).alias("o"))
    passages = settled(_passages(df, id_col, text_col, docs, least, anchor, window), "passages")
    wanted = kept.filter("k != hk or n != hn").select(*IDENTITY, F.col("hk").alias("ok"), F.col("hn").alias("on")).distinct()
    opened = settled(_compared(df, id_col, text_col, least, settled(wanted, "wanted-comparisons")), "comparisons").withColumnsRenamed({"ok": "hk", "on": "hn"})
    matches = passages.join(least, ["ok", "on"]).select(*IDENTITY, F.col("o.i").alias("other"), "start", "other_start", "passage")
    shared = F.when((F.col("k") == F.col("hk")) & (F.col("n") == F.col("hn")), F.col("n")).otherwise(F.col("opening")).alias("shared")
    found = kept.join(opened, [*IDENTITY, "hk", "hn"], "left").join(matches, IDENTITY, "left")
    found = found.select(F.col("i").alias(id_col), F.col("n").alias("length"), F.col("f").alias("fingerprint"), "head", shared, "other", "start", "other_start", "passage")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("length", "bigint"), ("fingerprint", "bigint"), ("head", kind), ("shared", "bigint"), ("other", kind), ("start", "bigint"), ("other_start", "bigint"), ("passage", "bigint"))]
    return found.unionByName(df.filter(F.col(f"`{text_col}`").isNull()).select(F.col(f"`{id_col}`"), *nothing))
