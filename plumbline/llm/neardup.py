"""Near duplicates by MinHash and a multi-index Hamming join.

A document's signature has, for each of HASHES hash functions, BITS bits of the least hash among its pairs of
neighbouring words. Two signatures are near if they differ in at most DISTANCE of the values. Every such pair is found:
the values are split into CHUNKS parts, of which, by the pigeonhole principle, one has at most DISTANCE // CHUNKS
differences; each way to leave out so many values of a part gives a key, and a near pair shares at least one key. Only
keys that several signatures share are followed up, and every candidate's distance is counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Spans64, bounds, categories, codepoints, fresh_name, mixed, runs, settled, slices

HASHES = 64
#: Bits of each value; 16 keep keys of three values apart among billions of documents.
BITS = 16
#: Values that may differ. With 64 hashes, 28 find pairs that have 0.64 of their word pairs in common 9 times in 10.
DISTANCE = 28
CHUNKS = 15
#: Neighbouring words that make a shingle.
SHINGLE = 2
#: Signatures of a bucket that one task walks; larger buckets are parted.
LARGE = 2000

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, 1024, np.uint64)


def signatures(texts: list[str | None], hashes: int = HASHES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A row of `hashes` values for each text, and whether it has any word. Case and kinds of white space don't count."""
    out, has = np.zeros((len(texts), hashes), np.uint16), np.zeros(len(texts), bool)
    for lo, hi in runs(texts):
        part = [(t or "").lower() for t in texts[lo:hi]]
        ends = bounds(part)
        codes = codepoints("".join(part))
        if not len(codes):
            continue
        ink = categories()[codes] != ord(" ")
        fresh = np.ones(len(codes), bool)
        fresh[1:] = ~ink[:-1]
        fresh[ends[:-1][np.diff(ends) > 0]] = True
        start = np.flatnonzero(ink & fresh)
        own = np.concatenate([[0], np.cumsum(ink)])
        begin = own[start]  # where words begin among the characters that aren't white space
        letters = codes[ink]
        letters = letters + np.uint32(0x110000) * (ink & fresh)[ink].astype(np.uint32)  # keeps "a bc" and "ab c" apart
        doc = np.searchsorted(ends, start, "right") - 1
        n = np.bincount(doc, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(n)])
        stop = np.append(begin, len(letters))
        index = np.arange(len(begin)) - first[doc]
        keep = np.flatnonzero(index < np.maximum(n[doc] - shingle + 1, 1))  # a text of few words is one shingle
        last = np.minimum(keep + shingle, first[doc[keep] + 1])
        x = Spans64(letters).of(begin[keep], stop[last])
        some = np.flatnonzero(n)
        at = np.searchsorted(doc[keep], some)
        least = np.empty((hashes, len(some)), np.uint64)
        for k in range(hashes):
            least[k] = np.minimum.reduceat(x * _A[k] + _B[k], at) if len(some) else 0
        out[lo + some] = (mixed(least.T) & np.uint64((1 << BITS) - 1)).astype(np.uint16)
        has[lo + some] = True
    return out, has


def key_plan(hashes: int, distance: int, chunks: int) -> list[np.ndarray]:
    """The values that each key keeps."""
    if not 0 <= distance < hashes or not 1 <= chunks <= hashes:
        raise ValueError("distance lies below the number of hashes, chunks between 1 and it")
    out = []
    for part in np.array_split(np.arange(hashes), chunks):
        errors = min(distance // chunks, len(part))
        out += [np.setdiff1d(part, left) for left in combinations(part, errors)]
    return out


def keys(values: np.ndarray, plan: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit keys for each signature; a key also holds its own number."""
    out = np.empty((len(values), len(plan)), np.uint64)
    wide = values.astype(np.uint64)
    for k, kept in enumerate(plan):
        h = np.full(len(values), k + 1, np.uint64)
        for v in kept:
            h = mixed(h * np.uint64(0x100000001B3) + wide[:, v])
        out[:, k] = h
    return out


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, hashes)


def signed(df: DataFrame, id_col: str, text_col: str, hashes: int, shingle: int) -> DataFrame:
    """(id, signature) of the rows that have an id and a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                values, has = signatures(batch.column(1).to_pylist(), hashes, shingle)
                rows = [v.astype("<u2").tobytes() for v in values]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary(), mask=~has)], names=["id", "signature"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(work, f"id {kind}, signature binary").filter("signature is not null")


def _keyed(df: DataFrame, make: Callable[[np.ndarray], np.ndarray], hashes: int) -> DataFrame:
    """(key, id) for every key that make() gives of the rows' signatures."""
    kind = df.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                k = make(_matrix(batch.column(1), hashes))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(k)), k.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int64)), ids], names=["key", "id"])

    return df.select("id", "signature").mapInArrow(work, f"key bigint, id {kind}")


def _shared(keyed: DataFrame, unique: DataFrame) -> DataFrame:
    """(key, id, n, signature) of the keys that n > 1 signatures share.

    Keys are counted with sums before the shuffle, and joined back, so that a hot key can be split between tasks.
    """
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(counts, "key").join(unique.select("id", "signature"), "id").select("key", "id", "n", "signature")


def inner_plan(hashes: int, distance: int, chunks: int, without: int) -> list[np.ndarray]:
    """The values that keys keep within a bucket whose members share their values of chunk `without`.

    All of the distance may fall on the other chunks, one of which then has at most distance // (chunks - 1) errors.
    """
    parts = np.array_split(np.arange(hashes), chunks)
    others = [p for k, p in enumerate(parts) if k != without] or [np.zeros(0, np.int64)]
    return [np.setdiff1d(p, left) for p in others for left in combinations(p, min(distance // len(others), len(p)))]


def _chunk_of_key(hashes: int, distance: int, chunks: int) -> np.ndarray:
    """The chunk of each key of key_plan()."""
    parts = np.array_split(np.arange(hashes), chunks)
    return np.repeat(np.arange(chunks), [sum(1 for _ in combinations(p, min(distance // chunks, len(p)))) for p in parts])


def _inner_keyed(big: DataFrame, plan: list[np.ndarray], hashes: int, distance: int, chunks: int) -> DataFrame:
    """(key, id, far) of large buckets' members, keyed once more, by a chunk other than that which they share."""
    kind = big.schema["id"].dataType.simpleString()
    chunk = _chunk_of_key(hashes, distance, chunks)
    inner = [inner_plan(hashes, distance, chunks, c) for c in range(chunks)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                outer = batch.column(0).to_numpy().astype(np.uint64)
                values = _matrix(batch.column(2), hashes)
                mine = chunk[(keys(values, plan) == outer[:, None]).argmax(1)]
                for c in np.unique(mine).tolist():
                    rows = np.flatnonzero(mine == c)
                    k = mixed(keys(values[rows], inner[c]) ^ (outer[rows] * np.uint64(0x9E3779B97F4A7C15))[:, None])
                    which = pa.array(np.repeat(rows, k.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int64)), batch.column(1).take(which), batch.column(3).take(which)], names=["key", "id", "far"])

    return big.select("key", "id", "signature", "far").mapInArrow(work, f"key bigint, id {kind}, far boolean")


def _pivoted(big: DataFrame, hashes: int, distance: int) -> DataFrame:
    """Large buckets' members (key, id, n, signature, pivot, far): far ones aren't near the bucket's least member, the pivot."""
    pivots = big.groupBy("key").agg(F.min_by(F.struct("id", "signature"), "id").alias("p")).select("key", F.col("p.id").alias("pivot"), F.col("p.signature").alias("ps"))

    @F.arrow_udf("boolean")
    def far(one: pa.Array, two: pa.Array) -> pa.Array:
        return pa.array((_matrix(one, hashes) != _matrix(two, hashes)).sum(1) > distance)

    return big.join(pivots, "key").withColumn("far", far("signature", "ps")).drop("ps")


def linked(unique: DataFrame, hashes: int, distance: int, chunks: int, large: int = LARGE) -> DataFrame:
    """(a, b): edges that connect what near pairs connect.

    A bucket of up to `large` signatures is walked in one task. Of a larger one, all that are near its least member are
    linked to that; pairs with one of the others, which are few if the bucket is one group of copies, are looked for by
    keys of a second chunk, which part signatures that only share the first. Buckets that are large once more are treated
    in the same way, and what is left of them is compared block by block, in parallel.
    """
    plan = key_plan(hashes, distance, chunks)
    every = settled(_shared(_keyed(unique, lambda v: keys(v, plan), hashes), unique), "buckets")
    found = _edges(_sorted(every.filter(F.col("n") <= large)), forest, hashes, distance)
    big = every.filter(F.col("n") > large)
    if big.isEmpty():
        return found
    first = settled(_pivoted(big, hashes, distance), "large-buckets")
    found = found.unionByName(_to_pivot(first))
    inner = _inner_keyed(first.join(first.filter("far").select("key").distinct(), "key"), plan, hashes, distance, chunks)
    counts = inner.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("some")).filter("n > 1 and some").select("key", "n")
    second = settled(inner.join(counts, "key").join(unique.select("id", "signature"), "id"), "inner-buckets")
    found = found.unionByName(_edges(_sorted(second.filter(F.col("n") <= large)), forest, hashes, distance))
    rest = second.filter(F.col("n") > large).select("key", "id", "n", "signature")
    if rest.isEmpty():
        return found
    third = settled(_pivoted(rest, hashes, distance), "large-inner-buckets")
    return found.unionByName(_to_pivot(third)).unionByName(_by_blocks(third, forest, hashes, distance, large))


def _to_pivot(big: DataFrame) -> DataFrame:
    return big.filter("not far and id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))


def _sorted(b: DataFrame) -> DataFrame:
    return b.select("key", "id", "signature").repartition("key").sortWithinPartitions("key", "id")


def _by_blocks(big: DataFrame, how: Callable, hashes: int, distance: int, large: int) -> DataFrame:
    """Edges between far members and all others of a bucket: each pair of its blocks is a bucket of its own."""
    blocks = F.ceil(F.col("n") / large).cast("int")
    mine = big.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = mine.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumn("key", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")))
    return _edges(_sorted(each), how, hashes, distance)


def _near(values: np.ndarray, one: np.ndarray, distance: int) -> np.ndarray:
    return (values != one).sum(1) <= distance


def all_pairs(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    for i in range(len(values) - 1):
        for j in np.flatnonzero(_near(values[i + 1 :], values[i], distance)):
            yield i, i + 1 + int(j)


def forest(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Edges from the first member of each connected group to its others: a walk that meets each row once."""
    open_ = np.arange(len(values))
    while len(open_):
        root, open_ = int(open_[0]), open_[1:]
        todo = [root]
        while todo and len(open_):
            near = _near(values[open_], values[todo.pop()], distance)
            found = open_[near].tolist()
            open_ = open_[~near]
            todo += found
            yield from ((root, j) for j in found)


def _edges(sorted_buckets: DataFrame, how: Callable, hashes: int, distance: int) -> DataFrame:
    kind = sorted_buckets.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = t["key"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            values = _matrix(t["signature"], hashes)
            a, b = [], []
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                for i, j in how(values[lo:hi], distance):
                    a.append(lo + i)
                    b.append(lo + j)
            ids = t["id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key == key[-1], True)) if len(key) else 0
            if cut:
                yield from solve(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    return sorted_buckets.select("key", "id", "signature").mapInArrow(work, f"a {kind}, b {kind}").distinct()


def _unique(sigs: DataFrame) -> DataFrame:
    return sigs.groupBy("signature").agg(F.min("id").alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each id is connected with, by alternating large and small stars."""
    edges = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "stars")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))  # summed up before the shuffle: a hub's star is no task of its own
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.filter("u != v").distinct(), "stars")
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = settled(small.filter("u != v").distinct(), "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, distance: int = DISTANCE, chunks: int = CHUNKS, shingle: int = SHINGLE, large: int = LARGE) -> DataFrame:
    """(a, b): all pairs of different ids, a < b, whose signatures are near. What groups() does is linear instead.

    Null ids, and null, empty and blank texts, are in no pair; rows that repeat an id are one document, near to what any
    of its texts is near to; very long texts are signed whole; an empty table has no pairs; other columns are left out.
    """
    sigs = settled(signed(df, id_col, text_col, hashes, shingle), "signatures")
    unique = settled(_unique(sigs), "unique")
    plan = key_plan(hashes, distance, chunks)
    every = settled(_shared(_keyed(unique, lambda v: keys(v, plan), hashes), unique), "buckets")
    found = _edges(_sorted(every.filter(F.col("n") <= large)), all_pairs, hashes, distance)
    found = found.unionByName(_by_blocks(every.filter(F.col("n") > large), all_pairs, hashes, distance, large)).distinct()
    same = unique.withColumnsRenamed({"id": "rep"})
    members = sigs.join(same, "signature").select("id", "rep").distinct()
    first, second = members.withColumnsRenamed({"id": "x", "rep": "a"}), members.withColumnsRenamed({"id": "y", "rep": "b"})
    across = found.join(first, "a").join(second, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = first.join(second, F.col("a") == F.col("b")).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.filter("a != b").unionByName(within).distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, distance: int = DISTANCE, chunks: int = CHUNKS, shingle: int = SHINGLE, large: int = LARGE) -> DataFrame:
    """(id_col, keeper): the ids of every group of near duplicates with the least id of the group, which stays.

    Groups are connected by near pairs; ids without a near one don't occur. Rows with a null id, and texts without a
    word (null, empty, only white space), are near to nothing. Very long texts are signed whole. Rows that repeat an id
    are one document; if their texts differ, it is near to what any of them is near to. Ties don't arise: the least id
    keeps. An empty table has no groups. Other columns are left out, whatever their names. Equal signatures are brought
    together before the join, and large buckets are parted (see linked()), so that groups of thousands take no square of
    steps.
    """
    sigs = settled(signed(df, id_col, text_col, hashes, shingle), "signatures")
    unique = settled(_unique(sigs), "unique")
    found = linked(unique, hashes, distance, chunks, large)
    copies = sigs.join(unique.withColumnsRenamed({"id": "rep"}), "signature").filter("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return components(found.unionByName(copies)).select(F.col("id").alias(id_col), F.col("root").alias("keeper"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near duplicates. Columns are df's.

    Rows are told apart by id and text, so that rows with one id and different texts keep to their own decisions, and
    rows with a null id take part. The least id stays, null ids after all others; of several texts of one id the one with
    the least hash. Rows equal in id and text are one document, of which one row stays. Rows without a word (null, empty
    and blank texts) are near to nothing and all stay. An empty table stays empty; extra columns may have any name.
    """
    key, again, gone = (fresh_name(df, x) for x in ("row_key", "row_again", "row_gone"))
    text, i = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    named = df.withColumn(key, F.struct(i.isNull().alias("z"), i.alias("i"), F.xxhash64(text).alias("h")))
    wordless = text.isNull() | text.rlike(r"(?U)\A\s*\z")
    full = named.filter(~wordless)
    near = groups(full.select(F.col(key).alias("k"), text.alias("t")), "k", "t").filter("k != keeper").select(F.col("k").alias(gone), F.lit(False).alias(again))
    repeated = full.select(key).groupBy(key).agg(F.count(F.lit(1)).alias(again)).filter(F.col(again) > 1).select(F.col(key).alias(gone), F.lit(True).alias(again))
    marks = near.unionByName(repeated).groupBy(gone).agg(F.min(again).alias(again))
    kept = full.join(marks, F.col(key) == F.col(gone), "left")
    once = kept.filter(F.col(again).isNull())
    one = kept.filter(F.col(again)).groupBy(key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(again))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return once.select(*columns).unionByName(one.select(f"{again}.*")).unionByName(named.filter(wordless).select(*columns))
