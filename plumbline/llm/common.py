"""What several corpus operators share: tables, the shared folder, text arrays and polynomial span hashes."""

from __future__ import annotations

import atexit
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in runs of about so many characters; a longer text makes a run of its own.
RUN_CHARS = 1_000_000
#: Of an Arrow batch, about so many bytes of text, and rows, become Python strings at a time.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches: spark.checkpoint.dir; a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver's program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df lacks, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: later reads survive the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_checked(df: DataFrame, rows: int, most: int = 1 << 20) -> DataFrame:
    """A broadcast hint for a side of a known number of rows; beyond `most` the planner chooses by itself."""
    return F.broadcast(df) if rows <= most else df


#: Bytes that are broadcast at once, at most.
MOST_BROADCAST = 128 << 20


def handed_out(spark: SparkSession, parts: tuple[bytes, ...], name: str, most: int = MOST_BROADCAST) -> Callable[[], tuple[bytes, ...]]:
    """A function by which workers get the parts: broadcast ones, or, where they are large, from a file in the shared folder."""
    if sum(map(len, parts)) <= most:
        shared = spark.sparkContext.broadcast(parts)
        return lambda: shared.value
    path = new_path(spark, name)
    fs, place = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(place) as out:
        out.write(b"".join(parts))
    ends = [0]
    for x in parts:
        ends.append(ends[-1] + len(x))
    held: list[tuple[bytes, ...]] = []

    def read() -> tuple[bytes, ...]:
        if not held:
            fs, place = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(place) as f:
                data = f.read()
            held.append(tuple(data[a:b] for a, b in zip(ends, ends[1:], strict=False)))
        return held[0]

    return read


def runs(texts: list[str | None], most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters each; a range has at least one text."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch: pa.RecordBatch | pa.StructArray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of its texts, so that a worker's memory doesn't follow Arrow's batches."""
    done = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(done):
        before = done[at - 1] if at else 0
        end = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(done, before + SLICE_BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


#: Bits of a membership filter, and places that a key sets in it: its size never grows, only its false hits do.
FILTER_BITS, FILTER_PLACES = 1 << 26, 3


def filter_of(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter over a column of 64-bit keys: `bits` bits, at most 8 MB whatever the number of keys."""
    at = [F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(bits)) for k in range(FILTER_PLACES)]
    places = keys.filter(F.col(key).isNotNull()).select(F.explode(F.array(*at)).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("b"))
    out = np.zeros(bits >> 6, np.int64)
    for batch in words.toArrow().to_batches():  # at most bits / 64 rows
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def maybe_in(df: DataFrame, key: str, found: np.ndarray) -> DataFrame:
    """df's rows whose key may be in the filter: all that are, and few others while the filter isn't full."""
    shared = df.sparkSession.sparkContext.broadcast(found)
    bits = len(found) << 6

    @F.arrow_udf("boolean")
    def test(*places: pa.Array) -> pa.Array:
        out = np.ones(len(places[0]), bool)
        for p in places:
            at = p.to_numpy(zero_copy_only=False).astype(np.int64)
            out &= (shared.value[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pa.array(out)

    at = [F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(bits)) for k in range(FILTER_PLACES)]
    return df.filter(test(*at))


_resident: list[tuple[Hashable, object]] = []


def resident(key: Hashable, make: Callable[[], object]) -> object:
    """What make() gives, kept as long as the worker asks for the same key; a worker holds one such model at a time."""
    if not _resident or _resident[0][0] != key:
        _resident[:] = []
        _resident.append((key, make()))
    return _resident[0][1]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def bounds(texts: list[str]) -> np.ndarray:
    """Where each text begins in their concatenation, and the end."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


_classes: dict[str, np.ndarray] = {}


def categories() -> np.ndarray:
    """The first letter of each code point's general category, as a byte; white space is b' '."""
    if "major" not in _classes:
        both = "".join(unicodedata.category(chr(c)) for c in range(0x110000)).encode()
        pair = np.frombuffer(both, dtype=np.uint8).reshape(-1, 2)
        major, minor = pair[:, 0].copy(), pair[:, 1].copy()
        white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        major[white] = ord(" ")
        _classes["major"], _classes["minor"] = major, minor
    return _classes["major"]


def minor_categories() -> np.ndarray:
    categories()
    return _classes["minor"]


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    while len(_powers["up"]) < n:
        have = len(_powers["up"])
        for key, base in (("up", BASE), ("down", INVERSE)):
            _powers[key] = np.concatenate([_powers[key], _powers[key] * np.uint64(pow(base, have, 1 << 64))])
    return _powers["up"], _powers["down"]


class Spans64:
    """Prefix hashes modulo 2**64, from which the hash of any span follows in constant time (for grouping, not for proof)."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = powers(len(codes) + 1)
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table64:
    """An open-addressed table from 64-bit keys to 32-bit values, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.free = np.ones(1 << bits, bool)
        slot = self._slot(keys)
        while len(keys):
            open_ = np.flatnonzero(self.free[slot])
            taken, first = np.unique(slot[open_], return_index=True)
            put = open_[first]
            self.key[taken], self.value[taken], self.free[taken] = keys[put], values[put], False
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        out = np.full(len(keys), missing, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            used = ~self.free[slot]
            hit = used & (self.key[slot] == keys)
            out[todo[hit]] = self.value[slot[hit]]
            go = used & ~hit
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & self.mask
        return out
