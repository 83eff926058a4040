"""Byte-level BPE, encoding and decoding.

Where a pre-token begins is decided without a regular expression. Code points become classes (letters, numbers, other
signs, white space, with what follows an apostrophe or a blank folded in); each class is a function from the state of a
small automaton to its next state. Such functions compose associatively and are few, so their products over all
prefixes of a batch come from a table of products: columns of the batch are scanned side by side, and the columns'
totals once more by doubling. The slices found so go through a cache; those that are new are merged together, many at
once, by pair rank. Each token keeps the byte at which it begins, and decoding is a gather from the vocabulary's bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounds, categories, codepoints, resident, runs, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers before it forgets all.
CACHE = 250_000

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, GAP, SPACE = range(8)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, AFTER_GAP, NEED_ONE, NEED_TWO, DONE = range(10)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token begins with this symbol."""
    if symbol == LETTER:
        if state == NEED_TWO:
            return NEED_ONE, False
        if state == NEED_ONE:
            return DONE, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, AFTER_BLANK):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: NEED_ONE, LONG: NEED_TWO}[symbol], True
    if symbol == BLANK:
        return AFTER_BLANK, True
    if symbol == GAP:
        return AFTER_GAP, True
    return IN_SPACE, state != IN_SPACE


STATES, SYMBOLS = 10, 8


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Element of each symbol (and, from SYMBOLS on, of each symbol that opens a text), products, actions, begins."""
    identity = tuple(range(STATES))
    gens = [tuple(_step(s, y)[0] for s in range(STATES)) for y in range(SYMBOLS)]
    gens += [(_step(START, y)[0],) * STATES for y in range(SYMBOLS)]
    ids = {identity: 0}
    todo = [identity]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    every = list(ids)
    product = np.array([[ids[tuple(g[x] for x in f)] for g in every] for f in every], np.int32)
    begins = np.array([[_step(s, y)[1] for y in range(SYMBOLS)] + [True] * SYMBOLS for s in range(STATES)])
    return np.array([ids[g] for g in gens], np.int32), product, np.array(every, np.uint8), begins, len(every)


ELEMENT, PRODUCT, ACTION, BEGINS, SIZE = _monoid()
_SCALED = (PRODUCT * SIZE).ravel()
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of each code point."""
    if not _kinds:
        major = categories()
        kind = np.full(len(major), OTHER, np.uint8)
        kind[major == ord("L")] = LETTER
        kind[major == ord("N")] = NUMBER
        kind[major == ord(" ")] = SPACE
        _kinds.append(kind)
    return _kinds[0]


def symbols(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's symbols for concatenated texts that begin at `starts` (none of them empty)."""
    n = len(codes)
    sym = _kind()[codes]
    final = np.zeros(n, bool)
    final[starts[1:] - 1] = True
    final[-1] = True
    space = sym == SPACE
    before_sign = np.zeros(n, bool)
    before_sign[:-1] = space[:-1] & ~space[1:]
    before_sign &= ~final
    sym[before_sign] = GAP
    sym[before_sign & (codes == 32)] = BLANK
    at = np.flatnonzero((codes == 39) & ~final)
    if len(at):
        one = codes[at + 1]
        sym[at[np.isin(one, [115, 116, 109, 100])]] = SHORT  # s t m d
        at, one = at[~final[at + 1]], one[~final[at + 1]]
        two = codes[at + 2]
        sym[at[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))]] = LONG
    sym[starts] += SYMBOLS
    return sym


def begins(sym: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Whether a pre-token begins at each place: an associative scan over the symbols' functions."""
    n = len(sym)
    columns = max(1, min(columns, n // 16))
    rows = -(-n // columns)
    element = np.zeros(rows * columns, np.int32)
    element[:n] = ELEMENT[sym]
    element = np.ascontiguousarray(element.reshape(columns, rows).T)
    prefix = np.empty((rows, columns), np.int32)  # elements times SIZE
    prefix[0] = element[0] * SIZE
    for t in range(1, rows):
        np.take(_SCALED, prefix[t - 1] + element[t], out=prefix[t])
    total, by = prefix[-1].copy(), 1
    while by < columns:
        total[by:] = _SCALED[total[:-by] + total[by:] // SIZE]
        by *= 2
    entry = np.full(columns, START, np.uint8)
    entry[1:] = ACTION[total[:-1] // SIZE, START]
    state = np.empty((rows, columns), np.uint8)
    state[0] = entry
    state[1:] = ACTION.ravel()[prefix[:-1] // SIZE * STATES + entry]
    return BEGINS.ravel()[state.T.ravel()[:n].astype(np.int32) * (2 * SYMBOLS) + sym]


#: The bytes of a little-endian word that belong to a piece of 0 to 8 (and more) bytes.
_MASKS = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)


class ByteBPE:
    """A vocabulary of ranked byte strings, with the caches of one worker."""

    def __init__(self, data: bytes, cache: int = CACHE) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        n = max(self.ranks.values()) + 1
        self.pieces: list[bytes] = [b""] * n
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.fromiter(map(len, self.pieces), np.int64, n)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.most = cache
        self._pairs()
        self._forget()

    def _pairs(self) -> None:
        """An open-addressed table from two token ids to the rank of their union."""
        keys, values = [], []
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                a, b = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        bits = max(10, (len(keys) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.key[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.key[taken], self.value[taken] = key[put], value[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    NONE = np.int32(2**31 - 1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's union, NONE where it is no token; a negative id is no token."""
        out = np.full(len(left), self.NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[open_].astype(np.int64) << 20 | right[open_]
        slot = self._slot(key)
        while len(open_):
            there = self.key[slot]
            hit = there == key
            out[open_[hit]] = self.value[slot[hit]]
            go = ~hit & (there >= 0)
            open_, key, slot = open_[go], key[go], (slot[go] + 1) & self.mask
        return out

    def _forget(self) -> None:
        """Empties the cache: a short piece's key is its bytes and its length in 16 bytes, a longer one's a string."""
        self.long: dict[str, int] = {}
        self.slots = 1 << 12
        self.key1, self.key2 = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.at = np.full(self.slots, -1, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i + 1] is the end of entry i
        self.entries = 0

    def _place(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        x = (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + two * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Cache entries of short pieces, -1 where there is none."""
        out = np.full(len(one), -1, np.int32)
        todo, slot = np.arange(len(one)), self._place(one, two)
        while len(todo):
            there = self.at[slot]
            hit = (self.key1[slot] == one) & (self.key2[slot] == two) & (there >= 0)
            out[todo[hit]] = there[hit]
            go = ~hit & (there >= 0)
            todo, slot, one, two = todo[go], (slot[go] + 1) & (self.slots - 1), one[go], two[go]
        return out

    def _claim(self, one: np.ndarray, two: np.ndarray, value: np.ndarray | None, first: int) -> np.ndarray:
        """Puts keys where there is room; equal keys share a slot. The rows that got one, numbered from `first` if no value is given."""
        todo, slot, put = np.arange(len(one)), self._place(one, two), []
        while len(todo):
            free = np.flatnonzero(self.at[slot] < 0)
            taken, which = np.unique(slot[free], return_index=True)
            rows = todo[free[which]]
            self.key1[taken], self.key2[taken] = one[rows], two[rows]
            self.at[taken] = np.arange(first, first + len(rows)) if value is None else value[rows]
            first += len(rows)
            put.append(rows)
            go = (self.key1[slot] != one[todo]) | (self.key2[slot] != two[todo])
            todo, slot = todo[go], (slot[go] + 1) & (self.slots - 1)
        return np.concatenate(put) if put else np.zeros(0, np.int64)

    def _room(self, more: int) -> None:
        while (self.entries + more) * 2 > self.slots:
            full = self.at >= 0
            old = self.key1[full], self.key2[full], self.at[full]
            self.slots *= 4
            self.key1, self.key2 = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
            self.at = np.full(self.slots, -1, np.int32)
            self._claim(*old, 0)

    def _append(self, flat: np.ndarray, count: np.ndarray) -> None:
        used = self.ends[self.entries]
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.entries + len(count) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(flat)] = flat
        self.ends[self.entries + 1 : self.entries + 1 + len(count)] = used + np.cumsum(count)
        self.entries += len(count)

    def _merge_long(self, piece: bytes) -> list[int]:
        """Pair merging with a heap over a linked list, for a piece of any length."""
        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        get, pieces = self.ranks.get, self.pieces
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(pieces[ids[i]] + pieces[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = rank, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if (r := get(pieces[rank] + pieces[ids[right[j]]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[right[j]]))
            if left[i] >= 0 and (r := get(pieces[ids[left[i]]] + pieces[rank])) is not None:
                heapq.heappush(heap, (r, left[i], ids[left[i]], rank))
        return [x for x in ids if x >= 0]

    def _merge_many(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces that are rows of bytes, one after another, and how many each has."""
        count = np.zeros(len(raw), np.int64)
        ids = np.full(raw.shape, -1, np.int32)
        order = np.argsort(sizes, kind="stable")
        at, ordered = 0, sizes[order]
        for most in (1, 3, 5, 7, 9, 12, 15):
            end = int(np.searchsorted(ordered, most, "right"))
            for lo in range(at, end, 16384):
                rows = order[lo : min(end, lo + 16384)]
                ids[rows, :most], count[rows] = self._merge_matrix(raw[rows, :most], sizes[rows])
            at = end
        return ids[np.arange(raw.shape[1]) < count[:, None]], count

    def _merge_matrix(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = raw.shape[1]
        out = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], -1).astype(np.int32)
        n = sizes.copy()
        if width == 1:
            return out, n
        live = np.arange(len(out))
        ids = out.copy()
        rank = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        places = np.arange(width)
        while len(live):
            j = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, j]
            go = best != self.NONE
            if not go.all():
                out[live[~go]] = ids[~go]
                live, ids, rank, j, best = live[go], ids[go], rank[go], j[go], best[go]
                row = np.arange(len(live))
                if not len(live):
                    break
            take = np.minimum(places + (places > j[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[:, -1] = -1
            ids[row, j] = best
            rank = np.take_along_axis(rank, np.minimum(take[:, :-1], width - 2), 1)
            rank[:, -1] = self.NONE
            n[live] -= 1
            after = np.where(j + 1 < width, ids[row, np.minimum(j + 1, width - 1)], -1)
            has = j < width - 1
            rank[row[has], j[has]] = self.rank_of(best[has], after[has])
            has = j > 0
            rank[row[has], j[has] - 1] = self.rank_of(ids[row[has], j[has] - 1], best[has])
        return out, n

    def _learn(self, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> None:
        """Takes short pieces into the cache, merging all that are new together."""
        self._room(len(one))
        rows = self._claim(one, two, None, self.entries)
        raw = np.stack([one[rows], two[rows]], 1).astype("<u8").view(np.uint8)
        self._append(*self._merge_many(raw, size[rows]))

    def _long(self, word: str) -> int:
        if word not in self.long:
            ids = self._merge_long(word.encode("utf-8", "surrogatepass"))
            self.long[word] = self.entries
            self._append(np.array(ids, np.int32), np.array([len(ids)]))
        return self.long[word]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts, one after another, and where each text's begin (with the end)."""
        ends = bounds(texts)
        filled = np.flatnonzero(np.diff(ends))
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if self.entries > self.most:
            self._forget()
        whole = "".join(texts)
        codes = codepoints(whole)
        cut = np.flatnonzero(begins(symbols(codes, ends[filled])))
        byte = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=byte[1:])
        start = byte[cut]
        size = np.diff(start, append=byte[-1])
        data = whole.encode("utf-8", "surrogatepass") + bytes(16)
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        short = np.flatnonzero(size <= 15)
        n = size[short]
        one, two = words[start[short]] & _MASKS[n], words[start[short] + 8] & _MASKS[np.maximum(n - 8, 0)] | n.astype(np.uint64) << np.uint64(56)
        entry = np.empty(len(cut), np.int32)
        found = self._find(one, two)
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn(one[new], two[new], n[new])
            found[new] = self._find(one[new], two[new])
        entry[short] = found
        for i in np.flatnonzero(size > 15).tolist():
            entry[i] = self._long(data[start[i] : start[i] + size[i]].decode("utf-8", "surrogatepass"))
        begin = self.ends[entry]
        count = self.ends[entry + 1] - begin
        done = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[np.repeat(begin - done[:-1], count) + np.arange(done[-1])]
        return flat, done[np.searchsorted(cut, ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; an id outside the vocabulary has none."""
        ids = ids[(ids >= 0) & (ids < len(self.pieces))]
        size = self.lengths[ids]
        done = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.starts[ids] - done[:-1], size) + np.arange(done[-1])].tobytes()

    def placed(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the tokens, each where its offset says (counted from the first token's)."""
        real = (ids >= 0) & (ids < len(self.pieces))
        ids, offsets = ids[real], offsets[real].astype(np.int64)
        if not len(ids):
            return b""
        size = self.lengths[ids]
        done = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(done[-1]) - np.repeat(done[:-1], size)
        out = np.zeros(int((offsets + size).max() - offsets[0]), np.uint8)
        out[np.repeat(offsets - offsets[0], size) + within] = self.bytes[np.repeat(self.starts[ids], size) + within]
        return out.tobytes()


def tokenizer(data: bytes) -> ByteBPE:
    """The worker's tokenizer for this vocabulary file; it lives, with its cache, from task to task."""
    return resident(("bpe", hash(data)), lambda: ByteBPE(data))


def encoded_batch(bpe: ByteBPE, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: token ids, where each text's begin (with the end), and each token's byte offset in its text."""
    flats, sizes, offsets = [], [], []
    for lo, hi in runs(texts):
        flat, done = bpe.encode([t or "" for t in texts[lo:hi]])
        at = np.concatenate([[0], np.cumsum(bpe.lengths[flat])])
        n = np.diff(done)
        flats.append(flat)
        sizes.append(n)
        offsets.append((at[:-1] - np.repeat(at[done[:-1]], n)).astype(np.int32))
    if not flats:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)
    return np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(offsets)


def vocabulary(path: str) -> bytes:
    """The vocabulary file; it is small and of fixed size, so it is broadcast."""
    data = Path(path).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't broadcast")
    return data


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Tokens of each row's whole text: (id_col, tokens, offsets, round_trip).

    offsets has the byte of the text's UTF-8 form at which each token begins; round_trip is whether decoding gives the
    text again. A null text has null tokens, offsets and round_trip; an empty text has empty lists. Rows correspond one
    to one, repeated ones and null ids included; other columns are left out, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared.value)
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                texts = batch.column(1).to_pylist()
                flat, done, offset = encoded_batch(bpe, texts)
                null = np.array([t is None for t in texts], bool)
                decoded = bpe.decode(flat)
                byte = np.concatenate([[0], np.cumsum(bpe.lengths[flat])])[done].tolist()
                same = [None if t is None else t.encode("utf-8") == decoded[a:b] for t, a, b in zip(texts, byte, byte[1:], strict=False)]
                lists = [_lists(done, values, null) for values in (flat, offset)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(same, pa.bool_())], names=[id_col, "tokens", "offsets", "round_trip"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, tokens array<int>, offsets array<int>, round_trip boolean")


def _lists(done: np.ndarray, values: np.ndarray, null: np.ndarray) -> pa.Array:
    at = pa.array(done.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(done.astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(values))


def decode(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", path: str = VOCABULARY, offsets_col: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """(id_col, text) from token ids, by one gather over a batch.

    With offsets_col each token's bytes are put where its offset says; with begin and end, columns of byte places, only
    the tokens that lie in that span (from the first that reaches into it) are decoded, which the offsets find by binary
    search. Null tokens have a null text, ids outside the vocabulary and null ids stand for nothing, bytes that are no
    UTF-8 become replacement characters. Repeated rows and null row ids are kept, lists of any length are decoded whole,
    an empty table gives no rows; no ties arise; other columns are left out, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    if (begin is None) != (end is None) or begin is not None and offsets_col is None:
        raise ValueError("a span needs begin, end and offsets")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(shared.value)
        for batch in batches:
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
            first, last = at[:-1].astype(np.int64), at[1:].astype(np.int64)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            if offsets_col is not None:
                offset = batch.column(2).values.fill_null(0).to_numpy(zero_copy_only=False)
            if begin is not None:
                spans = zip(*(batch.column(k).to_pylist() for k in (3, 4)), strict=True)
                for k, (lo, hi) in enumerate(spans):
                    own = offset[first[k] : last[k]]
                    if null[k] or lo is None or hi is None:
                        null[k] = True
                        continue
                    first[k], last[k] = first[k] + max(0, np.searchsorted(own, lo, "right") - 1), first[k] + np.searchsorted(own, hi, "left")
            texts = []
            for k in range(batch.num_rows):
                if null[k]:
                    texts.append(None)
                    continue
                ids = flat[first[k] : last[k]]
                if offsets_col is None:
                    data = bpe.decode(ids)
                else:
                    data = bpe.placed(ids, offset[first[k] : last[k]])
                texts.append(data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    columns = [F.col(f"`{id_col}`"), F.col(f"`{tokens_col}`").cast("array<int>").alias("t")]
    if offsets_col is not None:
        columns.append(F.col(f"`{offsets_col}`").cast("array<int>").alias("o"))
    if begin is not None:
        columns += [F.col(f"`{begin}`").cast("bigint").alias("b"), F.col(f"`{end}`").cast("bigint").alias("e")]
    return df.select(*columns).mapInArrow(work, f"`{id_col}` {kind}, text string")
