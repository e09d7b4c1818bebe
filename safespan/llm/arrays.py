"""Array helpers shared by the text operators: Arrow text columns as byte arrays, words, rolling hashes.

Everything works on one Arrow batch inside a task; Spark decides which rows meet where.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time, so that the working arrays stay small.
BLOCK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK)
        made = []
        for base in (BASE, BASE_INV):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if n > 4 * BLOCK:
            return made[0], made[1]  # not kept: one very long word or text
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Lookup:
    """Values by 64-bit keys, in an open table searched for many keys at once; -1 where a key is unknown. The key of all
    ones is not to be used."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.count = 0
        self._room(len(keys), values.dtype)
        self.put(keys, values)

    def _room(self, n: int, kind: np.dtype) -> None:
        bits = max(4, int(2 * n).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.keys = np.full(self.size, self.FREE)
        self.values = np.zeros(self.size, kind)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are new and differ from each other."""
        if 2 * (self.count + len(keys)) > self.size:
            held = self.keys != self.FREE
            keys, values = np.concatenate((self.keys[held], keys)), np.concatenate((self.values[held], values))
            self.count = 0
            self._room(2 * len(keys), values.dtype)
        self.count += len(keys)
        left, at = np.arange(len(keys)), self._at(keys)
        while len(left):
            free = self.keys[at] == self.FREE
            slots, who = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[who]
            self.keys[slots], self.values[slots] = keys[left[won]], values[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & (self.size - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        got = self.keys[at]
        hit = got == keys
        out = np.where(hit, self.values[at], self.values.dtype.type(-1))
        open_ = np.flatnonzero(~hit & (got != self.FREE))
        while len(open_):
            at_ = (at[open_] + 1) & (self.size - 1)
            at[open_] = at_
            got = self.keys[at_]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at_[hit]]
            open_ = open_[~hit & (got != self.FREE)]
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts in them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column, b"" if binary else "").cast(pa.large_binary() if binary else pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.empty(0, np.uint8)
    return raw, offsets - first


def runs(offsets: np.ndarray, most: int = 8 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes at most, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, by default [^\\x20\\x09-\\x0D]+, and the n + 1 offsets of the texts in
    them. apart: for each byte, whether it stands between words."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~apart[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, non-overlapping spans, by prefix sums of a polynomial in blocks."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        n = int(ends[j - 1]) - lo
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo : lo + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix64(out)


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, with n + 1 offsets. A text of 1 to k - 1 words has its whole
    sequence as its one shingle; a text without words has none."""
    c = np.uint64(0xD6E8FEB86659FD93)
    counts = np.diff(offsets)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(int(at[-1]), np.uint64)
    m = len(hashes) - k + 1
    if m > 0:
        acc = hashes[:m].copy()
        for j in range(1, k):
            acc *= c
            acc += hashes[j : j + m]
        full = np.flatnonzero(counts >= k)
        size = made[full]
        src = np.repeat(offsets[full] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        dst = np.repeat(at[full] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
        out[dst] = acc[src]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        one = int(counts[d])
        for h in hashes[offsets[d] : offsets[d + 1]].tolist():
            one = (one * int(c) + h) & 0xFFFFFFFFFFFFFFFF
        out[at[d]] = one
    return mix64(out), at


def per_batch(make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], rows: int = 2000, after: Callable[[], None] | None = None) -> Callable:
    """A function for mapInArrow that hands on at most `rows` rows at a time, so that tasks hold little at once. after is
    called at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from make(batch.slice(at, rows))
            del batch  # before the next one is read
            give_back()
        if after is not None:
            after()
        give_back()

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in ("_" * i + name for i in range(1, len(taken) + 2)) if n.lower() not in taken) for name in names]


def give_back() -> None:
    """Return freed memory to the system: Spark keeps idle workers, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def _recoded(df: DataFrame, columns: list[str], kind: T.DataType, change: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, kind, f.nullable) if f.name in columns else f for f in df.schema.fields])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one = change()
        out = []
        for n, c in zip(batch.schema.names, batch.columns, strict=True):
            if n in columns:
                c = pa.array([None if x is None else one(x) for x in c.cast(pa.binary()).to_pylist()], pa.binary()).cast(arrow)
            out.append(c)
        yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return df.mapInArrow(per_batch(make), schema)


def unpacked(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each packed text; null counts as empty."""
    one = zstandard.ZstdDecompressor().decompress
    return [one(x) if x is not None else b"" for x in column.to_pylist()]


def pack(df: DataFrame, *columns: str) -> DataFrame:
    """df with the text columns as zstandard frames (binary), for shuffles of whole texts. Null stays null."""
    return _recoded(df, list(columns), T.BinaryType(), lambda: zstandard.ZstdCompressor(level=3).compress)


def unpack(df: DataFrame, *columns: str) -> DataFrame:
    """The reverse of pack."""
    return _recoded(df, list(columns), T.StringType(), lambda: zstandard.ZstdDecompressor().decompress)
