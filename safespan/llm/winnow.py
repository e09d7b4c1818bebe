"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of each window of w successive hashes the least is chosen, the rightmost
one where several are least, and kept with its position. Two texts that share any k + w - 1 code points in a row share at
least one chosen hash; one shared hash comes from k equal code points (but for hash collisions).

Defined cases: null counts as empty and has an empty fingerprint; a text shorter than k has one hash, of the whole text;
with fewer than w hashes they form one window; equal texts have equal fingerprints; two empty fingerprints have likeness
1; very long texts are worked through in blocks; repeated rows and empty tables pass through; other columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.llm.arrays import BASE, mix64, per_batch, unused
from safespan.llm.bpe import _with

K, W = 8, 8
_BLOCK = 1 << 18


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k codes, by doubling: the hash of 2m codes comes from two hashes of m."""
    whole, size, out, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(codes) - k + 1
    while size <= k:
        if k & size:
            part = whole[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(BASE, size, 1 << 64)) + part
            done += size
        if size * 2 <= k:
            m = len(whole) - size
            whole = whole[:m] * np.uint64(pow(BASE, size, 1 << 64)) + whole[size:]
        size *= 2
    return mix64(out)


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """The chosen 40-bit hashes of a text and their positions, in order."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(codes))
    total = len(codes) - k + 1
    w = min(w, total)
    found = []
    for lo in range(0, total - w + 1, _BLOCK):  # window starts of this block
        m = min(_BLOCK, total - w + 1 - lo) + w - 1
        h = _hashes(codes[lo : lo + m + k - 1], k) >> np.uint64(24)
        # the low bits count down, so that the rightmost of equal hashes is the least
        key = (h << np.uint64(24)) | (np.uint64((1 << 24) - 1) - np.arange(m, dtype=np.uint64))
        least, size = key, 1
        while size * 2 <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
        chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
        at = lo + ((1 << 24) - 1) - (chosen & np.uint64((1 << 24) - 1)).astype(np.int64)
        found.append((chosen >> np.uint64(24), at))
    hashes, at = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = np.concatenate(([True], at[1:] != at[:-1]))  # a choice may span two blocks
    return hashes[keep], at[keep]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def show(hashes: np.ndarray, at: np.ndarray) -> str:
    """A fingerprint as text: hash@position, hashes in hexadecimal."""
    return " ".join([f"{h:x}@{p}" for h, p in zip(hashes.tolist(), at.tolist(), strict=True)])


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = K, w: int = W) -> DataFrame:
    """df with each text's fingerprint: array<struct<hash: bigint, at: bigint>>."""
    schema = _with(df, name, T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("at", T.LongType())])))

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [winnow(x, k, w) for x in batch.column(text).to_pylist()]
        flat = [np.concatenate([np.empty(0, np.int64), *(m[i].astype(np.int64) for m in made)]) for i in (0, 1)]
        ends = np.concatenate(([0], np.cumsum([len(m[0]) for m in made]))).astype(np.int32)
        column = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in flat], ["hash", "at"]))
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name}
        yield pa.RecordBatch.from_arrays([*keep.values(), column], [*keep, name])

    return df.mapInArrow(per_batch(make), schema)


def compare(df: DataFrame, text: str, others: dict[str, tuple[str, str | None]], name: str = "fingerprint", k: int = K, w: int = W) -> DataFrame:
    """df without the text columns, with the fingerprint of `text` as a string and, for each other text column in
    `others`, its likeness to it under the first name and its fingerprint under the second, if that isn't None."""
    drop = {text, *others}
    kept = [f for f in df.schema.fields if f.name not in drop]
    names = [f.name for f in kept]
    fields = kept + [T.StructField(name, T.StringType())]
    for like, shown in others.values():
        fields += [T.StructField(like, T.DoubleType())] + ([T.StructField(shown, T.StringType())] if shown else [])
    schema = T.StructType(fields)

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [batch.column(c).to_pylist() for c in (text, *others)]
        out: dict[str, list] = {f.name: [] for f in fields[len(names) :]}
        last: dict[str, tuple] = {}
        for row in zip(*texts, strict=True):
            now = {x: last[x] if x in last else winnow(x, k, w) for x in set(row)}
            own = now[row[0]]
            out[name].append(show(*own))
            for x, (like, shown) in zip(row[1:], others.values(), strict=True):
                out[like].append(likeness(own[0], now[x][0]))
                if shown:
                    out[shown].append(show(*now[x]))
            last = now  # the next row often has the text that was this row's next
        keep = [batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(v) for v in out.values())], schema.names)

    return df.mapInArrow(per_batch(make, 500), schema)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "next_text", keys: DataFrame | None = None) -> DataFrame:
    """df with the text (or packed text) of the row that follows in descending order of key (nulls last; rows of equal
    key by text); the last row is followed by the first.

    The rows are dealt over ranges of the key, with bounds from Spark's own range partitioning of the keys alone (of the table
    `keys`, where one is given that has the same keys and is cheaper to read than df); each range also gets the
    first row of the range below as a ghost, and looks ahead within itself. So the texts are shuffled once, and no range
    holds more than its share of the keys. Keys are numbers. The bounds are shared with the tasks: four for each shuffle
    partition.
    """
    n = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = (df if keys is None else keys).select(F.col(key).alias("key")).where("key is not null")
    ends = known.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("range")).agg(F.max("key").alias("end")).collect()  # n rows at most
    top = max((r.end for r in ends), default=None)
    bounds = sorted({r.end for r in ends} - {top})
    shared = df.sparkSession.sparkContext.broadcast((bounds, set(bounds), top))
    names, (range_, ghost) = df.columns, unused(df, "range", "ghost")

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bounds, ends, top = shared.value
        rows, at, ghosts = [], [], []
        for i, k in enumerate(batch.column(key).to_pylist()):
            below = bisect_left(bounds, k) if k is not None else 0
            places = [(below, False)]
            if top is None or k == top:  # the last row is followed by the first
                places.append((0, True))
            elif k in ends:
                places.append((below + 1, True))
            for p, g in places:
                rows.append(i)
                at.append(p)
                ghosts.append(g)
        made = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*made.columns, pa.array(at, pa.int32()), pa.array(ghosts, pa.bool_())], [*names, range_, ghost])

    schema = T.StructType([*df.schema.fields, T.StructField(range_, T.IntegerType()), T.StructField(ghost, T.BooleanType())])
    dealt = df.mapInArrow(per_batch(deal), schema)
    order = [F.col(ghost), F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first()]
    ahead = F.lead(text).over(Window.partitionBy(range_).orderBy(*order))
    return dealt.withColumn(name, ahead).where(~F.col(ghost)).select(*[c for c in df.columns if c != name], name)
