"""Removal of repeated substrings by hash-compared suffix sorting.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id. Sorting the suffixes of
all documents in one place doesn't scale, so suffixes are brought together by anchors. Each string of SPAN bytes has one
anchor: its k-gram with the least hash, the rightmost one of several. Equal strings have equal anchors at equal places, so
only strings that hang on equal anchors need comparing. The strings of one anchor occurrence start side by side and
together cover its context.

1. Each batch of documents makes its anchor occurrences, with hashes of the k-gram, of the context and of the SIDE bytes on
   either side of the k-gram, and keeps for each context those of the least document; the others are repeats at once, if
   their bytes are those of the least document's. What is left is dealt out by anchor.
2. A context that a smaller document has too is a repeat as a whole: hashes of 32 bits of the k-gram, 64 of the context
   and 32 of its shape and sides must agree, and then the bytes: each such context is linked with the one before it in the
   order of documents, and links of one offset that touch are compared as one stretch of bytes. A context is the one before
   of at most one other, so what a document is compared with is bounded by its own length, however many copies it has.
   Contexts whose hashes agree where bytes differ are marked, and the step is done again without settling them by hashes.
   Of the others, two can share a string only if they share the SIDE bytes on one
   side, as a string has 2 * SIDE bytes besides its k-gram; those that share one with another document are passed on.
3. The bytes of these contexts meet by anchor. They are sorted twice, from the anchor on and from the anchor back, by a
   mergesort: prefix sums of a polynomial hash and a binary search give the common extension of two suffixes in
   logarithmic steps. All neighbours are checked byte by byte against hash collisions. Contexts that share a string stand
   side by side in both orders, which yields the least document of each string. Anchors with more than CROWD such contexts
   are not gathered: their strings are grouped one by one by SHA-256 digests, which finds the same.

Defined cases: ids are integers; null and empty texts and those below SPAN bytes have no strings; rows without an id neither lose bytes nor
take them from others; rows of equal id (repeated rows) don't take bytes from each other; texts of any length are worked
through in blocks; an empty table gives an empty table; other columns are kept, one named as the new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.llm.arrays import BASE, hash_spans, mix64, pack, per_batch, powers, text_bytes, unpacked, unused
from safespan.session import materialize

SPAN, K = 50, 16
SIDE = (SPAN - K) // 2
CROWD = 100_000
#: Bits of a context's hash that are used; fewer let the tests see hashes agree where bytes differ.
CONTEXT_BITS = 64
_BLOCK = 1 << 18
_LOW = (1 << 24) - 1
_LISTS = T.ArrayType(T.LongType())


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings, by doubling."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < K:
        h = h[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return mix64(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor occurrence: hashes of the k-gram and of the context (64 bits each), the index of the text, the start
    of the first string that hangs on it, and its shape: anchor - first and last - first (6 bits each) and hashes of the
    SIDE bytes before and behind the k-gram (10 bits each, 0 where the text has fewer)."""
    w = SPAN - K + 1
    out = []
    for lo in range(0, max(len(data) - SPAN + 1, 0), _BLOCK):
        m = min(_BLOCK, len(data) - SPAN + 1 - lo)
        pad = min(lo, SIDE)
        wide = data[lo - pad : lo + m + SPAN - 1 + SIDE]
        part = wide[pad : pad + m + SPAN - 1]
        grams = _grams(part)
        least = ((grams >> np.uint64(24)) << np.uint64(24)) | (np.uint64(_LOW) - np.arange(len(grams), dtype=np.uint64))
        size = 1
        while size * 2 <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
        valid = np.ones(m, bool)
        first, last = np.searchsorted(offsets, [lo + 1, lo + m + SPAN], "left")
        for e in offsets[first : last + 1].tolist():  # ends of texts: strings don't cross them
            valid[max(0, e - SPAN + 1 - lo) : max(0, e - lo)] = False
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        at = _LOW - (least[starts] & np.uint64(_LOW)).astype(np.int64)
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:], [len(starts)])) - 1
        a, s, e = at[begin], starts[begin], starts[end]
        doc = np.searchsorted(offsets, s + lo, "right") - 1
        context = hash_spans(part, s, e + SPAN)
        shape = (a - s).astype(np.uint64) << np.uint64(26) | (e - s).astype(np.uint64) << np.uint64(20)
        for begin_, bits, there in ((a - SIDE, 10, a + lo - SIDE >= offsets[doc]), (a + K, 0, a + lo + K + SIDE <= offsets[doc + 1])):
            h = np.zeros(len(a), np.uint64)
            x = begin_[there] + pad
            h[there] = hash_spans(wide, x, x + SIDE) % np.uint64(1023) + np.uint64(1)
            shape |= h << np.uint64(bits)
        out.append((grams[a], context, doc, s + lo - offsets[doc], shape))
    if not out:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_of_context(gram, context, shape, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by gram, context and document, whether each is of its context's least document, and the first row of its
    context."""
    same = (gram.astype(np.uint64) << np.uint64(32)) | shape.astype(np.uint64)
    order = np.lexsort((doc, same, context))
    x, y, d = same[order], context[order], doc[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(d)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    first = np.repeat(begin, np.diff(np.concatenate((begin, [len(d)]))))
    return order, d == d[first], order[first]


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size bytes (8 or more) from a and from b are the same, 8 at a time."""
    same = np.ones(len(a), bool)
    if len(a):
        eights = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), 0, (1,))
        for step in range(0, int(size.max()), 8):
            at = np.minimum(step, size - 8)
            same &= eights[a + at] == eights[b + at]
    return same


def _met(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each row's key occurs in another document too."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    size = np.diff(np.concatenate((begin, [len(k)])))
    out = np.empty(len(k), bool)
    out[order] = np.repeat(d[begin] != d[begin + size - 1], size)
    return out


def _lists(cuts: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    at = pa.array(cuts.astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(c))) for c in columns]


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))), [len(x)]))


_INTS = T.ArrayType(T.IntegerType())
_DEALT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("gram", _INTS), T.StructField("context", _LISTS), T.StructField("doc", _LISTS), T.StructField("start", _INTS), T.StructField("shape", _INTS)])
_FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("whole", _LISTS), T.StructField("before", _LISTS), T.StructField("shift", _LISTS), T.StructField("place", _LISTS), T.StructField("gram", _LISTS), T.StructField("crowded", T.BooleanType())])


def _ints(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32).view(np.int32)


def _by_doc(doc: np.ndarray, start: np.ndarray, shape: np.ndarray, gram: np.ndarray | None = None, crowded: bool = False, before: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """_FOUND rows, some thousands at a time. A place is start << 12 | (anchor - first) << 6 | (last - first). before: the
    document and the start of the context that each has yet to be compared with; shift is the difference of the starts."""
    order = np.argsort(doc, kind="stable")
    d = doc[order]
    place = (start.astype(np.int64) << 12 | (shape.astype(np.int64) >> 20))[order]
    cuts = _cuts(d)
    for i in range(0, len(cuts) - 1, 4000):
        c = cuts[i : i + 4001]
        n, part = len(c) - 1, slice(c[0], c[-1])
        none = _lists(np.zeros(n + 1), np.empty(0, np.int64))[0]
        places = _lists(c - c[0], place[part])[0]
        links = [none, none] if before is None else _lists(c - c[0], before[0][order][part], (start - before[1])[order][part].astype(np.int64))
        columns = [places, *links, none, none] if gram is None else [none, *links, places, _lists(c - c[0], gram[order][part].astype(np.int64))[0]]
        yield pa.RecordBatch.from_arrays([pa.array(d[c[:-1]]), *columns, pa.array([crowded] * n)], _FOUND.names)


def _deal(df: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Step 1: rows of anchor occurrences for each bucket; bucket -1 - b holds repeats found within a batch."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(batch.column(key).is_valid())
        data, offsets = text_bytes(batch.column(text))
        gram, context, doc, start, shape = anchors(data, offsets)
        context &= np.uint64((1 << CONTEXT_BITS) - 1)
        ids = batch.column(key).cast(pa.int64()).to_numpy(zero_copy_only=False)[doc] if len(doc) else doc
        order, least, first = _first_of_context(gram >> np.uint64(32), context, shape, ids)
        more = np.flatnonzero(~least)
        one, two = order[more], first[more]
        size = (shape[one] >> np.uint64(20)).astype(np.int64) % 64 + SPAN
        least[more] = ~_equal(data, offsets[doc[one]] + start[one], offsets[doc[two]] + start[two], size)
        for keep, again in ((order[least], False), (order[~least], True)):
            keep = np.sort(keep)  # in the order of the texts, which packs well
            bucket = (gram[keep] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            keep, bucket = keep[by], bucket[by]
            cuts = _cuts(bucket)
            if len(cuts) == 1:
                continue
            doc_, start_, shape_ = _lists(cuts, ids[keep], _ints(start[keep]), _ints(shape[keep]))
            if again:
                gram_, context_ = (pa.nulls(len(cuts) - 1, pa.list_(k)) for k in (pa.int32(), pa.int64()))
            else:
                gram_, context_ = _lists(cuts, _ints(gram[keep] >> np.uint64(32)), context[keep].view(np.int64))
            names = pa.array(-1 - bucket[cuts[:-1]] if again else bucket[cuts[:-1]])
            yield pa.RecordBatch.from_arrays([names, gram_, context_, doc_, start_, shape_], _DEALT.names)

    return df.select(key, text).mapInArrow(per_batch(make, 3000), _DEALT)


def _settle(dealt: DataFrame) -> DataFrame:
    """Step 2: places that are repeats as a whole, and places whose strings have yet to be compared. Rows of dealt without
    documents are marks: contexts of their hashes are never settled as a whole."""

    def flush(bucket: int, parts: list, marks: list) -> Iterator[pa.RecordBatch]:
        gram, context, doc, start, shape = (np.concatenate(x) for x in zip(*parts, strict=True))
        gram, shape = (x.view(np.uint32).astype(np.uint64) for x in (gram, shape))
        order, least, _ = _first_of_context(gram, context, shape, doc)
        marked = np.zeros(len(doc), bool)
        if marks:
            g, c, s = (np.concatenate(x) for x in zip(*marks, strict=True))
            g, s = (x.view(np.uint32).astype(np.uint64) for x in (g, s))
            marked = np.isin(context, c) & np.isin(gram << np.uint64(32) | shape, g << np.uint64(32) | s)
            least |= marked[order]
        again = np.flatnonzero(~least)
        last, again = order[again - 1], order[again]
        yield from _by_doc(doc[again], start[again], shape[again], before=(doc[last], start[last]))
        one = order[least]
        g, d, s = gram[one], doc[one], shape[one]
        open_ = marked[one]
        for bits in (10, 0):
            side = (s >> np.uint64(bits)) & np.uint64(1023)
            has = np.flatnonzero(side)
            open_[has] |= _met(g[has] << np.uint64(10) | side[has], d[has])
        one, g = one[open_], g[open_]
        _, which, count = np.unique(g, return_inverse=True, return_counts=True)
        crowd = count[which] > CROWD
        for there in (False, True):
            x = one[crowd == there]
            # the bucket tells grams of equal upper halves apart
            yield from _by_doc(doc[x], start[x], shape[x], gram[x] << np.uint64(24) | np.uint64(bucket & 0xFFFFFF), there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, marks = None, [], []
        for batch in batches:
            lists = [batch.column(i) for i in range(1, 6)]
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                row = [np.asarray(c[i].values) if c[i].values is not None else None for c in lists]
                if bucket < 0:
                    yield from _by_doc(row[2], row[3], row[4].view(np.uint32))
                    continue
                if bucket != now:
                    if parts:
                        yield from flush(now, parts, marks)
                    now, parts, marks = bucket, [], []
                if row[2] is None:
                    marks.append((row[0], row[1], row[4]))
                else:
                    parts.append(row)
        if parts:
            yield from flush(now, parts, marks)

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # buckets are equally many in each task; repeats found within a batch may go anywhere
    to = F.expr(f"cast(pmod(if(bucket < 0, xxhash64(doc), bucket), {n}) as int)")
    return dealt.repartitionById(n, to).sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


_ASKED = T.StructType([T.StructField("before", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("start", _LISTS), T.StructField("shift", _LISTS), T.StructField("size", _LISTS), T.StructField("bytes", T.BinaryType())])


def _unequal(packed: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """doc, start and end of stretches of bytes that aren't those of the contexts they are linked with: none, unless hashes
    collide."""
    texts = packed.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("packed"))
    lists = ("whole", "before", "shift")
    links = found.where(F.size("before") > 0).groupBy("doc").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        rows = []
        for d, raw, *row in zip(batch.column("doc").to_pylist(), unpacked(batch.column("packed")), *(batch.column(c) for c in lists), strict=True):
            place, before, shift = (np.asarray(x.values) for x in row)
            order = np.lexsort((place, shift, before))
            place, before, shift = place[order], before[order], shift[order]
            start, end = place >> 12, (place >> 12) + (place & 63) + SPAN
            new = np.concatenate(([True], (before[1:] != before[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > end[:-1])))
            begin = np.flatnonzero(new)
            start, end, before, shift = start[begin], end[np.concatenate((begin[1:], [len(new)])) - 1], before[begin], shift[begin]
            cuts = _cuts(before)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                parts = b"".join(raw[s:e] for s, e in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True))
                rows.append((before[lo], d, start[lo:hi], shift[lo:hi], (end - start)[lo:hi], press(parts)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _ASKED.names)

    asked = texts.join(links, "doc").select("doc", "packed", *lists).mapInArrow(per_batch(ask, 500), _ASKED)
    asked = asked.groupBy("before").agg(F.collect_list(F.struct(*_ASKED.names[1:])).alias("asked"))

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wrong = []
        for raw, rows in zip(unpacked(batch.column("packed")), batch.column("asked"), strict=True):
            for row in rows:
                row = row.as_py()
                parts, at = zstandard.ZstdDecompressor().decompress(row["bytes"]), 0
                for s, shift, n in zip(row["start"], row["shift"], row["size"], strict=True):
                    if raw[s - shift : s - shift + n] != parts[at : at + n]:
                        wrong.append((row["doc"], s, s + n))
                    at += n
        columns = list(zip(*wrong, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "start", "end"])

    held = texts.join(asked, texts["doc"] == asked["before"]).select("packed", "asked")
    return held.mapInArrow(per_batch(compare, 500), "doc long, start long, end long")


def _marks(df: DataFrame, key: str, text: str, wrong: DataFrame, buckets: int) -> DataFrame:
    """Rows for _settle that mark the contexts within unequal stretches."""
    doc_, starts_, ends_ = unused(df.select(key, text), "doc", "starts", "ends")
    spans = wrong.groupBy(F.col("doc").alias(doc_)).agg(F.collect_list("start").alias(starts_), F.collect_list("end").alias(ends_))

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        gram, context, doc, start, shape = anchors(*text_bytes(batch.column(text)))
        context &= np.uint64((1 << CONTEXT_BITS) - 1)
        within = np.zeros(len(doc), bool)
        for i, (starts, ends) in enumerate(zip(batch.column(starts_).to_pylist(), batch.column(ends_).to_pylist(), strict=True)):
            for s, e in zip(starts, ends, strict=True):
                within |= (doc == i) & (start >= s) & (start < e)
        gram, context, shape = gram[within], context[within], shape[within]
        one = np.arange(len(gram) + 1)
        none = [pa.nulls(len(gram), pa.list_(k)) for k in (pa.int64(), pa.int32())]
        gram_, context_, shape_ = _lists(one, _ints(gram >> np.uint64(32)), context.view(np.int64), _ints(shape))
        yield pa.RecordBatch.from_arrays([pa.array((gram % np.uint64(buckets)).astype(np.int64)), gram_, context_, *none, shape_], _DEALT.names)

    texts = df.select(key, text)
    return texts.join(spans, texts[key] == spans[doc_]).select(text, starts_, ends_).mapInArrow(per_batch(make, 500), _DEALT)


_CONTEXT = T.StructType([T.StructField("gram", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("place", T.LongType()), T.StructField("bytes", T.BinaryType())])


def _contexts(packed: DataFrame, key: str, text: str, places: DataFrame) -> DataFrame:
    """The bytes of the open contexts: the strings of one occurrence, side by side."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        for d, raw, places_, grams in zip(batch.column("doc").to_pylist(), unpacked(batch.column("packed")), batch.column("place"), batch.column("gram"), strict=True):
            for p, g in zip(places_.as_py(), grams.as_py(), strict=True):
                rows.append((g, d, p, raw[p >> 12 : (p >> 12) + (p & 63) + SPAN]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _CONTEXT.names)

    texts = packed.select(F.col(key).alias("doc"), F.col(text).alias("packed"))
    joined = texts.join(places, "doc").select("doc", "packed", "place", "gram")
    return joined.mapInArrow(per_batch(make, 500), _CONTEXT)


class Suffixes:
    """Bounded suffixes of one byte buffer (suffix i: size[i] bytes from at[i]), compared by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.data, self.at, self.size = data, at, size
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes i and j share: binary search over hashes of prefixes."""
        a, b = self.at[i], self.at[j]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[i], self.size[j])
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = (self.sums[a + mid] - self.sums[a]) * self.down[a] == (self.sums[b + mid] - self.sums[b]) * self.down[b]
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i is less than suffix j; one that the other goes on from is less."""
        n = self.common(i, j)
        last = len(self.data) - 1
        ended_i, ended_j = n == self.size[i], n == self.size[j]
        return ~ended_j & (ended_i | (self.data[np.minimum(self.at[i] + n, last)] < self.data[np.minimum(self.at[j] + n, last)]))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """An order of the suffixes by group and, within one, by their bytes: a mergesort in which all pairs of
        neighbouring runs merge at once, each element finding its rank in the other run by binary search."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        begin = _cuts(g)[:-1]
        size = np.diff(np.concatenate((begin, [len(g)])))
        first, count = np.repeat(begin, size), np.repeat(size, size)
        within = np.arange(len(g)) - first
        width = 1
        while width < size.max(initial=0):
            run = within // width
            other = run ^ 1
            o_lo = np.minimum(other * width, count)
            o_hi = np.minimum(o_lo + width, count)
            act = np.flatnonzero(o_hi > o_lo)
            base, lo, hi = first[act] + o_lo[act], np.zeros(len(act), np.int64), (o_hi - o_lo)[act]
            me, later = order[act], (run[act] & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                it = order[base[open_] + mid]
                # elements of the later run come after equal ones of the earlier run
                is_later = later[open_]
                less = self.before(np.where(is_later, me[open_], it), np.where(is_later, it, me[open_])) ^ is_later
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            target = np.arange(len(g))
            target[act] = first[act] + np.minimum(run[act], other[act]) * width + (within[act] - run[act] * width) + lo
            merged = order.copy()
            merged[target] = order
            order = merged
            width *= 2
        return order

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and how many bytes each suffix in it shares with the one before it (-1 at the start of a group). Every
        pair of neighbours is checked byte by byte; should a hash collision have misled the sort, bytes alone decide."""
        order = self.sort(group)
        shared = self._neighbours(order, group, self.common)
        if (np.bincount(order, minlength=len(order)) != 1).any() or not self._checked(order, group, shared):
            most = int(self.size.max(initial=0))
            column = np.arange(most)
            wide = np.where(column < self.size[:, None], self.data[np.minimum(self.at[:, None] + column, len(self.data) - 1)].astype(np.int16), np.int16(-1))
            order = np.lexsort((*wide.T[::-1], group))
            shared = self._neighbours(order, group, lambda i, j: np.cumprod((wide[i] == wide[j]) & (wide[i] >= 0), axis=1).sum(axis=1))
        return order, shared

    @staticmethod
    def _neighbours(order: np.ndarray, group: np.ndarray, common) -> np.ndarray:
        shared = np.full(len(order), -1)
        near = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        shared[near] = common(order[near - 1], order[near])
        return shared

    def _checked(self, order: np.ndarray, group: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours share as many bytes as the hashes say, and stand in the order of the next byte."""
        near = np.flatnonzero(shared >= 0)
        i, j, n = order[near - 1], order[near], shared[near]
        for step in range(int(n.max(initial=0))):
            on = step < n
            if (self.data[self.at[i[on]] + step] != self.data[self.at[j[on]] + step]).any():
                return False
        on = n < np.minimum(self.size[i], self.size[j])
        if (self.data[self.at[i[on]] + n[on]] >= self.data[self.at[j[on]] + n[on]]).any():
            return False
        return bool((self.size[i[~on]] <= self.size[j[~on]]).all())


def repeated(gram: np.ndarray, doc: np.ndarray, place: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of the strings that a smaller document has too, among whole anchor groups. data holds the bytes
    of the contexts end to end.

    A string that starts s bytes before the anchor is equal in two contexts if they share SPAN - s bytes from the anchor on
    and s bytes before it. So each context is sorted twice: by its suffix from the anchor on, and by the bytes before the
    anchor, read backwards. In either order, contexts that share n bytes stand side by side."""
    by_doc = np.argsort(doc, kind="stable")
    gram, doc, place, base = gram[by_doc], doc[by_doc], place[by_doc], offsets[:-1][by_doc]
    left, more = (place >> 6) & 63, place & 63
    _, group = np.unique(gram, return_inverse=True)
    right = Suffixes(data, base + left, more + SPAN - left)
    last = len(data)
    back = Suffixes(np.ascontiguousarray(data[::-1]), last - (base + left), left)
    order_r, shared_r = right.sorted(group)
    order_b, shared_b = back.sorted(group)
    where_r, where_b = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    where_r[order_r], where_b[order_b] = np.arange(len(doc)), np.arange(len(doc))
    docs, starts = [doc[:0]], [place[:0]]
    for s in range(SPAN - K + 1):
        has = np.flatnonzero((s <= left) & (left - s <= more))
        if len(has) < 2:
            continue
        # contexts of one class at these depths have the same string; the lists are in the order of documents
        key = np.cumsum(shared_r < SPAN - s)[where_r[has]] * np.int64(len(doc) + 1) + np.cumsum(shared_b < s)[where_b[has]]
        order = np.argsort(key, kind="stable")
        cuts = _cuts(key[order])
        least = np.repeat(doc[has[order[cuts[:-1]]]], np.diff(cuts))
        found = has[order[doc[has[order]] > least]]
        docs.append(doc[found])
        starts.append((place[found] >> 12) + left[found] - s)
    return np.concatenate(docs), np.concatenate(starts)


def _compare(contexts: DataFrame) -> DataFrame:
    """Step 3: doc and place of the strings that are repeats, each as a place of one string."""
    schema = "doc long, place long"

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        d, s = repeated(*(t.column(n).to_numpy() for n in ("gram", "doc", "place")), *text_bytes(t.column("bytes")))
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s.astype(np.int64) << 12, pa.int64())], ["doc", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            g = batch.column("gram").to_numpy()
            if parts and len(g) and rows >= 20_000 and parts[-1].column("gram")[-1].as_py() != g[0]:
                yield flush(parts)
                parts, rows = [], 0
            at = 0
            for cut in (np.flatnonzero(g[1:] != g[:-1]) + 1).tolist() + [len(g)]:
                # only whole groups are compared: the last of a batch may reach into the next
                if cut < len(g) and rows + cut - at < 20_000:
                    continue
                parts.append(batch.slice(at, cut - at))
                rows += cut - at
                at = cut
                if cut < len(g):
                    yield flush(parts)
                    parts, rows = [], 0
        if parts:
            yield flush(parts)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, schema)


def _compare_crowds(contexts: DataFrame) -> DataFrame:
    """The same by grouping single strings, for anchors with very many contexts."""
    strings = contexts.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("place").bitwiseAND(63).cast("int"))))
    strings = strings.withColumn("string", F.sha2(F.substring("bytes", F.col("step") + 1, F.lit(SPAN)), 256))
    least = strings.groupBy("string").agg(F.min("doc").alias("least"))
    return strings.join(least, "string").where("doc > least").select("doc", F.expr("((place >> 12) + step) << 12").alias("place"))


def find_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "repeats") -> DataFrame:
    """df with the byte spans of each text that strings of smaller documents cover, joined and in order:
    array<struct<start: bigint, end: bigint>>."""
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, packed = _deal(df, key, text, buckets), pack(df, text)
    while True:
        found = materialize(_settle(dealt), "repeats")
        wrong = materialize(_unequal(packed, key, text, found), "unequal")
        if wrong.isEmpty():
            break
        dealt = dealt.unionByName(materialize(_marks(df, key, text, wrong, buckets), "marks"))
    parts = [found.where(F.size("whole") > 0).select("doc", F.col("whole").alias("places"))]
    for crowded, compare in ((False, _compare), (True, _compare_crowds)):
        some = found.where((F.size("place") > 0) & (F.col("crowded") == crowded))
        if some.isEmpty():
            continue
        places = some.groupBy("doc").agg(F.flatten(F.collect_list("place")).alias("place"), F.flatten(F.collect_list("gram")).alias("gram"))
        single = compare(_contexts(packed, key, text, places))
        parts.append(single.groupBy("doc").agg(F.collect_list("place").alias("places")))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    doc_, places_ = unused(df, "doc", "places")
    spans = spans.groupBy(F.col("doc").alias(doc_)).agg(F.flatten(F.collect_list("places")).alias(places_))
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts, ends, sizes = [], [], [0]
        for places in batch.column(places_):
            p = np.sort(np.asarray(places.values)) if places.values is not None else np.empty(0, np.int64)
            s = p >> 12
            reach = np.maximum.accumulate(s + (p & 63) + SPAN)
            new = np.concatenate((np.ones(min(1, len(s)), bool), s[1:] > reach[:-1]))
            starts.append(s[new])
            ends.append(reach[np.concatenate((new[1:], np.ones(min(1, len(s)), bool)))])
            sizes.append(int(new.sum()))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (starts, ends)], ["start", "end"])
        made = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), flat)
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (name, places_)}
        whole = pa.array(unpacked(keep[text]), pa.binary()).cast(pa.string())
        keep[text] = pc.if_else(keep[text].is_valid(), whole, pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([*keep.values(), made], [*keep, name])

    joined = packed.join(spans, packed[key] == spans[doc_], "left").drop(doc_)
    return joined.mapInArrow(per_batch(make, 500), schema)


def cut(df: DataFrame, text: str = "text", spans: str = "repeats", name: str = "kept") -> DataFrame:
    """df with the bytes of each text outside of the spans (binary)."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.BinaryType())])

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(text))
        out: list[bytes] = []
        for i, found in enumerate(batch.column(spans).to_pylist()):
            raw, parts, at = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
            for s in found or []:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            out.append(b"".join([*parts, raw[at:]]))
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name}
        yield pa.RecordBatch.from_arrays([*keep.values(), pa.array(out, pa.binary())], [*keep, name])

    return df.mapInArrow(per_batch(make, 500), schema)
