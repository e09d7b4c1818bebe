"""Importance resampling towards a target distribution, with hashed word and word-pair counts.

A feature is a run of one or two words joined by a space; its bucket is the crc32 of its bytes modulo `dims`. A bucket's
gain is the log ratio of its smoothed shares in the target and in all documents, in whole thousandths; a document's weight
is the floored mean of the gains of its features, and its score adds Gumbel noise made from its id. The highest scores are
drawn, which is sampling without replacement by the weights.

Lines repeat far more than documents, so a text is cut at its newlines, which no word holds, into lines:

- `lines`: the features of each distinct line are found once, and count as often as the line occurs;
- `documents`: a document keeps which lines it has and how often, and its features across lines, the pairs of the last
  word of a line and the first of the next line that has one;
- gains are summed once for each distinct line and joined to the documents that have it. Lines that make up more than a
  100,000th of all are joined by broadcast (so there are at most 100,000 of them), all others by a shuffle, in which no
  key then has more than that share.

Only `dims` counts, a fixed number, reach the driver and the tasks. The rank is found by ranges of the score.

Defined cases: null and empty texts and texts without words have no features and weight 0; documents below `least` words
are never drawn; ties of the score go to the smaller id, and then to any; null ids make their noise from an empty id and
come first among ties; repeated rows count each; without target texts all gains compare with an even distribution; an empty
table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from safespan.llm.arrays import LOWER, per_batch, runs, text_bytes, words
from safespan.operators.ranges import PART, dealt
from safespan.session import materialize

DIMS, PERCENT, LEAST, SEED = 10_000, 25, 20, 7
#: Lines are joined by broadcast from this share of all on (one in so many), and from so many occurrences.
SHARE, OFTEN = 100_000, 1000
APART = np.ones(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    APART[_low:_high] = False
#: Bytes of a word hashed in step with others; longer words are hashed one by one.
STEPS = 48


def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x.astype(np.uint32)


TABLE = _table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray | int = 0) -> np.ndarray:
    """The crc32 of each span of bytes, going on from the values `begin`."""
    sizes = ends - starts
    state = (np.zeros(len(starts), np.uint32) + np.asarray(begin, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(sizes, STEPS + 1), kind="stable")
    long = int((sizes > STEPS).sum())
    first, s = starts[order], state[order]
    counts = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(STEPS), "right")  # spans with more than j bytes
    for j in range(min(STEPS, int(sizes.max(initial=0)))):
        n = int(counts[j])
        part = s[long:n]
        s[long:n] = TABLE[(part ^ data[first[long:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    state[order] = s
    state ^= np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return state


def buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and of each word with the one behind it."""
    ones = crc32(data, starts, ends)
    blank = np.array([0x20], np.uint8)
    spaced = crc32(blank, np.zeros(max(len(ones) - 1, 0), np.int64), np.ones(max(len(ones) - 1, 0), np.int64), ones[:-1])
    return (ones % dims).astype(np.uint16), (crc32(data, starts[1:], ends[1:], spaced) % dims).astype(np.uint16)


def _blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of runs of 16-bit values."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array) -> list[bytes | None]:
    return [None if x is None else x.lower() for x in column.cast(pa.binary()).to_pylist()]  # of bytes, only A-Z change


def lines(docs: DataFrame, text: str, dims: int) -> DataFrame:
    """key (128 bits of its hash), n (occurrences) and features (buckets) of each distinct line of the texts."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for t in _bytes(batch.column(text)):
            if t:
                found.update(filter(None, t.split(b"\n")))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["line", "n"])

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column("line"))
        for i, j in runs(offsets):
            part = data[offsets[i] : offsets[j]]
            rows = offsets[i : j + 1] - offsets[i]
            starts, ends, at = words(part, rows, APART)
            ones, twos = buckets(part, starts, ends, dims)
            counts = np.diff(at)
            sizes = np.maximum(2 * counts - 1, 0)  # a line's features: each word, and each with the next one
            to = np.concatenate(([0], np.cumsum(sizes)))
            row = np.repeat(np.arange(j - i), counts)
            place = to[row] + 2 * (np.arange(len(starts)) - at[row])
            made = np.zeros(int(to[-1]), np.uint16)
            made[place] = ones
            inner = np.flatnonzero(row[1:] == row[:-1])
            made[place[inner] + 1] = twos[inner]
            keys = [xxhash.xxh3_128_digest(part[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("n").slice(i, j - i), _blobs(made, to)], ["key", "n", "features"])

    found = docs.select(text).mapInArrow(per_batch(cut), "line binary, n long").groupBy("line").agg(F.sum("n").alias("n"))
    return found.mapInArrow(per_batch(features, rows=20_000), "key binary, n long, features binary")


def documents(docs: DataFrame, id: str, text: str, dims: int) -> DataFrame:
    """id, n (words), own (keys and counts of its lines) and across (buckets of pairs across lines) of each document."""
    schema = f"id {docs.schema[id].dataType.simpleString()}, n long, own array<struct<key:binary,n:long>>, across binary"

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(text))
        kind = pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))
        for i, j in runs(offsets):
            part = LOWER[data[offsets[i] : offsets[j]]]
            rows = offsets[i : j + 1] - offsets[i]
            starts, ends, at = words(part, rows, APART)
            line = np.cumsum(part == 0x0A)[starts]
            row = np.repeat(np.arange(j - i), np.diff(at))
            cross = np.flatnonzero((row[1:] == row[:-1]) & (line[1:] != line[:-1]))
            both = np.unique(np.concatenate((cross, cross + 1)))
            _, twos = buckets(part, starts[both], ends[both], dims)
            own = []
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                found = Counter(filter(None, part[a:b].tobytes().split(b"\n")))
                own.append([{"key": xxhash.xxh3_128_digest(x), "n": n} for x, n in found.items()])
            of = np.searchsorted(row[cross], np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([batch.column(id).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(own, kind), _blobs(twos[np.searchsorted(both, cross)], of)], ["id", "n", "own", "across"])

    return docs.select(id, text).mapInArrow(per_batch(make), schema)


def counts(found: DataFrame, docs: DataFrame, dims: int) -> np.ndarray:
    """How often each bucket occurs: the features of distinct lines times their occurrences, and those across lines."""

    def add(name: str, times: str | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(dims, np.int64)
            for batch in batches:
                data, offsets = text_bytes(batch.column(name))
                often = None if times is None else np.repeat(batch.column(times).to_numpy(), np.diff(offsets) // 2)
                total += np.bincount(data.view(np.uint16), often, dims).astype(np.int64)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

        return run

    parts = found.select("n", "features").mapInArrow(add("features", "n"), "bucket long, n long").union(docs.select("across").mapInArrow(add("across", None), "bucket long, n long"))
    out = np.zeros(dims, object)  # of unbounded integers
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most dims rows
        out[r.bucket] = r.n
    return out


def gains(all_: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket."""
    dims, s, t = len(all_), int(all_.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((int(b) + 1) * (s + dims)) / float((int(a) + 1) * (t + dims)))) for a, b in zip(all_, target, strict=True)], np.int64)


def _sums(gain: np.ndarray, name: str, kept: list[str]) -> Callable:
    """For mapInArrow: the kept columns and the sum of the gains of the buckets in a column."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(name))
        sums = np.concatenate(([0], np.cumsum(gain[data.view(np.uint16)])))
        made = sums[offsets[1:] // 2] - sums[offsets[:-1] // 2]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(made, pa.int64())], [*kept, "gain"])

    return per_batch(make, rows=10_000)


def weights(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", dims: int = DIMS) -> DataFrame:
    """id, n_words, n_features and weight of each document."""
    found = materialize(lines(docs, text, dims), "lines")
    rows = materialize(documents(docs, id, text, dims).withColumn("row", F.monotonically_increasing_id()), "documents")
    few = target.select(F.lit(0).alias("id"), F.col(text).alias("text"))
    gain = gains(counts(found, rows, dims), counts(lines(few, "text", dims), documents(few, "id", "text", dims), dims))

    total = found.agg(F.sum("n")).first()[0] or 0
    line = found.mapInArrow(_sums(gain, "features", ["key", "n"]), "key binary, n long, gain long").withColumnRenamed("n", "often")
    held = rows.select("row", F.explode("own").alias("o")).select("row", "o.key", "o.n")
    hot = materialize(line.where(F.col("often") >= max(OFTEN, total // SHARE)).drop("often"), "hot")  # SHARE rows at most
    near = held.join(F.broadcast(hot), "key", "left")
    own = near.where("gain is not null").union(near.where("gain is null").drop("gain").join(line.drop("often"), "key"))
    across = rows.where("octet_length(across) > 0").select("row", "across").mapInArrow(_sums(gain, "across", ["row"]), "row long, gain long")
    sums = own.select("row", (F.col("n") * F.col("gain")).alias("gain")).union(across).groupBy("row").agg(F.sum("gain").alias("gain"))
    out = rows.select("row", F.col("id").alias(id), F.col("n").alias("n_words")).join(sums, "row", "left").drop("row")
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    mean = F.expr("(gain - pmod(gain, n_features)) div n_features")  # floors go down
    return out.withColumn("n_features", n.cast("long")).withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(0).cast("long")).drop("gain")


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (from 1, null for those not drawn) of each document."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, target, id, text, dims).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = materialize(scored, "scored")
    ranges = dealt(scored.where(F.col("n_words") >= least), F.struct(-F.col("score"), F.col(id)))
    sizes = ranges.groupBy(PART).count()
    before = sizes.select(PART, (F.sum("count").over(Window.orderBy(PART)) - F.col("count")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy(PART).orderBy(F.desc("score"), F.asc(id)))
    most = ranges.count() * percent // 100
    ranked = ranges.withColumn("_place", place).join(F.broadcast(before), PART)
    rank = (F.col("_place") + F.col("_before")).cast("long")
    drawn = ranked.withColumn("rank", F.when(rank <= most, rank)).drop("_place", "_before", PART)
    return drawn.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
