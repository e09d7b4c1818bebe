"""Quality by perplexity under an interpolated modified Kneser-Ney model of bytes.

The model of order ORDER is trained on trusted texts. Tasks count their n-grams, and the counts meet in a shuffle; all
further tables (continuation counts, discounts, context weights, probabilities) are joins and groupings of sharded count
tables. A document's perplexity is held against a quantile of its language's trusted documents that were kept out of
training.

For scoring, probabilities and context weights go to the tasks in shards of about SHARD rows. A shard has all rows of
some two-byte contexts, on which every lookup of a position depends, so each shard answers its positions completely and
the sums of a text's shards add up. Contexts are dealt to shards by their counted rows, the largest first. Up to TOGETHER
shards are scored in one reading of the texts; the sums of several readings are added by id and text, whatever the number
of equal rows. What orders 1 and 2 need has 65,536 rows at most and goes with every shard.

Defined cases: null and empty texts have perplexity 1 and are kept; short texts are judged by a mean that is drawn to
their language's median (PRIOR bytes of it), as a few bytes say little; languages without trusted texts (and null) use
the limit of all trusted texts, and without any trusted text all are kept; repeated rows score alike and stay
apart, whatever the number of shards; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.llm.arrays import LOWER, Lookup, hash_spans, per_batch, runs, text_bytes, unused
from safespan.session import materialize

ORDER = 5
SHARD = 3_000_000
TOGETHER = 4
PRIOR = 60
QUANTILE = 0.99
SLACK = 1.05
#: Rows of labels that are sent to every task; more are joined by shuffling.
BROADCAST_ROWS = 2_000_000


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """At each byte, the byte and the ORDER - 1 bytes before it in its text (0 before the start), the byte itself lowest."""
    x = LOWER[data].astype(np.uint64)
    out = x.copy()
    for j in range(1, ORDER):
        out[j:] |= x[:-j] << np.uint64(8 * j)
    starts, ends = offsets[:-1], offsets[1:]
    for i in range(ORDER - 1):
        at = starts[starts + i < ends] + i
        out[at] &= np.uint64((1 << 8 * (i + 1)) - 1)
    return out


def count_grams(df: DataFrame, text: str = "text") -> DataFrame:
    """gram and n over all texts."""

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(text))
        for i, j in runs(offsets, 1 << 23):
            g, n = np.unique(grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return df.select(text).mapInArrow(per_batch(make, 5000), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> tuple[DataFrame, list[float]]:
    """rows (kind, gram, value) for orders 3 to ORDER, kind m for the probability of a seen gram of order m and -m for the
    weight of a context of m - 1 bytes; and the probabilities of all pairs of bytes (256 * context + byte)."""
    tables = {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):  # in how many ways a shorter gram is continued to the left
        low = F.col("gram").bitwiseAND((1 << 8 * m) - 1)
        tables[m] = materialize(tables[m + 1].groupBy(low.alias("gram")).agg(F.count("*").alias("n")), f"order{m}")
    pairs = np.full(65536, 1 / 256)
    rows, below = None, None
    for m in range(1, ORDER + 1):
        t = tables[m]
        n1, n2, n3, n4 = (x or 0 for x in t.agg(*[F.sum((F.col("n") == i).cast("long")) for i in range(1, 5)]).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [y_ if 0 < y_ < i else 0.5 * i for i, y_ in ((1, 1 - 2 * y * n2 / max(n1, 1)), (2, 2 - 3 * y * n3 / max(n2, 1)), (3, 3 - 4 * y * n4 / max(n3, 1)))]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("context", F.shiftright("gram", 8)).withColumn("off", off)
        contexts = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("offs"))
        if m <= 2:  # at most 65,536 rows
            seen = np.zeros(65536 if m == 2 else 256)
            weight = np.ones(256 if m == 2 else 1)
            for r in t.join(contexts, "context").select("gram", "context", (F.col("n") - F.col("off")) / F.col("total"), F.col("offs") / F.col("total")).collect():
                seen[r[0]], weight[r[1]] = r[2], r[3]
            pairs = np.tile(seen + weight[0] / 256, 256) if m == 1 else seen + np.repeat(weight, 256) * pairs
            if m == 2:
                below = counts.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(pairs)], "low long, under double")
            continue
        low = F.col("gram").bitwiseAND((1 << 8 * (m - 1)) - 1)
        made = t.join(contexts, "context").withColumn("low", low).join(below, "low")
        made = made.select("gram", ((F.col("n") - F.col("off") + F.col("offs") * F.col("under")) / F.col("total")).alias("value"))
        made = materialize(made, f"probability{m}")
        part = made.select(F.lit(m).alias("kind"), "gram", "value").unionByName(contexts.select(F.lit(-m).alias("kind"), F.col("context").alias("gram"), (F.col("offs") / F.col("total")).alias("value")))
        rows = part if rows is None else rows.unionByName(part)
        below = made.select(F.col("gram").alias("low"), F.col("value").alias("under"))
    return materialize(rows, "model"), pairs.tolist()


class Scorer:
    """Scores the positions whose context lies in one shard. shard_of: the shard of each two-byte context."""

    def __init__(self, kind: np.ndarray, gram: np.ndarray, value: np.ndarray, pairs: list[float], shard: int, shard_of: np.ndarray):
        self.tables = {k: Lookup(gram[kind == k].view(np.uint64), value[kind == k].astype(np.float32)) for m in range(3, ORDER + 1) for k in (m, -m)}
        self.pairs = np.array(pairs)
        self.shard, self.shard_of = shard, shard_of

    def loss(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text the sum of -ln p over its bytes whose context lies in this shard."""
        g = grams(data, offsets)
        out = np.zeros(len(g))
        rest = np.flatnonzero(self.shard_of[((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)] == self.shard)
        weight = np.ones(len(rest))
        for m in range(ORDER, 2, -1):
            key = g[rest] & np.uint64((1 << 8 * m) - 1)
            p = self.tables[m].find(key)
            hit = p >= 0
            out[rest[hit]] = -np.log(weight[hit] * p[hit])
            rest, weight, key = rest[~hit], weight[~hit], key[~hit]
            w = self.tables[-m].find(key >> np.uint64(8))
            weight = np.where(w >= 0, weight * w, weight)
        out[rest] = -np.log(weight * self.pairs[(g[rest] & np.uint64(0xFFFF)).astype(np.int64)])
        sums = np.concatenate(([0.0], np.cumsum(out)))
        return sums[offsets[1:]] - sums[offsets[:-1]]


_scorers: list = [None, None]


def _ready(shared: dict, pairs: list[float], shard_of: np.ndarray) -> list[Scorer]:
    """The scorers of these shards, made once in a worker. Tasks reach them by this function's name: what a task's own
    function names is copied into it."""
    first = next(iter(shared.values())).value
    if _scorers[0] is not first:
        _scorers[:] = [None, None]  # the old ones go before new ones are made
        _scorers[:] = [first, [Scorer(*x.value, pairs, i, shard_of) for i, x in shared.items()]]
    return _scorers[1]


def dealt(rows: DataFrame, near: F.Column) -> np.ndarray:
    """The shard of each two-byte context: at most 65,536 counts, dealt to the emptiest shard, the largest first."""
    counts = {r[0]: r[1] for r in rows.groupBy(near).count().collect()}
    shards = max(1, -(-sum(counts.values()) // SHARD))
    shard_of = (np.arange(65536) % shards).astype(np.int32)  # unseen contexts need no rows
    heap = [(0, i) for i in range(shards)]
    for context, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        size, i = heappop(heap)
        shard_of[context] = i
        heappush(heap, (size + n, i))
    return shard_of


def losses(df: DataFrame, rows: DataFrame, pairs: list[float], key: str, text: str, keep: list[str]) -> DataFrame:
    """The kept columns with nll (the sum of -ln p over all bytes) and n_bytes."""
    near = F.when(F.col("kind") > 0, F.shiftright("gram", 8)).otherwise(F.col("gram")).bitwiseAND(0xFFFF)
    shard_of = dealt(rows, near)
    shards, context, parts = int(shard_of.max()) + 1, df.sparkSession.sparkContext, []
    marks = unused(df, "text_a", "text_b")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("nll", T.DoubleType()), T.StructField("n_bytes", T.LongType())] + [T.StructField(m, T.LongType()) for m in marks])
    for first in range(0, shards, TOGETHER):
        shared = {}
        for shard in range(first, min(first + TOGETHER, shards)):
            held = [int(c) for c in np.flatnonzero(shard_of == shard)]
            got = (rows.where(near.isin(held)) if shards > 1 else rows).toArrow()
            columns = [got.column(n).to_numpy() for n in ("kind", "gram", "value")]
            shared[shard] = context.broadcast((columns[0].astype(np.int8), columns[1], columns[2].astype(np.float32)))  # about SHARD rows

        def make(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            scorers = _ready(shared, pairs, shard_of)
            data, offsets = text_bytes(batch.column(text))
            sums = [sum(s.loss(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for s in scorers) for i, j in runs(offsets, 1 << 19)]
            whole = [hash_spans(data, offsets[:-1], offsets[1:]), hash_spans(data[::-1], (len(data) - offsets[1:])[::-1], (len(data) - offsets[:-1])[::-1])[::-1]]
            columns = [*(batch.column(c) for c in keep), pa.array(np.concatenate([np.empty(0), *sums])), pa.array(np.diff(offsets)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in whole)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

        parts.append(materialize(df.select(*dict.fromkeys([*keep, text])).mapInArrow(per_batch(make), schema), "losses"))
    if len(parts) == 1:
        return parts[0].drop(*marks)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy(*keep, "n_bytes", *marks).agg(F.sum("nll").alias("nll"), (F.count("*") / len(parts)).cast("int").alias("_copies"))
    return out.select(*keep, (F.col("nll") / F.col("_copies")).alias("nll"), "n_bytes", F.explode(F.sequence(F.lit(1), "_copies"))).drop("col")


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """key, lang, perplexity, limit and keep. labels has the keys of trusted documents: four fifths of them train the
    model, the others set the limits."""
    labels = labels.select(key).where(F.col(key).isNotNull()).distinct()
    aside = F.crc32(F.col(key).cast("string")) % 5 == 0
    if labels.count() <= BROADCAST_ROWS:
        labels = F.broadcast(labels)
    counts = materialize(count_grams(df.join(labels.where(~aside), key, "left_semi"), text), "counts")
    rows, pairs = model(counts)
    scored = losses(df, rows, pairs, key, text, [key, lang])
    mean = F.col("nll") / F.col("n_bytes")
    trusted = scored.join(labels.where(aside), key, "left_semi").where("n_bytes > 0").withColumn("mean", mean)
    limits = [F.percentile_approx("mean", quantile, 10_000).alias("high"), F.percentile_approx("mean", 0.5, 10_000).alias("middle")]
    # a few rows: one for each language
    by_lang = trusted.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(*limits)
    overall = trusted.agg(*[F.percentile_approx("mean", q, 10_000).alias(n) for q, n in ((quantile, "all_high"), (0.5, "all_middle"))])
    out = scored.join(by_lang, scored[lang] == by_lang["_lang"], "left").join(F.broadcast(overall), F.lit(True), "left")
    high, middle = F.coalesce("high", "all_high"), F.coalesce("middle", "all_middle")
    drawn = (F.col("nll") + PRIOR * middle) / (F.col("n_bytes") + PRIOR)
    keep = F.coalesce((F.col("n_bytes") == 0) | (drawn <= high * SLACK), F.lit(True))
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(mean)).otherwise(1.0)
    return out.select(key, lang, F.round(perplexity, 6).alias("perplexity"), F.round(F.exp(high * SLACK), 6).alias("limit"), keep.alias("keep"))
