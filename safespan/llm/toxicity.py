"""Toxicity scores by a factorization machine over hashed terms.

A text's distinct terms (runs of letters in lower case) are hashed into DIMS places. The score is a logistic function of
a bias, the sum of the terms' weights, and the sum over pairs of terms of the inner products of their factors: so an
insult beside the mention of a group can count for more than both alone, which additive weights can't express.

Fitting takes at most SAMPLE labelled rows, those with the least hashes of their keys, and runs stochastic gradient steps
on their term lists on the driver: SAMPLE bounds the rows, and a row's list is as long as its text has distinct terms.
Terms that occur in MIN_ROWS sampled rows or more get weights and factors if their presence depends on the label (a G-test
statistic of MIN_GAIN or more), or if that of a pair of terms does: among the rows with either of the two, the presence
of the other depends on the label (PAIR_GAIN or more both ways), as where only both together are toxic, or only one of
them alone. Other terms get none, so that the many chance terms of long texts don't add up. Tasks search the pairs, each
for a range of terms. Scoring covers every row and whole texts.

Defined cases: null and empty texts and texts without letters score by the bias alone; repeated rows score alike; without
labelled rows every score is 0.5, and with labels of one class that class's bias is learned; an empty table gives an
empty table; other columns are kept, and columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.llm.arrays import LOWER, hash_spans, per_batch, runs, text_bytes, words

BITS = 20
DIMS = 1 << BITS
FACTORS = 4
SAMPLE = 12_000
FLAG = 0.3
MIN_ROWS = 4
MIN_GAIN = 14.0
PAIR_GAIN = 30.0
APART = np.ones(256, dtype=bool)
APART[97:123] = False
APART[128:] = False  # letters beyond ASCII


def term_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct places of each text's terms."""
    data, offsets = text_bytes(column)
    for i, j in runs(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, at = words(part, offsets[i : j + 1] - offsets[i], APART)
        places = (hash_spans(part, starts, ends) >> np.uint64(64 - BITS)).astype(np.int32)
        for d in range(j - i):
            yield np.unique(places[at[d] : at[d + 1]])


@dataclass
class Machine:
    """Weights of the known places: place k is known if slot[k] > 0; row 0 of the tables is zero."""

    bias: float
    slot: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def score(self, places: np.ndarray) -> float:
        s = self.slot[places]
        s = s[s > 0]
        v = self.factor[s]
        total = v.sum(axis=0)
        x = self.bias + float(self.weight[s].sum()) + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def dependence(ones: np.ndarray, seen: np.ndarray, n1: np.ndarray | float, n: np.ndarray | float) -> np.ndarray:
    """The G-test statistic of a term seen in `seen` of n rows, `ones` of them among the n1 rows of label 1."""
    out = np.zeros(np.shape(seen))
    for got, row, column in ((ones, seen, n1), (seen - ones, seen, n - n1), (n1 - ones, n - seen, n1), (n - n1 - seen + ones, n - seen, n - n1)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += 2 * np.where(got > 0, got * np.log(got * n / (row * column)), 0.0)
    return out


def counted(lists: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows each place occurs, and in how many of label 1."""
    empty = [np.empty(0, np.int32)]
    seen = np.bincount(np.concatenate(empty + lists), minlength=DIMS).astype(float)
    ones = np.bincount(np.concatenate(empty + [x for x, y in zip(lists, labels, strict=True) if y]), minlength=DIMS).astype(float)
    return seen, ones


class Pairs:
    """Finds terms that matter in pairs. Rows of equal terms and label count once here: copies are no evidence."""

    def __init__(self, lists: list[np.ndarray], labels: np.ndarray):
        once = {(x.tobytes(), y): i for i, (x, y) in enumerate(zip(lists, labels.tolist(), strict=True))}
        lists, self.labels = [lists[i] for i in once.values()], labels[list(once.values())]
        self.places = np.flatnonzero(counted(lists, self.labels)[0] >= MIN_ROWS)
        number = np.full(DIMS, -1, np.int32)
        number[self.places] = np.arange(len(self.places))
        self.rows = [x[x >= 0] for x in (number[p] for p in lists)]
        flat = np.concatenate([np.empty(0, np.int32), *self.rows])
        row = np.repeat(np.arange(len(self.rows)), [len(x) for x in self.rows])
        by = np.argsort(flat, kind="stable")
        self.holders, self.at = row[by], np.searchsorted(flat[by], np.arange(len(self.places) + 1))
        self.seen = np.diff(self.at).astype(float)
        self.ones = np.bincount(flat, self.labels[row], minlength=len(self.places))

    def partners(self, a: int) -> np.ndarray:
        """The places of a term and of its partners after it, if it has any."""
        holders, n = self.holders[self.at[a] : self.at[a + 1]], len(self.places)
        if not len(holders):
            return self.places[:0]
        met = np.concatenate([self.rows[i] for i in holders])
        both = np.bincount(met, minlength=n).astype(float)
        ones = np.bincount(met, np.repeat(self.labels[holders], [len(self.rows[i]) for i in holders]), minlength=n)
        b = np.flatnonzero(both >= MIN_ROWS)
        b = b[b > a]
        gain = dependence(ones[b], both[b], self.ones[a], self.seen[a])
        b, gain = b[gain >= PAIR_GAIN], gain[gain >= PAIR_GAIN]
        other = dependence(ones[b], both[b], self.ones[b], self.seen[b])
        # a term beside one that never occurs without it says nothing more than that one
        b = b[(other >= PAIR_GAIN) & (both[b] < self.seen[b]) & (both[b] < self.seen[a])]
        return self.places[np.concatenate(([a], b))] if len(b) else self.places[:0]


def paired(spark: SparkSession, lists: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Places of the terms that matter in pairs; the terms are dealt to tasks."""
    pairs = Pairs(lists, labels)
    shared = spark.sparkContext.broadcast(pairs)  # the term lists of at most SAMPLE rows

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.partners(a) for a in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, np.int64), *found])))], ["place"])

    n = len(pairs.places)
    got = spark.range(0, n, 1, min(64, max(1, n // 64))).mapInArrow(make, "place long").distinct().toArrow()  # at most n places
    return np.sort(got.column("place").to_numpy())


def train(lists: list[np.ndarray], labels: np.ndarray, epochs: int = 12, seed: int = 7, partners: np.ndarray | None = None) -> Machine:
    """Logistic loss with AdaGrad steps, one row at a time. partners: places of terms that matter in pairs."""
    slot = np.zeros(DIMS, np.int32)
    if not len(lists):
        return Machine(0.0, slot, np.zeros(1), np.zeros((1, FACTORS)))
    seen, ones = counted(lists, labels)
    alone = np.flatnonzero((seen >= MIN_ROWS) & (dependence(ones, seen, float(labels.sum()), float(len(lists))) >= MIN_GAIN))
    known = alone if partners is None else np.union1d(alone, partners)
    slot[known] = np.arange(1, len(known) + 1)
    rng = np.random.default_rng(seed)
    weight, gw = np.zeros(len(known) + 1), np.full(len(known) + 1, 1e-2)
    factor, gv = rng.normal(0, 0.1, (len(known) + 1, FACTORS)), np.full((len(known) + 1, FACTORS), 1e-2)
    factor[0] = 0
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, gb = float(np.log(rate / (1 - rate))), 1e-2
    rows = [x[x > 0] for x in (slot[p] for p in lists)]
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            s = rows[r]
            v = factor[s]
            total = v.sum(axis=0)
            x = bias + weight[s].sum() + 0.5 * ((total * total).sum() - (v * v).sum())
            p = 1 / (1 + np.exp(-min(40.0, max(-40.0, x))))
            g = p - labels[r]
            if abs(g) < 1e-3:
                continue
            gb += g * g
            bias -= 0.05 * g / np.sqrt(gb)
            gw[s] += g * g
            weight[s] -= 0.3 * (g + 2e-3 * weight[s]) / np.sqrt(gw[s] + 1)
            d = g * (total - v) + 2e-3 * v
            gv[s] += d * d
            factor[s] -= 0.05 * d / np.sqrt(gv[s] + 1)
    return Machine(float(bias), slot, weight, factor)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine from the labelled rows (label 0 or 1); at most `sample` of them, chosen by the hashes of their keys."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.xxhash64(key).alias("hash"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod("hash", F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n)))
    schema = "hash long, label int, places array<int>"

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = list(term_lists(batch.column("text")))
        at = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, np.int32), *made])))
        yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("label"), lists], ["hash", "label", "places"])

    got = rows.mapInArrow(per_batch(make), schema).toArrow().sort_by([("hash", "ascending"), ("label", "ascending")]).slice(0, sample)
    lists = [np.asarray(x.values, np.int32) if x.values is not None else np.empty(0, np.int32) for x in got.column("places")]
    labels = np.asarray(got.column("label").to_pylist(), float)
    return train(lists, labels, partners=paired(labelled.sparkSession, lists, labels))


def score(df: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score of each whole text, from 0 to 1."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(machine)  # DIMS slots and at most DIMS rows of weights

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        made = pa.array([m.score(p) for p in term_lists(batch.column(text))], pa.float64())
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name}
        yield pa.RecordBatch.from_arrays([*keep.values(), made], [*keep, name])

    return df.mapInArrow(per_batch(make), schema)
