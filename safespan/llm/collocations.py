"""Phrases of words that occur together more often than their parts let expect, for each language.

A phrase's score is the least of 1000 a n / (l r) over its cuts in two, floored, with a the phrase's count, l and r those
of the parts and n all words of the language. Counts come from a multikey three-way quicksort of suffix pointers:

- words, and then pairs of frequent words, are counted everywhere first; a suffix ends where a pair is infrequent, as no
  frequent phrase goes on there. Which words and pairs are frequent reaches the tasks as bit tables of a fixed size, whose
  few wrong answers cost rows, not results;
- equal suffixes of up to `longest` words are counted once, and routed by their first three words, so that a task has all
  suffixes of its phrases. Leads with very many suffixes are counted apart and their suffixes routed by four words, then
  five, until no group is large;
- a bucket of suffixes is sorted by the words at one depth: into those below, equal to and above a pivot. The equal ones
  are one phrase, their occurrences its count, and go on at the next depth; a part with fewer than `least` occurrences is
  abandoned.

Phrases inside a longer one with as many occurrences are dropped, and the first `top` of each language returned.

Defined cases: null and empty texts have no words; null languages are `und`; ties go to the more frequent phrase and then
by code point; repeated rows count each; languages without frequent phrases have no rows; an empty table gives an empty
result; other columns don't matter, whatever their names. A word of any length is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from safespan.llm.arrays import LOWER, give_back, hash_spans, mix64, runs, text_bytes, words
from safespan.session import materialize

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text whose equal suffixes are counted together before they are sent.
CHUNK = 6 << 20
#: Suffixes of a bucket, and of a lead from FEW on to BUCKET at most, unless more than SHARE leads have more.
BUCKET, FEW, SHARE = 1 << 17, 1024, 1_000_000
#: Bits of a table of frequent words or pairs.
BITS = 26
PIECE = np.zeros(256, dtype=bool)
PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
APART = PIECE.copy()
APART[[0x20, 0x09]] = True
_PHRASE = "lang string, phrase string, n long"


def _lang_keys(langs: pa.Array) -> np.ndarray:
    codes = langs.dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(x) for x in codes.dictionary.to_pylist()], np.uint64)
    return known[codes.indices.to_numpy(zero_copy_only=False)]


def _key(hashes: list[np.ndarray], langs: np.ndarray) -> np.ndarray:
    """One 64-bit key of one or two words of a language."""
    key = langs.copy()
    for h in hashes:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h)
    return key


def seen(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys are in the table; now and then true for others."""
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        bit = (keys >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
        out &= (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def bit_table(phrases: DataFrame) -> np.ndarray:
    """The table of the phrases (one or two words): two bits each, joined in Spark by or."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("phrase"))
            starts, ends, at = words(data, offsets, APART)
            hashes, counts = hash_spans(data, starts, ends), np.diff(at)
            langs = _lang_keys(batch.column("lang"))
            keys = np.concatenate([_key([hashes[at[:-1][counts == k] + i] for i in range(k)], langs[counts == k]) for k in (1, 2)])
            bits = np.concatenate([(keys >> np.uint64(s)) & np.uint64((1 << BITS) - 1) for s in (0, 32)])
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], ["block", "bits"])

    got = phrases.mapInArrow(make, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**(BITS - 6) rows
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[got.column("block").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


@dataclass
class Tokens:
    """The words of some texts: where they are, their keys, and whether the next word is in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: np.ndarray
    hashes: np.ndarray
    lang_keys: np.ndarray
    goes_on: np.ndarray

    def strings(self, which: np.ndarray) -> pa.DictionaryArray:
        """The words at ascending places, numbered."""
        sizes = (self.ends - self.starts)[which]
        at = np.concatenate(([0], np.cumsum(sizes)))
        bytes_ = self.data[np.repeat(self.starts[which] - at[:-1], sizes) + np.arange(int(at[-1]))]
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(bytes_)]).dictionary_encode()


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[Tokens, pa.Array]]:
    """Tokens of some texts at a time, and the languages that their lang numbers stand for."""
    data, offsets = text_bytes(batch.column("text"))
    langs = batch.column("lang").dictionary_encode()
    numbers, keys = langs.indices.to_numpy(zero_copy_only=False), _lang_keys(batch.column("lang"))
    for i, j in runs(offsets, CHUNK):
        part = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, at = words(part, offsets[i : j + 1] - offsets[i], APART)
        row = np.repeat(np.arange(i, j), np.diff(at))
        piece = np.cumsum(PIECE[part], dtype=np.int64)[starts]
        goes_on = np.zeros(len(starts), bool)
        goes_on[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        yield Tokens(part, starts, ends, numbers[row], hash_spans(part, starts, ends), keys[row], goes_on), langs.dictionary


def _each(make):
    """For mapInArrow: rows of phrases from the tokens of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, langs in tokens(batch):
                if not len(t.starts):
                    continue
                for lang, phrase, n in make(t):
                    lang = pa.DictionaryArray.from_arrays(pa.array(lang), langs).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])
            give_back()

    return run


def _counted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of the different rows of columns of small integers."""
    code = columns[0].astype(np.int64)
    for c in columns[1:]:
        code = np.unique(code * (int(c.max(initial=0)) + 2) + c + 1, return_inverse=True)[1]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return first, n


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word, null: all words), n."""

    def make(t: Tokens) -> Iterator[tuple]:
        names = t.strings(np.arange(len(t.starts)))
        codes = names.indices.to_numpy()
        first, n = _counted([t.lang, codes])
        yield t.lang[first], names.dictionary.take(pa.array(codes[first])), n
        langs = np.bincount(t.lang)
        yield np.arange(len(langs)), pa.nulls(len(langs), pa.large_binary()), langs

    return docs.mapInArrow(_each(make), _PHRASE).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """lang, phrase, n of pairs of words in the table."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # 2**BITS bits

    def make(t: Tokens) -> Iterator[tuple]:
        ok = seen(shared.value, _key([t.hashes], t.lang_keys))
        first = np.flatnonzero(t.goes_on[:-1] & ok[:-1] & ok[1:])
        yield _phrases(t, first, np.full(len(first), 2), 2)

    return docs.mapInArrow(_each(make), _PHRASE).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, frequent: np.ndarray, longest: int) -> DataFrame:
    """lang, phrase, n of the different suffixes of three words or more, up to the first pair that isn't in the table."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make(t: Tokens) -> Iterator[tuple]:
        on = t.goes_on.copy()
        on[:-1] &= seen(shared.value, _key([t.hashes[:-1], t.hashes[1:]], t.lang_keys[:-1]))
        size, run = np.ones(len(on), np.int64), np.ones(len(on), bool)
        for _ in range(longest - 1):
            run &= on
            size += run
            on = np.append(on[1:], False)
        first = np.flatnonzero(size >= 3)
        yield _phrases(t, first, size[first], longest)

    return docs.mapInArrow(_each(make), _PHRASE).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _phrases(t: Tokens, first: np.ndarray, size: np.ndarray, longest: int) -> tuple:
    """Languages, phrases and counts of the different runs of `size` words from the places `first`."""
    used = np.unique(np.concatenate([first[size > i] + i for i in range(longest)]))
    names = t.strings(used)
    codes = names.indices.to_numpy()
    # the words of a run are neighbours among the used ones
    at = np.searchsorted(used, first)
    columns = [np.where(size > i, codes[np.minimum(at + i, len(used) - 1)], -1) if len(used) else np.zeros(0, np.int64) for i in range(longest)]
    one, n = _counted([t.lang[first], *columns])
    parts = [names.dictionary.take(pa.array(c[one], pa.int64(), mask=c[one] < 0)) for c in columns]
    return t.lang[first[one]], pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()), null_handling="skip"), n


def quicksorted(ids: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of the rows of ids (-1 behind a row's end): a row that starts with it, the length and
    the weight of every prefix of a weight of `least` or more."""
    todo = [(np.arange(len(ids)), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == ids.shape[1] or weights[rows].sum() < least:
            continue  # abandoned
        keys = ids[rows, depth]
        pivot = np.sort(keys[[0, len(keys) // 2, -1]])[1]
        todo += [(rows[keys < pivot], depth), (rows[keys > pivot], depth)]
        equal = rows[keys == pivot]
        n = int(weights[equal].sum())
        if pivot >= 0 and n >= least:
            yield int(equal[0]), depth + 1, n
            todo.append((equal, depth + 1))


def _bucket_counts(least: int, shortest: int) -> object:
    """For mapInArrow over rows in order of their buckets: the frequent phrases of each bucket."""

    def count(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        data, offsets = text_bytes(table.column("phrase"))
        starts, ends, at = words(data, offsets, APART)
        sizes = np.diff(at)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        ids = np.full((len(sizes), 1 + int(sizes.max())), -1, np.int64)
        ids[:, 0] = langs.indices.to_numpy(zero_copy_only=False)
        t = Tokens(data, starts, ends, starts, starts, starts, starts)
        row = np.repeat(np.arange(len(sizes)), sizes)
        ids[row, 1 + np.arange(len(starts)) - at[row]] = t.strings(np.arange(len(starts))).indices.to_numpy()
        found = [f for f in quicksorted(ids, table.column("n").to_numpy(), least) if f[1] > shortest]  # the language is a key, too
        phrases = [data[offsets[r] : ends[at[r] + d - 2]].tobytes() for r, d, _ in found]
        lang = table.column("lang").combine_chunks().take(pa.array([r for r, _, _ in found], pa.int64()))
        return pa.RecordBatch.from_arrays([lang, pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([n for _, _, n in found], pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            b = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and lo < hi and held[-1].column("bucket")[0].as_py() != b[lo]:
                    yield count(held)
                    held = []
                if lo < hi:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield count(held)
        give_back()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n and k (words) of every phrase of up to `longest` words that occurs `least` times or more,
    and for each language its number of words, with a null phrase."""
    spark = docs.sparkSession
    ones = materialize(word_counts(docs).where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    twos = materialize(pair_counts(docs, bit_table(ones.where("phrase is not null"))).where(F.col("n") >= least), "pairs")
    found = [ones.withColumn("k", F.when(F.col("phrase").isNotNull(), 1)), twos.withColumn("k", F.lit(2))]
    rows = materialize(suffixes(docs, bit_table(twos), longest), "suffixes")
    n = rows.count()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // BUCKET + 1)
    limit = max(FEW, n // SHARE, min(BUCKET, 2 * n // buckets))
    for k in range(3, longest + 1):
        rows = rows.withColumn("lead", F.substring_index("phrase", " ", k))
        sizes = rows.groupBy("lang", "lead").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
        hot = materialize(sizes.where(F.col("rows") > limit), "leads").select("lang", "lead", F.col("n").alias("total"))
        marked = rows.join(F.broadcast(hot), ["lang", "lead"], "left")  # at most SHARE rows
        cold = marked.where("total is null").withColumn("bucket", F.pmod(F.xxhash64("lang", "lead"), F.lit(buckets)))
        dealt = cold.select("bucket", "lang", "phrase", "n").repartition("bucket").sortWithinPartitions("bucket")
        found.append(_with_size(dealt.mapInArrow(_bucket_counts(least, k), _PHRASE)))
        found.append(_with_size(hot.where(F.col("total") >= least).select("lang", F.col("lead").alias("phrase"), F.col("total").alias("n"))))
        if hot.isEmpty():
            break
        longer = F.size(F.split("phrase", " ")) > k
        rows = marked.where(F.col("total").isNotNull() & longer).select("lang", "phrase", "n")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return materialize(out, "phrases")


def _with_size(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.size(F.split("phrase", " ")))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language."""
    counts = phrase_counts(docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")), least, longest)
    # stored apart, so that Spark sees how small it is and doesn't deal all phrases by language
    total = materialize(counts.where("phrase is null").select("lang", F.col("n").alias("all")), "languages")
    known, phrases = counts.where("phrase is not null"), counts.where("k >= 2")

    # all phrases within a longer one, with its count
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, s), " "))))
    inner = phrases.where("k >= 3").select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = phrases.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).select("lang", "phrase", F.col("n").alias("a"), "k")

    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cuts = cuts.join(total, "lang")
    a, n, l, r = (f"cast(`{c}` as decimal(18,0))" for c in ("a", "all", "l", "r"))
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {a} * {n}) div ({l} * {r})")  # products of up to 38 digits
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", F.col("all").alias("n"), "score"), F.struct("score", "cut")).alias("b")).select("lang", "phrase", "b.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
