"""Token counts by byte-pair merging with a heap and a linked list, without making any ids.

A word's symbols form a linked list; a heap holds the rank and place of each adjacent pair that has a merge rule. The
lowest is popped again and again and its pair merged; the count is the initial symbols less the merges.

Defined cases: null and empty texts count 0; special strings inside texts count 1 each; texts of any length are counted
whole; repeated rows count alike; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from safespan.llm.arrays import per_batch
from safespan.llm.bpe import Memory, Vocabulary, _with


#: Bytes that a task remembers of chunks, and as many of words: texts of a batch of rows have hundreds of thousands of them.
REMEMBERED = 128_000_000


class Counter:
    """Numbers of tokens of texts, chunks and words; what was found is remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()
        #: rank << 32 of each pair's rule, and what a rule makes, by rank.
        self.rules = {a << 20 | b: rank << 32 for (a, b), (rank, _) in vocabulary.merges.items()}
        self.made = {rank: made for rank, made in vocabulary.merges.values()}
        symbol = vocabulary.symbol_ids
        self.inner, self.last = ([symbol.get(chr(x + mark)) for x in range(256)] for mark in (0, 256 if vocabulary.end else 0))

    def chunk(self, chunk: str) -> int:
        return sum([self.words[w] for w in self.v.words(chunk)])

    def word(self, word: str) -> int:
        raw = word.encode("utf-8")
        ids = [*map(self.inner.__getitem__, raw)]
        ids[-1] = self.last[raw[-1]]
        return self.count(ids)

    def count(self, ids: list[int]) -> int:
        n, rule, made = len(ids), self.rules.get, self.made
        # what each symbol's pair with the next one has as its rule; -1: none, or the symbol is gone
        pair = [rule(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        heap = [r | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        pair.append(-1)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        left = n
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top - i:
                continue  # one of the two has merged elsewhere since
            a = ids[i] = made[top >> 32]
            left -= 1
            j = after[i]
            pair[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = pair[i] = rule(a << 20 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = rule(ids[h] << 20 | a, -1)
                if r >= 0:
                    heappush(heap, r | h)
        return left

    def forget(self) -> None:
        self.chunks, self.words = Memory(self.chunk, REMEMBERED), Memory(self.word, REMEMBERED)

    def text(self, text: str) -> int:
        known = self.chunks
        return sum([(special != "") + sum([known[c] for c in chunks]) for special, chunks in self.v.chunks(text)])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(Vocabulary(path))


def count_tokens(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each whole text."""
    schema = _with(df, name, T.LongType())

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        made = pa.array([c.text(x or "") for x in batch.column(text).to_pylist()], pa.int64())
        keep = {n: x for n, x in zip(batch.schema.names, batch.columns, strict=True) if n != name}
        yield pa.RecordBatch.from_arrays([*keep.values(), made], [*keep, name])

    return df.mapInArrow(per_batch(make, after=lambda: counter(path).forget()), schema)
