"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to e edits, e = m div EVERY whatever its length, or 0 below
LEAST characters. It is split into e + 1 pieces: each edit spoils one piece at most, so one piece occurs unchanged. An Aho-Corasick automaton finds all
pieces in one pass over a text; around each hit, Myers' bit-parallel algorithm gives the least edit distance of the item
to any stretch of the text.

The test items are a stated query set. They are shared with the tasks in blocks of at most BLOCK characters, whatever
their number, and each block is matched against all documents.

Defined cases: null and empty texts match nothing; null and empty items are left out; items below LEAST characters match
only without edits; letters match in either case; equal items are all reported; repeated rows match alike; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from safespan.llm.arrays import per_batch

EVERY, LEAST = 25, 40
MOST = math.inf  # the budget has no bound but the item's length
BLOCK = 8_000_000


def lowered(text: str) -> str:
    """The text in lower case, at the same positions."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def nearest(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of item to a stretch of text, and where the first such stretch ends (Myers 1999)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, now, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(xv | up)) & full
        minus = up & xv & full
        if now < best:
            best, end = now, j
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[object, str]], every: int = EVERY, least: int = LEAST):
        self.items = [(k, lowered(t)) for k, t in items if t]
        self.budget = [len(t) // every if len(t) >= least else 0 for _, t in self.items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, ((_, t), e) in enumerate(zip(self.items, self.budget, strict=True)):
            for p in range(e + 1):
                lo, hi = p * len(t) // (e + 1), (p + 1) * len(t) // (e + 1)
                pieces.setdefault(t[lo:hi], []).append((i, hi))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, uses)
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first: bool = False) -> list[tuple[object, int, int, int]]:
        """(item key, start, end, distance) of the items found in the text, non-overlapping for each item; with `first`
        at most one match."""
        if not text or not self.items:
            return []
        low = lowered(text)
        starts: dict[int, list[int]] = {}
        for end, uses in self.automaton.iter(low):
            for i, offset in uses:
                starts.setdefault(i, []).append(end + 1 - offset)
        out = []
        for i, places in starts.items():
            key, item = self.items[i]
            e, done, tried = self.budget[i], -1, None
            for s in sorted(set(places)):
                if tried is not None and s <= tried + e // 2 and e or s + e < done:
                    continue  # the last window covered this start, or the last match reaches beyond it
                lo = max(0, s - 2 * e, done)
                if not e:  # the piece was the whole item
                    out.append((key, s, s + len(item), 0))
                    done = s + len(item)
                    if first:
                        return out
                    continue
                window = low[lo : s + len(item) + 2 * e]
                tried = s
                best, stop = nearest(item, window)
                if best > e:
                    continue
                _, back = nearest(item[::-1], window[:stop][::-1])
                out.append((key, lo + stop - back, lo + stop, best))
                done = lo + stop
                if first:
                    return out
        return sorted(out, key=lambda x: x[1:])


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK characters, each fetched when it is needed."""
    usable = items.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // BLOCK))
    for i in range(n):
        part = usable.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == i) if n > 1 else usable
        rows = [(r["key"], r["text"]) for r in part.orderBy("key", "text").collect()]
        if rows or i == 0:
            yield rows


_made: dict[int, object] = {}


def _matcher(shared) -> Matcher:
    """The matcher of a shared block; a worker keeps the last one, with the block itself as its mark."""
    rows = shared.value
    if id(rows) not in _made:
        _made.clear()
        _made[id(rows)] = Matcher(rows)
        _made[0] = rows  # held, so that its id stays its own
    return _made[id(rows)]


def find_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each occurrence of an item in a document: both keys, match_start, match_end (code points) and distance."""
    context = docs.sparkSession.sparkContext
    schema = T.StructType([docs.schema[key], T.StructField(item_key, items.schema[item_key].dataType)] + [T.StructField(n, T.LongType()) for n in ("match_start", "match_end", "distance")])
    kind = to_arrow_type(items.schema[item_key].dataType)
    out = None
    for rows in _blocks(items, item_key, item_text):
        shared = context.broadcast(rows)  # at most about BLOCK characters

        def make(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared)
            found = [(i, *x) for i, t in enumerate(batch.column(text).to_pylist()) for x in m.matches(t)]
            keys = pa.array([x[1] for x in found], kind)
            columns = [pa.array([x[c] for x in found], pa.int64()) for c in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(columns[0]), keys, *columns[1:]], schema.names)

        part = docs.select(key, text).mapInArrow(per_batch(make), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    context = docs.sparkSession.sparkContext
    for rows in _blocks(items, item_key, item_text):
        shared = context.broadcast(rows)  # at most about BLOCK characters

        def make(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            m = _matcher(shared)
            yield batch.filter(pa.array([not m.matches(t, first=True) for t in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(per_batch(make), docs.schema)
    return docs
