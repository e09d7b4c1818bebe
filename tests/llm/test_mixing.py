"""Mixtures against plain versions, and the properties of every draw."""

import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from safespan.llm import mixing
from safespan.llm.queries import op11_mixing

SCHEMA = "doc_id long, text string, source string, words int, place string, shard int"


def plain_targets(words, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    """By handing out what is left again and again."""
    names = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [s for s in words if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(words.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        if not free:
            return fixed
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * words[s]]
        if not over:
            return fixed | got
        fixed |= {s: most * words[s] for s in over}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = op11_mixing(spark, sf).collect()
    assert rows == op11_mixing(spark, sf).collect() or sorted(rows) == sorted(op11_mixing(spark, sf).collect())  # reruns agree
    got, words, taken = {r.doc_id: r for r in rows}, Counter(), Counter()
    for d in docs:
        words[d.source] += size(d.text)
        taken[d.source] += got[d.doc_id].taken
    want = plain_targets(words)
    assert len(rows) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert r.size == size(d.text) and r.source_size == words[d.source] and r.target == pytest.approx(want[d.source])
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in words)


def test_targets_against_sharing_again_and_again(spark):
    rng = random.Random(4)
    for _ in range(6):
        words = {rng.choice(["", "é", "Z"]) + str(i): rng.choice([0, 1, 5, 100, 10_000, 1_000_000]) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 500)}
        df = spark.createDataFrame(list(words.items()), "source string, words long")
        want = plain_targets(words)
        assert {r.source: r.target for r in mixing.targets(df).collect()} == {s: pytest.approx(t) for s, t in want.items()}


@pytest.mark.parametrize(("marked", "everything", "drawn"), [(30, 100, 40), (3, 7, 7), (0, 5, 2), (1, 1000, 999), (6, 10, 8)])
def test_draws_have_the_hypergeometric_distribution(spark, marked, everything, drawn):
    n = 40_000
    one = mixing.hypergeometric(*[F.lit(x).cast("long") for x in (marked, everything, drawn)], mixing.unit(F.col("id")))
    got = Counter(r[0] for r in spark.range(n).select(one).collect())
    off = 0.0
    for x in range(max(0, drawn + marked - everything), min(marked, drawn) + 1):
        want = n * comb(marked, x) * comb(everything - marked, drawn - x) / comb(everything, drawn)
        if want < 5:
            n -= got.pop(x, 0)
            continue
        off += (got.pop(x) - want) ** 2 / want
    assert not got and off < 60


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97, 4097):
        places = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1))
        assert sorted(r[0] for r in spark.range(n).select(places).collect()) == list(range(n))


def mixture(spark, rows, **kind):
    df = spark.createDataFrame(rows, SCHEMA)
    pieces, documents, sources = mixing.mix(df, **kind)
    return df, pieces, documents, sources


def test_shards_blocks_and_texts(spark):
    """Every drawn block is in one shard only, shards are even, and the pieces are the words of their documents."""
    rng = random.Random(5)
    texts = [" ".join(f"w{i}_{j}" for j in range(rng.randint(0, 60))) for i in range(200)]
    rows = [(i, t, rng.choice(["a", "b", "c", None]), 1, "x", 2) for i, t in enumerate(texts)]
    df, pieces, documents, sources = mixture(spark, rows, shards=7, least=40)
    found = mixing.texts(pieces, df).collect()
    blocks = Counter((r.place, r.block, r.round) for r in {(r.shard, r.at, r.place, r.block, r.round): r for r in found}.values())
    assert set(blocks.values()) == {1}
    quota = {r.place: r.quota for r in sources.collect()}
    assert Counter(p for p, _, _ in blocks) == quota
    shards = Counter(r.shard for r in {(r.shard, r.at): r for r in found}.values())
    assert set(shards) == set(range(7)) and max(shards.values()) - min(shards.values()) <= 1
    for s in shards:
        assert sorted({r["at"] for r in found if r.shard == s}) == list(range(shards[s]))
    for r in found:
        assert r.piece.split(" ") == texts[r.id].split(" ")[r["first"] : r["first"] + r.words]
    taken = {r.id: r.taken for r in mixing.taken(pieces, documents).collect()}
    assert taken == {i: sum(r.words for r in found if r.id == i) for i in range(200)}


def test_a_split_keeps_the_quotas(spark):
    found = spark.createDataFrame([(0, 900, 1000), (1, 7, 7), (2, 50, 0)], "place int, blocks long, quota long")
    leaves = mixing.split(found, 13, 3).collect()
    drawn = Counter()
    for r in leaves:
        drawn.update({p.place: p.quota for p in r.parts})
    assert len(leaves) == 13 and drawn == {0: 1000, 1: 7}
    for place, n in drawn.items():
        seen = sorted(x for r in leaves for p in r.parts if p.place == place for x in range(p["first"], p["first"] + p.quota))
        assert seen == list(range(n))
    assert {sum(p.quota for p in r.parts) for r in leaves} <= {1007 // 13, 1007 // 13 + 1}


def test_nulls_empty_long_and_repeated(spark):
    long = "word " * 300_000
    rows = [(1, None, "a", 9, "p", 1), (2, "", "a", 9, "p", 1), (3, " \t\n", "a", 9, "p", 1), (4, "one two", "a", 9, "p", 1), (4, "one two", "a", 9, "p", 1), (4, "other", "b", 9, "p", 1), (None, "x y z", None, 9, "p", 1), (5, long, "z", 9, "p", 1), (6, None, "only empty", 9, "p", 1)]
    _, pieces, documents, sources = mixture(spark, rows)
    got = mixing.taken(pieces, documents).collect()
    assert sorted((r.id or 0, r["size"]) for r in got) == [(0, 3), (1, 0), (2, 0), (3, 0), (4, 1), (4, 2), (4, 2), (5, 300_000), (6, 0)]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    of = {r.source: r.target for r in sources.collect()}
    assert of["only empty"] == 0 and of[None] == 6 and sum(r.taken for r in got) == pytest.approx(1.5 * 300_008, rel=0.01)


def test_empty_tables(spark):
    _, pieces, documents, sources = mixture(spark, [])
    assert pieces.count() == documents.count() == sources.count() == mixing.taken(pieces, documents).count() == 0
