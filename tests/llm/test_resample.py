"""Importance resampling against SQL and a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from oracle import connect, same
from safespan.llm import resample
from safespan.llm.queries import RESAMPLING, op12_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target):
    def buckets(texts):
        return Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = buckets(x for _, x in docs), buckets(target)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        n, fs = features(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in (zlib.crc32(f.encode()) % 10000 for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] if r[0] is not None else -1))
    ranks = {id(r): k + 1 for k, r in enumerate(drawn) if k < 25 * len(drawn) // 100}
    return sorted(((-1 if r[0] is None else r[0]), *r[1:], ranks.get(id(r), 0)) for r in out)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_same_as_sql(spark, folder):
    assert same(op12_resampling(spark, folder), connect(folder), RESAMPLING) > 0


def test_crc32():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(5000), np.uint8)
    cuts = sorted((a := rng.randint(0, 4000), a + rng.choice([0, 1, 5, 47, 48, 49, 300])) for _ in range(200))
    starts, ends = (np.array(x) for x in zip(*cuts, strict=True))
    begin = np.array([rng.getrandbits(32) for _ in cuts], np.uint32)
    assert resample.crc32(data, starts, ends, begin).tolist() == [zlib.crc32(data[a:b].tobytes(), int(x)) for a, b, x in zip(starts, ends, begin, strict=True)]


def test_against_a_plain_version(spark, monkeypatch):
    """Lines that repeat, blank lines, words of any length, ties, null ids and texts, names that clash; hot and cold lines."""
    monkeypatch.setattr(resample, "OFTEN", 3)
    rng = random.Random(2)
    bits = ["the", "House", "É", "日本", "x1", "9", "\n", "\n", "\n\n", ".", "\r\n", "the same line\n", "the same line\n", "\x00", "w" * 60, "\x7f"]
    docs = [(i, " ".join(rng.choices(bits, k=rng.randint(0, 60)))) for i in range(150)] + [(7, "again " * 30), (7, "again " * 30), (200, None), (201, ""), (202, "\n\n"), (None, "no id " * 20), (203, "a b " * 200_000)]
    target = ["the same line is here", None, "House of the É", "", "日本 x1\nthe end"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, gain int, key string")
    b = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    got = resample.resample(df, b).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got) == plain(docs, target)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resample.resample(df.limit(0), none).count() == 0
    one = resample.resample(df, none).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in one] == [(1, 79, None)] and one[0].weight == plain([(1, "a b " * 20)], [])[0][3]
