"""Phrase counts and collocations against SQL and a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from oracle import connect, same
from safespan.llm import collocations
from safespan.llm.queries import COLLOCATIONS, op13_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for i in range(len(w)) for k in range(1, 6) if i + k <= len(w))
    f = Counter({p: a for p, a in f.items() if a >= least})
    inside = {}
    for (lang, *w), a in f.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    inside[(lang, *w[i:j])] = max(inside.get((lang, *w[i:j]), 0), a)
    rows = []
    for (lang, *w), a in f.items():
        if len(w) > 1 and inside.get((lang, *w), 0) < a:
            cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]], n[lang]))
    out, ranks = [], Counter()
    for lang, score, a, phrase, l, r, total in sorted(rows):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], phrase.decode(), -a, l, r, total, -score))
    return sorted(out)


def test_query_same_as_sql(spark, sf):
    assert same(op13_collocations(spark, sf), connect(sf), COLLOCATIONS) > 0


def texts(n, seed=3):
    rng = random.Random(seed)
    bits = ["new", "York", "city", "the", "of", "É", "日本", "a\tb", ",", ".", "\n", "!", "new York city hall opens", "the same old song", "x" * 500, "it's"]
    return [(rng.choice(["en", "de", None]), " ".join(rng.choices(bits, k=rng.randint(0, 80)))) for _ in range(n)]


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize(("bucket", "share", "chunk"), [(1 << 17, 1_000_000, 6 << 20), (4, 1_000_000, 2000)])
def test_against_a_plain_version(spark, monkeypatch, bucket, share, chunk):
    """Also with leads that are too many for one group at three and at four words, and with texts in many chunks."""
    for name, value in (("BUCKET", bucket), ("SHARE", share), ("CHUNK", chunk), ("FEW", 4 if bucket == 4 else collocations.FEW)):
        monkeypatch.setattr(collocations, name, value)
    docs = texts(300) + [(None, None), ("en", ""), ("fr", "seul"), ("en", "long run " * 50_000)]
    docs += docs[:40]
    df = spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], "lang string, text string, n int, phrase string, k double")
    got = collected(collocations.collocations(df, least=20, top=30))
    assert got == plain(docs, 20, 30) and len(got) > 40


def test_hot_leads_are_routed_by_more_words(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET", 4)
    monkeypatch.setattr(collocations, "FEW", 4)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [("en", f"one two three {rng.choice(words)} {rng.choice(words)}. one two three four {rng.choice(words)}, {' '.join(rng.choices(words, k=6))}") for _ in range(3000)]
    got = collected(collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), least=50))
    assert got == plain(docs, 50, 2000) and any(p == "one two three four" for _, _, p, *_ in got)


def test_quicksort_counts_prefixes():
    rng = random.Random(5)
    rows = np.array([[rng.randint(0, 3) for _ in range(4)] for _ in range(500)])
    rows[::7, 2:] = -1
    weights = np.array([rng.randint(1, 5) for _ in rows])
    want = Counter()
    for r, w in zip(rows.tolist(), weights.tolist(), strict=True):
        for d in range(1, 5):
            if r[d - 1] >= 0:
                want[tuple(r[:d])] += w
    got = {tuple(rows[i, :d].tolist()): n for i, d, n in collocations.quicksorted(rows, weights, 30)}
    assert got == {k: n for k, n in want.items() if n >= 30}


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as large as those of a corpus of many terabytes give exact scores."""
    big = {"a": 9_000_000_000_001, "b": 8_000_000_000_003, "a b": 7_999_999_999_999}
    n = 123_456_789_012_345
    rows = [("en", p, c, len(p.split())) for p, c in big.items()] + [("en", None, n, None)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, n long, k int"))
    got = collected(collocations.collocations(spark.createDataFrame([], "lang string, text string")))
    assert got == [("en", 1, "a b", big["a b"], big["a"], big["b"], n, 1000 * big["a b"] * n // (big["a"] * big["b"]))]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], df.schema)).count() == 0
