"""Fingerprints, near duplicates and repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from safespan.llm import minhash, suffix, winnow
from safespan.llm.queries import op1_winnowing

WORDS = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "iota", "kappa", "lam,", "mu"]


def slow_winnow(text, k, w):
    if not text:
        return []
    k = min(k, len(text))
    m, hashes = (1 << 64) - 1, []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * winnow.BASE + ord(c) + 1) & m
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m
        hashes.append((h ^ h >> 31) >> 24)
    w, out = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == least)
        if not out or out[-1][1] != at:
            out.append((least, at))
    return out


@pytest.mark.parametrize(("k", "w"), [(1, 1), (3, 4), (5, 7), (32, 64)])
def test_winnow(k, w, monkeypatch):
    monkeypatch.setattr(winnow, "_BLOCK", 50)
    rng = random.Random(k)
    for _ in range(60):
        t = "".join(rng.choices("ab é😀", k=rng.randint(0, 300)))
        h, at = winnow.winnow(t, k, w)
        assert list(zip(h.tolist(), at.tolist(), strict=True)) == slow_winnow(t, k, w)


def test_winnow_guarantee():
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdefgh", k=winnow.K + winnow.W - 1))
    for _ in range(20):
        a, b = ("".join(rng.choices("ijklmnop", k=200)) for _ in range(2))
        assert set(winnow.winnow(a + shared + a)[0]) & set(winnow.winnow(b + shared)[0])
    assert winnow.likeness(winnow.winnow("")[0], winnow.winnow(None)[0]) == 1.0


def test_next_document_over_many_ranges(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**6), 200)
    rows = [(i, f"text {i}") for i in ids] + [(None, "none"), (None, None)]
    got = winnow.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(ids, reverse=True)
    want = {i: f"text {j}" for i, j in zip(order, order[1:], strict=False)}
    assert len(got) == 202 and all(r.next_text == want[r.doc_id] for r in got if r.doc_id in want)
    assert sorted((r.text or "", r.next_text or "") for r in got if r.doc_id is None) == [("", "none"), ("none", f"text {order[0]}")]


@pytest.mark.parametrize("ids", [[7], [None], []])
def test_next_document_of_tiny_tables(spark, ids):
    got = winnow.with_next(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")).collect()
    assert [(r.text, r.next_text) for r in got] == [("x", "x")] * len(ids)


@pytest.mark.parametrize("small", [False, True])
def test_op1_against_plain_texts(spark, sf, small):
    """All fingerprints of the smallest table, one in ten of a larger one: the slow version takes its time."""
    sf = "/root/testdata/sf0.001" if small else sf
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in op1_winnowing(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)][1], len(t) // 2
        assert got[d].n_chars == len(t)
        edited = t[: len(t) - half] + after[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if small or i % 10 == 0:
            own, other, next_ = (slow_winnow(x, winnow.K, winnow.W) for x in (t, edited, after))
            assert got[d].fingerprint == " ".join(f"{h:x}@{p}" for h, p in own) and got[d].edited_fingerprint == " ".join(f"{h:x}@{p}" for h, p in other)
            a, b, c = ({h for h, _ in x} for x in (own, other, next_))
            for likeness, x in ((got[d].near_edited, b), (got[d].near_next, c)):
                assert likeness == pytest.approx(len(a & x) / len(a | x) if a | x else 1.0)


def test_fingerprints_keep_columns_and_repeated_rows(spark):
    rows = [(3, "one text", "k")] * 2 + [(2, None, "k"), (1, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _at string")
    got = winnow.with_next(df).collect()
    assert sorted((r.doc_id, r._at, r.next_text or "") for r in got) == [(1, "k", "one text"), (2, "k", ""), (3, "k", ""), (3, "k", "one text")]
    made = winnow.fingerprint(df.withColumnRenamed("_at", "fingerprint"))
    assert {r.doc_id: [(x.hash, x.at) for x in r.fingerprint] for r in made.collect()} == {3: [(h, p) for h, p in slow_winnow("one text", winnow.K, winnow.W)], 2: [], 1: []}
    pairs = df.withColumnRenamed("_at", "other").limit(0)
    assert winnow.compare(pairs, "text", {"other": ("near", None)}).count() == 0


def plain_components(rows, k, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_near_duplicates(spark):
    rng = random.Random(4)
    rows, base = [], [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(80)]
    for i in range(60):  # copies that drift away from the first: links chain
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one two three")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k=4).collect()}
    assert got == plain_components(rows, 4, 80)
    kept = minhash.keep_one(df.union(df), k=4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if i == c) and kept.columns == df.columns
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_a_group_that_shares_losses(spark):
    """Members that are below the threshold to most others and above it to few: links by shared losses and extras."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    spots = [rng.sample(range(2, 148), 5) for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(spots) if i % 3 else rng.sample(range(2, 148), rng.randint(1, 7)):
            w[p] = f"new{rng.randint(0, 3)}"
        rows.append((5000 - 7 * i, " ".join(w)))
    rows.append((1, "word " + " ".join(f"l{i}" for i in range(40_000))))  # a very long text, twice
    rows.append((2, rows[-1][1] + " end"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == plain_components(rows, 4, 80)
    assert len({c for _, c in got.values()}) > 10


def test_rows_of_one_id_and_different_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()} == {(i, 1) for i in (1, 2, 3, 4)}
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(df).collect()) == [(1, a), (1, b)]


def test_circulant_estimates_likeness():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        a, b = x[:1000], x[int(1000 * (1 - share)) : int(1000 * (2 - share))]
        j = share / (2 - share)
        got = np.mean(minhash.circulant(np.unique(a), 960) == minhash.circulant(np.unique(b), 960))
        assert abs(got - j) < 0.06


def plain_repeats(rows):
    seen, out = {}, {}
    for d, t in sorted(rows):
        covered = bytearray(len(t))
        new = set()
        for i in range(len(t) - suffix.SPAN + 1):
            x = t[i : i + suffix.SPAN]
            if seen.get(x, d) < d:
                covered[i : i + suffix.SPAN] = b"\1" * suffix.SPAN
            new.add(x)
        for x in new:
            seen.setdefault(x, d)
        out[d] = bytes(b for b, c in zip(t, covered, strict=True) if not c)
    return out


@pytest.mark.parametrize("crowd", [suffix.CROWD, 2])
def test_repeats(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", crowd)  # 2: nearly all goes the way for crowded anchors
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdefgh é", k=n)) for n in (49, 50, 51, 70, 120, 400)]
    texts = {}
    for d in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.5 else "".join(rng.choices("abcdefgh é", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        texts[d * 3] = "".join(parts)
    texts[900], texts[901] = texts[3], "z" * 5000
    texts[902] = "z" * 300
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()] + [(5000, None, 1), (None, texts[3], 1)], "doc_id long, text string, repeats int")
    got = suffix.cut(suffix.find_repeats(df)).collect()
    assert len(got) == len(texts) + 2
    want = plain_repeats([(d, t.encode()) for d, t in texts.items()])
    for r in got:
        kept = bytes(r.kept)
        assert kept == (want[r.doc_id] if r.doc_id in want else (r.text or "").encode())
    assert suffix.find_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [100_000, 2])
def test_repeats_compare_bytes_where_hashes_agree(spark, monkeypatch, crowd):
    """Contexts of one k-gram, shape and sides have equal hashes here, whatever stands further out."""
    monkeypatch.setattr(suffix, "CROWD", crowd)
    monkeypatch.setattr(suffix, "CONTEXT_BITS", 0)
    rng = random.Random(8)
    passages = ["".join(rng.choices("abcdefgh", k=n)) for n in (50, 56, 62, 90)]
    texts = {d: "".join("".join(rng.choices("xy", k=rng.randint(0, 40))) + rng.choice(passages) for _ in range(3)) for d in range(300)}
    texts |= {1000 + d: texts[d] for d in range(0, 300, 7)} | {2000 + d: texts[d][:-60] for d in range(0, 300, 11)}
    rows = list(texts.items())
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    dealt = suffix._deal(df, "doc_id", "text", 32)
    wrong = suffix._unequal(suffix.pack(df, "text"), "doc_id", "text", suffix._settle(dealt))
    assert wrong.count() > 0  # otherwise nothing is tested
    want = plain_repeats([(d, t.encode()) for d, t in texts.items()])
    got = {r.doc_id: bytes(r.kept) for r in suffix.cut(suffix.find_repeats(df)).collect()}
    assert got == want
    monkeypatch.setattr(suffix, "CONTEXT_BITS", 64)
    assert suffix._unequal(suffix.pack(df, "text"), "doc_id", "text", suffix._settle(suffix._deal(df, "doc_id", "text", 32))).count() == 0


def plain_contexts(gram, doc, place, contexts):
    seen, found = {}, set()
    for i in np.argsort(doc, kind="stable"):
        for step in range((place[i] & 63) + 1):
            key = (gram[i], (place[i] >> 6 & 63) - step, contexts[i][step : step + 50])
            if seen.setdefault(key, doc[i]) < doc[i]:
                found.add((int(doc[i]), int(place[i] >> 12) + step))
    return found


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_sorts_and_collisions(monkeypatch, collide):
    rng = random.Random(2)
    contexts, place, gram, doc = [], [], [], []
    for i in range(400):  # the k-gram of each stands at its place; sides come from few choices
        left, more = rng.randint(0, 34), 0
        right = rng.randint(34 - left, 34)
        more = left + right - 34
        side = ["".join(rng.choices("ab", k=34, weights=(9, 1))) for _ in range(2)]
        g = rng.randrange(3)
        contexts.append((side[0][34 - left :] + f"gram{g}" + "x" * 11 + side[1][:right]).encode())
        place.append(i << 12 | left << 6 | min(more, left))
        contexts[-1] = contexts[-1][: min(more, left) + 50]
        gram.append(g)
        doc.append(rng.randrange(150))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
    if collide:  # a hash that takes three bytes for any others: the byte checks must still tell them apart
        plain = suffix.Suffixes.common

        def wrong(self, i, j):
            n = plain(self, i, j)
            return np.minimum(n + 3, np.minimum(self.size[i], self.size[j]))

        monkeypatch.setattr(suffix.Suffixes, "common", wrong)
    gram, doc, place = np.array(gram), np.array(doc), np.array(place)
    d, start = suffix.repeated(gram, doc, place, data, offsets)
    want = plain_contexts(gram, doc, place, contexts)
    assert set(zip(d.tolist(), start.tolist(), strict=True)) == want and len(want) > 50


def test_suffix_order():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 30))).encode() for _ in range(200)]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    order, shared = suffix.Suffixes(np.frombuffer(b"".join(texts), np.uint8), at, np.array([len(t) for t in texts])).sorted(np.zeros(200, np.int64))
    assert [texts[i] for i in order] == sorted(texts) and shared[0] == -1


def test_repeats_accept_columns_of_any_name(spark):
    passage = "a passage of more than fifty bytes that stands in several documents, twice"
    rows = [(i, f"{i} {passage} {i}", 1, 2, 3, 4, 5) for i in range(5)] * 2  # each row twice
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int, place int, gram int, _doc int, _places int")
    got = suffix.find_repeats(df)
    assert got.columns == [*df.columns, "repeats"]
    assert all(len(r.repeats) == (r.doc_id > 0) and (r.doc, r._places) == (1, 5) for r in got.collect())


def test_empty_batches():
    none = pa.array([], pa.string())
    assert list(minhash.shingle_sets(none, 4)) == []
