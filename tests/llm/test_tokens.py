import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from safespan.llm import bpe, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [*"abcdefghijk'stre ABC0123 \t\n.,;!?éÉßÆΣσςİıſ中文字½१", "😀", "́", "​", "\x85", "\xa0", "\x1c", "\x1d", " ", "　", "ﬁ", "ǅ", "<|endoftext|>", "<|startoftext|>", "'ll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_counts_and_texts_as_the_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 25))) for _ in range(1500)] + ["a" * n for n in range(40)] + ["ab" * n for n in range(40)]
    e, c, d = bpe.encoder(PATH), tokencount.counter(PATH), bpe.decoder(PATH)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.text(t), "<u4").tolist() == ids
        assert c.text(t) == len(ids)
        assert d.texts(np.array(ids, np.int64), np.array([0, len(ids)])) == [library.decode(ids, skip_special_tokens=False)]


def test_forgetting_changes_nothing(library):
    e, c = bpe.Encoder(bpe.Vocabulary(PATH)), tokencount.Counter(bpe.Vocabulary(PATH))
    e.most = c.chunks.most = c.words.most = 2500  # four entries or so in either half
    for i in range(30):
        t = f"word{i} and another one {i % 3} the theory"
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(e.text(t), "<u4").tolist() == ids and c.text(t) == len(ids)
        assert all(len(m) < 20 for m in (e.known, e.older, e.words, c.chunks, c.chunks.older, c.words, c.words.older))


def test_long_words_and_texts_in_parts(monkeypatch, library):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdefgh", k=n)) for n in (3000, 400, 1, 0)] + [" ".join("".join(rng.choices("aeinrst", k=rng.randint(1, 12))) for _ in range(3000))]
    texts += [texts[-1].replace("a ", "a<|endoftext|> "), "x" * 500 + " " + "yz" * 300]
    monkeypatch.setattr(bpe, "PART", 1000)
    monkeypatch.setattr(bpe, "CELLS", 200)
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.texts(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_beside_a_letter(library):
    """Normalization, white space and splitting, for each code point beside itself and a letter."""
    e = bpe.encoder(PATH)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"{p}{p}b " for p in points[i : i + 8]) for i in range(0, len(points), 8)]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.text(t), "<u4").tolist() == want.ids, t.encode("unicode_escape")


def test_columns_nulls_repeats_and_long_texts(spark, library):
    long = "thereon wording " * 20_000
    rows = [(1, None, 5), (2, "", 5), (3, "hello there", 5), (3, "hello there", 5), (4, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")  # the name clashes with the result's
    for packed in (False, True):
        got = bpe.decode(bpe.encode(df, PATH, packed=packed), PATH).orderBy("doc_id").collect()
        assert [r.doc_id for r in got] == [1, 2, 3, 3, 4] and got[0].decoded == got[1].decoded == ""
        assert got[2].decoded == got[3].decoded == library.decode(library.encode("hello there", add_special_tokens=False).ids, skip_special_tokens=False)
    counts = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, PATH).collect()}
    assert counts == {1: 0, 2: 0, 3: 2, 4: len(library.encode(long, add_special_tokens=False).ids)}
    assert bpe.encode(df.limit(0), PATH).count() == tokencount.count_tokens(df.limit(0), PATH).count() == 0


def test_queries_against_the_library(spark, sf, library):
    from safespan.llm.queries import op7_bpe, op9_token_counts

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    counts = {r.doc_id: r for r in op9_token_counts(spark, sf).collect()}
    import hashlib

    got = op7_bpe(spark, sf).collect()
    assert len(got) == len(texts) == len(counts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[r.doc_id].n_tokens == len(ids) and counts[r.doc_id].over_limit == (len(ids) > 2048)


def test_long_words_take_no_longer_than_short_ones(library):
    """A word of a million letters, one of many ideographs, and words about the length from which they count as long."""
    import time

    rng = random.Random(11)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    ideographs = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(33_000))
    words = ["".join(rng.choices("aeinrst", k=n)) for n in range(50, 80)] + ["é" * n for n in range(25, 40)] + ["a" * 100, "a" * 101]
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    e.text("warm up")
    for text, most in ((letters[:100_000], 1.5), (ideographs, 1.5), (letters, 15), (" ".join(words), 5)):
        began = time.process_time()
        got = e.text(text)
        assert time.process_time() - began < most
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
