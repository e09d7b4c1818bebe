"""Long texts are judged like short ones."""

import random

from safespan.llm import langid


def test_long_texts_keep_their_language():
    rng = random.Random(8)
    words = {lang: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)] for lang in ("aa", "bb")}
    model = {lang: " ".join(rng.choices(w, k=3000)).encode() for lang, w in words.items()}
    text = " ".join(rng.choices(words["aa"], k=2_000_000))
    short, long = (langid.classify(t, model) for t in (text[:90_000], text))
    assert short[0] == long[0] == "aa" and long[2] > 10 * langid.MARGIN
    assert abs(long[2] - short[2]) < 0.2 * short[2]
    assert langid.classify(text[:200_000] + "é", model)[0] == "aa"
