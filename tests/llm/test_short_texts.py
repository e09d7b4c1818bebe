"""Short texts have fingerprints that tell."""

import random

from safespan.llm import winnow


def test_edited_short_texts_share_a_hash():
    assert winnow.K + winnow.W - 1 <= 15
    rng = random.Random(6)
    for n in (30, 31, 45, 63, 64, 94, 95, 130, 189):
        for _ in range(40):
            text = "".join(rng.choices("abcdefgh ", k=n))
            edited = text[: n - n // 2] + "".join(rng.choices("ijklmnop ", k=n // 2))
            assert winnow.likeness(winnow.winnow(text)[0], winnow.winnow(edited)[0]) > 0
