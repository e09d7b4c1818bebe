"""Benchmark items of any length are matched."""

import random

from safespan.llm import decontam


def test_the_budget_grows_with_the_item():
    rng = random.Random(3)
    for n in (300, 1000, 5000):
        item = "".join(rng.choices("abcdefghij ", k=n))
        m = decontam.Matcher([(7, item)])
        for edits in (n // 50, n // 25, n // 25 + 1):
            x = list(item)
            for p in rng.sample(range(1, n - 1), edits):
                x[p] = "#"
            found = m.matches("z" * 50 + "".join(x) + "z" * 50)
            assert found == ([(7, 50, 50 + n, edits)] if edits <= n // 25 else [])


def test_short_items_match_exactly(spark):
    item = "What is the capital of Peru?"
    assert len(item) < decontam.LEAST
    texts = [(1, f"One. {item.upper()} {item}"), (2, "What is the capital of Peru."), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (6, ""), (7, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.find_matches(docs, items).collect())
    assert got == [(1, 5, 5, 5 + len(item), 0), (1, 5, 6 + len(item), 6 + 2 * len(item), 0)]
    assert [r.doc_id for r in decontam.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3]
