"""What models learn from, and that workers give back what they hold."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from safespan.llm import kneser, langid


def rows(n, words, rng, lang):
    return [(" ".join(rng.choices(words, k=12)), lang) for _ in range(n)]


DE, EN = ("der die das und nicht ist ein mit auf für".split(), "the and of to in that is was for with".split())


def test_languages_of_few_different_texts_are_learned(spark):
    """Rows that repeat five texts 40,000 times count as five texts."""
    rng = random.Random(1)
    few = spark.createDataFrame(rows(5, DE, rng, "de"), "text string, lang string").crossJoin(spark.range(20_000)).drop("id")
    model = langid.fit(few.union(spark.createDataFrame(rows(3000, EN, rng, "en"), few.schema)))
    assert set(model) == {"de", "en"} and model["de"].count(b"\n") == 4 and model["en"].count(b"\n") == langid.SAMPLE - 1
    assert langid.classify("und das ist nicht die der", model)[0] == "de"


def test_languages_of_long_texts_are_learned(spark):
    """Long texts are taken where shorter ones are too few, in one part each."""
    rng = random.Random(2)
    long = [(" ".join(rng.choices(DE, k=9000)), "de") for _ in range(30)]
    df = spark.createDataFrame(long + rows(3, DE, rng, "de") + rows(400, EN, rng, "en") + [(" ".join(rng.choices(EN, k=9000)), "en")], "text string, lang string")
    model = langid.fit(df)
    parts = model["de"].decode().split("\n")
    assert len(parts) == 33 and sum(len(p) == langid.LONGEST for p in parts) >= 5 and max(map(len, parts)) == langid.LONGEST
    assert all(any(p in t.lower() for t, _ in long) for p in parts if len(p) > 1000)
    assert max(map(len, model["en"].decode().split("\n"))) < 1000
    assert langid.classify("und das ist nicht die der", model)[0] == "de"


def test_learning_does_not_depend_on_use(spark):
    """A driver that has classified can still hand the work out, and a worker's compressors go at the end of each task."""
    rng = random.Random(3)
    df = spark.createDataFrame(rows(40, DE, rng, "de") + rows(40, EN, rng, "en"), "text string, lang string")
    model = langid.fit(df)
    langid.classify("the and of", model)
    assert langid._compressors
    left = langid.identify(df, model)
    assert left.where("lang_pred = lang").count() == 80

    def held(batches):
        from safespan.llm import langid as here

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(here._compressors)] * b.num_rows)], ["n"])

    seen = spark.range(0, 1000, 1, 16).mapInArrow(held, "n long").agg(F.max("n")).first()[0]
    assert seen == 0


def test_scorers_are_made_once_in_a_worker(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows(400, EN, rng, "en"))], "doc_id long, text string").repartition(16)
    model, pairs = kneser.model(kneser.count_grams(df, "text"))
    got = kneser.losses(df, model, pairs, "doc_id", "text", ["doc_id"])
    assert got.count() == 400 and kneser._scorers == [None, None]  # the driver made none

    def held(batches):
        from safespan.llm import kneser as here

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0 if here._scorers[1] is None else len(here._scorers[1])] * b.num_rows)], ["n"])

    assert spark.range(0, 1000, 1, 16).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 1  # kept behind the tasks
