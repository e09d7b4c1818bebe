import numpy as np

import corpus_pipeline
from safespan.llm import secrets
from safespan.session import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        if name != "encoding":
            assert out.columns == columns and out.dtypes == docs.dtypes
        if name == "language_id":
            labels = {r.doc_id: r.lang for r in docs.collect()}
            assert np.mean([r.lang == labels[r.doc_id] for r in out.collect() if labels[r.doc_id]]) > 0.95
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        assert seen[name] <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
        if name == "secret_scan":
            assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in out.collect())
    assert len(seen["near_dedup"]) < len(seen["language_id"]) and len(seen["decontamination"]) < len(seen["near_dedup"])
    assert seen["decontamination"] == seen["secret_scan"] == seen["encoding"]
    assert len(seen["language_id"]) > 0.97 * spark.read.parquet(f"{sf}/documents.parquet").count()


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
    assert docs.count() == 0


def test_stages_take_nulls_repeats_and_other_columns(spark, sf):
    text = "the house stands by the river and the people of the town walk along it in the evening when it is warm"
    rows = [(1, text, "en", "a", 1, 2), (1, text, "en", "a", 1, 2), (2, None, None, None, None, 2), (3, "", "en", "a", 0, 2), (None, text + " again", "en", "a", 5, 2), (4, text + " token=abcdefgh12", None, "b", 9, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.dtypes == docs.dtypes
        docs = out
    kept = sorted((r.doc_id or 0, r.text) for r in docs.collect() if r.text)
    assert [i for i, _ in kept] in ([0, 1], [0, 1, 4]) and all("abcdefgh12" not in t for _, t in kept)
    few = docs.drop("lang", "n_chars")
    assert corpus_pipeline.secret_scan(spark, few, sf).columns == few.columns
    assert corpus_pipeline.encoding(spark, few, sf).columns == ["doc_id", "source", "n_tokens", "ids"]
