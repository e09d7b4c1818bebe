"""The corpus pipeline: documents in, token ids of the clean ones out.

Each stage takes what its predecessor kept and works on all of it. Documents whose language is too close to call go;
one document of each group of near copies stays; documents that hold a benchmark item go; secrets are masked; what is
left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from safespan.llm import bpe, decontam, langid, minhash, secrets
from safespan.session import materialize

WORD_BPE = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language, which becomes their lang; null texts and texts without letters have none. Each half
    of the documents is judged by what was learned from the other half."""
    half = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2
    parts = []
    for i in (0, 1):
        found = langid.identify(docs.where(half == i), langid.fit(docs.where(half != i))).where("not rejected")
        parts.append(found.withColumn("lang", F.col("lang_pred")).select(docs.columns))
    return parts[0].unionByName(parts[1])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness 0.8), the one with the least id."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, give or take the edit budget."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked and n_chars, where there is one, brought up to date."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and their number."""
    path = public_tokenizers.path(WORD_BPE)
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    ids = bpe.encode(docs.select(*kept, "text"), path)
    return ids.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
