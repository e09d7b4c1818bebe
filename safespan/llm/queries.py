"""The queries of the text operators, each over the whole of its tables, and the SQL they can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from safespan.llm import bpe, collocations, decontam, kneser, langid, minhash, mixing, resample, secrets, suffix, tokencount, toxicity, winnow
from safespan.llm.arrays import pack, unpack

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = unpack(winnow.with_next(pack(docs, "text"), keys=docs), "text", "next_text").withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_text")
    return winnow.compare(pairs, "text", {"edited": ("near_edited", "edited_fingerprint"), "next_text": ("near_next", None)})


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("secrets", secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.joined("secrets", secrets.KINDS).alias("spans"))


def held_out(n: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n == rest


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(3, 1)))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = suffix.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = suffix.cut(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("repeats").cast("long").alias("n_spans"), "repeats"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kneser.judge(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    machine = toxicity.fit(docs.where(~held_out(4, 2)).join(F.broadcast(sampled(labels.where(~held_out(4, 2)))), "doc_id"))
    found = toxicity.score(docs, machine)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.FLAG).cast("int").alias("predicted"))


def sampled(labels: DataFrame) -> DataFrame:
    """About toxicity.SAMPLE labels, as many as fitting uses, those of the least key hashes, before any text is read."""
    n = labels.count()
    if n <= toxicity.SAMPLE:
        return labels
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * toxicity.SAMPLE / n))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, packed=True).select("doc_id", "ids")
    both = bpe.decode(ids, path)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = tokencount.count_tokens(docs, public_tokenizers.path(WORD_BPE))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counts.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, documents, sources = mixing.mix(table(spark, sf_dir, "documents"))
    found = sources.select("place", F.col("words").alias("source_size"), "target")
    return mixing.taken(pieces, documents).join(found, "place").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_minhash": op2_minhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_language": op4_language,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_bpe": op7_bpe,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_mixing": op11_mixing,
    "op12_resampling": op12_resampling,
    "op13_collocations": op13_collocations,
}

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)] END) AS sh
  FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, o.b FROM reach r JOIN both_ways o ON o.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

RESAMPLING = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
w AS (
  SELECT side, id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
f AS (SELECT side, row, unnest(ws || [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS feature FROM w),
n AS (SELECT side, row, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (
  SELECT feature, xor(list_reduce([4294967295] || [('0x' || h[2 * i + 1:2 * i + 2])::BIGINT for i in range(0, len(h) // 2)], lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM n)), t),
k AS (SELECT range AS bucket FROM range(10000)),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM k LEFT JOIN (b JOIN n USING (feature)) USING (bucket) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM s),
m AS (SELECT row, sum(n * gain)::DOUBLE AS gain FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY row),
x AS (
  SELECT id AS doc_id, len(ws) AS n_words, greatest(2 * len(ws) - 1, 0)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE floor(gain / (2 * len(ws) - 1)) END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[:8])::BIGINT + 0.5e0) / 4294967296e0)))::BIGINT AS noise
  FROM w LEFT JOIN m USING (row) WHERE side = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER (PARTITION BY n_words >= 20) AS total FROM x)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND rank <= total * 25 // 100 THEN rank END AS rank FROM r
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
g AS (SELECT lang, k, unnest([ws[i:i + k - 1] for i in range(1, len(ws) - k + 2)]) AS ws FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
inside AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(n) AS longer FROM f, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) WHERE i < j AND j <= k AND j - i + 1 < k GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR 100 * longer < 100 * n)),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, x.n AS l, y.n AS r, t.n, cut, (1000::HUGEINT * c.n * t.n) // (x.n::HUGEINT * y.n) AS score
  FROM c JOIN (SELECT unnest(range(1, 5)) AS cut) ON cut < k JOIN f x ON x.lang = c.lang AND x.ws = c.ws[:cut] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[cut + 1:] JOIN t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM best QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {"op2_minhash": NEAR_DUPLICATES, "op12_resampling": RESAMPLING, "op13_collocations": COLLOCATIONS}
