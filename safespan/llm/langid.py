"""Language identification by compression.

Each language has a raw-content dictionary for zstandard, made of a bounded sample of its labelled texts. A text is
compressed with each, in parts of PART bytes that each start anew from the dictionary, so that what a dictionary saves
grows with the text; the language with the smallest result in all parts together wins. Where the runner-up is within CLOSE of it (as a share
of its size), as with very short texts, both are weighed again by a slower encoder that also uses matches of three
bytes, and the two sizes are added. Where the runner-up is still within `margin`, the answer is rejected as too close to
call.

Fitting takes at most SAMPLE different labelled texts a language: those with the least hashes among those of at most
LONGEST code points, whole, and where they are too few also longer ones, of which it takes one part of LONGEST code
points, picked by the text's hash. Only these bounded samples reach the driver. Prediction compresses whole texts of any
length.

Defined cases: texts that are null or have no letter get `und`, score 0 and are rejected; ties go to the first language
in alphabetical order and are rejected; repeated rows get equal answers; with no labelled texts all get `und`; an empty
table gives an empty table; other columns are kept, and columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.llm.arrays import per_batch

SAMPLE = 250
LONGEST = 20_000
PART = 100_000
LEVEL = 3
CLOSE = 0.03
MARGIN = 0.002
NONE = "und"


def fit(df: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> dict[str, bytes]:
    """The dictionary content of each language: the sampled texts in lower case, least hash last (nearest to the text)."""
    rows = df.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "long": F.length("text") > longest})
    # texts that repeat count once; only hashes are shuffled for that
    distinct = rows.groupBy("lang", "hash", "long").agg(F.lit(1).alias("one"))
    counts = {(r["lang"], r["long"]): r["n"] for r in distinct.groupBy("lang", "long").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # a first cut by hash leaves about four times the sample in each language, whatever its size
    shares = {k: min(1.0, 4 * sample / n) for k, n in counts.items() if not k[1] or counts.get((k[0], False), 0) < sample}
    share = F.create_map(*[F.lit(x) for (k, long), v in shares.items() for x in (f"{int(long)}{k}", v)])
    key = F.concat(F.col("long").cast("int").cast("string"), "lang")
    few = rows.where(F.pmod(F.col("hash"), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, key), F.lit(0.0)) * (1 << 20))
    best = few.groupBy("lang", "hash", "long").agg(F.min("text").alias("text"))
    order = "row_number() over (partition by lang order by long, hash, text)"
    part = F.expr(f"substring(text, cast(1 + pmod(hash, ceil(length(text) / {longest})) * {longest} as int), {longest})")
    chosen = best.withColumn("place", F.expr(order)).where(F.col("place") <= sample).withColumn("text", part).collect()
    made: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: -r["place"]):
        made.setdefault(r["lang"], []).append(r["text"].lower())
    return {k: "\n".join(v).encode() for k, v in sorted(made.items())}


_compressors: dict[int, list] = {}


def forget() -> None:
    """Drop a worker's compressors. Handed over by name: a copy would clear a copy."""
    _compressors.clear()


def _ready(model: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor, zstandard.ZstdCompressor]]:
    key = hash(tuple(model.items()))
    if key not in _compressors:
        _compressors.clear()
        made = []
        for lang, content in model.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            fine = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            slow = zstandard.ZstdCompressionParameters.from_level(19, min_match=3, strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=False, write_dict_id=False)
            fine.precompute_compress(compression_params=slow)
            quick = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            made.append((lang, quick, zstandard.ZstdCompressor(dict_data=fine, compression_params=slow)))
        _compressors[key] = made
    return _compressors[key]


def classify(text: str | None, model: dict[str, bytes]) -> tuple[str, float, float]:
    """Language, score and margin of one text. The score is the winner's share when each byte saved counts double."""
    if not text or not model or not any(map(str.isalpha, text)):
        return NONE, 0.0, 0.0
    raw = text.lower().encode("utf-8", "replace")
    parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
    ready = _ready(model)
    sizes = sorted((sum(len(quick.compress(x)) for x in parts), lang) for lang, quick, _ in ready)
    least = sizes[0][0]
    close = {lang: n for n, lang in sizes if n - least <= CLOSE * least}
    if len(close) > 1:
        sizes = sorted([(close[lang] + sum(len(slow.compress(x)) for x in parts), lang) for lang, _, slow in ready if lang in close])
        least = sizes[0][0]
    score = 1 / sum(2.0 ** max(least - n, -60) for n, _ in sizes)
    return sizes[0][1], score, (sizes[1][0] - least) / least if len(sizes) > 1 else 1.0


def identify(df: DataFrame, model: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """df with lang_pred, score (0 to 1), margin and rejected."""
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.DoubleType()), ("rejected", T.BooleanType())]
    names = [n for n, _ in new]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(*x) for x in new])
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE * LONGEST characters a language

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [classify(x, shared.value) for x in batch.column(text).to_pylist()]
        keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in names}
        made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[0] == NONE or f[2] <= margin for f in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*keep.values(), *made], [*keep, *names])

    # idle workers stay, and the compressors of a model take some 150 MB
    return df.mapInArrow(per_batch(make, after=forget), schema)
