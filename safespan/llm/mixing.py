"""Mixtures of sources with exact quotas, by a multivariate-hypergeometric splitting tree.

Each source's words lie end to end in an order of content hashes and are cut into blocks of equal length. Sources weigh
5, 2, 1, 5, ... by their order and share `share` times all words; a target stops at `most` times its source, and the
excess is shared anew by weight (`targets`). A source's quota is its target in blocks; its blocks are drawn in the order
of a keyed permutation, anew for each round through the source, so that no block is drawn more than `most` times.

The tree deals the quotas over output shards: a node holds a range of shards and how many blocks of each source they get.
Its left half of shards gets as many blocks as it has room for, drawn without replacement from the node's: source after
source by the hypergeometric distribution given what is left. So each leaf has the exact numbers that a shuffle of all
blocks would give it, and of each source a range of draws that no other leaf has. The leaf turns its draws into blocks by
the permutation and shuffles them among themselves.

All of it is column expressions. What moves is a narrow row for each distinct document (`sizes`), block and shard; texts
are read once to be counted and again only by `texts`. A node's row is as long as the number of sources, a leaf's as the
number of blocks in a shard; sources are the components of a mixture, and windows over them alone have one row for each.

Defined cases: null and empty texts and texts without words have size 0 and are taken 0 times; a null source is a source
of its own, the last; sources without words have target 0; repeated rows (equal id, source and text) count each and get a
row each; null ids are ids; an empty table gives empty results; other columns don't matter, and none of their names can
clash with those made here. Reruns agree: every draw is a function of the content, the parameters and the seed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safespan.session import materialize

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Words of a block at most, blocks of a source's quota at least, and words of a shard unless the number is given.
BLOCK, LEAST = 4096, 256
SHARD = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each distinct (id, source, text): id, source, size in words, a hash of the text, and copies."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words.alias("size"), F.xxhash64(text).alias("hash"))
    return materialize(rows.groupBy("id", "source", "size", "hash").agg(F.count("*").alias("copies")), "sizes")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, words) with place (from 0, by code point, null last) and target.

    With targets w * level, capped at most * words, the level is the one that uses up the share. Sources are capped in the
    order of words to weight; the level is what the first one that isn't capped finds when those before it are."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sources.withColumn("place", F.row_number().over(order) - 1)
    placed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1))
    cap, w, everything = F.col("words") * most, F.col("weight"), Window.partitionBy()
    first = Window.orderBy(cap / w, "place")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("words").over(everything) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = left / (F.sum(w).over(everything) - F.coalesce(F.sum(w).over(before), F.lit(0.0)))
    levels = placed.withColumns({"_level": level, "_order": F.row_number().over(first)})
    open_ = F.col("_level") <= cap / w
    chosen = levels.withColumn("_chosen", F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.col("_order"))).over(everything))
    return chosen.withColumn("target", F.least(cap, F.coalesce(w * F.col("_chosen"), cap))).drop("_level", "_order", "_chosen", "weight")


def quotas(found: DataFrame, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """Targets with the words of a block, the number of the source's blocks and its quota of them: blocks are short enough
    for a quota of `least` of them, where the words suffice."""
    step = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / least))).cast("long")
    out = found.withColumn("step", step).withColumn("blocks", F.ceil(F.col("words") / F.col("step")).cast("long"))
    quota = F.when(F.col("words") > 0, F.round(F.col("blocks") * (F.col("target") / F.col("words")))).otherwise(0)
    return out.withColumn("quota", quota.cast("long"))


def _let(values: Column, use) -> Column:
    """use(values), with the values computed once."""
    return F.transform(F.array(values), use)[0]


def unit(*keys: Column) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def hypergeometric(marked: Column, all_: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` draws without replacement from `all_`, `marked` of them marked, are marked: the inverse of the
    distribution at u. The sums run over ten deviations and ten on either side of the mean; what lies beyond is below the
    resolution of a double."""
    mean = drawn * marked / F.greatest(all_, F.lit(1))
    wide = 10 * F.sqrt(mean * (1 - marked / F.greatest(all_, F.lit(1))) * (all_ - drawn) / F.greatest(all_ - 1, F.lit(1))) + 10
    low = F.greatest(F.lit(0), drawn - (all_ - marked), F.floor(mean - wide)).cast("long")
    high = F.least(marked, drawn, F.ceil(mean + wide)).cast("long")
    given = F.struct(marked.cast("double").alias("k"), drawn.cast("double").alias("m"), (all_ - marked - drawn).cast("double").alias("rest"), low.alias("low"), high.alias("high"), u.alias("u"))

    def pick(v: Column) -> Column:
        steps = F.sequence(v["low"], v["high"])

        def next_(weight: Column, x: Column) -> Column:
            return weight * (v["k"] - x) * (v["m"] - x) / ((x + 1) * (v["rest"] + x + 1))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        total = F.aggregate(steps, start, lambda s, x: F.struct(next_(s["w"], x).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
        begin = F.struct(F.lit(1.0).alias("w"), (v["u"] * total).alias("left"), v["low"].alias("x"), F.lit(False).alias("done"))

        def step(s: Column, x: Column) -> Column:
            hit = s["done"] | (s["left"] <= s["w"])
            return F.struct(next_(s["w"], x).alias("w"), (s["left"] - s["w"]).alias("left"), F.when(s["done"], s["x"]).otherwise(x).alias("x"), hit.alias("done"))

        return F.aggregate(steps, begin, step, lambda s: s["x"])

    return _let(given, pick)


_PARTS = "array<struct<place:int,blocks:bigint,first:bigint,quota:bigint>>"


def _halves(total: int, shards: int, seed: int) -> Column:
    """The two nodes below a node (low, high, parts); a node of one shard stays."""
    middle = F.expr("(low + high) div 2")
    take = F.expr(f"(low + high) div 2 * {total} div {shards} - low * {total} div {shards}")  # room in the left shards
    all_ = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["quota"])
    begin = F.struct(all_.alias("all"), take.alias("take"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        x = hypergeometric(p["quota"], s["all"], s["take"], unit(F.lit(seed), F.col("low"), F.col("high"), p["place"]))
        return _let(x, lambda x: F.struct((s["all"] - p["quota"]).alias("all"), (s["take"] - x).alias("take"), F.concat(s["out"], F.array(x)).alias("out")))

    drawn = F.aggregate("parts", begin, step, lambda s: s["out"])

    def part(p: Column, first: Column, quota: Column) -> Column:
        return F.struct(p["place"].alias("place"), p["blocks"].alias("blocks"), first.cast("long").alias("first"), quota.cast("long").alias("quota"))

    def two(x: Column) -> Column:
        left = F.transform("parts", lambda p, i: part(p, p["first"], F.get(x, i)))
        right = F.transform("parts", lambda p, i: part(p, p["first"] + F.get(x, i), p["quota"] - F.get(x, i)))
        kept = [F.filter(y, lambda p: p["quota"] > 0) for y in (left, right)]
        return F.array(*[F.struct(a.alias("low"), b.alias("high"), y.alias("parts")) for a, b, y in ((F.col("low"), middle, kept[0]), (middle, F.col("high"), kept[1]))])

    same = F.array(F.struct("low", "high", "parts"))
    return F.when(F.col("high") - F.col("low") > 1, _let(drawn, two)).otherwise(same)


def split(found: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard and parts (place, blocks, first, quota): how many blocks of each source a shard gets, and of which draws."""
    part = F.struct("place", "blocks", F.lit(0).cast("long").alias("first"), "quota")
    root = found.where("quota > 0").agg(F.array_sort(F.collect_list(part)).cast(_PARTS).alias("parts"))  # a row for each source
    total = found.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    nodes = root.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "parts")
    levels = max(1, (shards - 1).bit_length())
    for level in range(levels):
        nodes = nodes.select(F.explode(_halves(total, shards, seed)).alias("n")).select("n.*")
        if level in (levels // 2, levels - 1) and shards > 1:  # half of the levels run in one task for few nodes, the others in many
            nodes = nodes.repartition(min(shards, 4096), "low")
    return nodes.select(F.col("low").alias("shard"), "parts")


def permuted(x: Column, n: Column, *keys: Column) -> Column:
    """The place of x under a keyed permutation of 0..n-1: four rounds over an a x c grid, walked again while they lead to
    one of the less than a places beyond n."""

    def walk(v: Column) -> Column:
        a, c = v["a"], v["c"]

        def round_(x: Column, k: int) -> Column:
            """Each half moves by a hash of the other."""
            return _let(F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r")), lambda h: _let(
                (h["l"] + F.pmod(F.xxhash64(h["r"], F.lit(k), *keys), a)) % a,
                lambda l: l + a * ((h["r"] + F.pmod(F.xxhash64(l, F.lit(-k), *keys), c)) % c),
            ))

        def once(x: Column) -> Column:
            return _let(round_(x, 1), lambda y: round_(y, 2))

        # of 64 walks each but the first is needed with a chance below 1 / sqrt(n) only
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(v["x"]), lambda y, _: F.when(y >= v["n"], once(y)).otherwise(y))

    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return _let(F.struct(x.alias("x"), n.alias("n"), side.alias("a"), F.ceil(n / side).cast("long").alias("c")), walk)


def draws(leaves: DataFrame, seed: int) -> DataFrame:
    """shard, at (its place in the shard), place (of the source), block and round: every drawn block, shuffled in its
    shard."""

    def of(p: Column) -> Column:
        numbers = F.sequence(p["first"], p["first"] + p["quota"] - 1)
        return F.transform(numbers, lambda x: F.struct(F.xxhash64(F.lit(seed + 1), x, p["place"]).alias("key"), p["place"].alias("place"), p["blocks"].alias("blocks"), x.alias("draw")))

    blocks = leaves.select("shard", F.posexplode(F.array_sort(F.flatten(F.transform("parts", of)))).alias("at", "d")).select("shard", "at", "d.*")
    turn = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    block = permuted(F.col("draw") - turn * F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("place"), turn)
    return blocks.select("shard", "at", "place", block.alias("block"), turn.alias("round"))


def laid(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each copy of a document with its place, step and start in the words of its source. Documents are dealt
    over buckets of content hashes, about as many as a bucket has rows; each bucket starts where those before it end."""
    buckets = 1 << (math.isqrt(rows.count())).bit_length()
    # a mixture has few sources, but nothing bounds them: the joins are left to Spark
    placed = rows.join(found.select(F.col("source").alias("_source"), "place", "step"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = F.xxhash64("id", "hash")
    placed = placed.withColumns({"bucket": F.pmod(key, F.lit(buckets)), "key": key})
    ends = placed.groupBy("place", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("n"))
    before = ends.select("place", "bucket", (F.sum("n").over(Window.partitionBy("place").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("place", "bucket").orderBy("key", "id", "hash", "size")
    within = placed.withColumn("within", F.sum(F.col("size") * F.col("copies")).over(inner) - F.col("size") * F.col("copies"))
    copies = within.join(before, ["place", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return copies.select("id", "source", "hash", "copy", "size", "place", "step", (F.col("before") + F.col("within") + F.col("copy") * F.col("size")).alias("start"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, least: int = LEAST, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixture as (pieces, documents, sources).

    pieces: shard, at, place, block, round, id, hash, copy, first, words: the words of a document that lie in a drawn
    block, by their first word's number. In order of shard, at and start they are the mixture. documents: every copy of a
    document with its size and start; sources: source, words, place, target, step, blocks, quota."""
    rows = sizes(docs, id, text, source)
    found = materialize(quotas(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), weights, share, most), block, least), "sources")
    if shards is None:
        shards = int((found.agg(F.sum("target")).first()[0] or 0) // SHARD) + 1
    documents = materialize(laid(rows, found), "laid")
    drawn = draws(split(found, shards, seed), seed)
    begin, end, step = F.col("start"), F.col("start") + F.col("size"), F.col("step")
    spans = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(begin / step).cast("long"), F.floor((end - 1) / step).cast("long"))))
    lo, hi = F.greatest(begin, F.col("block") * step), F.least(end, (F.col("block") + 1) * step)
    spans = spans.select("id", "hash", "copy", "place", "block", "start", (lo - begin).alias("first"), (hi - lo).alias("words"))
    return drawn.join(spans, ["place", "block"]), documents, found


def taken(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    """Every copy of a document with the words that the mixture takes of it."""
    sums = pieces.groupBy("place", "start").agg(F.sum("words").alias("taken"))  # a start belongs to one document with words
    out = documents.where("size > 0").join(sums, ["place", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.unionByName(documents.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def texts(pieces: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """pieces with the words themselves, joined by spaces, as `piece`."""
    rows = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).distinct()
    joined = pieces.join(rows, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    words = F.slice(F.regexp_extract_all("_text", F.lit(f"({WORD})")), (F.col("first") + 1).cast("int"), F.col("words").cast("int"))
    return joined.withColumn("piece", F.array_join(words, " ")).drop("_id", "_hash", "_text")
