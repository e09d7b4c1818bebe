"""Near-duplicate groups by circulant MinHash.

Two permutations make all signature coordinates: a first one scatters the shingles over a circle of 2**32 places, a
second one, shifted by 0, 1, 2, ... places, orders them anew; each coordinate is the least value of one shift. Bands of
coordinates give candidate pairs, and every link is confirmed on the full shingle sets.

Documents of equal sets are one node. In a band's bucket no list of pairs is made. Members are first compared with the
bucket's least node, its head; a pair within one component needs no test. Buckets that are then torn (some members in
other components than the head) form clusters, one for each component of a head, and the pairs of a cluster are looked for
by evidence against its consensus R, the shingles that most members have. With L = R without A and E = A without R,

    |A and B| = |R| - |La| - |Lb| + |La and Lb| + |Ea and Eb|,

so a pair of small losses and extras is linked whatever they are (the member of the least of them is then linked with
each such member: a star, not pairs), and any other pair must share a known number of losses or extras, `need`. Members
that don't share as many with anyone are dropped until none is left to drop; what remains is joined on single losses or
extras, the rarest ones, as many as must hold one of the shared ones. So every pair that shares a bucket is tested,
already connected or ruled out exactly, and a group of near copies costs about one test a member. The chance that a pair
of likeness 0.8 shares no bucket is (1 - 0.8**6)**40, about 5 in a million.

Defined cases: null and empty texts and texts without words have an empty set and are linked with nothing; a text with
fewer words than a shingle has its whole sequence as its one shingle; repeated rows fall in one group; rows of one id and
different texts are one document, which has the links of each of its texts, and get one row each; rows without an id are
never linked and kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from safespan.llm.arrays import LOWER, hash_spans, mix64, pack, per_batch, runs, shingle_hashes, text_bytes, unpacked, words
from safespan.session import materialize

ROWS, BANDS = 6, 40
_C1, _C2 = 0x85EBCA6B, 0xC2B2AE35


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles; A-Z count as a-z."""
    data, offsets = text_bytes(column)
    for i, j in runs(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, at = words(part, offsets[i : j + 1] - offsets[i])
        made, at = shingle_hashes(hash_spans(part, starts, ends), at, k)
        for d in range(j - i):
            yield np.unique(made[at[d] : at[d + 1]])


def circulant(shingles: np.ndarray, count: int) -> np.ndarray:
    """The signature of a set: the least value of the second permutation under each of `count` shifts."""
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    # (x + shift) * C1 = x * C1 + shift * C1: the first step of the second permutation is linear
    places = (mix64(shingles) >> np.uint64(32)).astype(np.uint32) * np.uint32(_C1)
    shifts = np.arange(count, dtype=np.uint32) * np.uint32(_C1)
    for lo in range(0, len(places), 256):
        x = places[lo : lo + 256, None] + shifts
        x ^= x >> np.uint32(15)
        x *= np.uint32(_C2)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the signature."""
    parts = signature.reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return key


def signatures(df: DataFrame, key: str, text: str, k: int, rows: int, bands: int) -> DataFrame:
    """key, size of the shingle set, a 128-bit identity of the set, and the band keys (none for empty sets)."""
    schema = T.StructType([
        df.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, a, b, keys = [], [], [], []
        for s in shingle_sets(batch.column(text), k):
            size.append(len(s))
            a.append(int(np.sum(mix64(s + np.uint64(1))).view(np.int64)))
            b.append(int(np.sum(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)))
            keys.append(band_keys(circulant(s, rows * bands), rows).view(np.int64) if len(s) else np.empty(0, np.int64))
        at = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], schema.names)

    return df.select(key, text).mapInArrow(per_batch(make), schema)


def sets_of(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """node, tag (a hash of the set) and its full shingle set; a node of several texts has a row for each. Texts may be
    packed."""
    schema = T.StructType([T.StructField("node", df.schema[key].dataType), T.StructField("tag", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(text)
        made = list(shingle_sets(pa.array(unpacked(column), pa.binary()) if pa.types.is_binary(column.type) else column, k))
        at = np.concatenate(([0], np.cumsum([len(x) for x in made]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, np.uint64), *made]).view(np.int64)))
        tags = pa.array([int(np.sum(mix64(x + np.uint64(1))).view(np.int64)) for x in made], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(key), tags, lists], schema.names)

    return df.select(key, text).mapInArrow(per_batch(make), schema)


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for every node of the links (a, b), by least-neighbour labels with
    shortcuts: each round hands on the least label of the neighbours and then the label of that label."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        new = materialize(hooked.join(up, "comp").select("node", "old", F.least("comp", "above").alias("comp")), "labels")
        done = new.where("comp <> old").isEmpty()
        labels = new.select("node", "comp")
        if done:
            return labels


def roots(parents: DataFrame) -> DataFrame:
    """node, comp for links (a, b) in which each a has one b, below it: the root of each node's tree, by pointer jumping."""
    up = parents.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    tops = parents.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    labels = materialize(up.unionByName(tops).groupBy("node").agg(F.min("comp").alias("comp")), "labels")
    while True:
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        jumped = materialize(labels.join(above, "comp").select("node", F.col("comp").alias("old"), F.col("above").alias("comp")), "labels")
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> old").isEmpty():
            return labels


def dealt(left: DataFrame, right: DataFrame, on: str, most: int = 1000) -> DataFrame:
    """left joined with right on a column that may be hot in left and has few rows for each value in right: right's rows
    are copied for every `most` rows of left, and each row of left goes to one copy."""
    copies = left.groupBy(on).agg(F.ceil(F.count("*") / most).alias("copies"))
    wide = right.join(copies, on).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
    hot = copies.where("copies > 1")
    spread = left.join(hot, on, "left").withColumn("copy", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("copies"))).cast("bigint"))
    return spread.drop("copies").join(wide, [on, "copy"]).drop("copy")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a likeness of `percent` or more."""
    own = sets.select("node", "shingles")
    wide = dealt(pairs, own.withColumnsRenamed({"node": "b", "shingles": "set_b"}), "b")
    wide = wide.join(own.withColumnsRenamed({"node": "a", "shingles": "set_a"}), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = wide.select(*pairs.columns, both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))
    return found.where(F.expr(f"100 * both >= {percent} * either")).select(pairs.columns)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """key, n_shingles, component_id (the least id reachable over links) and kept (whether it is the row's own)."""
    sig = materialize(signatures(df, key, text, k, rows, bands), "signatures")
    usable = sig.where(F.col("n_shingles") > 0).where(F.col(key).isNotNull())
    nodes = materialize(usable.groupBy("set_a", "set_b").agg(F.min(key).alias("node")), "nodes")
    firsts = usable.withColumnRenamed(key, "node").select("node", "set_a", "set_b", "bands")
    rows_ = firsts.join(nodes, ["set_a", "set_b", "node"]).select("node", F.explode("bands").alias("band"))
    heads = rows_.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("band", "head")
    members = materialize(rows_.join(heads, "band").groupBy("head", "node").agg(F.count("*").alias("bands")), "members")
    touched = members.select(F.col("node").alias(key)).distinct()
    # texts are shuffled packed; sorted on both sides, so that the plan is the same at every size
    texts = pack(df.select(key, text), text).join(touched.hint("merge"), key, "left_semi")
    sets = materialize(sets_of(texts, key, text, k).dropDuplicates(["node", "tag"]), "sets")

    # first each node with the least of its heads, then with its other heads, where that can still matter
    pairs = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    labels = roots(confirmed(pairs.groupBy("a").agg(F.min("b").alias("b")), sets, percent).distinct())
    labels = _grow(pairs, labels, sets, percent)
    # then what is apart from its bucket's head with all of the buckets of that head's component
    comp = _labelled(_labelled(members, labels, "node"), labels, "head", "cluster")
    torn = comp.groupBy("cluster").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("cluster")
    clusters = comp.join(torn, "cluster").select("cluster", "node").distinct()
    large = clusters.groupBy("cluster").agg(F.count("*").alias("members")).where("members > 2")  # two were compared already
    clusters = materialize(clusters.join(large, "cluster"), "clusters")
    if not clusters.isEmpty():
        apart = materialize(_against_consensus(clusters, sets, percent), "apart")
        # losses and extras so few that a link is certain
        star = apart.groupBy("cluster").agg(F.min_by("node", "weight").alias("star"), F.min("weight").alias("least"))
        sure = dealt(apart.select("cluster", "node", "weight", "size"), star, "cluster").where(f"weight + least <= {100 - percent} * size and node <> star")
        labels = _grow(sure.select(F.greatest("node", "star").alias("a"), F.least("node", "star").alias("b")).distinct(), labels, sets, percent)
        apart = _labelled(apart, labels, "node").withColumn("main", F.col("cluster"))
        apart = _labelled(apart, labels, "main", "main_comp").withColumn("loose", F.col("comp") != F.col("main_comp")).drop("main", "main_comp")
        apart = materialize(apart, "apart")
        losses = apart.withColumn("items", F.transform("lost", lambda x: x.bitwiseAND(-2)))  # even; extras are odd
        both = losses.withColumn("items", F.concat("items", F.transform("extra", lambda x: x.bitwiseOR(1))))
        pairs = _evidence(both, percent, True).unionByName(_evidence(losses, percent, False)).distinct()
        labels = _grow(pairs, labels, sets, percent)
    found = sig.join(nodes, ["set_a", "set_b"], "left")
    found = found.withColumn("node", F.when((F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.col("node")).otherwise(F.col(key)))
    found = found.join(labels, "node", "left").withColumn("component_id", F.coalesce("comp", "node"))
    return found.select(key, "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str = "comp") -> DataFrame:
    """df with the label of a column of nodes; a node without one is its own."""
    known = labels.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return df.join(known, df[node] == known["_node"], "left").withColumn(name, F.coalesce("_comp", node)).drop("_node", "_comp")


def _against_consensus(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cluster, node, tag, the losses and extras of each member against its cluster's consensus, their weight and the size
    of the consensus. Two members are linked if and only if (100 - percent) * size + (100 + percent) * shared reaches the
    sum of their weights, shared being the number of losses and of extras that they share."""
    wide = clusters.join(sets, "node")
    common = wide.select("cluster", "members", F.explode("shingles").alias("s")).groupBy("cluster", "members", "s").agg(F.count("*").alias("n"))
    consensus = common.where("2 * n > members").groupBy("cluster").agg(F.collect_list("s").alias("consensus"))
    consensus = _with_consensus(clusters.select("cluster").distinct(), consensus)
    made = dealt(wide.select("cluster", "node", "tag", "shingles"), consensus, "cluster")
    made = made.select("cluster", "node", "tag", F.array_except("consensus", "shingles").alias("lost"), F.array_except("shingles", "consensus").alias("extra"), F.size("consensus").cast("long").alias("size"))
    return made.withColumn("weight", 100 * F.size("lost").cast("long") + percent * F.size("extra"))


def _with_consensus(clusters: DataFrame, consensus: DataFrame) -> DataFrame:
    """Each cluster's consensus, an empty one where its members have nothing in common."""
    return clusters.join(consensus, "cluster", "left").withColumn("consensus", F.coalesce("consensus", F.array().cast("array<bigint>")))


def _evidence(apart: DataFrame, percent: int, extras: bool) -> DataFrame:
    """Pairs (a, b) in different components of a cluster that may share as many items as a link needs. With extras: pairs
    that share an extra, losses counting too; without: pairs that reach the number by losses alone."""
    need = f"ceil((weight + other - {100 - percent} * size) / {100 + percent})"
    left = apart.select("cluster", "node", "tag", "comp", "loose", "weight", "size", "items")
    for _ in range(2):  # each round drops members that share too little with any other; none that can have a partner
        counts = left.select("cluster", "node", "tag", F.explode("items").alias("item")).groupBy("cluster", "item").agg(F.min("node").alias("node"), F.min("tag").alias("tag"), F.count("*").alias("n"))
        alone = counts.where("n = 1").groupBy("cluster", "node", "tag").agg(F.collect_list("item").alias("own"))
        least = left.groupBy("cluster").agg(F.min("weight").alias("any_least"), F.min(F.when(F.col("loose"), F.col("weight"))).alias("loose_least")).where("loose_least is not null")
        left = left.join(alone, ["cluster", "node", "tag"], "left").withColumn("items", F.when(F.col("own").isNull(), F.col("items")).otherwise(F.array_except("items", "own"))).drop("own")
        left = dealt(left, least, "cluster").withColumn("other", F.when(F.col("loose"), F.col("any_least")).otherwise(F.col("loose_least"))).drop("any_least", "loose_least")
        left = materialize(left.withColumn("need", F.greatest(F.lit(1), F.expr(need))).where("size(items) >= need").drop("other"), "left")
        if left.isEmpty():
            return left.select(F.col("node").alias("a"), F.col("node").alias("b"))
    single = left.withColumn("shared", F.size("items")).withColumn("losses", F.size(F.filter("items", lambda x: x.bitwiseAND(1) == 0)))
    # of the items in order of rarity, so many that one of any `need` is among them
    if extras:  # at least need - losses of the shared items are extras
        single = single.withColumn("take", F.expr("shared - losses - greatest(1, need - losses) + 1")).withColumn("items", F.filter("items", lambda x: x.bitwiseAND(1) == 1))
    else:
        single = single.withColumn("take", F.expr("shared - need + 1"))
    single = single.where("take > 0").select("cluster", "node", "tag", "comp", "loose", "weight", "size", "shared", "take", F.explode("items").alias("item"))
    counts = single.groupBy("cluster", "item").agg(F.count("*").alias("n"), F.max("loose").alias("with_loose")).where("n > 1")
    single = single.join(counts, ["cluster", "item"])
    single = single.withColumn("place", F.row_number().over(Window.partitionBy("cluster", "node", "tag").orderBy("n", "item")))
    single = materialize(single.where("place <= take and with_loose"), "evidence")
    one = single.where("loose").select("cluster", "item", "size", *[F.col(c).alias(f"{c}_a") for c in ("node", "comp", "weight", "shared")])
    two = single.select(F.col("cluster").alias("cluster_b"), F.col("item").alias("item_b"), "loose", *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "weight", "shared")])
    bound = f"weight_a + weight_b <= {100 - percent} * size + {100 + percent} * least(shared_a, shared_b)"
    once = "(not loose or node_a < node_b)"
    met = one.join(two, [F.col("cluster") == F.col("cluster_b"), F.col("item") == F.col("item_b"), F.expr("comp_a <> comp_b"), F.expr(once), F.expr(bound)])
    return met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _grow(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels after testing the pairs that lie in different components. The new links are followed between components, of
    which there are far fewer than nodes."""
    for side in "ab":
        known = labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_in"))
        pairs = pairs.join(known, side, "left").withColumn(f"{side}_in", F.coalesce(f"{side}_in", side))
    new = materialize(confirmed(pairs.where("a_in <> b_in").select("a", "b", "a_in", "b_in"), sets, percent), "confirmed")
    if new.isEmpty():
        return labels
    merged = components(new.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct())
    above = merged.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
    moved = labels.join(above, "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))
    return materialize(moved.unionByName(merged.join(labels, "node", "left_anti")), "labels")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that stand for their groups of near copies, with all their columns. Of rows of equal id and text one
    stays; rows of one id and different texts are one document and stay or go together."""
    kept = near_duplicates(df, key, text, k, percent).where("kept").select(key).where(F.col(key).isNotNull()).distinct()
    loose = df.where(F.col(key).isNull())
    return df.join(kept, key, "left_semi").dropDuplicates([key, text]).unionByName(loose).select(df.columns)
