"""Near copies by the similarity of their sets of five-word shingles.

A text's set is sketched by 150 minima of hashes, in 30 bands of five.  Two texts
of similarity 0.8 agree in no band with a probability of (1 - 0.8**5)**30, seven in
a million.  Texts that share a band and are not in one group yet are compared by
their whole sets, all of them where at most 16 texts of a bucket are outside its
largest group.  In larger buckets two leaders first merge what is alike as a whole.
The texts of buckets that are still mixed then, such as pages of one template, meet anew by their rarest shingles: two sets of similarity s
share one among the first n - s n + 1 of n shingles in the order of their frequency.
Shingles that only one text has come first there and bring nobody together, so pages
that have a fifth or more for themselves are no candidates, however many there are, and
no link is lost.  Buckets of one rare shingle that are themselves that large and mixed
are compared in full as well, in blocks that bound what a task holds; that work grows
with the square of such a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import connected_components, release, stored

JACCARD = 0.8
WIDTH, BANDS, ROWS = 5, 30, 5
#: Texts outside its largest group up to which a bucket is compared in full.
ALL_PAIRS = 16
#: Texts whose sets are handed over at once.
TOGETHER = 500
#: Texts and shingles of a block, at most, where all pairs of large buckets are compared.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles whose holders are laid out at once there.
AT_ONCE = 1024

_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _RANDOM.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS, np.uint64)


def wide_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted different hashes of five-word shingles; none for texts of fewer words.

    ``hashes`` are those of the runs of three words: the ones at i and i + 2 make up
    the five words from i on.
    """
    if words < WIDTH:
        return np.zeros(0, np.uint64)
    mixed = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(mixed ^ mixed >> np.uint64(31))


def band_keys(wide: np.ndarray) -> list[int]:
    """One key for each band of the set's minima; none for an empty set."""
    if not len(wide):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(wide), 512):
        least = np.minimum(least, (wide[at : at + 512, None] * FACTORS).min(axis=0))
    keys = (least.reshape(BANDS, ROWS) >> np.uint64(1)) * MIX
    return (keys.sum(axis=1, dtype=np.uint64) + OFFSETS).view(np.int64).tolist()


#: Bits of a set's parities.
PARITY = 512


def parities(wide: np.ndarray) -> list[int]:
    """For each of ``PARITY`` classes of hashes whether the set has an odd number of them, as longs.

    Sets that differ in d members differ in d of these bits at most, so many different
    bits rule a pair out without its sets.
    """
    odd = np.bincount((wide % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).tolist()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(text_hash, shingles)``: the whole sets of the texts in ``wanted``."""
    from .simhash import shingle_hashes

    arrow = pa.schema([("text_hash", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.slice(at, TOGETHER)
                sets = [wide_hashes(*shingle_hashes(t.as_py())).view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], schema=arrow)

    text = F.col("text").cast("string")
    held = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(wanted, "text_hash", "left_semi")
    return held.dropDuplicates(["text_hash"]).mapInArrow(run, "text_hash long, shingles array<long>")


def similar_roots(docs: DataFrame, pairs: DataFrame, jaccard: float, parity: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """``(root_a, root_b)`` of the ``pairs`` of texts whose whole sets are similar.

    Sets are read and compared only where ``parity`` leaves that open.
    """
    told = pairs.dropDuplicates(["a", "b"]).join(parity.toDF("a", "odd_a"), "a").join(parity.toDF("b", "odd_b"), "b")
    differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = stored(told.where(differ <= (1 - jaccard) / (1 + jaccard) * (F.col("n_a") + F.col("n_b")) + 1e-9).drop("odd_a", "odd_b"))
    if sets is None:
        sets = stored(shingle_sets(docs, pairs.select(F.col("a").alias("text_hash")).union(pairs.select("b")).distinct()))
    whole = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return whole.where(both >= jaccard * (F.col("n_a") + F.col("n_b") - both) - 1e-9).select("root_a", "root_b").distinct()


def _sides(left: DataFrame, right: DataFrame, jaccard: float) -> DataFrame:
    """Pairs of two sides that share a key, are in different groups and of sizes that similar texts can have, with the smaller text first.

    All filters are on the sides' own columns.  Filters on pairs in order are pushed into
    the join, and with the order in each of them the JVM's compiler took 0.5 GB for it.
    """
    near = F.least("n", "m") >= jaccard * F.greatest("n", "m") - 1e-9
    both = left.toDF("key", "text", "n", "root").join(right.toDF("key", "other", "m", "far"), "key").where("text != other and root != far").where(near)
    of = lambda x, y, name: F.when(F.col("text") < F.col("other"), F.col(x)).otherwise(F.col(y)).alias(name)
    return both.select(
        of("text", "other", "a"), of("n", "m", "n_a"), of("root", "far", "root_a"),
        of("other", "text", "b"), of("m", "n", "n_b"), of("far", "root", "root_b"),
    )


MEMBER = ("key", "text_hash", "n", "root")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one group, with ``rest``, how many are outside the largest, and ``major``, that group.

    Members may be exploded and are then more than Spark takes them for, so they are not to be broadcast.
    """
    groups = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    sizes = groups.groupBy("key").agg((F.sum("c") - F.max("c")).alias("rest"), F.max(F.struct("c", "root"))["root"].alias("major"))
    return members.select(*MEMBER).hint("merge").join(sizes.where("rest > 0"), "key")


def _in_full(few: DataFrame, jaccard: float) -> DataFrame:
    """Pairs of each text outside its bucket's largest group with all of like size that are in another group."""
    return _sides(few.where("root != major").select(*MEMBER), few.select(*MEMBER), jaccard)


def _with_leaders(many: DataFrame, jaccard: float) -> DataFrame:
    """Pairs of two texts of each bucket with all of it that are of like size."""
    by = F.struct(F.xxhash64("text_hash", F.lit(0)), "text_hash", "n", "root")
    chosen = many.groupBy("key").agg(F.array(F.min(by), F.max(by)).alias("leaders"))
    leaders = chosen.select("key", F.explode("leaders").alias("x")).select("key", "x.text_hash", "x.n", "x.root")
    return _sides(leaders, many.select(*MEMBER), jaccard)


def _moved(members: DataFrame, step: DataFrame) -> DataFrame:
    """Members with the roots that ``step`` made of theirs."""
    to = members.join(step, members["root"] == step["node"], "left")
    return to.select("key", "text_hash", "n", F.coalesce("component", "root").alias("root"))


def merged_roots(docs: DataFrame, texts: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``(node, component)`` of the roots that similar texts connect.

    ``texts`` has ``text_hash``, its ``n`` different shingles, ``bands``, ``parity`` and
    the ``root`` of the group that it is in.
    """
    parity = texts.select("text_hash", "parity")
    members = stored(_mixed(texts.select(F.explode("bands").alias("key"), "text_hash", "n", "root")))
    merged, left = _merge(docs, members, None, jaccard, parity, None)
    hot = stored(left.select("text_hash", "n", "root").distinct())
    if hot.isEmpty():
        return merged
    sets = stored(shingle_sets(docs, hot.select("text_hash")))
    rare = stored(_mixed(_once_each(rare_shingles(hot, sets, jaccard))))
    merged, left = _merge(docs, rare, merged, jaccard, parity, sets)
    few, many = left.where(F.col("rest") <= ALL_PAIRS), left.where(F.col("rest") > ALL_PAIRS)
    found = similar_roots(docs, _in_full(few, jaccard), jaccard, parity, sets).union(linked_in_blocks(many, sets, jaccard))
    return stored(_carried(merged, stored(connected_components(found))))


def _merge(docs: DataFrame, members: DataFrame, merged: DataFrame | None, jaccard: float, parity: DataFrame, sets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What buckets add to ``merged``: in full where few are outside the largest group, else by two leaders.

    Also the members, by their roots now, of the buckets that leaders have left mixed.
    """
    many = members.where(F.col("rest") > ALL_PAIRS)
    pairs = _in_full(members.where(F.col("rest") <= ALL_PAIRS), jaccard).union(_with_leaders(many, jaccard))
    step = stored(connected_components(stored(similar_roots(docs, pairs, jaccard, parity, sets))))
    merged = step if merged is None else stored(_carried(merged, step))
    return merged, stored(_mixed(_moved(many, step)))


def _once_each(members: DataFrame) -> DataFrame:
    """Members of one bucket of those that hold the same texts, told by their number and two sums of hashes."""
    told = [F.count("*"), *(F.sum(F.xxhash64("text_hash", F.lit(k)).cast("decimal(38,0)")) for k in range(2))]
    alike = members.groupBy("key").agg(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(told))).alias("_texts"))
    return members.join(alike.groupBy("_texts").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def linked_in_blocks(many: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """``(root_a, root_b)``: links that connect the roots of all similar texts that share a bucket, every pair compared.

    Similar sets are of one class of sizes or of neighbouring ones.  A bucket's texts of
    a class are dealt into blocks that hold so many texts and shingles at most, and each
    pair of blocks with texts outside the bucket's largest group is one small task's work.
    """
    width = math.log(1 / jaccard) + 1e-6
    held = many.withColumns({"c": F.floor(F.log("n") / width), "apart": F.col("root") != F.col("major")})
    size = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), BLOCK_SHINGLES / F.exp((c + 1) * width)))
    counts = held.groupBy("key", "c", "apart").agg(F.ceil(F.count("*") / size(F.col("c"))).alias("blocks"))
    own = held.join(counts, ["key", "c", "apart"]).withColumn("block", F.pmod(F.xxhash64("text_hash", F.lit(1)), "blocks"))
    other = counts.select("key", F.col("c").alias("c_2"), F.col("apart").alias("apart_2"), F.col("blocks").alias("blocks_2"))
    dealt = own.join(other, "key").where(((F.col("c") - F.col("c_2")).between(-1, 1)) & (F.col("apart") | F.col("apart_2")))
    dealt = dealt.withColumn("block_2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_2") - 1)))
    one, two = F.struct("c", "apart", "block"), F.struct(F.col("c_2").alias("c"), F.col("apart_2").alias("apart"), F.col("block_2").alias("block"))
    work = dealt.select(F.struct("key", F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).alias("work"), (one <= two).alias("first"), "text_hash", "n", "root")
    return work.join(sets, "text_hash").groupBy("work").applyInArrow(lambda rows: _links_of(rows, jaccard), "root_a long, root_b long")


def _links_of(rows: pa.Table, jaccard: float) -> pa.Table:
    """Links from each root to the smallest that similar sets of two blocks, or within one, connect it with."""
    n, first = rows["n"].to_numpy(), rows["first"].to_numpy()
    names, root = np.unique(rows["root"].to_numpy(), return_inverse=True)
    one = np.flatnonzero(first)
    two = np.flatnonzero(~first) if not first.all() else one
    code, owner, shared = _shared(rows["shingles"])
    both = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, shared, AT_ONCE):
        some = slice(*np.searchsorted(code, [at, at + AT_ONCE]))
        holds = np.zeros((len(n), AT_ONCE), np.float32)
        holds[owner[some], code[some] - at] = 1
        both += holds[one] @ holds[two].T
    near = (both >= jaccard * (n[one][:, None] + n[two] - both) - 1e-9) & (root[one][:, None] != root[two])
    a, b = (root[side[k]] for side, k in zip((one, two), np.nonzero(near)))
    least, before = np.arange(len(names)), None
    while before is None or (least != before).any():
        before, small = least.copy(), np.minimum(least[a], least[b])
        np.minimum.at(least, a, small)
        np.minimum.at(least, b, small)
    moved = np.flatnonzero(least != np.arange(len(names)))
    return pa.table({"root_a": names[moved], "root_b": names[least[moved]]})


def _shared(sets: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles that several of the sets have, numbered and in order, the set of each, and how many there are."""
    values = np.concatenate([c.flatten().to_numpy() for c in sets.chunks])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), np.concatenate([c.value_lengths().to_numpy() for c in sets.chunks]))
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    del order
    code = np.cumsum(np.append(False, values[1:] != values[:-1]), dtype=np.int32)
    del values
    several = np.bincount(code) > 1
    kept = several[code]
    return (np.cumsum(several, dtype=np.int32) - 1)[code[kept]], owner[kept], int(several.sum())


def rare_shingles(hot: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """``(key, text_hash, n, root)``: each text under those of its rarest shingles that a similar text must have one of.

    Of its n shingles, in the order of how many texts have them, these are the first
    n - jaccard * n + 1; the ones that no other text has are among them but bring nobody
    together, so they are only counted.
    """
    each = hot.join(sets, "text_hash").select("text_hash", "n", "root", F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(often, "key")
    own = Window.partitionBy("text_hash")
    first = F.col("n") - F.ceil(jaccard * F.col("n") - 1e-9) + 1 - (F.col("n") - F.count("*").over(own))
    ranked = shared.withColumns({"_rank": F.row_number().over(own.orderBy("often", "key")), "_first": first})
    return ranked.where(F.col("_rank") <= F.col("_first")).select(*MEMBER)


def _carried(merged: DataFrame, step: DataFrame) -> DataFrame:
    """Roots by what ``step`` made of their components, and the roots that only ``step`` has."""
    to = step.toDF("from", "to")
    moved = merged.join(to, merged["component"] == to["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.union(step.join(merged, "node", "left_anti").select("node", "component"))
