"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's sketch is made of the MinHash order of its own shingles: the shingles with
the smallest hashes.  A document is a candidate if it holds any of them.  How many
are needed follows from the item's size: if a document holds a share t of the item's
n distinct shingles, it lacks at most n - ceil(t n) of them, so one more than that
many sketch shingles cannot all be missing, however long the document is.  Items
are partitioned by size in powers of two, and each partition takes the sketch size
of its largest n.  Candidates are verified by exact containment of whole shingles.

Everything here is DataFrame functions; no Python runs in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

WIDTH = 5
CONTAINMENT = 0.8
#: Rows of sketches or candidate ids up to which a side is broadcast, at 16 bytes a row.
BROADCAST_ROWS = 500_000
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives none."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)
    )


def _shingles(array: str, width: int, make: str) -> Column:
    """One value for each run of ``width`` words of the column ``array``."""
    run = ", ".join([f"get({array}, i + {k})" if k else "x" for k in range(width)])
    call = f"{make}({run})" if make == "xxhash64" else f"concat_ws(' ', {run})"
    return F.expr(f"slice(transform({array}, (x, i) -> {call}), 1, greatest(size({array}) - {width - 1}, 0))")


def item_shingles(items: DataFrame) -> DataFrame:
    """``(item_id, width, shingle, hash, n)``: the distinct shingles of every item.

    Rows of one item_id are one item.  An item of fewer than five words is one
    shingle of all its words; an item without words, or without an id, has none.
    """
    base = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    base = base.withColumn("width", F.least(F.size("w"), F.lit(WIDTH))).where("width > 0")
    hashed, plain = F.lit(None), F.lit(None)
    for width in range(1, WIDTH + 1):
        hashed = F.when(F.col("width") == width, _shingles("w", width, "xxhash64")).otherwise(hashed)
        plain = F.when(F.col("width") == width, _shingles("w", width, "text")).otherwise(plain)
    rows = base.select("item_id", "width", F.explode(F.arrays_zip(hashed.alias("h"), plain.alias("s"))).alias("z"))
    rows = rows.select("item_id", "width", F.col("z.s").alias("shingle"), F.col("z.h").alias("hash")).distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    return rows.join(sizes, "item_id")


def sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The ``(item_id, width, hash)`` that every document holding enough of the item meets."""
    part = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")  # the size partition's largest n
    size = part - F.ceil(part * F.lit(containment) - F.lit(1e-9)) + 1
    by_hash = F.array_sort(F.collect_list("hash"))
    return (
        shingles.groupBy("item_id", "width", "n")
        .agg(by_hash.alias("hashes"))
        .select("item_id", "width", F.explode(F.slice("hashes", F.lit(1), size.cast("int"))).alias("hash"))
        .distinct()
    )


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is seen to be small; else it is joined by a shuffle, whatever Spark makes of exploded shingles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def contamination(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for every pair at or above it.

    Both tables have an id and ``text``; other columns are ignored.  Rows of one
    doc_id are one document; rows without an id are left out.  Null and empty texts
    match nothing.  Repeated shingles count once.
    """
    shingles = cut(item_shingles(items))
    sketch = cut(sketches(shingles, containment))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    widths = [r[0] for r in sketch.select("width").distinct().collect()]  # five values at most

    small = _small(sketch)
    found = None
    for width in sorted(widths):
        rows = texts.select("doc_id", words(F.col("text")).alias("w")).select(
            "doc_id", F.explode(_shingles("w", width, "xxhash64")).alias("hash")
        )
        hits = rows.join(small.where(F.col("width") == width), "hash").select("doc_id", "item_id")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = texts.join(sketch, F.lit(False)).select("doc_id", "item_id")
    candidates = cut(found.distinct())

    ids = candidates.select("doc_id").distinct()
    held = cut(texts.join(_small(ids), "doc_id", "left_semi"))
    exact = None
    for width in sorted(widths):
        rows = held.select("doc_id", words(F.col("text")).alias("w")).select(
            "doc_id", F.explode(F.array_distinct(_shingles("w", width, "text"))).alias("shingle")
        )
        own = shingles.where(F.col("width") == width).select("item_id", "shingle", "n")
        shared = rows.join(_small(own), "shingle")
        exact = shared if exact is None else exact.unionByName(shared)
    if exact is None:
        exact = held.join(shingles, F.lit(False)).select("shingle", "doc_id", "item_id", "n")
    counted = exact.groupBy("doc_id", "item_id", "n").agg(F.countDistinct("shingle").alias("n_shared"))
    share = F.col("n_shared") / F.col("n")
    return (
        counted.where(F.col("n_shared") >= F.col("n") * F.lit(containment) - F.lit(1e-9))
        .join(candidates, ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", share.alias("containment"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows without a doc_id stay."""
    bad = cut(contamination(docs, items, containment).select("doc_id").distinct())
    return docs.join(_small(bad), "doc_id", "left_anti").select(*docs.columns)
