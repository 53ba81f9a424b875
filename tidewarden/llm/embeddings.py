"""Embedding near-duplicates by random-hyperplane sign hashing in several tables.

A table hashes a vector to the signs of its products with random hyperplanes.  Two
vectors of cosine c agree in a sign with probability 1 - acos(c) / pi, so in a table
of k signs with the k-th power of it; the number of tables follows from k, so that
a pair at the threshold is missed in all of them once in a million at most.  Vectors
that share a label, table and signs are compared exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import connected_components, cut

THRESHOLD = 0.93
MISS = 1e-6
SEED = 20240229
#: Vectors of a block; a bucket is compared block by block, each pair of blocks in a row of its own.
BLOCK = 512


def table_shape(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Signs per table and tables for ``n`` different vectors.

    Signs grow with the logarithm of n, which keeps buckets of unlike vectors at a
    few rows; tables grow so that the chance to miss a pair at the threshold stays.
    """
    signs = max(4, min(24, round(math.log2(max(n, 2))) - 10))
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(miss) / math.log(1 - agree))


def _one_zero(vectors: DataFrame) -> Column:
    """The vectors with -0.0 as 0.0, in the width they have."""
    kind = vectors.schema["embedding"].dataType.elementType
    width = kind.simpleString() if isinstance(kind, (T.FloatType, T.DoubleType)) else "double"
    return F.transform("embedding", lambda x: (x.cast(width) + F.lit(0).cast(width)))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``(label, embedding, rep, copies)`` of the different vectors that can link.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components are left out: they link with nothing.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = vectors.select(F.col("vec_id").cast("long"), "label", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound & some
    )
    return usable.withColumn("embedding", _one_zero(vectors)).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _planes(dims: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((count, dims)).T


def signatures(distinct: DataFrame, signs: int, tables: int) -> DataFrame:
    """``(label, dims, rep, copies, embedding, sigs)``, ``sigs`` the signs in each table as an int."""
    kind = distinct.schema["label"].dataType.simpleString()
    width = distinct.schema["embedding"].dataType.simpleString()
    schema = f"label {kind}, dims int, rep long, copies long, embedding {width}, sigs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(x) for x in batch.column(1)], np.int32)
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                values = _matrix(part.column(1))
                bits = (_unit(values) @ _planes(int(d), signs * tables) > 0).reshape(len(values), tables, signs)
                sigs = bits @ (1 << np.arange(signs)).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, sigs.size + 1, tables, dtype=np.int32), pa.array(sigs.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(values), d, np.int32)), part.column(2), part.column(3), part.column(1), lists],
                    names=["label", "dims", "rep", "copies", "embedding", "sigs"],
                )

    return distinct.select("label", "embedding", "rep", "copies").mapInArrow(run, schema)


FOUND = "rep long, links long, other long"


def _close(left: pd.DataFrame, right: pd.DataFrame, table: int, threshold: float) -> np.ndarray:
    """Which rows of two blocks link and meet in no table before ``table``."""
    a, b = (_unit(np.stack(side["embedding"].to_numpy()).astype(np.float64)) for side in (left, right))
    close = a @ b.T >= threshold
    seen, also = np.stack(left["sigs"].to_numpy())[:, :table], np.stack(right["sigs"].to_numpy())[:, :table]
    at, to = np.nonzero(close)
    before = (seen[at] == also[to]).any(axis=1)
    close[at[before], to[before]] = False
    return close


def links(signed: DataFrame, tables: int, threshold: float = THRESHOLD) -> DataFrame:
    """``(rep, links, other)``: partial link counts of vectors, and edges to link components by.

    A pair counts in the first table in which both have the same signs, so counts add
    up over tables.  A row with ``links`` 0 is an edge; of the links in a group only a
    spanning forest is handed on.

    Rows go to buckets of label, length, table and signs.  A bucket of more than
    ``BLOCK`` rows is cut into blocks and each pair of blocks is a task's group of its
    own, so no group grows with the data.
    """
    kind = signed.schema["label"].dataType.simpleString()
    exploded = signed.select("label", "dims", "rep", "copies", "embedding", "sigs", F.posexplode("sigs").alias("table", "sig"))
    keys = ["label", "dims", "table", "sig"]
    sizes = signed.select("label", "dims", F.posexplode("sigs").alias("table", "sig")).groupBy(*keys).agg(F.count("*").alias("rows"))
    sizes = cut(sizes.where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = exploded.join(sizes, keys).withColumn("block", block)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    copies = placed.withColumn("other", F.explode(others)).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")}
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        table, low, high = int(pdf["table"].iloc[0]), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        left = pdf if low == high else pdf[pdf["block"] == low]
        right = pdf if low == high else pdf[pdf["block"] == high]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "other": []}).astype("int64")
        close = _close(left, right, table, threshold)
        one, two = left["rep"].to_numpy(), right["rep"].to_numpy()
        if low == high:
            np.fill_diagonal(close, False)
        spanning = _spanning(close, one, two)
        parts = [np.stack([one, close @ right["copies"].to_numpy(), one], axis=1)]
        if low != high:
            parts.append(np.stack([two, left["copies"].to_numpy() @ close, two], axis=1))
        found = np.concatenate([*parts, np.stack([spanning[:, 0], np.zeros(len(spanning), np.int64), spanning[:, 1]], axis=1)])
        return pd.DataFrame(found[(found[:, 1] > 0) | (found[:, 0] != found[:, 2])], columns=["rep", "links", "other"])

    columns = ["rep", "copies", "embedding", "sigs", "block", *keys, "low", "high"]
    return copies.select(*columns).groupBy(*keys, "low", "high").applyInPandas(compare, FOUND)


def _spanning(close: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Edges that connect whatever ``close`` connects: a forest found by sweeping rows."""
    edges, left, right = [], np.zeros(len(one), bool), np.zeros(len(two), bool)
    for start in range(len(one)):
        if left[start]:
            continue
        left[start] = True
        rows = np.array([start])
        while len(rows):
            new = close[rows].any(axis=0) & ~right
            cols = np.flatnonzero(new)
            if not len(cols):
                break
            edges.append(np.stack([one[rows[close[np.ix_(rows, cols)].argmax(axis=0)]], two[cols]], axis=1))
            right |= new
            fresh = close[:, cols].any(axis=1) & ~left
            rows = np.flatnonzero(fresh)
            if len(rows):
                edges.append(np.stack([one[rows], two[cols[close[np.ix_(rows, cols)].argmax(axis=1)]]], axis=1))
            left |= fresh
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Rows link if their labels are equal and not null and their cosine is
    ``threshold`` at least.  Equal vectors link with each other and are compared with
    others once.  What cannot link (see :func:`distinct_vectors`) has no links and is
    its own component.  Vectors of different lengths are never compared.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    classes = cut(distinct_vectors(vectors))
    n = classes.count()
    signs, tables = table_shape(n, threshold)
    signed = cut(signatures(classes, signs, tables))
    found = cut(links(signed, tables, threshold))
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b"))
    roots = connected_components(edges)
    grouped = classes.select("label", "embedding", "rep", "copies").join(degree, "rep", "left").join(
        roots, F.col("rep") == F.col("node"), "left"
    )
    grouped = cut(grouped.select(
        F.col("label").alias("c_label"), F.xxhash64("embedding").alias("c_hash"), F.col("embedding").alias("c_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
    ))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", _one_zero(vectors).alias("embedding"))
    rows = rows.withColumn("hash", F.xxhash64("embedding"))
    same = (rows["hash"] == grouped["c_hash"]) & (rows["label"] == grouped["c_label"]) & (rows["embedding"] == grouped["c_embedding"])
    joined = rows.join(grouped, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
