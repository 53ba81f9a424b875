"""Helpers that several operators share: checkpoints, folders, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a folder of the warehouse
    serves, which is shared as well; only a session of one machine, as in tests, makes a
    temporary one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and re.fullmatch(r"local(\[.*\])?", sc.master):
        named = tempfile.mkdtemp(prefix="spark-")
    elif not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The copy survives a lost executor, and a join above it gets exchanges of
    its own, which adaptive execution can split where a key is hot.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a table and read it back.

    As ``cut``, but nothing of the plan stays, which a loop needs: what the optimizer
    knows of a checkpoint's columns would grow with each turn.
    """
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, made: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task under ``key``, the only thing it keeps."""
    if key not in _KEPT:
        release()
        _KEPT[key] = made()
    return _KEPT[key]


def release() -> None:
    """Forget what a task of another operator has kept in this worker, and give its memory back."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def connected_components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has two columns of one ordered type.  Returns ``(node, component)``
    for every node of an edge between different nodes, ``component`` the smallest
    node that can be reached.  Each round moves every node's links to the smallest
    neighbour, until all links go straight to a smallest node.  The driver sees one
    yes or no a round.
    Null ends and loops are ignored; an empty input gives an empty result.
    """
    a, b = edges.columns[:2]
    links = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    while not _are_stars(links):
        links = _small_star(_large_star(links))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has either one link down or links from above only."""
    end = lambda node, down: F.struct(F.col(node).alias("node"), F.lit(down).alias("down"))
    nodes = links.select(F.inline(F.array(end("u", 1), end("v", 0)))).groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("ends"))
    return nodes.where("down > 0 and ends > 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = both.where("v > u").join(least, "u")
    return cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = cut(links.groupBy("u").agg(F.min("v").alias("m")))
    joined = links.join(least, "u").where("v != m")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
