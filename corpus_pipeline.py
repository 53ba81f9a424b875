"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on what its predecessor kept and is written before the next one
reads it.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import decontaminate, packing, pii, simhash, toxicity
from tidewarden.llm.queries import table, tokenizer_path
from tidewarden.llm.shared import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows that Spark hands to Python at once: texts are long, so fewer than its default.
BATCH_ROWS = 1000


def in_small_batches(stage: Stage) -> Stage:
    """A stage whose session hands texts to Python in small batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash or shingles, stays: the one with the smallest doc_id."""
    return simhash.keep_one_per_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; ``n_chars`` follows the text."""
    masked = pii.mask_pii(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is tokenized and placed into sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("near_duplicates", in_small_batches(drop_near_copies)),
    ("decontamination", in_small_batches(drop_benchmark)),
    ("pii", in_small_batches(mask_personal)),
    ("packing", in_small_batches(pack)),
]

#: Learned scores and a tokenizer have no SQL; tests hold stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` and return the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
