"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the folder of ``spark.checkpoint.dir``.

    Where that is unset, a folder of the warehouse serves; only a session of one machine,
    as in tests, makes a temporary one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        one_machine = re.fullmatch(r"local(\[.*\])?", sc.master)
        root = tempfile.mkdtemp(prefix="spark-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
