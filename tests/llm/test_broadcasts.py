"""What grows in a task or by an explode is not broadcast: Spark sizes it by what it was made of."""

import pytest
from pyspark.sql import functions as F

from tidewarden.llm import decontaminate, shingles, simhash


@pytest.fixture
def sized(spark):
    """Spark's own limit of a broadcast, whatever the session of the tests has."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def final_plan(df):
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    return rows, plan.split("== Initial Plan ==")[0]


def test_keys_of_fingerprints_are_not_broadcast(sized):
    """84 keys a fingerprint went to the driver where the fingerprints alone would have fitted."""
    near = [(1 << 20) ^ bit for bit in (0, 1, 3, 7)]
    prints = sized.createDataFrame([(k * 0x9E3779B97F4A7C1 % (1 << 62),) for k in range(1, 300)] + [(x,) for x in near], "fp long")
    rows, plan = final_plan(simhash.fingerprint_links(prints))
    assert {(a, b) for a in near for b in near if a < b} <= set(rows)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_members_of_bands_are_not_broadcast(sized):
    texts = sized.createDataFrame([(k, 9, [k // 2, -1 - k], k % 3) for k in range(60)], "text_hash long, n long, bands array<long>, root long")
    rows, plan = final_plan(shingles._mixed(texts.select(F.explode("bands").alias("key"), "text_hash", "n", "root")))
    assert sorted(r[1] for r in rows) == list(range(60)) and all(r[4] == 1 for r in rows)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shingles_of_documents_are_not_broadcast(sized, monkeypatch):
    """Where the sketches are too many to be broadcast, the documents' exploded shingles were instead."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows = sized.range(50).select(F.col("id").alias("doc_id"), F.explode(F.sequence("id", F.col("id") + 3)).alias("hash"))
    few = sized.range(10).select(F.col("id").alias("hash"), (F.col("id") % 2).alias("item_id"))
    found, plan = final_plan(rows.join(decontaminate._small(few), "hash"))
    assert len(found) == sum(1 for k in range(50) for x in range(k, k + 4) if x < 10)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
