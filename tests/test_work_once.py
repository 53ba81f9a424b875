"""Queries that look at their rows more than once make them once."""

from pyspark.sql import functions as F

from tidewarden.plans import alerting


def test_alerts_are_scored_once_to_be_appended_twice(spark, monkeypatch):
    """The engine ran for each look of both batches at their rows: five times."""
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    severity = F.when(F.col("id") % 3 == 0, "HIGH").otherwise("LOW")
    rows = spark.range(30).select(F.col("id").cast("string").alias("alert_id"), F.udf(counted, "long")("id").alias("risk_score"), severity.alias("severity"))
    monkeypatch.setattr(alerting, "scored", lambda spark, d: rows)
    got = sorted(tuple(r) for r in alerting.k1(spark, "").collect())
    assert got == sorted((str(k), k) for k in range(30)) and made.value == 30
