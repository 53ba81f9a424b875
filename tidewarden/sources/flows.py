"""Network flows projected from the test tables, in Spark and in SQL.

The tables hold no flows, so ``events`` is read as if its rows were sensor records:
every query over flows grows with it.  The projection is integer and string
arithmetic, written once for each engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One normalized flow record per row of ``events``."""
    return as_flows(table(spark, sf_dir, "events"))


def as_flows(events: DataFrame) -> DataFrame:
    """The projection itself, for a bounded table or a stream."""
    e = events.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    eid, user, k = F.col("event_id"), F.col("user_id"), F.col("k")
    dns, tls = F.col("kind") == "signup", F.col("kind") == "purchase"
    outside = F.concat(F.lit("203.0.113."), (user % 256).cast("string"))
    inside = F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))
    name = F.when(eid % 2 == 0, F.concat(F.substring(F.md5(eid.cast("string").cast("binary")), 1, 24), F.lit(".example.net"))).otherwise(
        F.concat(F.element_at(F.array(*[F.lit(w) for w in HOSTS]), (k % len(HOSTS) + 1).cast("int")), F.lit(".example.org"))
    )
    return e.select(
        eid.alias("event_id"), eid.cast("string").alias("flow_id"), (F.col("us") / 1e6).alias("ts"), F.col("us"),
        F.when(dns, "dns").when(tls, "tls").otherwise("flow").alias("event_type"),
        F.when(user % 5 == 0, outside).otherwise(inside).alias("src_ip"),
        F.concat(F.lit("198.51.100."), (k % 10).cast("string")).alias("dst_ip"), (k + 1000).alias("dst_port"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes_out"), ((eid * 37) % 5000).alias("bytes_in"),
        (eid % 40 + 1).alias("pkts_out"), (eid % 7).alias("pkts_in"), ((eid % 50) / 10.0).alias("duration"),
        F.when(F.col("kind") == "error", "REJ").otherwise("SF").alias("conn_state"),
        F.when(dns, name).alias("dns_query"),
        F.when(tls, F.md5(F.concat(F.lit("ja3-"), (k % 12).cast("string")).cast("binary"))).alias("ja3"),
    )


HOSTS = ("mail", "login", "static", "weather", "news", "internal", "another", "there", "printer", "storage")

FLOWS = """
flows AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS flow_id, epoch_us(ts) / 1e6 AS ts, epoch_us(ts) AS us,
    CASE event_type WHEN 'signup' THEN 'dns' WHEN 'purchase' THEN 'tls' ELSE 'flow' END AS event_type,
    CASE WHEN user_id % 5 = 0 THEN '203.0.113.' || (user_id % 256)
         ELSE '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS src_ip,
    '198.51.100.' || (k % 10) AS dst_ip, k + 1000 AS dst_port,
    CAST(floor(value * 1000) AS BIGINT) AS bytes_out, (event_id * 37) % 5000 AS bytes_in,
    event_id % 40 + 1 AS pkts_out, event_id % 7 AS pkts_in, (event_id % 50) / 10.0::DOUBLE AS duration,
    CASE WHEN event_type = 'error' THEN 'REJ' ELSE 'SF' END AS conn_state,
    CASE WHEN event_type = 'signup' THEN
      CASE WHEN event_id % 2 = 0 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 24) || '.example.net'
           ELSE (['mail','login','static','weather','news','internal','another','there','printer','storage'])[k % 10 + 1] || '.example.org' END
    END AS dns_query,
    CASE WHEN event_type = 'purchase' THEN md5('ja3-' || (k % 12)) END AS ja3
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def with_flows(sql: str) -> str:
    """SQL over ``flows``; common table expressions of its own follow a leading comma."""
    return f"WITH {FLOWS}\n{sql}"
