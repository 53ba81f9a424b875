"""Queries of the streaming operators, each run over a whole table with the available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.alerts import entity_of
from ..sources import sensors
from ..sources.flows import as_flows, flows
from ..sources.paths import new_path
from ..streaming import jobs, keyed
from .common import DAY, WIDE, detections, round6, sql_alerts, sql_flows
from .features import _eve_logs, envelopes
from .registry import query

LATE = 50


def turns(rows, time, n=3):
    """A table in ``n`` parts of equal spans of time, one after the other."""
    lo, hi = rows.agg(F.min(time), F.max(time)).first()
    if lo is None:
        return [rows] * n
    at = F.least(F.floor((F.col(time) - lo) * n / (hi - lo + 1)), F.lit(n - 1))
    return [rows.where(at == k) for k in range(n)]


def stream_flows(spark, d, files=None):
    path = f"{d}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return as_flows(reader.parquet(f"{d}/events*.parquet"))


WINDOWS = """SELECT src_ip, us // {step} * {step} AS start_us, us // {step} * {step} + {step} AS end_us, count(*) AS attempts FROM flows GROUP BY 1, 2, 3"""


@query("x2_window_features", sql_flows(WINDOWS.format(step=DAY * 1_000_000)))
def x2(spark, d):
    return jobs.run(spark, jobs.window_features(stream_flows(spark, d), "1 day"), "complete").select("src_ip", "start_us", "end_us", "attempts")


HOURS = f"SELECT * FROM ({WINDOWS.format(step=3600 * 1_000_000)}) WHERE end_us <= (SELECT max(us) // 1000 * 1000 FROM flows) - 600000000"
LATE_SQL = f"""
, late AS (SELECT * FROM flows WHERE event_id % {LATE} = 0 AND floor((us - (SELECT min(us) FROM flows)) * 3 / ((SELECT max(us) - min(us) + 1 FROM flows))::DOUBLE) < 1),
whole AS ({HOURS}),
seen AS ({HOURS.replace("FROM flows GROUP", "FROM (SELECT * FROM flows ANTI JOIN late USING (event_id)) GROUP")})
SELECT 'stream' AS kind, * FROM seen
UNION ALL SELECT 'dropped', NULL, NULL, NULL, count(*) FROM late
UNION ALL SELECT 'repaired', * FROM (SELECT * FROM whole EXCEPT SELECT * FROM seen)"""


@query("x4_watermark", sql_flows(LATE_SQL))
def x4(spark, d):
    """Windows of a stream to which some rows of the first part come with the last, how many it dropped, and the repair from a batch run."""
    rows = flows(spark, d)
    first, *rest, last = turns(rows, "us")
    late = F.col("event_id") % LATE == 0
    found, queries = jobs.in_turns(
        spark, [first.where(~late), *rest, last.union(first.where(late))],
        lambda fed: jobs.window_features(jobs.deduplicate(jobs.timed(fed), "flow_id", "10 minutes"), "1 hour"),
    )
    dropped = jobs.rows_dropped(queries, "dedupeWithinWatermark")
    names = ["src_ip", "start_us", "end_us", "attempts"]
    final = F.floor(F.col("us") / 1000) * 1000 - 600_000_000
    done = rows.agg(F.max(final).alias("final"))
    whole = jobs.window_features(rows, "1 hour").select(names).join(done, F.col("end_us") <= F.col("final")).select(names)
    repaired = whole.exceptAll(found.select(names))
    count = spark.range(1).select(F.lit("dropped").alias("kind"), *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names[:3]], F.lit(dropped).cast("long").alias("attempts"))
    return found.select(F.lit("stream").alias("kind"), *names).union(count).union(repaired.select(F.lit("repaired"), *names))


@query("x8_quarantined_stream", sql_flows("""SELECT 'event' AS kind, '' AS error, count(*) AS n FROM flows WHERE event_id % 4 <> 3 UNION ALL
  SELECT 'reject', CASE event_id % 12 WHEN 3 THEN 'not a JSON object' WHEN 7 THEN 'ts is not a finite number' ELSE 'missing event_type' END, count(*) FROM flows WHERE event_id % 4 = 3 GROUP BY 2"""))
def x8_stream(spark, d):
    """A stream of envelopes, a quarter of them poisoned, in three parts with a restart between."""
    source, events, rejects, checkpoint = (new_path(spark, name) for name in ("envelopes", "events", "rejects", "state"))
    for part in turns(flows(spark, d), "us"):
        envelopes(part).write.mode("append").parquet(source)
        jobs.quarantined(spark.readStream.schema("data string").parquet(source), events, rejects, checkpoint)
    good = spark.read.parquet(events).agg(F.lit("event").alias("kind"), F.lit("").alias("error"), F.count("*").alias("n"))
    return good.union(spark.read.parquet(rejects).groupBy("error").agg(F.count("*").alias("n")).select(F.lit("reject"), "error", "n"))


SESSIONS = """, g AS (SELECT src_ip, us, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS new FROM flows),
s AS (SELECT *, sum(new) OVER (PARTITION BY src_ip ORDER BY us ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT src_ip, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS attempts FROM s GROUP BY src_ip, n"""


@query("x3_gap_sessions", sql_flows(SESSIONS))
def x3(spark, d):
    return jobs.run(spark, jobs.gap_sessions(stream_flows(spark, d), "21600 seconds"), "complete")


@query("x6_redelivery", sql_flows("SELECT flow_id, src_ip FROM flows"))
def x6(spark, d):
    rows = jobs.timed(stream_flows(spark, d))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.run(spark, jobs.deduplicate(twice, "flow_id").select("flow_id", "src_ip"))


@query("x1_trailing_state", sql_flows(f"""SELECT a.event_id, CAST(count(DISTINCT b.dst_port) AS INTEGER) AS ports, CAST(count(DISTINCT b.dst_ip) AS INTEGER) AS ips, CAST(count(*) AS INTEGER) AS attempts FROM flows a JOIN flows b
  ON a.src_ip = b.src_ip AND b.ts >= a.ts - {DAY} AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY 1"""))
def x1(spark, d):
    found, _ = jobs.in_turns(spark, turns(flows(spark, d), "us"), lambda fed: keyed.trailing_state(fed, float(DAY)))
    return found.drop("src_ip")


def _identified(spark, d):
    rows = detections(spark, d)
    return rows.withColumns({"alert_id": S.alert_id(F.col("flow_id"), F.col("threat_class"), F.col("detector")), "entity": entity_of(F.col("threat_class"), F.col("src_ip"), F.col("dst_ip"))})


def _engine(rows):
    return keyed.alert_engine(rows, WIDE)


@query("x7_alert_engine", sql_alerts(f"SELECT alert_id, entity, threat_class, event_time, {round6('recency')} AS recency, risk_score, alert_count, incident_risk, first_seen AS incident_start FROM alerts"))
def x7(spark, d):
    found, _ = jobs.in_turns(spark, turns(_identified(spark, d), "event_time"), _engine)
    return found.withColumn("recency", S.round_to(F.col("recency"), 6))


@query("x5_exactly_once_effect", sql_alerts("SELECT alert_id, risk_score FROM alerts"))
def x5(spark, d):
    path, source = new_path(spark, "delivered"), new_path(spark, "detections")
    _identified(spark, d).write.parquet(source)
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for _ in range(2):  # the second run delivers everything again, as after a lost checkpoint
        jobs.deliver(_engine(rows).select("alert_id", "risk_score"), path, new_path(spark, "state"))
    return spark.read.parquet(path).select("alert_id", "risk_score")


@query("x9_drain", sql_flows("SELECT event_type, count(*) AS n FROM flows GROUP BY 1"))
def x9(spark, d):
    return jobs.run(spark, stream_flows(spark, d, files=1).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("s3_stream_events", sql_flows("SELECT event_type, count(*) AS n FROM flows WHERE ts >= (SELECT min(ts) FROM flows) GROUP BY 1"))
def s3(spark, d):
    rows = sensors.stream_events(spark, _eve_logs(spark, d), files_per_trigger=2, since=0.0)
    return jobs.run(spark, rows.groupBy("event_type").agg(F.count("*").alias("n")), "complete")


FILES = 4


def _counted(spark, d):
    """Flows in four files, taken one a batch."""
    path = new_path(spark, "flows")
    flows(spark, d).repartition(FILES).write.parquet(path)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.observe("flows", F.count("*").alias("rows"), F.max("us").alias("newest"))


def _watched(spark, rows, runs=1):
    """What a listener saw of each of ``runs`` runs of a stream, and what the last one wrote."""
    metrics, seen = jobs.Metrics(), []
    spark.streams.addListener(metrics)
    try:
        for _ in range(runs):
            path = new_path(spark, "stream")
            seen.append(metrics.wait(jobs.drain(rows, "complete", path, new_path(spark, "stream-state"))))
    finally:
        spark.streams.removeListener(metrics)
    return seen, spark.read.schema(rows.schema).parquet(path)


@query("x11_live_metrics", sql_flows(f"SELECT r AS run, count(*) AS rows, {FILES} AS batches, count(*) AS observed, max(us) AS newest, true AS has_rates, true AS ranks_in_order FROM flows, (VALUES (1), (2)) AS v(r) GROUP BY r"))
def x11(spark, d):
    """Two runs as a listener saw them: rows, batches, rates, observed figures and nearest-rank times of batches, each from nothing."""
    seen, _ = _watched(spark, _counted(spark, d).groupBy("src_ip").agg(F.count("*").alias("n")), runs=2)
    rows = []
    for k, run in enumerate(seen):
        ranks = [jobs.nearest_rank(run["millis"], q) for q in (50, 95, 99, 100)]
        noted = [x for x in run["observed"]["flows"] if x["rows"]]
        rows.append((k + 1, run["rows"], run["batches"], sum(x["rows"] for x in noted), max(x["newest"] for x in noted), all(r > 0 for r in run["rates"]), 0 < ranks[0] and ranks == sorted(ranks)))
    return spark.createDataFrame(rows, "run int, rows long, batches int, observed long, newest long, has_rates boolean, ranks_in_order boolean")


@query("x10_rate_limit", sql_flows(f"SELECT src_ip, count(*) AS n, {FILES} AS batches FROM flows GROUP BY 1"))
def x10(spark, d):
    """Counts of a stream limited to one file a batch, and the batches that a listener saw."""
    seen, counts = _watched(spark, _counted(spark, d).groupBy("src_ip").agg(F.count("*").alias("n")))
    return counts.withColumn("batches", F.lit(seen[0]["batches"]))
