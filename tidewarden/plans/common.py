"""Parameters and tables that several registered queries share.

The test tables spread their events over a month, so queries widen windows and lower
thresholds; the defaults are tested on hand-made records.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.alerts import guarded_alerts, score_alerts
from ..operators.checks import check_detection
from ..operators.detectors import RULES, detect_dns_tunnel, detect_tls, union_detections
from ..operators.ml import with_dns_features
from ..params import DEFAULTS, Params
from ..sources.flows import FLOWS, flows
from ..sources.paths import new_path

DAY = 86400
WIDE = replace(
    DEFAULTS, scan_window_s=DAY, scan_ports=3, ddos_rate_window_s=DAY, ddos_entropy=4.5, beacon_cv=0.95,
    cooldown_s=6 * 3600, recency_window_s=DAY, recency_half_life_s=6 * 3600.0, incident_gap_s=DAY,
)


def blocklist(spark: SparkSession) -> DataFrame:
    """Two of the twelve fingerprints that the projected flows carry."""
    return spark.range(1).select(F.explode(F.array(*[F.md5(F.lit(f"ja3-{k}").cast("binary")) for k in (3, 7)])).alias("ja3"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all six detectors find; names are scored by a rule instead of a trained model.

    The detectors go over the flows about ten times, each over a few of their columns, so
    records are parsed once and written as columns.  Detections are few against flows and
    the engine goes over them more than once, so they are written and read again.
    """
    parsed, path = flows(spark, sf_dir), new_path(spark, "found")
    parsed.write.parquet(f"{path}-flows")
    rows = spark.read.schema(parsed.schema).parquet(f"{path}-flows")
    found = union_detections(RULES.run(rows, WIDE), detect_tls(rows, blocklist(spark), WIDE), by_digits(rows, WIDE))
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def by_digits(rows: DataFrame, params: Params) -> DataFrame:
    """The detector of generated names with twice the share of digits as their probability."""
    named = with_dns_features(rows).withColumn("probability", F.least(F.lit(1.0), 2 * F.col("dns_digit_ratio")))
    return detect_dns_tunnel(named, params)


def with_event(found: DataFrame) -> DataFrame:
    """Detections with the event's own columns, which fill what a detector left out."""
    return found.withColumns({"event_flow_id": F.col("flow_id"), "event_src_ip": F.col("src_ip"), "event_dst_ip": F.col("dst_ip"), "event_ts": F.col("event_time")})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the checked detections; the detectors leave nothing out, so none is rejected (``guarded`` keeps rejects)."""
    return score_alerts(check_detection(with_event(detections(spark, sf_dir)))[0], WIDE)


#: What the guarded engine is given to reject: detections of an unknown class, and alerts whose score leaves 0 to 100.
BAD_DETECTION_SQL = "detector = 'dns' AND CAST(flow_id AS BIGINT) % 10 = 0"
BAD_ALERT_CLASS = "C2_BEACONING"


def guarded(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """The folder of a guarded engine, its alerts, and what it rejected before and after."""
    planted = (F.col("detector") == "dns") & (F.col("flow_id").cast("long") % 10 == 0)
    found = with_event(detections(spark, sf_dir)).withColumn("threat_class", F.when(planted, "unheard of").otherwise(F.col("threat_class")))
    root = new_path(spark, "guarded")
    return root, *guarded_alerts(found, root, WIDE, fusion=lambda c, p, a, r: F.when(c == BAD_ALERT_CLASS, F.lit(1000).cast("long")).otherwise(S.fuse(c, p, a, r)))


PRIORS = "CASE {c} WHEN 'DDOS' THEN 0.75 WHEN 'C2_BEACONING' THEN 0.85 WHEN 'DGA_DNS_TUNNELING' THEN 0.65 WHEN 'ENCRYPTED_MALWARE' THEN 0.70 WHEN 'RECON_PORT_SCAN' THEN 0.30 WHEN 'DATA_EXFILTRATION' THEN 0.90 ELSE 0.5 END::DOUBLE"
WEIGHTS = """(CASE {c} WHEN 'DDOS' THEN [0.45,0.25,0.20,0.10] WHEN 'C2_BEACONING' THEN [0.45,0.20,0.25,0.10]
  WHEN 'DGA_DNS_TUNNELING' THEN [0.50,0.15,0.25,0.10] WHEN 'ENCRYPTED_MALWARE' THEN [0.50,0.15,0.25,0.10]
  WHEN 'RECON_PORT_SCAN' THEN [0.40,0.20,0.30,0.10] WHEN 'DATA_EXFILTRATION' THEN [0.40,0.20,0.30,0.10] ELSE [0.50,0.20,0.20,0.10] END)::DOUBLE[]"""
SEVERITY = "CASE WHEN {x} >= 81 THEN 'CRITICAL' WHEN {x} >= 61 THEN 'HIGH' WHEN {x} >= 31 THEN 'MEDIUM' WHEN {x} IS NOT NULL THEN 'LOW' END"


def anomaly(p: str, c: str) -> str:
    return f"floor(least(1.0::DOUBLE, greatest(0.3::DOUBLE, {p} * (0.6::DOUBLE + 0.3::DOUBLE * {PRIORS.format(c=c)}))) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


def round4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


def round6(x: str) -> str:
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"


SCAN_SQL = f"""
scan_w AS (
  SELECT src_ip AS s, CAST(floor(ts / {DAY}) AS BIGINT) AS bucket, count(DISTINCT dst_port) AS unique_ports, count(*) AS attempts,
    max(struct_pack(ts := ts, event_id := event_id, flow_id := flow_id, src_ip := src_ip, dst_ip := dst_ip, conn_state := conn_state)) AS l
  FROM flows GROUP BY 1, 2
), scan AS (
  SELECT 'RECON_PORT_SCAN' AS threat_class,
    {round4("CASE WHEN l.conn_state IN ('new','S0','REJ','RSTO') THEN least(1.0::DOUBLE, least(1.0::DOUBLE, unique_ports / 100.0::DOUBLE) + 0.10::DOUBLE) ELSE least(1.0::DOUBLE, unique_ports / 100.0::DOUBLE) END")} AS confidence,
    l.flow_id AS flow_id, l.src_ip AS src_ip, l.dst_ip AS dst_ip, 'scan' AS detector, l.ts AS event_time
  FROM scan_w WHERE unique_ports >= 3
)"""
EXFIL_SQL = f"""
exfil_r AS (
  SELECT *, bytes_out::DOUBLE / greatest(1.0::DOUBLE, bytes_in::DOUBLE) AS ratio FROM flows WHERE bytes_out >= 100000 AND src_ip LIKE '10.%'
), exfil_z AS (SELECT *, least(1.0::DOUBLE, abs((ratio - 2.0::DOUBLE) / 1.5::DOUBLE) / 6.0::DOUBLE) AS c0 FROM exfil_r WHERE ratio >= 10),
exfil_c AS (SELECT *, CASE WHEN ratio > 100 THEN least(1.0::DOUBLE, c0 + 0.2::DOUBLE) ELSE c0 END AS c1 FROM exfil_z),
exfil AS (
  SELECT 'DATA_EXFILTRATION' AS threat_class, {round4("CASE WHEN ratio > 1000 THEN least(1.0::DOUBLE, c1 + 0.2::DOUBLE) ELSE c1 END")} AS confidence,
    flow_id, src_ip, dst_ip, 'exfil' AS detector, ts AS event_time FROM exfil_c
)"""
TLS_SQL = f"""
tls AS (
  SELECT 'ENCRYPTED_MALWARE' AS threat_class, {round4("0.95::DOUBLE")} AS confidence, flow_id, src_ip, dst_ip, 'tls' AS detector, ts AS event_time
  FROM flows WHERE ja3 IN (md5('ja3-3'), md5('ja3-7'))
)"""
DDOS_SQL = f"""
pairs AS (SELECT dst_ip AS d, CAST(floor(ts / {DAY}) AS BIGINT) AS bucket, src_ip AS s, count(*) AS c FROM flows GROUP BY 1, 2, 3),
ddos_w AS (SELECT d, bucket, sum(c) AS flow_count, count(*) AS sources, greatest(0.0::DOUBLE, log2(sum(c)::DOUBLE) - sum(c * log2(c::DOUBLE)) / sum(c)) AS entropy FROM pairs GROUP BY 1, 2),
ddos_l AS (SELECT dst_ip AS d, CAST(floor(ts / {DAY}) AS BIGINT) AS bucket,
    max(struct_pack(ts := ts, event_id := event_id, flow_id := flow_id, src_ip := src_ip, dst_ip := dst_ip)) AS l FROM flows GROUP BY 1, 2),
ddos_z AS (SELECT *, (greatest(flow_count, sources)::DOUBLE - 10.0::DOUBLE) / 5.0::DOUBLE AS z FROM ddos_w JOIN ddos_l USING (d, bucket)),
ddos AS (
  SELECT 'DDOS' AS threat_class, {round4("CASE WHEN entropy > 4.5 AND sources > 50 THEN least(1.0::DOUBLE, least(1.0::DOUBLE, abs(z) / 6.0::DOUBLE) + 0.15::DOUBLE) ELSE least(1.0::DOUBLE, abs(z) / 6.0::DOUBLE) END")} AS confidence,
    l.flow_id AS flow_id, l.src_ip AS src_ip, l.dst_ip AS dst_ip, 'ddos' AS detector, l.ts AS event_time
  FROM ddos_z WHERE (entropy > 4.5 OR sources > 50) AND (z > 3 OR sources > 50)
)"""
BEACON_GAPS = """
g AS (SELECT src_ip AS s, dst_ip AS d, ts, event_id, flow_id, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, event_id) AS gap FROM flows),
stats AS (SELECT s, d, count(*) AS n_flows, count(gap) AS n, coalesce(avg(gap), 0) AS mean_gap, coalesce(stddev_samp(gap), 0) AS std_gap FROM g GROUP BY 1, 2),
cvs AS (SELECT *, CASE WHEN n < 2 THEN 0.0::DOUBLE WHEN mean_gap < 1e-9 THEN 'inf'::DOUBLE ELSE std_gap / mean_gap END AS cv FROM stats)"""
ACF_SQL = """
series AS (SELECT s, d, list(gap ORDER BY ts, event_id) AS x FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
centred AS (SELECT s, d, len(x) AS n, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS x FROM series),
squares AS (SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS sq FROM centred),
acfs AS (
  SELECT s, d, n, lag, CASE WHEN n < 3 THEN 1.0::DOUBLE WHEN sq / n < 1e-12 THEN 0.0::DOUBLE
    ELSE list_sum(list_transform(range(1, n - lag + 1), lambda i: x[i] * x[i + lag])) / sq END AS r
  FROM (SELECT *, unnest(range(0, CASE WHEN n < 3 THEN 1 ELSE n // 2 + 1 END)) AS lag FROM squares)
), peaks AS (SELECT s, d, coalesce(max(CASE WHEN lag >= 2 THEN r END), 0) AS acf_peak FROM acfs GROUP BY 1, 2)"""
BEACON_SQL = f"""{BEACON_GAPS}, {ACF_SQL},
beacon_l AS (SELECT s, d, max(struct_pack(ts := ts, event_id := event_id, flow_id := flow_id)) AS l FROM g GROUP BY 1, 2),
beacon AS (
  SELECT 'C2_BEACONING' AS threat_class, {round4("CASE WHEN coalesce(acf_peak, 0) > 0.7 AND n_flows >= 8 THEN least(1.0::DOUBLE, least(greatest(1.0::DOUBLE - cv / 0.95::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) + 0.15::DOUBLE) ELSE least(greatest(1.0::DOUBLE - cv / 0.95::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END")} AS confidence,
    l.flow_id AS flow_id, s AS src_ip, d AS dst_ip, 'beacon' AS detector, l.ts AS event_time
  FROM cvs JOIN beacon_l USING (s, d) LEFT JOIN peaks USING (s, d) WHERE n_flows >= 5 AND cv <= 0.95
)"""
DNS_SQL = f"""
dns_p AS (SELECT *, least(1.0::DOUBLE, 2 * (length(regexp_replace(dns_query, '[^0-9]', '', 'g')) / length(dns_query)::DOUBLE)) AS p FROM flows WHERE dns_query IS NOT NULL),
dns AS (SELECT 'DGA_DNS_TUNNELING' AS threat_class, {round4("p")} AS confidence, flow_id, src_ip, dst_ip, 'dns' AS detector, ts AS event_time FROM dns_p WHERE p >= 0.5)"""
DETECTIONS_SQL = f"""{SCAN_SQL}, {EXFIL_SQL}, {TLS_SQL}, {DDOS_SQL}, {BEACON_SQL}, {DNS_SQL},
dets0 AS MATERIALIZED (SELECT * FROM exfil UNION ALL SELECT * FROM tls UNION ALL SELECT * FROM scan UNION ALL SELECT * FROM ddos UNION ALL SELECT * FROM beacon UNION ALL SELECT * FROM dns),
dets AS (SELECT *, {anomaly("confidence", "threat_class")} AS anomaly FROM dets0)"""
KEPT_SQL = f"""{DETECTIONS_SQL},
ids AS (
  SELECT DISTINCT ON (alert_id) * FROM (
    SELECT *, substr(sha1(flow_id || '|' || threat_class || '|' || detector), 1, 32) AS alert_id,
      CASE WHEN threat_class = 'DDOS' THEN coalesce(dst_ip, src_ip) ELSE src_ip END AS entity FROM dets)
), seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity, threat_class ORDER BY event_time, alert_id) AS rn FROM ids),
rec AS (
  SELECT entity, threat_class, rn, event_time AS last_kept, true AS keep FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.entity, s.threat_class, s.rn, CASE WHEN s.event_time >= r.last_kept + 21600 THEN s.event_time ELSE r.last_kept END,
    s.event_time >= r.last_kept + 21600
  FROM rec r JOIN seq s ON s.entity = r.entity AND s.threat_class = r.threat_class AND s.rn = r.rn + 1
), kept AS (SELECT seq.* FROM seq JOIN rec USING (entity, threat_class, rn) WHERE keep)"""
ALERTS_SQL = f"""{KEPT_SQL},
rcy AS (
  SELECT a.alert_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - exp(-coalesce(sum(pow(2.0::DOUBLE, -(a.event_time - b.event_time) / 21600.0::DOUBLE)), 0)))) AS recency
  FROM kept a LEFT JOIN kept b ON a.entity = b.entity AND b.event_time >= a.event_time - {DAY}
    AND (b.event_time < a.event_time OR (b.event_time = a.event_time AND b.alert_id < a.alert_id))
  GROUP BY 1
), fused AS (
  SELECT k.*, recency, CAST(floor(100.0::DOUBLE * least(greatest(0.0::DOUBLE + w[1] * confidence + w[2] * anomaly + w[3] * prior + w[4] * recency, 0.0::DOUBLE), 1.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS risk_score
  FROM (SELECT *, {WEIGHTS.format(c="threat_class")} AS w, {PRIORS.format(c="threat_class")} AS prior FROM kept) k JOIN rcy USING (alert_id)
), gaps AS (
  SELECT *, {SEVERITY.format(x="risk_score")} AS severity,
    CASE WHEN coalesce(event_time - lag(event_time) OVER (PARTITION BY entity ORDER BY event_time, alert_id), 1e18) > {DAY} THEN alert_id END AS st FROM fused
), starts AS (
  SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY entity ORDER BY event_time, alert_id ROWS UNBOUNDED PRECEDING) AS start_id FROM gaps
), inc AS (SELECT *, 'INC-' || substr(sha1(entity || '|' || start_id), 1, 16) AS incident_id FROM starts),
alerts AS (
  SELECT *, count(*) OVER w AS alert_count, min(event_time) OVER w AS first_seen, max(event_time) OVER w AS last_seen,
    least(100, CAST(floor(100.0::DOUBLE * (1.0::DOUBLE
      - (1.0::DOUBLE - coalesce(max(CASE WHEN threat_class = 'DDOS' THEN risk_score END) OVER w, 0) / 100.0::DOUBLE)
      * (1.0::DOUBLE - coalesce(max(CASE WHEN threat_class = 'C2_BEACONING' THEN risk_score END) OVER w, 0) / 100.0::DOUBLE)
      * (1.0::DOUBLE - coalesce(max(CASE WHEN threat_class = 'DGA_DNS_TUNNELING' THEN risk_score END) OVER w, 0) / 100.0::DOUBLE)
      * (1.0::DOUBLE - coalesce(max(CASE WHEN threat_class = 'ENCRYPTED_MALWARE' THEN risk_score END) OVER w, 0) / 100.0::DOUBLE)
      * (1.0::DOUBLE - coalesce(max(CASE WHEN threat_class = 'RECON_PORT_SCAN' THEN risk_score END) OVER w, 0) / 100.0::DOUBLE)
      * (1.0::DOUBLE - coalesce(max(CASE WHEN threat_class = 'DATA_EXFILTRATION' THEN risk_score END) OVER w, 0) / 100.0::DOUBLE)) + 0.5::DOUBLE) AS BIGINT)) AS incident_risk
  FROM inc WINDOW w AS (PARTITION BY incident_id ORDER BY event_time, alert_id ROWS UNBOUNDED PRECEDING)
)"""


def sql_flows(body: str) -> str:
    return f"WITH RECURSIVE {FLOWS}\n{body}"


def sql_detections(body: str) -> str:
    return f"WITH RECURSIVE {FLOWS}, {DETECTIONS_SQL}\n{body}"


def sql_kept(body: str) -> str:
    return f"WITH RECURSIVE {FLOWS}, {KEPT_SQL}\n{body}"


def sql_guarded(body: str) -> str:
    """SQL over ``alerts`` of the sound detections, and ``dets_all``, sound or not."""
    sound = ALERTS_SQL.replace("dets AS (SELECT *,", f"dets_all AS (SELECT * FROM dets0), dets AS (SELECT *,").replace("AS anomaly FROM dets0)", f"AS anomaly FROM dets0 WHERE NOT ({BAD_DETECTION_SQL}))")
    return f"WITH RECURSIVE {FLOWS}, {sound}\n{body}"


def sql_alerts(body: str) -> str:
    return f"WITH RECURSIVE {FLOWS}, {ALERTS_SQL}\n{body}"
