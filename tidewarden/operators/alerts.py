"""The alert engine: from detections to scored alerts and incidents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..params import DEFAULTS, Params
from ..schemas import ALERT_COLUMNS, SCHEMA_VERSION
from .checks import alert_rules, failed_rules, judge_detections, split_failed
from .sinks import quarantine
from .windows import cooldown, repeat_recency, running_incident, split_incidents

Fusion = Callable[[Column, Column, Column, Column], Column]


def entity_of(threat_class: Column, src: Column, dst: Column) -> Column:
    """Floods are kept by victim, everything else by source."""
    return F.when(threat_class == "DDOS", F.coalesce(dst, src)).otherwise(src)


def with_fallback(custom: Fusion) -> Fusion:
    """A fusion that is replaced by the built-in one where it gives null or leaves 0 to 100."""

    def fuse(threat_class: Column, p: Column, a: Column, r: Column) -> Column:
        own = custom(threat_class, p, a, r)
        return F.when(own.between(0, 100), S.round_half_up(own.cast("double"))).otherwise(S.fuse(threat_class, p, a, r))

    return fuse


def correlate(alerts: DataFrame, params: Params = DEFAULTS, custom: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Alerts with ``incident_id``; a custom correlator that gives no such column is not used."""
    if custom is not None:
        made = custom(alerts)
        if "incident_id" in made.columns and set(alerts.columns) <= set(made.columns):
            return made
    return split_incidents(alerts, params.incident_gap_s)


def score_alerts(detections: DataFrame, params: Params = DEFAULTS, fusion: Fusion = S.fuse, correlator: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cooldown, recency, fusion, severity and incidents, in this order.

    Only detections that the cooldown keeps count as history, so the order is fixed.
    Repeated detections are one alert, since its id derives from the flow, the class
    and the detector.  Every step but the first partitions by entity or incident.
    """
    entity = entity_of(F.col("threat_class"), F.col("src_ip"), F.col("dst_ip"))
    identified = detections.withColumns({"alert_id": S.alert_id(F.col("flow_id"), F.col("threat_class"), F.col("detector")), "entity": entity})
    kept = cooldown(identified.dropDuplicates(["alert_id"]), params.cooldown_s)
    recent = repeat_recency(kept, params.recency_window_s, params.recency_half_life_s)
    scored = recent.withColumn("risk_score", fusion(F.col("threat_class"), F.col("confidence"), F.col("anomaly"), F.col("recency")))
    graded = scored.withColumn("severity", S.severity(F.col("risk_score")))
    return running_incident(correlate(graded, params, correlator))


def as_alerts(scored: DataFrame, written_at: Column | None = None) -> DataFrame:
    """Scored rows in the strict alert form; ``timestamp`` is the event's time unless given."""
    iso = S.to_iso(F.col("event_time"))
    return scored.withColumns({
        "timestamp": iso if written_at is None else written_at, "event_time": iso, "confidence": S.round_to(F.col("confidence"), 4), "schema_version": F.lit(SCHEMA_VERSION),
    }).select(*ALERT_COLUMNS)


def guarded_alerts(found: DataFrame, root: str, params: Params = DEFAULTS, fusion: Fusion = S.fuse, correlator: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The alert engine with its checks on both sides: alerts, rejected detections, rejected alerts.

    ``found`` has the detection columns and the event's, as ``judge_detections`` takes
    them.  Detections and alerts are each judged once and written below ``root`` with
    what they failed; the parts are read from there, and rejects of both sides are added
    to the quarantine in ``root``.  Alerts keep their incident's state in further columns.
    """
    spark = found.sparkSession
    judged = judge_detections(found)
    judged.write.parquet(f"{root}/detections")
    good, before = split_failed(spark.read.schema(judged.schema).parquet(f"{root}/detections"))
    scored = score_alerts(good, params, fusion, correlator)
    iso = S.to_iso(F.col("event_time"))
    strict = scored.withColumns({
        "event_epoch": F.col("event_time"), "timestamp": iso, "event_time": iso, "confidence": S.round_to(F.col("confidence"), 4), "schema_version": F.lit(SCHEMA_VERSION),
    }).withColumn("failed", failed_rules(alert_rules(list(ALERT_COLUMNS))))
    strict.write.parquet(f"{root}/alerts")
    alerts, after = split_failed(spark.read.schema(strict.schema).parquet(f"{root}/alerts"))
    why, now = F.concat_ws(", ", "failed"), F.current_timestamp().cast("double")
    parked = quarantine(before, "detection", why, now).unionByName(quarantine(after, "alert", why, now))
    parked.write.mode("append").parquet(f"{root}/quarantine")
    return alerts, before, after


def incidents_of(scored: DataFrame) -> DataFrame:
    """One row per incident with its final state, derived from the deduplicated alerts."""
    last = F.max_by(F.struct("threat_classes", "incident_risk"), F.struct("event_time", "alert_id"))
    grouped = scored.groupBy("incident_id").agg(
        F.first("entity").alias("src_ip"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
        F.count("*").alias("alert_count"), last.alias("_l"),
    )
    risk = F.col("_l.incident_risk")
    return grouped.select("incident_id", "src_ip", "first_seen", "last_seen", "alert_count", F.col("_l.threat_classes").alias("threat_classes"),
                          risk.alias("risk_score"), S.severity(risk).alias("severity"), F.lit("OPEN").alias("status"))
