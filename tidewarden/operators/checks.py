"""Constraint checks that split rows into good ones and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import CLASS_PARAMS, RISK_BANDS
from ..functions.scalars import canonical_class, class_value, clip01, default_anomaly, finite, ipv4_number, parse_ts, severity
from ..schemas import ALERT_COLUMNS, SCHEMA_VERSION

SEVERITIES = tuple(name for _, name in RISK_BANDS)


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; null counts as not holding."""
    return F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def split_by(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    return split_failed(rows.withColumn("failed", failed_rules(rules)))


def split_failed(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``failed`` is empty, without it, and the others."""
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def check_detection(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical, complete detections, and rejects with the rules that failed; see ``judge_detections``."""
    return split_failed(judge_detections(rows))


def judge_detections(rows: DataFrame) -> DataFrame:
    """Detections made canonical and complete where that can be done, with ``failed``, the rules that do not hold.

    ``rows`` has the detection columns with evidence as an array, plus the event's
    ``event_flow_id``, ``event_src_ip``, ``event_dst_ip`` and ``event_ts``, which fill
    what the detector left out.  Confidence is clipped, a missing anomaly computed.
    """
    name = canonical_class(F.col("threat_class"))
    confidence = clip01(finite(F.col("confidence").try_cast("double")))
    either = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    evidence = F.transform("evidence", lambda x: F.trim(x))
    coerced = rows.withColumns({
        "threat_class": name, "confidence": confidence, "evidence": evidence, "flow_id": either("flow_id", "event_flow_id"), "src_ip": either("src_ip", "event_src_ip"),
        "dst_ip": either("dst_ip", "event_dst_ip"), "event_time": finite(F.coalesce("event_time", "event_ts")),
        "anomaly": clip01(F.coalesce(finite(F.col("anomaly")), default_anomaly(confidence, class_value(name, None)))),
    }).drop("event_flow_id", "event_src_ip", "event_dst_ip", "event_ts")
    return coerced.withColumn("failed", failed_rules({
        "threat_class": F.col("threat_class").isNotNull(), "confidence": F.col("confidence").isNotNull(),
        "evidence": (F.size("evidence") > 0) & F.forall("evidence", lambda x: x != ""), "flow_id": F.col("flow_id").isNotNull(),
        "src_ip": F.col("src_ip").isNotNull(), "event_time": F.col("event_time").isNotNull(), "anomaly": F.col("anomaly").isNotNull(),
    }))


def alert_rules(columns: list[str]) -> dict[str, Column]:
    c = F.col
    return {
        "no_extra_fields": F.lit(set(columns) <= set(ALERT_COLUMNS)), "threat_class": c("threat_class").isin(*CLASS_PARAMS),
        "confidence": c("confidence").between(0, 1) & ~F.isnan("confidence"), "risk_score": c("risk_score").between(0, 100),
        "severity": c("severity").isin(*SEVERITIES) & (c("severity") == severity(c("risk_score"))),
        "evidence": (F.size("evidence") > 0) & F.forall("evidence", lambda x: x != ""), "alert_id": c("alert_id") != "", "flow_id": c("flow_id") != "",
        "src_ip": c("src_ip") != "", "timestamp": parse_ts(c("timestamp")).isNotNull(), "event_time": parse_ts(c("event_time")).isNotNull(),
        "schema_version": c("schema_version") == SCHEMA_VERSION,
    }


def check_alert(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts in the strict form, and rejects with the rules that failed; missing columns fail theirs."""
    missing = [c for c in ALERT_COLUMNS if c not in alerts.columns]
    kinds = {"confidence": "double", "risk_score": "bigint", "evidence": "array<string>"}
    whole = alerts.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in missing})
    return split_by(whole, alert_rules(alerts.columns) | {"complete": F.lit(not missing)})


def check_incident(incidents: DataFrame, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Incidents with sound ranges, classes and an address, and rejects; ``carry`` as in ``ipv4_number``."""
    c = F.col
    return split_by(incidents, {
        "incident_id": c("incident_id") != "", "src_ip": ipv4_number(c("src_ip"), carry).isNotNull() | c("src_ip").rlike("^[0-9a-fA-F:]+:[0-9a-fA-F:.]*$"),
        "risk_score": c("risk_score").between(0, 100), "alert_count": c("alert_count") >= 1, "times": c("last_seen") >= c("first_seen"),
        "threat_classes": (F.size("threat_classes") > 0) & F.forall("threat_classes", lambda x: x.isin(*CLASS_PARAMS)),
        "severity": c("severity") == severity(c("risk_score")),
    })
