"""Golden vectors of the alert engine, checks and reports on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from tidewarden.dims import CLASS_PARAMS
from tidewarden.operators import alerts as A
from tidewarden.operators import checks, reports, sinks, windows
from tidewarden.params import DEFAULTS
from tidewarden.schemas import ALERT

DETECTION = "threat_class string, confidence double, evidence array<string>, flow_id string, src_ip string, dst_ip string, anomaly double, detector string, event_time double"


def dets(spark, rows):
    full = [(c, p, ["seen"], flow, src, dst, 0.5, "d", float(t)) for c, p, flow, src, dst, t in rows]
    return spark.createDataFrame(full, DETECTION)


def scored_rows(spark, rows):
    """Alerts with given risks: (class, risk, source, target, time)."""
    made = [(f"a{k}", c, r, src, dst, float(t), dst if c == "DDOS" else src) for k, (c, r, src, dst, t) in enumerate(rows)]
    return spark.createDataFrame(made, "alert_id string, threat_class string, risk_score long, src_ip string, dst_ip string, event_time double, entity string")


def run_incidents(spark, rows):
    out = windows.running_incident(windows.split_incidents(scored_rows(spark, rows)))
    return {r["alert_id"]: r for r in out.collect()}


def test_kill_chain_escalates(spark):
    chain = [("RECON_PORT_SCAN", 40, "h", None, 0), ("DGA_DNS_TUNNELING", 42, "h", None, 30), ("C2_BEACONING", 50, "h", None, 60), ("DATA_EXFILTRATION", 70, "h", None, 90)]
    got = run_incidents(spark, chain)
    assert [got[f"a{k}"]["incident_risk"] for k in range(4)] == [40, 65, 83, 95]
    assert len({r["incident_id"] for r in got.values()}) == 1 and got["a3"]["alert_count"] == 4
    assert got["a3"]["threat_classes"] == ["RECON_PORT_SCAN", "DGA_DNS_TUNNELING", "C2_BEACONING", "DATA_EXFILTRATION"]


def test_repeats_of_a_class_add_nothing(spark):
    got = run_incidents(spark, [("RECON_PORT_SCAN", 40, "h", None, 0), ("RECON_PORT_SCAN", 30, "h", None, 5)])
    assert (got["a1"]["incident_risk"], got["a1"]["alert_count"]) == (40, 2)


def test_three_stages_and_a_repeat(spark):
    rows = [("RECON_PORT_SCAN", 55, "h", None, 0), ("C2_BEACONING", 77, "h", None, 9), ("DATA_EXFILTRATION", 82, "h", None, 20), ("C2_BEACONING", 75, "h", None, 30)]
    got = run_incidents(spark, rows)
    assert [got[f"a{k}"]["incident_risk"] for k in range(4)] == [55, 90, 98, 98]
    assert got["a0"]["incident_severity"] == "MEDIUM" and got["a3"]["alert_count"] == 4


def test_hosts_and_gaps_separate_incidents(spark):
    got = run_incidents(spark, [("C2_BEACONING", 40, "h", None, 0), ("C2_BEACONING", 40, "g", None, 1), ("C2_BEACONING", 40, "h", None, 601)])
    assert len({r["incident_id"] for r in got.values()}) == 3
    got = run_incidents(spark, [("C2_BEACONING", 40, "h", None, 0), ("C2_BEACONING", 40, "h", None, 600)])
    assert len({r["incident_id"] for r in got.values()}) == 1


def test_floods_are_kept_by_victim(spark):
    got = run_incidents(spark, [("DDOS", 30, "s1", "v", 0), ("DDOS", 30, "s2", "v", 1), ("DDOS", 99, "s3", "w", 2)])
    assert got["a0"]["incident_id"] == got["a1"]["incident_id"] != got["a2"]["incident_id"]


def test_cooldown_keeps_one_of_fifty(spark):
    rows = [("RECON_PORT_SCAN", 0.9, f"f{k}", "h", "x", 100 + k * 0.1) for k in range(50)] + [("C2_BEACONING", 0.9, "b", "h", "x", 101)]
    assert A.score_alerts(dets(spark, rows)).count() == 2


def test_cooldown_of_floods_is_by_victim(spark):
    rows = [("DDOS", 0.9, f"f{k}", f"s{k}", "A", 100 + k * 0.1) for k in range(20)] + [("DDOS", 0.9, "z", "s1", "B", 101)]
    assert A.score_alerts(dets(spark, rows)).count() == 2


def test_kept_detections_are_a_cooldown_apart(spark):
    rows = [("RECON_PORT_SCAN", 0.9, f"f{k:03}", "h", "x", 7 * k) for k in range(60)]
    times = sorted(r[0] for r in A.score_alerts(dets(spark, rows)).select("event_time").collect())
    assert all(b - a >= 30 for a, b in zip(times, times[1:])) and times[:2] == [0.0, 35.0]


def test_recency_raises_risk(spark):
    rows = [("RECON_PORT_SCAN", 0.5, "a", "h", "x", 100), ("DGA_DNS_TUNNELING", 0.5, "b", "h", "x", 105)]
    got = {r["threat_class"]: r for r in A.score_alerts(dets(spark, rows)).collect()}
    alone = A.score_alerts(dets(spark, rows[1:])).first()
    assert got["DGA_DNS_TUNNELING"]["risk_score"] > alone["risk_score"]
    assert got["DGA_DNS_TUNNELING"]["recency"] == pytest.approx(1 - math.exp(-(2 ** (-5 / 120))))


def test_redelivery_is_one_alert(spark):
    row = ("RECON_PORT_SCAN", 0.5, "a", "h", "x", 100)
    twice, once = A.score_alerts(dets(spark, [row, row])).collect(), A.score_alerts(dets(spark, [row])).collect()
    assert twice == once and len(once) == 1


def test_noisy_or_per_alert(spark):
    alerts = scored_rows(spark, [("C2_BEACONING", r, "h", None, r) for r in (40, 42, 50, 70)])
    assert reports.noisy_or(alerts, ["entity"]).first()["combined"] == pytest.approx(0.9478, abs=1e-4)
    assert reports.noisy_or(alerts, ["entity"], per="class").first()["combined"] == pytest.approx(0.7)


def test_noisy_or_does_not_depend_on_order_and_grows(spark):
    risks = [10, 90, 35, 60]
    one = reports.noisy_or(scored_rows(spark, [("DDOS", r, "s", "v", k) for k, r in enumerate(risks)]), ["entity"]).first()[1]
    two = reports.noisy_or(scored_rows(spark, [("DDOS", r, "s", "v", k) for k, r in enumerate(sorted(risks))]), ["entity"]).first()[1]
    more = reports.noisy_or(scored_rows(spark, [("DDOS", r, "s", "v", k) for k, r in enumerate([*risks, 5])]), ["entity"]).first()[1]
    assert one == pytest.approx(two) and more > one


def test_nearest_rank(spark):
    row = reports.nearest_rank_percentiles(spark.range(1, 101), "id").first()
    assert (row["p50"], row["p95"], row["p99"], row["max"]) == (50, 95, 99, 100)
    assert reports.nearest_rank_percentiles(spark.range(0), "id").first()["p50"] == 0


EVENT = "event_flow_id string, event_src_ip string, event_dst_ip string, event_ts double"
RAW = "threat_class string, confidence string, evidence array<string>, flow_id string, src_ip string, dst_ip string, anomaly double, detector string, event_time double, " + EVENT


def raw(spark, threat_class="scan", confidence="1.7", evidence=("many ports",), **more):
    base = {"flow_id": None, "src_ip": None, "event_flow_id": "7", "event_src_ip": "10.0.0.1", "event_ts": 5.0} | more
    row = (threat_class, confidence, list(evidence), base["flow_id"], base["src_ip"], None, None, "d", None, base["event_flow_id"], base["event_src_ip"], None, base["event_ts"])
    return spark.createDataFrame([row], RAW)


def test_detection_is_completed(spark):
    good, bad = checks.check_detection(raw(spark))
    row = good.first()
    assert bad.count() == 0 and row["threat_class"] == "RECON_PORT_SCAN" and row["confidence"] == 1.0
    assert (row["flow_id"], row["src_ip"], row["event_time"]) == ("7", "10.0.0.1", 5.0) and row["anomaly"] == pytest.approx(0.69)


@pytest.mark.parametrize("spoil, rule", [({"evidence": ()}, "evidence"), ({"evidence": (" ",)}, "evidence"), ({"confidence": "NaN"}, "confidence"), ({"confidence": "high"}, "confidence"), ({"threat_class": "ransomware"}, "threat_class"), ({"event_flow_id": ""}, "flow_id"), ({"event_ts": float("nan")}, "event_time")])
def test_detection_rejects(spark, spoil, rule):
    good, bad = checks.check_detection(raw(spark, **spoil))
    assert good.count() == 0 and rule in bad.first()["failed"]


ALERT_ROW = {
    "alert_id": "a", "timestamp": "2026-01-01T00:00:00Z", "event_time": "2026-01-01T00:00:00Z", "flow_id": "f", "threat_class": "DDOS", "confidence": 0.5, "risk_score": 70,
    "severity": "HIGH", "evidence": ["x"], "incident_id": None, "src_ip": "1.2.3.4", "dst_ip": None, "detector": "d", "schema_version": "1.0",
}


def alert(spark, **changes):
    return spark.createDataFrame([tuple((ALERT_ROW | changes).values())], ALERT)


def test_alert_passes(spark):
    assert checks.check_alert(alert(spark))[0].count() == 1


@pytest.mark.parametrize("spoil", [{"risk_score": 150}, {"risk_score": -1}, {"severity": "LOW"}, {"severity": "URGENT"}, {"confidence": 1.5}, {"confidence": None}, {"threat_class": "ddos"}, {"evidence": []}, {"event_time": "soon"}, {"schema_version": "2"}, {"flow_id": ""}])
def test_alert_rejects(spark, spoil):
    assert checks.check_alert(alert(spark, **spoil))[1].count() == 1


def test_alert_with_extra_or_missing_field_is_rejected(spark):
    assert checks.check_alert(alert(spark).withColumn("extra", F.lit(1)))[1].first()["failed"] == ["no_extra_fields"]
    assert "complete" in checks.check_alert(alert(spark).drop("detector"))[1].first()["failed"]


def test_incident_checks(spark):
    schema = "incident_id string, src_ip string, first_seen double, last_seen double, alert_count bigint, threat_classes array<string>, risk_score bigint, severity string, status string"
    good = ("i", "fe80::1", 0.0, 1.0, 1, ["DDOS"], 70, "HIGH", "OPEN")
    rows = [good, ("i", "host", *good[2:]), ("i", "1.2.3.4", 2.0, *good[3:]), (*good[:5], [], *good[6:])]
    ok, bad = checks.check_incident(spark.createDataFrame(rows, schema))
    assert ok.count() == 1 and bad.count() == 3


def test_quarantine_replays_alerts_and_incidents(spark):
    parked = spark.createDataFrame([("alert", '{"alert_id":"a"}', "e", 0.0), ("incident", '{"incident_id":"i"}', "e", 0.0), ("event", "{}", "e", 0.0), ("alert", "broken", "e", 0.0)], "kind string, payload string, error string, quarantined_at double")
    alerts, incidents, rest = sinks.replay_quarantine(parked, "alert_id string", "incident_id string")
    assert (alerts.count(), incidents.count(), rest.count()) == (1, 1, 2)


def test_appending_twice_changes_nothing(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").cast("string").alias("alert_id"))
    for _ in range(2):
        sinks.append_alerts(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_upsert_takes_the_new_row(spark, tmp_path):
    schema = "incident_id string, last_seen double, alert_count long"
    sinks.upsert_incidents(spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], schema), str(tmp_path))
    path = sinks.upsert_incidents(spark.createDataFrame([("a", 2.0, 5)], schema), str(tmp_path))
    assert {r["incident_id"]: r["alert_count"] for r in spark.read.parquet(path).collect()} == {"a": 5, "b": 1}


def test_empty_session_is_not_archived(spark, tmp_path):
    empty = scored_rows(spark, [("DDOS", 1, "s", "v", 0)]).limit(0)
    assert sinks.archive_session(empty, empty, "s", str(tmp_path)) is None


def test_best_detection_prefers_confidence_then_specificity(spark):
    rows = [("RECON_PORT_SCAN", 0.9, "f", "h", "x", 0), ("DGA_DNS_TUNNELING", 0.9, "f", "h", "x", 0), ("DDOS", 0.8, "f", "h", "x", 0)]
    assert windows.best_detection(dets(spark, rows)).first()["threat_class"] == "DGA_DNS_TUNNELING"


def test_report_of_an_absent_class_is_zero(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a")], "l string, p string")
    got = {r["class"]: r for r in reports.classification_report(rows, "l", "p").collect()}
    assert got["b"]["precision"] == got["b"]["f1"] == 0 and got["accuracy"]["precision"] == 0.5
    assert reports.roc_auc(rows.select(F.lit(1.0).alias("s"), F.lit(1).alias("y")), "s", "y").first()["auc"] == 0


def test_defaults_are_as_documented():
    assert (DEFAULTS.cooldown_s, DEFAULTS.incident_gap_s, DEFAULTS.scan_ports) == (30, 600, 20) and len(CLASS_PARAMS) == 6


def test_addresses_meet_networks_of_any_size(spark):
    import ipaddress

    from tidewarden.dims import networks
    from tidewarden.operators.joins import cidr_join

    cidrs = ("0.0.0.0/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32", "192.168.50.0/24", "128.0.0.0/1")
    ips = ["10.1.2.3", "10.1.2.4", "10.9.9.9", "192.168.50.255", "192.168.51.0", "255.255.255.255", "host", None]
    got = {(r["src_ip"], r["cidr"]) for r in cidr_join(spark.createDataFrame([(x,) for x in ips], "src_ip string"), networks(spark, cidrs)).collect()}
    assert got == {(x, c) for x in ips[:6] for c in cidrs if ipaddress.ip_address(x) in ipaddress.ip_network(c)}
    assert cidr_join(spark.createDataFrame([("10.1.2.3",)], "src_ip string"), networks(spark, cidrs).limit(0)).count() == 0


def test_every_earlier_alert_within_the_window_is_a_pair(spark):
    """More than the three nearest: each pair is a row, over bucket edges, with ties by alert id."""
    from tidewarden import plans
    from tidewarden.operators.joins import prior_pairs

    times = {"a": 0.0, "b": 5.0, "c": 9.5, "d": 10.0, "e": 10.0, "f": 15.0, "g": 20.1}
    rows = spark.createDataFrame([*((i, "h", t) for i, t in times.items()), ("x", "other", 9.0), ("y", None, 9.0), ("z", None, 9.0)], "alert_id string, entity string, event_time double")
    want = {(x, y) for x in times for y in times if (times[y], y) < (times[x], x) and times[y] >= times[x] - 10}
    got = [(r["alert_id"], r["prior_id"]) for r in prior_pairs(rows, 10.0).collect()]
    assert len(got) == len(want) and set(got) == want and sum(x == "f" for x, _ in got) == 4
    assert "prior_id" in plans.ORACLES["j5_prior_alerts"]
