"""Schemas of sensor records, events, detections, alerts, incidents and sessions."""

from __future__ import annotations

EVE = """
timestamp string, flow_id bigint, in_iface string, event_type string, src_ip string, src_port int, dest_ip string, dest_port int,
ip_v int, proto string, app_proto string, icmp_type int, icmp_code int,
flow struct<pkts_toserver: bigint, pkts_toclient: bigint, bytes_toserver: bigint, bytes_toclient: bigint, `start`: string, `end`: string,
  age: bigint, state: string, reason: string, alerted: boolean, tx_cnt: int>,
tcp struct<tcp_flags: string, tcp_flags_ts: string, tcp_flags_tc: string, syn: boolean, psh: boolean, ack: boolean, state: string>,
tls struct<ja3: struct<hash: string>>, ja3 string, ja3_hash string,
dns struct<rrname: string, rrtype: string, queries: array<struct<rrname: string, rrtype: string>>>
"""

ZEEK = """
ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, `id.resp_p` int, proto string, service string,
orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, duration double, conn_state string, query string, qtype_name string
"""

EVENT_COLUMNS = (
    "source", "log_type", "event_type", "ts", "flow_id", "uid", "src_ip", "src_port", "dst_ip", "dst_port", "proto", "app_proto",
    "bytes_out", "bytes_in", "pkts_toserver", "pkts_toclient", "duration", "conn_state", "dns_query", "dns_qtype", "ja3",
)

ENVELOPE = """
ts string, flow_id string, src_ip string, event_type string, dst_ip string, src_port int, dst_port int, proto string, app_proto string,
bytes_out double, bytes_in double, pkts_toserver double, pkts_toclient double, duration double, conn_state string, dns_query string, ja3 string
"""

DETECTION_COLUMNS = ("threat_class", "confidence", "evidence", "flow_id", "src_ip", "dst_ip", "anomaly", "detector", "event_time")

ALERT = """
alert_id string, timestamp string, event_time string, flow_id string, threat_class string, confidence double, risk_score bigint,
severity string, evidence array<string>, incident_id string, src_ip string, dst_ip string, detector string, schema_version string
"""
ALERT_COLUMNS = tuple(c.split()[0] for c in ALERT.replace("\n", " ").split(","))
SCHEMA_VERSION = "1.0"

INCIDENT = """
incident_id string, src_ip string, first_seen double, last_seen double, alert_count bigint, threat_classes array<string>,
risk_score bigint, severity string, status string
"""
