"""Normalizing sensor records into events, routing them, and per-flow kinetics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_ts
from ..schemas import EVENT_COLUMNS


def _flow_id(own: Column, src: str, src_port: str, dst: str, dst_port: str) -> Column:
    ends = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in (src, src_port, dst, dst_port)]
    return F.coalesce(own.cast("string"), F.concat(ends[0], F.lit(":"), ends[1], F.lit("-"), ends[2], F.lit(":"), ends[3]))


def normalize_eve(raw: DataFrame) -> DataFrame:
    """Nested records to events; DNS names from the record or its first query, fingerprints from three places."""
    first = F.get("dns.queries", F.lit(0))
    named = F.nullif(F.col("dns.rrname"), F.lit(""))
    return raw.select(
        F.lit("suricata").alias("source"), F.col("event_type").alias("log_type"), "event_type", parse_ts(F.col("timestamp")).alias("ts"),
        _flow_id(F.col("flow_id"), "src_ip", "src_port", "dest_ip", "dest_port").alias("flow_id"), F.col("flow_id").cast("string").alias("uid"),
        "src_ip", "src_port", F.col("dest_ip").alias("dst_ip"), F.col("dest_port").alias("dst_port"), "proto", "app_proto",
        F.col("flow.bytes_toserver").alias("bytes_out"), F.col("flow.bytes_toclient").alias("bytes_in"),
        F.col("flow.pkts_toserver").alias("pkts_toserver"), F.col("flow.pkts_toclient").alias("pkts_toclient"),
        F.col("flow.age").cast("double").alias("duration"), F.col("flow.state").alias("conn_state"),
        F.coalesce(named, first["rrname"]).alias("dns_query"), F.when(named.isNotNull(), F.col("dns.rrtype")).otherwise(first["rrtype"]).alias("dns_qtype"),
        F.coalesce(F.nullif(F.col("tls.ja3.hash"), F.lit("")), F.nullif("ja3", F.lit("")), "ja3_hash").alias("ja3"),
    )


def normalize_zeek(raw: DataFrame) -> DataFrame:
    """Flat records, with ``log_type``, to events; this sensor has no fingerprints."""
    return raw.select(
        F.lit("zeek").alias("source"), "log_type", F.col("log_type").alias("event_type"), "ts",
        _flow_id(F.nullif("uid", F.lit("")), "`id.orig_h`", "`id.orig_p`", "`id.resp_h`", "`id.resp_p`").alias("flow_id"), "uid",
        F.col("`id.orig_h`").alias("src_ip"), F.col("`id.orig_p`").alias("src_port"), F.col("`id.resp_h`").alias("dst_ip"),
        F.col("`id.resp_p`").alias("dst_port"), "proto", F.col("service").alias("app_proto"), F.col("orig_bytes").alias("bytes_out"),
        F.col("resp_bytes").alias("bytes_in"), F.col("orig_pkts").alias("pkts_toserver"), F.col("resp_pkts").alias("pkts_toclient"),
        "duration", "conn_state", F.col("query").alias("dns_query"), F.col("qtype_name").alias("dns_qtype"), F.lit(None).cast("string").alias("ja3"),
    )


def union_sensors(*events: DataFrame) -> DataFrame:
    """One event table of several sensors' events."""
    out = events[0]
    for other in events[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.select(*[c for c in EVENT_COLUMNS if c in out.columns], *[c for c in out.columns if c not in EVENT_COLUMNS])


ALIASES = (("dst_ip", "dest_ip"), ("dst_port", "dest_port"), ("conn_state", "flow_state"), ("ja3", "ja3_hash"))


def unify_aliases(events: DataFrame) -> DataFrame:
    """Both names of each aliased column, filled from whichever is there."""
    new = {}
    for pair in ALIASES:
        there = [c for c in pair if c in events.columns]
        for name, order in ((pair[0], pair), (pair[1], pair[::-1])):
            if there:
                new[name] = F.coalesce(*[F.col(c) for c in order if c in events.columns])
    return events.withColumns(new)


def is_connection(log_type: Column) -> Column:
    """Only rows of these types are connections, so that each counts once."""
    return F.coalesce(log_type.isin("conn", "flow"), F.lit(False))


def is_dns(query: Column, log_type: Column) -> Column:
    return (F.coalesce(query, F.lit("")) != "") | F.coalesce(log_type == "dns", F.lit(False))


def is_tls(ja3: Column, app_proto: Column, log_type: Column) -> Column:
    return (F.coalesce(ja3, F.lit("")) != "") | F.coalesce(app_proto == "tls", F.lit(False)) | F.coalesce(log_type == "ssl", F.lit(False))


def flow_kinetics(events: DataFrame, out: str = "bytes_out", into: str = "bytes_in", pkts_out: str = "pkts_out", pkts_in: str = "pkts_in") -> DataFrame:
    """Totals, ratio and rates of each flow; a missing or zero duration counts as a millisecond."""
    zero = F.lit(0.0)
    b_out, b_in, p_out, p_in = (F.coalesce(F.col(c).cast("double"), zero) for c in (out, into, pkts_out, pkts_in))
    seconds = F.coalesce(F.nullif(F.col("duration"), F.lit(0.0)), F.lit(0.001))
    return events.withColumns({
        "total_bytes": b_out + b_in, "total_packets": p_out + p_in, "upload_download_ratio": b_out / F.greatest(F.lit(1.0), b_in),
        "byte_rate": (b_out + b_in) / F.greatest(F.lit(0.001), seconds), "packet_rate": (p_out + p_in) / F.greatest(F.lit(0.001), seconds),
        "average_packet_size": (b_out + b_in) / F.greatest(F.lit(1.0), p_out + p_in), "flow_duration": seconds,
    })
